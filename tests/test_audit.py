import json

import pytest
from pyspark.sql import functions as F

from marginalia.config import AuditConfig
from marginalia.operators import review, rollups
from marginalia.operators.index import CorpusIndex
from marginalia.operators.overlap import overlap_scores
from marginalia.operators.rhetoric import rhetoric_scores
from marginalia.plans.audit import audit_projects, audit_sentences
from marginalia.sources import sinks
from marginalia.sources.corpus import corpus_sentences
from marginalia.streaming.watch import watch_folder

MAIN = "\\documentclass{article}\n\\begin{document}\n\\section{Opening}\n\\input{one}\n\n\\section{Methods}\nWe use vector similarity against candidate source passages to rank local matches. It is important to note that a robust framework plays a crucial role here.\n\nUndoubtedly this proves that our novel paradigm is highly effective in all of the cases.\n\\end{document}"
ONE = "A plain first sentence without any tells at all. Another plain sentence follows, with commas, and more."
CORPUS = [("a.txt", "a", "We use vector similarity against candidate source passages to rank local matches. An unrelated sentence about cooking rice."), ("b.txt", "b", "Nothing in common whatsoever here today.")]


@pytest.fixture(scope="module")
def audit(spark):
    files = spark.createDataFrame([("p", "main.tex", MAIN), ("p", "one.tex", ONE)], "doc_id string, path string, text string")
    return audit_projects(files, spark.createDataFrame(CORPUS, "source_path string, source_label string, text string"))


def test_end_to_end(spark, audit, tmp_path):
    rows = {r.sentence_id: r for r in audit.review_rows.collect()}
    assert sorted(rows) == ["methods.par_002.sent_001", "methods.par_002.sent_002", "methods.par_003.sent_001", "opening.par_001.sent_001", "opening.par_001.sent_002"]
    copied = rows["methods.par_002.sent_001"]
    assert copied.vector == pytest.approx(1) and copied.lexical == 1 and copied.rare == pytest.approx(0.5 * (1 - 1 / 3) + 0.5)
    assert copied.matches[0].source_label == "a" and copied.is_flagged and copied.overlap_band == "high"
    assert copied.matches[0].phrases[0] == "against candidate source passages to" or len(copied.matches[0].phrases) == 5
    assert rows["methods.par_002.sent_002"].categories == ["empty_transition", "framework_boilerplate"]
    assert rows["methods.par_003.sent_001"].categories == ["unsupported_confidence"]
    assert rows["opening.par_001.sent_001"].phrases == [] and rows["opening.par_001.sent_001"].source_file == "one.tex"
    assert (rows["opening.par_001.sent_001"].line_start, rows["opening.par_001.sent_001"].line_end) == (2, 4)
    assert all(0 <= r.overlap <= 1 and 0 <= r.rhetoric <= 1 for r in rows.values())
    summary = audit.summary().first()
    assert summary.sentence_count == 5 and summary.category_totals["unsupported_confidence"] == 1 and len(summary.top_overlap_sentences) == 5
    assert [s.label for s in audit.outline().orderBy("position").collect()] == ["Opening", "Methods"]
    assert audit.metrics().first().section_count == 2
    sinks.write_csv(audit.facts, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.count() == 5 and "finding_summary" in back.columns
    sinks.write_json(audit.facts, audit.summary(), str(tmp_path / "json"))
    assert len(json.loads(spark.read.text(str(tmp_path / "json")).first()[0])["sentences"]) == 5
    page = sinks.html_page(audit.review_rows, "p", "A <title>")
    assert "A &lt;title&gt;" in page and page.count("</script>") == 1


def test_minimum_tokens(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    corpus = corpus_sentences(spark.createDataFrame([("s", "s", text)], "source_path string, source_label string, text string"))
    config = AuditConfig(min_tokens_for_overlap=11, phrase_ngrams=(5, 5))
    index = CorpusIndex(corpus, config.phrase_ngrams, config.min_tokens_for_overlap)
    row = overlap_scores(spark.createDataFrame([(1, text)], "key int, text string"), "key", index, config).first()
    assert row.lexical == 0 and row.rare == 0 and row.matches and row.overlap < 0.5


def test_no_corpus_and_no_match(spark):
    rows = spark.createDataFrame([("d", 0, "Completely different words stand here alone.")], "doc_id string, ord int, text string")
    assert audit_sentences(rows, None).first().overlap == 0
    corpus = corpus_sentences(spark.createDataFrame([("s", "s", "xx yy zz xx yy zz xx yy zz xx")], "source_path string, source_label string, text string"))
    row = audit_sentences(rows, CorpusIndex(corpus)).first()
    assert (row.overlap, row.matches) == (0, [])
    empty = CorpusIndex(corpus.where("false"))
    assert audit_sentences(rows, empty).first().matches == []


def test_rhetoric_without_neighbours(spark):
    rows = spark.createDataFrame([("d", 0, "It is evident that this clearly demonstrates the point."), ("e", 0, "")], "doc_id string, ord int, text string")
    got = {r.doc_id: r for r in rhetoric_scores(rows).collect()}
    assert got["d"].unsupported_confidence == 1 and got["d"].style_shift == 0 and got["d"].smoothness == 0
    assert got["d"].finding_summary == "unsupported_confidence=1.00|low_specificity=0.30"
    assert got["e"].thinness == 0 and got["e"].finding_summary == ""


def spans_of(spark, rows):
    schema = "doc_id int, paragraph_id string, paragraph_index int, section string, line_start int, line_end int, combined_risk double, has_match boolean"
    df = spark.createDataFrame(rows, schema).withColumns({"overlap_risk": F.col("combined_risk"), "rhetoric_risk": F.lit(0.0), "has_trigger": F.lit(False), "is_flagged": F.col("combined_risk") >= 0.6, "sentence_ids": F.array("paragraph_id")})
    return review.suspicious_spans(df).orderBy("doc_id", "position").collect()


def test_spans_break_at_gaps_sections_and_calm_paragraphs(spark):
    risks = {1: ("A", 0.5), 2: ("A", 0.9), 4: ("A", 0.5), 5: ("B", 0.5), 6: ("B", 0.1), 7: ("B", 0.46)}
    got = spans_of(spark, [(1, f"p{k}", k, s, k * 2, k * 2 + 1, r, False) for k, (s, r) in risks.items()])
    assert [(s.start_paragraph, s.end_paragraph, s.flagged_count, s.span_id) for s in got] == [(1, 2, 1, "span-1-2-2"), (4, 4, 0, "span-4-4-8"), (5, 5, 0, "span-5-5-10"), (7, 7, 0, "span-7-7-14")]


def test_spans_are_limited_by_document(spark):
    got = spans_of(spark, [(d, f"p{k}", k, "A", 1, 1, 0.5, True) for d in (1, 2) for k in range(1, 80, 2)])
    assert len(got) == 48 and {s.position for s in got} == set(range(1, 25))


def test_documents_without_sentences_stay_in_the_summary(spark, audit):
    docs = spark.createDataFrame([("p",), ("empty",)], "doc_id string")
    row = rollups.document_summary(audit.facts, docs).where("doc_id = 'empty'").first()
    assert (row.sentence_count, row.mean_overlap, row.category_totals, row.top_findings) == (0, 0.0, {}, [])


def test_workspace_defaults_need_both_scores(audit):
    assert review.workspace(audit.review_rows).count() == 0
    assert review.workspace(audit.review_rows, rhetoric=0).count() == 1
    best = review.workspace(audit.review_rows, overlap=0, rhetoric=0, sort="overlap").first()
    assert best.sentence_id == "methods.par_002.sent_001"


def test_partitioning_changes_nothing(spark, audit):
    once = sorted(map(str, audit.facts.select("sentence_id", "overlap", "rhetoric").collect()))
    rows = audit.rows.repartition(7)
    assert sorted(map(str, audit_sentences(rows, audit.index).select("sentence_id", "overlap", "rhetoric").collect())) == once


def test_watch_folder(spark, tmp_path):
    spark.createDataFrame([("x", "This is a manuscript sentence that is long enough. And here is one more of them.")], "doc_id string, text string").write.parquet(str(tmp_path / "in"))
    run = watch_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    run.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
