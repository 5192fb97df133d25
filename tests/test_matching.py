"""The matches that workers find against a small corpus, held against the join and against plain definitions."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from marginalia.config import AuditConfig
from marginalia.functions import text as X
from marginalia.operators.index import CorpusIndex
from marginalia.operators.overlap import match_evidence, with_overlap
from marginalia.operators.rhetoric import style, token_features
from marginalia.plans import queries as Q

FIELDS = ("rank", "corpus_idx", "source_path", "source_label", "matched_text", "vector", "lexical", "rare", "phrases")


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return Q.benchmark_corpus(spark, sf).persist()


def found(rows, index):
    got = match_evidence(rows, "key", index, AuditConfig()).select("key", *FIELDS).collect()
    return sorted((r.key, r.rank, r.corpus_idx, r.source_path, r.source_label, r.matched_text, round(r.vector, 9), round(r.lexical, 9), round(r.rare, 9), tuple(r.phrases)) for r in got)


def test_workers_find_what_the_join_finds(spark, sf, corpus):
    """Also of odd texts: none of their words in the corpus, repeats, apostrophes, capitals, no words, empty, null."""
    some = [r.text for r in corpus.limit(5).collect()]
    odd = ["zzz yyy xxx", "the " * 300, "It's the model's 'result' and it's the model's", some[0].upper(), "İstanbul the K ſ", "- — -", "", None, f"{some[1]} {some[2]}", *some]
    texts = [r.text for r in Q.document_sentences(spark, sf).select("text").distinct().orderBy("text").limit(300).collect()]
    rows = spark.createDataFrame(list(enumerate(odd + texts)), "key int, text string").repartition(3)
    index, other = CorpusIndex(corpus), CorpusIndex(corpus)
    other.small = False
    assert index.small and found(rows, index) == found(rows, other)
    overlap = lambda i: {r.key: (round(r.overlap, 9), round(r.vector, 9), len(r.matches)) for r in with_overlap(rows.where("text is not null"), i).collect()}
    assert overlap(index) == overlap(other)
    top = lambda i: sorted((r.key, r.rank, r.corpus_idx, round(r.cosine, 9)) for r in i.top_matches(rows.where("text is not null"), "key").collect())
    assert top(index) == top(other)


def test_equal_corpus_sentences_tie_to_the_smaller(spark):
    text = "Seven unequal words weigh one corpus sentence, and their sum is rounded."
    corpus = spark.createDataFrame([(i, f"p{i}", str(i), text if i % 2 else f"Words of sentence {i} that differ.") for i in range(20)], "corpus_idx long, source_path string, source_label string, text string")
    rows = spark.createDataFrame([(0, f"{text} More unequal words weigh {w}.") for w in "abcdefgh"], "key int, text string")
    assert {tuple(m.corpus_idx for m in r.matches) for r in with_overlap(rows, CorpusIndex(corpus)).collect()} == {(1, 3, 5)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["top_matches", "sentence_audit"])
def test_matching_moves_no_sentences(spark, sf, name):
    """Documents are dealt once; no products of features are shuffled, and texts are matched in one place of the plan."""
    got = plan(Q.QUERIES[name](spark, sf))
    assert got.count("Exchange") == 1 and got.count("ArrowEvalPython") == 1, got


def test_long_blocks_do_not_change_the_matches(spark, corpus, monkeypatch):
    """Blocks of one sentence and of many give the same sums."""
    from marginalia.operators import matching

    rows = sorted(map(tuple, corpus.select("corpus_idx", "source_path", "source_label", "text", F.lower("text")).collect()))
    texts = [r[4] for r in rows] + ["", "nothing of it"]
    once = matching.Matcher(rows, AuditConfig()).matches(texts, FIELDS[1:])
    monkeypatch.setattr(matching, "_CELLS", 1)
    assert matching.Matcher(rows, AuditConfig()).matches(texts, FIELDS[1:]) == once


def test_review_documents_keeps_no_facts(spark, sf):
    """Cards need neither matches nor a persisted fact table; only the small corpus index stays."""
    got = plan(Q.review_documents(spark, sf))
    assert "ArrowEvalPython" not in got and "InMemoryTableScan" not in got, got


def test_score_by_quality_moves_no_features(spark, sf):
    got = plan(Q.score_by_quality(spark, sf))
    assert got.count("ArrowEvalPython") == 1 and "corpus_idx" not in "".join(line for line in got.splitlines() if "Exchange" in line), got


def test_workspace_searches_the_sentence_alone(spark, tmp_path):
    """A turn's other sentences are not looked in."""
    shared = "Seven unequal words weigh one corpus sentence in its turn"
    spark.createDataFrame([(1, 0, "user", f"{shared}. Furthermore the other one is here, undoubtedly.")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(1, f"{shared}.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [r.sentence_id for r in Q.workspace_filter(spark, str(tmp_path)).collect() if r.sentence_id.endswith("sent_001")] == []


def test_texts_are_split_once(spark, sf):
    """No filter above the documents splits them a second time, and nobody searches places that are not asked for."""
    got = Q.document_sentences(spark, sf).select("doc_id", "ord", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert got.count("regexp_replace(trim(") == 1 and "aggregate(" not in got, got


def test_more_words_than_ids(monkeypatch):
    """A sentence of more different words than ids fit into a feature's number, and blocks cut by their words."""
    from marginalia.operators import matching

    corpus = [(i, "p", "l", f"alpha beta gamma delta {w}", f"alpha beta gamma delta {w}") for i, w in enumerate("one two three".split())]
    texts = ["alpha beta gamma two " + " ".join(f"w{k}" for k in range(5000)) + " beta gamma", "gamma delta two w7 w8 w7 w8", "w1 w2 w3 one"]
    once = matching.Matcher(corpus, AuditConfig()).matches(texts, FIELDS[1:])
    monkeypatch.setattr(matching, "_BITS", 4)
    monkeypatch.setattr(matching, "_WORDS", 5)
    again = matching.Matcher(corpus, AuditConfig()).matches(texts, FIELDS[1:])
    assert again.pop("vector") == pytest.approx(once.pop("vector"), rel=1e-12) and again == once


def test_fewer_matches_than_asked_for():
    """The first corpus sentence does not come again where there are no others."""
    from marginalia.operators.matching import Matcher

    corpus = [(i, "p", "l", w, w) for i, w in enumerate(["alpha beta", "gamma", "delta", "epsilon"])]
    got = Matcher(corpus, AuditConfig()).matches(["alpha", "gamma alpha", "zeta"], ("corpus_idx",))
    assert got["n"] == [1, 2, 0] and got["corpus_idx"][0] == 0 and sorted(got["corpus_idx"][1:]) == [0, 1]


def test_score_by_quality_audits_labelled_documents_once(spark, sf):
    """Documents that no label names are not audited, a row a document meets the labels, and only scores of matches move."""
    got = plan(Q.score_by_quality(spark, sf))
    assert "LeftSemi" in got and "distinct doc_id" not in got and "matched_text" not in got, got


def test_score_by_quality_on_odd_labels(spark, tmp_path):
    """No label, two qualities, the same label twice, no quality, rows that share a doc_id, no text, no id."""
    one, two = "Moreover, the robust framework plays a crucial role (as we said). It is 'plain' here; two commas, and so on, it goes.", "Another sentence of the benchmark that some of the documents share, as it is."
    docs = [(1, one), (2, f"{two} {one}"), (3, two), (4, one), (4, two), (5, None), (6, one), (None, one), (7, "short")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 1), (2, 0), (3, 1), (3, 1), (4, 0), (5, 1), (6, None), (None, 1), (7, 1), (9, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, two), (2, f"{one} It has nothing else of note in it.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, Q.score_by_quality(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(Q.SQL["score_by_quality"]).fetchall()
    assert got == sorted(want, key=str) and [r[:3] for r in got] == [(0, 2, 6), (1, 2, 4), (None, 1, 2)]


def test_figures_of_words_are_those_of_token_lists(spark):
    """Listed words are counted as tokens, not as parts of tokens; the neighbours' sums hold with none to four of them."""
    texts = ["The the-a is's 'a a' IT_and it.The novel NOVEL novels x-novel demonstrates", "", "İt is ſo, (it: is); a, b", "ΑΒΣ of\nthe\tto", "was"] * 2 + [None]
    rows = spark.createDataFrame([(d, k, t) for d, n in enumerate((1, 2, 3, 11)) for k, t in enumerate(texts[:n])], "doc_id int, ord int, text string")
    tok = X.tokens(F.col("text"))
    plain = {"content_ratio": X.content_ratio(tok), "abstract_ratio": X.abstract_ratio(tok), "entropy": X.punctuation_entropy(F.col("text")), "low_specificity": X.low_specificity(tok), "thinness": X.thinness(tok)}
    got = style(token_features(rows)).select("*", *[c.alias(f"{n}_plain") for n, c in plain.items()]).orderBy("doc_id", "ord").collect()
    for r in got:
        assert [r[n] for n in plain] == [r[f"{n}_plain"] for n in plain], r.text
        near = [q for q in got if q.doc_id == r.doc_id and 0 < abs(q.ord - r.ord) <= 2]
        gaps = [r[c] - sum(q[c] for q in near) / len(near) for c in ("length", "content_ratio", "entropy")] if near and r.entropy is not None and all(q.entropy is not None for q in near) else []
        if gaps:
            assert r.style_shift == pytest.approx(min(1, math.sqrt(sum(g * g for g in gaps)) / 18), abs=1e-12)
        lengths = [q.length for q in (*near, r)]
        mean = sum(lengths) / len(lengths)
        assert r.smoothness == pytest.approx(max(0, 1 - sum((n - mean) ** 2 for n in lengths) / len(lengths) / 40) if near else 0, abs=1e-12)


def test_words_are_forgotten_in_time(monkeypatch):
    """Ids of words that the corpus lacks are kept between blocks, up to a limit; matches are the same."""
    from marginalia.operators import matching

    corpus = [(i, "p", "l", f"alpha beta gamma delta {w}", f"alpha beta gamma delta {w}") for i, w in enumerate("one two three".split())]
    texts = [f"alpha w{k} beta gamma delta w{k + 1} {w}" for k in range(40) for w in ("one", "it's")]
    once = matching.Matcher(corpus, AuditConfig()).matches(texts, FIELDS[1:])
    monkeypatch.setattr(matching, "_CELLS", 1)
    monkeypatch.setattr(matching, "_KEPT", 5)
    few = matching.Matcher(corpus, AuditConfig())
    again = few.matches(texts, FIELDS[1:])
    assert len(few.words) < 12 and len(few.words.long) == len(few.words) + 1
    assert again.pop("vector") == pytest.approx(once.pop("vector"), rel=1e-12) and again == once
