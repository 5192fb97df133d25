"""Quality, pieces, pseudo-likelihood, language and the pipeline."""

import collections
import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import catalog
from marginalia.llm import language as L
from marginalia.llm import pieces as P
from marginalia.llm import pseudo_lm as M
from marginalia.llm import quality as Q
from marginalia.llm.words import words as words_of


def test_line_figures_by_hand():
    x, of, length = Q.line_figures(pa.array(["Ab 1!\n\nAb 1!", "", None, "zz zz %%\n"], pa.string()))
    assert of.tolist() == [0, 3, 4, 5, 7] and length.tolist() == [6, 1, 6, 1, 1, 9, 1]
    col = Q.FIGURES.index
    assert x[0, col("letters")] == pytest.approx(2 / 5) and x[0, col("upper")] == pytest.approx(1 / 5) and x[0, col("digits")] == pytest.approx(1 / 5)
    assert x[[0, 1, 2], col("line_again")].tolist() == [1, 0, 1]
    assert x[5, col("same_word")] == pytest.approx(1 / 2) and x[5, col("symbols")] == pytest.approx(2 / 8) and x[5, col("longest_word")] == 2
    assert x[:, col("first_or_last")].tolist() == [1, 0, 2, 3, 3, 1, 2]


def test_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    chain = Q.Chain(np.zeros((1, Q.BINS - 1)))
    chain.stay = np.array([0.7, -0.4])
    of = np.array([0, 1, 5, 8])
    odds = rng.normal(size=8)
    good, z, kept = chain.marginals(odds, of)
    for s, e in itertools.pairwise(of):
        paths = list(itertools.product((0, 1), repeat=e - s))
        score = [sum(odds[s + k] for k in range(e - s) if p[k]) + sum(chain.stay[p[k]] for k in range(e - s - 1) if p[k] == p[k + 1]) for p in paths]
        w = np.exp(score)
        assert z[np.searchsorted(of, s)] == pytest.approx(np.log(w.sum()))
        assert good[s:e] == pytest.approx(np.array(paths).T @ w / w.sum())
        both = sum(w[i] * sum(p[k] == p[k + 1] == 1 for k in range(e - s - 1)) for i, p in enumerate(paths)) / w.sum()
        assert kept[s:e, 1].sum() == pytest.approx(both)


def test_quality_on_held_out_rows(spark, sf):
    small = sf.replace("sf0.001", "sf0.01")
    got = catalog.QUERIES["op5_quality_classifier"](spark, small)
    assert got.count() == spark.read.parquet(f"{small}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    assert ((rows.score >= 0) & (rows.score <= 1)).all() and ((rows.score >= 0.3) == (rows.predicted == 1)).all()
    assert (rows.predicted == rows.quality).mean() > 0.9 and rows[rows.quality == 1].score.mean() > rows[rows.quality == 0].score.mean() + 0.3


def test_quality_without_labels_and_odd_texts(spark):
    docs = spark.createDataFrame([(1, "a line\nanother"), (2, ""), (3, None), (3, None), (None, "\n\n\n"), (4, "long " * 50_000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    chain = Q.fit_chain(docs, spark.createDataFrame([(1, None)], "doc_id long, quality int"))
    assert [r.score for r in Q.score_documents(Q.pack(docs), chain).collect()] == [0.5] * 6
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (9, 1)], "doc_id long, quality int")
    kept = Q.keep_good(docs, Q.fit_chain(docs, labels), threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == 6
    assert Q.score_documents(Q.pack(docs.where("false")), chain).collect() == []


ODD = ["", "a", " ", "   hello   world  ", "\n\n", "a▁b", "日本語 é́ \U0001f600", "def f(x):\n    return x\n\t\ty", "<s> </s> <unk> <0x0A>", "aaaa" * 50, "====----____", "U.S.A. 3.14159 (e.g.)", "x\x00y"]


def test_pieces_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.MODEL))
    random.seed(0)
    texts = ODD + ["".join(random.choice(" abeirnstT.,\n-_=é日▁") for _ in range(random.randint(1, 60))) for _ in range(300)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(-1, None, "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in P.encode(df).collect()}
    assert [got[k].ids for k in range(len(texts))] == [library.encode(t) for t in texts]
    assert all(got[k].n_tokens == len(got[k].ids) and got[k].exact == ("▁" not in t) for k, t in enumerate(texts))
    assert got[-1].ids == []
    back = {r.doc_id: r.text for r in P.decode(P.encode(df)).collect()}
    assert [back[k] for k in range(len(texts))] == [t.replace("▁", " ") for t in texts]
    assert P.encode(df.where("false")).collect() == []


def test_viterbi_is_the_best_of_all_segmentations():
    random.seed(2)
    vocab = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca", "aa"]
    model = P.Pieces.of([("<unk>", 0.0, 2), *[(p, -random.random() * 4, 1) for p in vocab]], bpe=False)
    for _ in range(60):
        unit = "▁" + "".join(random.choice("abcx") for _ in range(random.randint(0, 7)))

        def best(t):
            if not t:
                return 0.0
            known = [model.score[i] + best(t[len(p) :]) for p, i in model.ids.items() if t.startswith(p)]
            return max(known + ([model.lowest + best(t[1:])] if t[0] not in model.ids else []))

        ids = model.encode_unit(unit)
        assert sum(model.score[i] if i else model.lowest for i in ids) == pytest.approx(best(unit))


def test_pseudo_likelihood(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "..."), (-4, "one"), (-4, "one")], "doc_id long, text string")
    both = docs.unionByName(odd).withColumn("n_words", F.lit("x"))
    got = M.score(both).collect()
    assert len(got) == both.count()
    by = {r.doc_id: r for r in got}
    assert all((by[k].n_words, by[k].log_likelihood, by[k].perplexity) == (0, 0.0, None) for k in (-1, -2, -3))
    assert all(r.log_likelihood < 0 and np.isfinite(r.log_likelihood) for r in got if r.n_words)
    assert M.score(both.where("false")).collect() == []


def test_words_of_one_bucket_keep_their_own_counts(spark, monkeypatch):
    monkeypatch.setattr(M, "FREQUENT", 1)
    monkeypatch.setattr(M, "BUCKETS", 1)
    got = M.score(spark.createDataFrame([(0, "a a a a a a"), (1, "b"), (2, "c"), (3, "c"), (4, "c")], "doc_id long, text string")).collect()
    by = {r.doc_id: r.log_likelihood for r in got}
    assert len(got) == 5 and [by[2], by[3], by[4]] == pytest.approx([by[1] + np.log(3)] * 3)


def plain_scores(texts, voc, flat):
    """The summed log-probabilities, word by word in plain loops, with the counts of the very texts."""
    fields, at = {}, 0
    for name, shape in M._FIELDS:
        size = int(np.prod(shape))
        fields[name] = flat[at : at + size].astype(float).reshape(shape)
        at += size
    words = [words_of(pa.array([t], pa.string()))[0] for t in texts]
    counts = collections.Counter(int(w) for ws in words for w in ws)
    out = []
    for ws in words:
        entry, score = voc.entries(ws).tolist(), 0.0
        for k, e in enumerate(entry):
            h = fields["hidden"].copy()
            for p, d in enumerate((-2, -1, 1, 2)):
                h += fields["embeddings"][entry[k + d] if 0 <= k + d < len(entry) else M.ENTRIES] @ fields["places"][p]
            h = np.tanh(h)
            c, m = divmod(e, M.MEMBERS)
            kinds = np.exp(voc.classes + fields["class_bias"] + h @ fields["to_class"])
            members = np.exp(voc.members[c] + fields["to_member"][c * M.MEMBERS : (c + 1) * M.MEMBERS] @ h)
            score += np.log(kinds[c] / kinds.sum()) + np.log(members[m] / members.sum())
            if voc.is_bucket[e]:
                bucket = sum(n for w, n in counts.items() if voc.entries(np.array([w], np.uint64))[0] == e)
                score += np.log(counts[int(ws[k])] / bucket)
        out.append(score)
    return out


def test_scores_equal_a_plain_version_whatever_the_partitions(spark, sf, monkeypatch):
    monkeypatch.setattr(M, "FREQUENT", 64)
    monkeypatch.setattr(M, "SHARD_WORDS", 2000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 60 and length(text) < 1500")
    rows = docs.unionByName(spark.createDataFrame([(-1, "x1 x2 x1"), (-2, None), (-3, "x1 " * 3000)], docs.schema)).select(F.col("doc_id").alias("id"), "text")
    entries, _, total = M.count_vocabulary(rows.select("text"))
    sent = spark.sparkContext.broadcast(entries)
    assert total // 2000 >= 2
    flat = M.train(rows.repartition(5), sent, total)
    assert np.abs(flat - M.train(rows.coalesce(1), sent, total)).max() < 1e-5 and np.abs(flat - M.Network(entries).flat).max() > 0.01
    texts = {r.id: r.text for r in rows.collect()}
    want = dict(zip(texts, plain_scores(list(texts.values()), entries, flat), strict=True))
    for parts in (2, 16):
        got = {r.id: r.log_likelihood for r in M.score(rows.repartition(parts), id_col="id").collect()}
        assert got == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_vocabulary_is_a_distribution_and_the_network_learns():
    rng = np.random.default_rng(1)
    seq = np.cumsum(rng.integers(1, 3, 60_000)).astype(np.uint64) % np.uint64(700)  # each word leaves two for the next
    keys, n = np.unique(seq, return_counts=True)
    voc = M.Vocabulary(keys, n, np.zeros(M.BUCKETS, np.int64))
    assert np.exp(voc.classes).sum() == pytest.approx(1, rel=1e-4) and np.exp(voc.members[:2]).sum(axis=1) == pytest.approx([1, 1], rel=1e-4)
    y = voc.entries(seq)
    x = M.contexts(y, np.array([0, 50_000, len(y)]))
    net = M.Network(voc)
    held = slice(50_000, None)
    unigram = net.log_probability(x[:, held], y[held]).mean()
    assert unigram == pytest.approx(np.log(1 / 700), abs=0.1)
    M.learn(net, np.column_stack([y[:50_000], x[:, :50_000].T]).astype(np.uint16).repeat(6, axis=0))
    assert net.log_probability(x[:, held], y[held]).mean() > unigram + 0.5
    every = np.arange(M.ENTRIES)
    p = np.exp(net.log_probability(np.repeat(x[:, 70:71], M.ENTRIES, axis=1), every)).sum()
    assert p == pytest.approx(1, rel=1e-3)


PAGES = [
    (1, "http://a.example.fr/x", '<html lang="fr"><body>le chat est sur la table avec les autres dans la maison</body></html>'),
    (2, "http://a.example.fr/y", "<html><script>the the the the</script><nav>with the and of</nav><p>le chien est dans la maison avec les enfants</p></html>"),
    (3, "https://b.example.com/", '<html lang=en-US><p>the cat is on the table with the others in the house</p>'),
    (4, "https://b.example.com/z", None),
    (5, None, ""),
    (5, None, ""),
    (6, "not a url [", '<HTML LANG="de"><p>der hund ist in dem haus mit den kindern und der katze</p>'),
]


def test_language(spark):
    texts = {"fr": "le chat est sur la table avec les enfants dans la maison et le chien", "en": "the cat is on the table with the children in the house and the dog", "de": "der hund und die katze ist in dem haus mit den kindern auf dem tisch"}
    docs = spark.createDataFrame([(t, k) for k, t in texts.items()] * 5 + [(None, "en"), ("x", None)], "text string, lang string")
    model = L.fit(docs)
    assert model.langs == ["de", "en", "fr"]
    got = L.identify(spark.createDataFrame([(*p, 0) for p in PAGES], "page_id long, url string, html string, host int"), model).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(PAGES) and {k: by[k].lang for k in (1, 2, 3, 6)} == {1: "fr", 2: "fr", 3: "en", 6: "de"}
    assert by[4].lang == "en" and by[4].text_lang is None and all(0 < r.probability <= 1 for r in got)
    none = L.fit(docs.where("false"))
    assert all(r.lang is None and r.probability == 0 for r in L.identify(spark.createDataFrame(PAGES, "page_id long, url string, html string"), none).collect())
    assert L.identify(spark.createDataFrame([], "page_id long, url string, html string"), model).collect() == []


def test_declared_language_is_the_whole_primary_subtag(spark):
    tags = {"fil": "fil", "fi": "fi", "CEB-PH": "ceb", "gsw_CH": "gsw", "en-US": "en"}
    pages = spark.createDataFrame([(k, "http://a.example/", f'<html lang="{t}"><p>text</p>') for k, t in enumerate(tags)], "page_id long, url string, html string")
    model = L.fit(spark.createDataFrame([("some text", "en"), ("du texte", "fr")], "text string, lang string"))
    got = {r.page_id: r.declared for r in L.identify(pages, model).collect()}
    assert [got[k] for k in range(len(tags))] == list(tags.values())


def test_broken_pages_take_linear_time():
    assert L.visible("a<b>c</b><!-- x > --> d<script x>1<2</script >e<STYLE>s</style><nav>f</nav>&amp;g < h").split() == ["a", "c", "d", "e", "g", "<", "h"]
    assert L.visible("<!-- never ends > a <script> b").split() == ["a", "b"]
    for piece in ("<", "<!--", "<script ", "<html ", "<html lang", "</script ", "<!-- > "):
        began = time.time()
        L.visible(piece * 300_000), L.declared_language(piece * 300_000)
        assert time.time() - began < 10


def test_long_runs_of_blanks():
    import public_tokenizers
    import sentencepiece

    tool = P.loaded(P.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.MODEL))
    for text in (" " * 50_001, "  a" * 3000, "a" * 30_000, "=" * 20_001 + " x", "ab   " * 3000 + " " * 777):
        assert np.frombuffer(tool.encode(text), np.int32).tolist() == library.encode(text)


def test_all_languages_take_part(spark):
    # the last language has the fewest trigrams
    names = [f"{a}{b}" for a in "abcdefghijklm" for b in "abcdefghijklmnopqrst"]
    texts = {x: f"{x}{x[::-1]}{x} " * (300 - k) for k, x in enumerate(names)}
    model = L.fit(spark.createDataFrame([(t, x) for x, t in texts.items()], "text string, lang string"))
    assert model.langs == sorted(names) and len(names) == 260
    some = [names[0], names[130], names[255], names[-1]]
    pages = spark.createDataFrame([(k, f"http://h{k}.example/", f"<p>{texts[x]}</p>") for k, x in enumerate(some)], "page_id long, url string, html string")
    got = {r.page_id: r for r in L.identify(pages, model).collect()}
    assert [(got[k].text_lang, got[k].lang) for k in range(4)] == [(x, x) for x in some] and all(0.5 < r.probability <= 1 for r in got.values())


def test_pipeline_cuts_passages_of_51_words(spark):
    random.seed(3)
    word = lambda n: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passages = [" ".join(word(n + k % 2) for k in range(51)) for n in (4, 5, 6)]
    assert [len(p) < 400 for p in passages] == [True] * 3
    fill = lambda: " ".join(word(7) for _ in range(80))
    texts = [f"{fill()}. {p}. {fill()}" for p in passages for _ in range(2)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    for k, t in enumerate(texts):
        a, b = t.split(f". {passages[k // 2]}. ")
        assert got[k].text.startswith(a) and got[k].text.endswith(b) and len(got[k].text) <= len(a) + len(b) + 4 and got[k].n_chars == len(got[k].text)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", None, None, None)], docs.schema)
    kept = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, kept, sf)
        assert now.columns == docs.columns and now.schema.simpleString() == docs.schema.simpleString(), name
        kept = spark.createDataFrame(now.collect(), docs.schema)
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns)
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and 0.5 * docs.count() < len(ids) < docs.count()


def test_queries_are_complete():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 11))
