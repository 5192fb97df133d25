"""The stages of the pipeline against plain versions, and texts longer than what a worker takes at once."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_classes, brute_removals
from test_words_and_search import brute_contamination

from marginalia.llm import decontaminate as D
from marginalia.llm import language as L
from marginalia.llm import near_dups as N
from marginalia.llm import pieces as P
from marginalia.llm import quality as Q
from marginalia.llm import suffix_dedup as S
from marginalia.llm import token_counts as C

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, hits string, bands string"


def word(r):
    return "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(6)
    some = lambda n: " ".join(word(r) for _ in range(n))
    base, passage, test = some(120), some(60), some(40)
    texts = [some(r.randint(1, 150)) for _ in range(40)]
    texts += [base, base, base + " one more", base.replace(" ", "\n", 3), some(50) + " " + passage + " " + some(50), passage + " " + some(90), some(20) + " " + test + " " + some(20), some(900) + " " + test[:60], None, None, "", "", "a b"]
    rows = [(k, t, "en", "s", len(t) if t else None, 0.5, "x", "y") for k, t in enumerate(texts)] + [(3, texts[3], "en", "s", None, 0.1, "x", "z")] * 2
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, test), (2, some(20)), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return rows, folder, test


def stage(spark, corpus, name, rows=None):
    df = spark.createDataFrame(corpus[0] if rows is None else rows, COLUMNS).repartition(4)
    return dict(corpus_pipeline.STAGES)[name](spark, df, corpus[1])


def test_quality_stage(spark, corpus):
    chain = Q.fitted(spark, spark.createDataFrame(corpus[0], COLUMNS), corpus[1])
    scores = chain.score(pa.array([r[1] for r in corpus[0]], pa.string()))
    want = sorted(r[0] for r, s in zip(corpus[0], scores, strict=True) if s >= Q.THRESHOLD)
    got = stage(spark, corpus, "quality classifier")
    assert got.columns == [c.split()[0] for c in COLUMNS.split(", ")] and sorted(r.doc_id for r in got.collect()) == want


def test_near_dedup_stage(spark, corpus):
    classes = set(brute_classes([r[:2] for r in corpus[0]]))
    got = stage(spark, corpus, "near dedup").collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, c in classes if i == c)
    texts = {r[0]: r[1] for r in corpus[0]}
    assert all(r.text == texts[r.doc_id] for r in got)


def test_suffix_dedup_stage(spark, corpus):
    got = stage(spark, corpus, "suffix dedup").collect()
    want = {i: n - gone for i, n, gone, _, _ in brute_removals([r[:2] for r in corpus[0]], corpus_pipeline.REPEAT)}
    assert len(got) == len(corpus[0]) and {r.doc_id: len(r.text.encode()) for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert any(n == 0 for n in want.values()) and len(set(want.values())) > 20


def test_decontamination_stage(spark, corpus):
    items = spark.read.parquet(f"{corpus[1]}/benchmark.parquet").collect()
    bad = [r[0] for r in brute_contamination([r[:2] for r in corpus[0]], [(i.item_id, i.text) for i in items]) if r[5]]
    got = stage(spark, corpus, "decontamination").collect()
    assert bad and sorted(r.doc_id for r in got) == sorted(r[0] for r in corpus[0] if r[0] not in bad)


def test_encoding_stage(spark, corpus):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.MODEL))
    got = {r.doc_id: r.ids for r in stage(spark, corpus, "piece encoding").collect()}
    assert got == {r[0]: library.encode(r[1] or "") for r in corpus[0]}


def test_stages_one_after_the_other(spark, corpus):
    docs = spark.read.parquet(f"{corpus[1]}/documents.parquet")
    for name, _ in corpus_pipeline.STAGES:
        docs = stage(spark, corpus, name, [tuple(r) for r in docs.collect()])
    want = {r.doc_id: r.ids for r in docs.collect()}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, corpus[1]).collect()} == want and want


def test_stages_on_an_empty_table(spark, corpus):
    for name, _ in corpus_pipeline.STAGES:
        assert stage(spark, corpus, name, []).collect() == []


# ---- texts beyond a worker's slice


def test_texts_longer_than_a_slice(spark):
    r = random.Random(2)
    long, test = " ".join(word(r) for _ in range(250_000)), " ".join(word(r) for _ in range(20))
    rows = [(1, f"{long} {test}"), (2, f"{long} {test}"), (3, "short " * 10), (4, test)]
    assert len(rows[0][1]) > 1_500_000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {x.doc_id: x for x in D.contamination(df, spark.createDataFrame([(9, test)], "item_id long, text string")).collect()}
    assert {k: (x.n_words, x.n_hit, x.n_items) for k, x in got.items()} == {1: (250_020, 20, 1), 2: (250_020, 20, 1), 3: (10, 0, 0), 4: (20, 20, 1)}
    assert got[1].longest_at == 250_000 and got[1].longest_words == 20
    gone = {x.doc_id: (x.n_bytes, x.n_removed) for x in S.removals(df).collect()}
    n = len(rows[0][1])
    assert gone[1] == gone[2] == (n, n) and gone[3] == (60, 0) and gone[4] == (len(test), 0)
    assert sorted(map(tuple, N.classify(df).collect())) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    tool = C.counted(C.tokenizer_path("byte_bpe_50k.json")).tokenizer
    assert {x.doc_id: x.n_tokens for x in C.count_tokens(df).collect()} == {k: len(tool.encode(t, add_special_tokens=False).ids) for k, t in rows}
    back = P.decode(P.encode(df)).collect()
    assert {x.doc_id: x.text for x in back} == dict(rows)


def test_more_texts_in_a_bag_than_bits_for_them():
    texts = pa.array([f"w{k} a b c d" for k in range(70_000)])
    of, shingle, weight = N.bag(texts)
    assert of.tolist() == list(range(70_000)) and len(set(shingle.tolist())) == 70_000 and (weight == 1).all()
    assert N.bag(texts, most=1000)[1].tolist() == shingle.tolist()


def test_measured_recall_of_the_bands():
    """Pairs of similarity 0.8 to 0.9 by 400 words of which some are replaced: how many share a band."""
    r, met, pairs = random.Random(4), 0, 0
    for _ in range(150):
        a = [word(r) for _ in range(400)]
        b = list(a)
        for at in r.sample(range(400), r.randint(4, 9)):
            b[at] = "x" + word(r)
        both = pa.array([" ".join(a), " ".join(b)])
        of, shingle, weight = N.bag(both)
        x, y = ({s: w for o, s, w in zip(of, shingle.tolist(), weight, strict=True) if o == k} for k in (0, 1))
        shared = sum(min(w, y.get(s, 0)) for s, w in x.items())
        if shared >= 0.8 * (sum(x.values()) + sum(y.values()) - shared):
            keys = N.band_keys(N.signatures(of, shingle, weight, 2))
            met, pairs = met + bool((keys[0] == keys[1]).any()), pairs + 1
    assert pairs > 50 and met == pairs


# ---- language, in plain loops


def plain_languages(labelled, pages):
    def buckets(text):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        low = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in low)
        return [((low[k] << 16 | low[k + 1] << 8 | low[k + 2]) * 2654435761 % (1 << 32)) >> (32 - L.BITS) for k in range(len(low) - 2) if low[k : k + 3] != b"   "]

    langs = sorted({x.lower() for t, x in labelled if t is not None and x is not None})
    counts = {x: np.zeros(1 << L.BITS) for x in langs}
    for t, x in labelled:
        if t is not None and x is not None:
            for b in buckets(t):
                counts[x.lower()][b] += 1
    logs = {x: np.log((c + L.TRIGRAM) / (c + L.TRIGRAM).sum()) for x, c in counts.items()}
    seen = []
    for page, url, html in pages:
        host = L.host_of(url)
        found = buckets(L.visible(html or ""))
        ll = np.array([L.TEMPER * sum(logs[x][b] for b in found) for x in langs])
        ll -= ll.max()
        post = np.exp(ll) / np.exp(ll).sum()
        seen.append((page, {"host": host, "domain": ".".join(host.split(".")[-2:]), "declared": L.declared_language(html or ""), "suffix": host.rpartition(".")[2]}, ll, post))
    out = []
    for page, clues, ll, post in seen:
        def share(clue, parent, weight):
            total = sum(p for _, c, _, p in seen if clue is None or c[clue] == clues[clue]) - post
            total = np.maximum(total, 0)
            return (total + weight * parent) / (total.sum() + weight)

        overall = share(None, np.full(len(langs), 1 / len(langs)), 1.0)
        prior = share("host", share("domain", overall, L.DOMAIN), L.HOST)
        score = ll + np.log(prior) + np.log(share("declared", overall, L.CLUE) / overall) + np.log(share("suffix", overall, L.CLUE) / overall)
        out.append((page, langs[int(np.argmax(score))], 1 / np.exp(score - score.max()).sum()))
    return out


def test_languages_equal_a_plain_version(spark):
    r = random.Random(9)
    words = {x: [word(r) for _ in range(30)] for x in ("aa", "bb", "cc")}
    labelled = [(" ".join(r.choices(words[x], k=20)), x) for x in words for _ in range(4)] + [(None, "aa"), ("zz", None), ("", "bb")]
    pages = [(k, r.choice(["http://h1.ex.aa/", "http://h2.ex.aa/x", "https://k.bb", None, "bad ["]), f"<html lang='{r.choice(['aa', 'bb-X', ''])}'><p>{' '.join(r.choices(words[r.choice(list(words))], k=r.randint(0, 4)))}</p>") for k in range(40)] + [(40, None, None), (41, "http://h1.ex.aa/", "")]
    model = L.fit(spark.createDataFrame(labelled, "text string, lang string"))
    got = L.identify(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), model).orderBy("page_id").collect()
    want = plain_languages(labelled, pages)
    assert [x.page_id for x in got] == [k for k, _, _ in want]
    assert [x.probability for x in got] == pytest.approx([p for _, _, p in want], rel=1e-3)
    assert all(x.lang == lang for x, (_, lang, p) in zip(got, want, strict=True) if p > 0.51)
