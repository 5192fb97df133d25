"""Decontamination, top-k search, sharding and token counts, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import decontaminate as D
from marginalia.llm import kd_shards as K
from marginalia.llm import token_counts as C
from marginalia.llm import topk
from marginalia.llm import words as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


TEXTS = ["", None, "One two", "éa-ÉB_c7 日本", "x" * 5000, " \n\t", "Tail word", "word" * 3, "a,b;c"]


def test_words_match_the_pattern():
    fp, off = W.words(pa.array(TEXTS, pa.string()))
    flat = [w for t in TEXTS for w in plain_words(t)]
    assert np.diff(off).tolist() == [len(plain_words(t)) for t in TEXTS]
    assert len(set(zip(flat, fp.tolist(), strict=True))) == len(set(flat)) == len(set(fp.tolist()))


def test_words_of_a_sliced_array():
    whole, part = W.words(pa.array(TEXTS, pa.string())), W.words(pa.array(["pad pad", *TEXTS], pa.string()).slice(1))
    assert whole[0].tolist() == part[0].tolist() and whole[1].tolist() == part[1].tolist()


def brute_contamination(docs, items):
    out = []
    for doc_id, text in docs:
        w = plain_words(text)
        hit, names = set(), set()
        for name, item in items:
            v = plain_words(item)
            n = min(len(v), 13)
            for at in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[at : at + n]:
                        hit.update(range(p, p + n))
                        names |= {str(name)} if name is not None else set()
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 200])
def test_decontamination(spark, block_bytes):
    random.seed(5)
    pool = "alpha beta gamma delta eps zeta eta theta".split()
    some = lambda n: " ".join(random.choices(pool, k=n))
    items = [(10, some(30)), (9, some(13)), (2, some(5)), (3, "solo"), (4, ""), (5, None), (None, some(20)), (10, some(14)), (9, "Shared, words")]
    docs = [(k, some(40)) for k in range(10)]
    docs += [(20, some(300) + " " + items[0][1].upper() + " " + some(3)), (21, items[1][1] + "!" + items[1][1]), (22, items[6][1]), (23, "SOLO"), (23, "SOLO"), (24, None), (25, ""), (26, "shared words"), (None, "solo x"), (27, some(2000) + " solo")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, hits string").repartition(3)
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, n_words int")
    got = D.contamination(df, bench, block_bytes=block_bytes).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, got.collect()), key=str) == brute_contamination(docs, items)
    kept = D.decontaminate(df, bench, block_bytes=block_bytes)
    bad = {r[0] for r in brute_contamination(docs, items) if r[5]}
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)


def test_decontamination_in_several_passes(spark, monkeypatch):
    random.seed(6)
    some = lambda n: " ".join(random.choices("alpha beta gamma delta".split(), k=n))
    items = [(k, some(14)) for k in range(30)]
    docs = [(k, some(40) + " " + items[k % 30][1]) for k in range(60)] + [(99, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    carried = [[len(b) for b in p] for p in D._passes(bench.selectExpr("cast(item_id as string) as item", "text"), 600)]
    monkeypatch.setattr(D, "PASS_BLOCKS", 3)
    passes = list(D._passes(bench.selectExpr("cast(item_id as string) as item", "text"), 600))
    assert len(carried) == 1 and len(passes) > 2 and max(map(len, passes)) == 3
    assert sorted(r for p in passes for b in p for r in b) == sorted((str(k), t) for k, t in items)
    got = D.contamination(df, bench, block_bytes=600).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, got.collect()), key=str) == brute_contamination(docs, items)


def test_longest_match_and_its_place(spark):
    item = " ".join(f"w{k}" for k in range(40))
    text = "before it " + " ".join(f"w{k}" for k in range(5, 30)) + " after " + " ".join(f"w{k}" for k in range(14))
    row = D.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert (row.longest_words, row.longest_at, row.n_hit) == (25, 2, 39)


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, items).collect() == []
    assert D.contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).first().n_hit == 0


# ---- top-k


def brute_top(rows, k=5):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        mine = min(v for i, v in ok if i == q)
        scored = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in ok if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def asked():
    return F.col("id") % 50 == 0


@pytest.mark.parametrize("n", [3, 400])
def test_top_k(spark, n):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 20))
    rows = [(k * 10, (centres[k % 6] + 0.1 * rng.normal(size=20)).tolist()) for k in range(n)]
    rows += [(50, rows[0][1]), (7, rows[1][1]), (7, rows[1][1]), (None, rows[0][1]), (8, None), (9, [None] + [0.0] * 19), (11, [float("nan")] * 20), (12, [float("inf")] * 20)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    got = topk.top_k(df, asked(), block_bytes=1000, chunk=32)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_top(rows)


def test_top_k_of_negative_scores_and_ties_on_the_pruned_path(spark):
    rows = [(0, [12.0] * 32)] + [(k, [-12.0] * 32) for k in range(1, 3000)] + [(5000 + k, [-13.0] * 32) for k in range(500)]
    df = spark.createDataFrame(rows[::-1], "vec_id long, embedding array<float>").repartition(2)
    got = topk.top_k(df, F.col("id") == 0, chunk=256)
    assert [(r["rank"], r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(k, k, -32 * 12 * 12 * 256 * 256) for k in range(1, 6)]


@pytest.mark.parametrize("shift", [0.0, -400.0])
def test_chunks_prune_and_stay_exact(shift):
    """Clusters, ties and copies; with the shift, every score is far below 0."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 48)) * 60
    x = np.floor(centres[rng.integers(9, size=2400)] + rng.normal(size=(2400, 48)) * 4)
    x[1200:1500] = x[7]
    x[:40] -= shift
    x[40:] += shift
    ids = rng.permutation(2400).astype(np.int64)
    q = topk.Queries(ids[:40], x[:40], 5)
    for at in range(0, 2400, 200):
        q.search(ids[at : at + 200], x[at : at + 200])
    assert 0 < q.survived[-1] < 0.5 * q.survived[0]
    for k in range(40):
        scores = x[k] @ x.T
        best = [i for i in np.lexsort((ids, -scores)) if i != k][:5]
        assert q.found[k].tolist() == ids[best].tolist() and q.score[k].tolist() == scores[best].tolist()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 64)) * 60
    x = np.floor(centres[rng.integers(8, size=3000)] + rng.normal(size=(3000, 64)) * 5)
    q = topk.Queries(np.arange(20), x[:20], 5)
    for s in (4, 16, 32):
        assert (topk.statistics(x[:20], s) @ topk.statistics(x, s).T >= x[:20] @ x.T - 1e-6).all()
    for at in range(0, 3000, 500):
        q.search(np.arange(3000)[at : at + 500], x[at : at + 500])
    assert q.survived[-1] < 0.6 * q.survived[0]


def test_top_k_of_empty_tables(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), asked()).collect() == []


# ---- shards


def shard(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").repartition(4)
    return K.kd_shards(df, **options).collect()


def test_shards(spark):
    random.seed(4)
    rows = [(k, "x" * random.randint(0, 900) + str(k), random.choice(["en", "de", None]), f"s{k % 9}", None, "z") for k in range(600)]
    rows += [(1000 + k, "copy of one text", f"l{k}", f"s{k}", k, "z") for k in range(20)] + [(5, None, None, None, None, None)] * 2
    got = shard(spark, rows, shards=8)
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(8))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    total = {s: sum(r.size for r in part) for s, part in by.items()}
    assert max(total.values()) - min(total.values()) < 2000 and sum(total.values()) == sum(len(r[1] or "") + 1 for r in rows)
    assert len({r.shard for r in got if 1000 <= r.doc_id < 1020}) == 1
    assert sorted((r.doc_id, r.text_crc32) for r in got) == sorted((r[0], zlib.crc32((r[1] or "").encode())) for r in rows)


def test_a_group_that_outweighs_shards_is_split(spark):
    got = shard(spark, [(k, "same text " * 20, "en", "s", 1, "") for k in range(400)] + [(1000 + k, f"other {k} " * 20, "en", "s", 2, "") for k in range(400)], shards=4)
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(4)]
    assert max(sizes) < 1.1 * min(sizes)


def test_shards_do_not_depend_on_partitions(spark):
    rows = [(k, "same text " * 20, "en", f"https://example.org/{k % 7}", k % 5, "") for k in range(400)] + [(1000 + k, f"other {k} " * 20, "en", "https://example.net", 2, "") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    one, many = ({(r.doc_id, r.shard) for r in K.kd_shards(d, shards=4).collect()} for d in (df.coalesce(1), df.repartition(7)))
    assert one == many and len(one) == 500


def test_what_strings_share_is_no_coordinate():
    assert K.shared_bytes("https://a", "https://b/c") == 8 and K.shared_bytes(None, "x") == 0 and K.shared_bytes("é", "è") == 1 and K.shared_bytes("ab", "abc") == 2


def test_a_very_long_text_is_a_shard_of_its_own(spark):
    got = shard(spark, [(0, "long " * 500_000, "en", "s", 1, "")] + [(k, f"short {k}", "en", "s", k, "") for k in range(1, 200)], shards=4)
    alone = next(r for r in got if r.doc_id == 0)
    assert alone.size == 2_500_001 and sum(r.shard == alone.shard for r in got) < 100 and len(got) == 200


def test_few_rows_and_target_bytes(spark):
    assert [r.slot for r in shard(spark, [(1, "a", "en", "s", 1, "")], shards=8)] == [0]
    assert shard(spark, [], shards=8) == []
    assert len({r.shard for r in shard(spark, [(k, "t" * 99, "en", "s", k, "") for k in range(50)], target_bytes=1000)}) == 5


# ---- token counts


def test_token_counts(spark):
    texts = ["", None, "Hello world", "a<|endoftext|>b <|endoftext|>", "  two  spaces\n\n tab\t", "日本語 é ñ", "x" * 30_000, "it's 123,456.7", "𒐀 \U00011de0 1", "\x85 \x1c ok", "word " * 5000]
    random.seed(1)
    texts += ["".join(random.choice("ab é'1.,\n\t ~日<|>") for _ in range(200)) for _ in range(50)]
    tool = C.counted(C.tokenizer_path("byte_bpe_50k.json")).tokenizer
    want = {k: (len((t or "").encode()), len(tool.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(texts)}
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(0, "", 1)], "doc_id long, text string, n_tokens int")
    got = C.count_tokens(df).collect()
    assert len(got) == len(texts) + 1 and all((r.n_bytes, r.n_tokens) == want[r.doc_id] for r in got)
    assert C.count_tokens(df.where("false")).collect() == []


def test_small_caches_count_alike(monkeypatch):
    tool = C.Counted(C.tokenizer_path("byte_bpe_50k.json"))
    monkeypatch.setattr(C, "CACHED", 3)
    monkeypatch.setattr(C, "CACHED_KEY", 2)
    texts = ["one two three four", "five six one", "seven"]
    assert tool.count(texts) == tool.count(texts) == tool.encode(texts)
