"""Near-duplicates and repeated bytes, against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import near_dups as N
from marginalia.llm import suffix_dedup as S

from test_words_and_search import plain_words


def bag(text):
    w = plain_words(text)
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(rows):
    ids = {}
    nodes = []
    for k, (i, t) in enumerate(rows):
        nodes.append(k if t is None else ids.setdefault(t, k))
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    bags = [bag(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            ta, tb = rows[a][1], rows[b][1]
            if ta is None or tb is None:
                continue
            shared = sum((bags[a] & bags[b]).values())
            if ta == tb or rows[a][0] == rows[b][0] or (shared and shared >= 0.8 * sum((bags[a] | bags[b]).values())):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, t) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, least[root(k)] if t is not None else i) for k, (i, t) in enumerate(rows))


def some_words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def near_rows():
    random.seed(8)
    rows = [(100 + k, " ".join(some_words(random.randint(1, 120), k))) for k in range(40)]
    for g in range(6):
        base = some_words(150, 1000 + g)
        for k in range(12):
            w = list(base)
            for _ in range(random.randint(0, 4)):
                w[random.randrange(len(w))] = f"e{random.random()}"
            rows.append((1000 + 20 * g + k, " ".join(w)))
    passage = some_words(90, 77)
    rows += [(3000 + k, " ".join(some_words(60, 5000 + k) + passage)) for k in range(40)]
    rows += [(1, "copy me now please ok go"), (2, "copy me now please ok go"), (3, None), (4, None), (5, ""), (6, ""), (7, "!!!"), (8, "two words"), (9, "Two, WORDS"), (10, "ha " * 400), (11, "ha " * 380), (12, "ha " * 100), (1, "copy me now please ok go")]
    return rows


@pytest.mark.parametrize("start", ["all", "none"])
def test_near_classes(spark, start):
    rows = near_rows() if start == "all" else []
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, twin string, node int").repartition(5)
    assert sorted(map(tuple, N.classify(df).collect())) == brute_classes(rows)
    kept = N.keep_one(df)
    classes = dict(brute_classes(rows))
    want = sorted(i for i, c in set(classes.items()) if i == c)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == want


def test_texts_that_share_an_id_are_one_class(spark):
    rows = [(1, "first text of five words"), (5, "first text of five words"), (5, "another text of five words here"), (9, "another text of five words here"), (4, "alone in the world it is")]
    got = N.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (4, 4), (5, 1), (5, 1), (9, 1)]


def test_signatures_estimate_weighted_jaccard():
    random.seed(3)
    a = [f"t{k}" for k in range(300)]
    texts, slots = [], 4096
    for extra in (0, 60, 200):
        texts.append(" ".join(a[: 300 - extra] + [f"z{extra}{k}" for k in range(extra)]) + " rep rep rep rep rep rep" * (1 + extra // 50))
    of, shingle, weight = N.bag(pa.array(texts))
    won = N.signatures(of, shingle, weight, len(texts), slots)
    bags = [bag(t) for t in texts]
    for x in range(3):
        for y in range(x):
            real = sum((bags[x] & bags[y]).values()) / sum((bags[x] | bags[y]).values())
            assert abs((won[x] == won[y]).mean() - real) < 4 * np.sqrt(real * (1 - real) / slots) + 0.005


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(70)] + [(200, 201), (201, 200)], "a long, b long")
    assert sorted(map(tuple, N.components(edges).collect())) == [(k, 0) for k in range(71)] + [(200, 200), (201, 200)]
    more = N.extended(N.components(edges), spark.createDataFrame([(70, 201), (300, 301)], "a long, b long"))
    assert sorted(map(tuple, more.collect())) == [(k, 0) for k in range(71)] + [(200, 0), (201, 0), (300, 300), (301, 300)]


# ---- repeated bytes


def brute_removals(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(d)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def repeat_rows():
    random.seed(1)
    some = lambda n: " ".join("".join(random.choice("abcdeé") for _ in range(random.randint(1, 8))) for _ in range(n))
    base, passage, rows = some(300), some(150), []
    for i in range(90):
        t, c = some(random.randint(0, 200)), random.randrange(8)
        if c == 0:
            t = "a" * random.randint(390, 1500)
        elif c == 1:
            t = "Es " * random.randint(100, 600) + some(20)
        elif c == 2:
            k = random.randrange(len(base))
            t = base[:k] + some(1) + base[k + 3 :]
        elif c == 3:
            k = random.randrange(len(t) + 1)
            t = t[:k] + passage + t[k:]
        elif c == 4:
            t = passage + passage[: random.randint(300, 500)]
        elif c == 5:
            t = None if random.random() < 0.5 else ""
        rows.append((i if i % 10 else 5, t))
    return [*rows, (200, rows[7][1]), (7, rows[7][1]), (None, "q" * 400), (201, "q" * 399)]


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"length": 120, "window": 64}])
def test_removals(spark, options):
    rows = repeat_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, size string").repartition(5)
    assert sorted(map(tuple, S.removals(df, **options).collect()), key=str) == brute_removals(rows, options.get("length", 400))


def test_cut_repeats_keeps_rows_and_columns(spark):
    passage = "é" * 210
    df = spark.createDataFrame([(1, "aé" + passage + "b", "k"), (2, "c" + passage + "é", "l"), (3, None, "m"), (4, "clean", "n")], "doc_id long, text string, key string")
    got = {r.doc_id: r for r in S.cut_repeats(df).collect()}
    assert {k: r.text for k, r in got.items()} == {1: "ab", 2: "c", 3: "", 4: "clean"} and got[1].key == "k"


def test_removals_of_an_empty_table(spark):
    assert S.removals(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_levels_grow_geometrically():
    family, rng = S.Family(8), np.random.default_rng(0)
    texts = [rng.integers(0, 255, 200).astype(np.uint8) for _ in range(33)]
    texts.append(texts[3].copy())
    for t in texts:
        family.add(t, np.arange(193), np.zeros(193, bool))
    sizes = [len(a) for a, _ in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and len(sizes) <= 7
    recurs = np.concatenate(family.recurs)
    assert set(np.flatnonzero(recurs) // 193) == {3, 33} and recurs.sum() == 2 * 193
