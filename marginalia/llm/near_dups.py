"""MinHash near-duplicates by BagMinHash.

A text is the multiset of its five-word shingles. For every shingle, Poisson processes over the dyadic pieces of its
weight axis ([0, 1), [1, 2), [2, 4), ...) yield points in order of time; each point falls into one slot of the
signature and, in the piece that the weight ends in, counts only if its level lies below the weight. The earliest point
wins a slot. Two texts agree in a slot with probability equal to their weighted Jaccard similarity. A process stops
as soon as its next point is later than the latest slot of its text, which makes long texts cheap.

Signatures are cut into BANDS bands of ROWS rows. Equal texts stand for one node from the start. In each bucket of a
band all members are compared with one leader (links are verified on the multisets of whole texts), linked nodes are
merged, then a second leader, the node with most links so far, is tried in the buckets whose members are not yet one
class. Nodes of buckets that are still apart are joined on their rarest shingles (an exact prefix filter), only across
classes, so no link is lost to a cap. At similarity 0.8 a pair shares no band with probability 3e-6.

Defined results: equal texts are one class whatever their words; null texts are a class each row; a text without words
is near to equal texts only; a text of one to four words has one shingle; rows that share a doc_id are one class, and a
null doc_id counts as the smallest long; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import column, materialize, mix, pack, slices, unpack, with_columns_of
from .words import shingles, words

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 5
SLOTS = BANDS * ROWS
_GOLD, _NULL_ID = np.uint64(0x9E3779B97F4A7C15), -(1 << 63)


def bag(texts: pa.Array, n: int = WORDS, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) and the shingle's count in the text. Shingles keep 48 bits; 16 are for the text, so more
    texts are taken in parts."""
    if len(texts) > most:
        parts = [(at, *bag(texts.slice(at, most), n)) for at in range(0, len(texts), most)]
        return np.concatenate([of + at for at, of, _, _ in parts]), *(np.concatenate([p[k] for p in parts]) for k in (2, 3))
    found, of = shingles(*words(texts), n)
    keys = np.sort((of.astype(np.uint64) << np.uint64(48)) | (found >> np.uint64(16)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(keys)]]))
    keys = keys[first]
    return (keys >> np.uint64(48)).astype(np.int64), keys & np.uint64((1 << 48) - 1), count


def signatures(of: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, slots: int = SLOTS) -> np.ndarray:
    """The point that won each slot of each text (0: the text has no shingle)."""
    time, won = np.full((texts, slots), np.inf), np.zeros((texts, slots), np.uint64)
    flat_time, flat_won = time.ravel(), won.ravel()
    pieces = [(of, shingle, weight, np.zeros(len(of), np.int64))]
    k = 1
    while (more := weight > 1 << (k - 1)).any():  # piece k covers levels from 2 ** (k - 1) up to 2 ** k
        pieces.append((of[more], shingle[more], weight[more], np.full(more.sum(), k)))
        k += 1
    doc, shingle, weight, piece = (np.concatenate(x) for x in zip(*pieces, strict=True))
    width = np.where(piece == 0, 1, 1 << np.maximum(piece - 1, 0))
    seed = mix(shingle + _GOLD * (piece.astype(np.uint64) + np.uint64(1)))
    now, rounds = np.zeros(len(doc)), 0
    while len(doc):
        rounds += 1
        point = mix(seed + np.uint64(int(_GOLD) * rounds % (1 << 64)))
        now = now - np.log(((point >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)) / width
        point = mix(point ^ _GOLD)
        slot = doc * slots + (point & np.uint64(0xFFFFFFFF)).astype(np.int64) * slots // (1 << 32)
        level = width + ((point >> np.uint64(32)).astype(np.int64) * width >> 32)
        counts = (piece == 0) | (level < weight)
        put, at, what = slot[counts], now[counts], point[counts]
        better = at < flat_time[put]
        put, at, what = put[better], at[better], what[better]
        np.minimum.at(flat_time, put, at)
        wins = flat_time[put] == at
        flat_won[put[wins]] = what[wins] | np.uint64(1)
        if rounds <= 4 or rounds % 4 == 0:  # a bound that is out of date is only too high
            latest = time.max(axis=1)
        live = now < latest[doc]
        doc, weight, piece, width, seed, now = (x[live] for x in (doc, weight, piece, width, seed, now))
    return won


def band_keys(won: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = won.reshape(len(won), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, rows.shape[:2]).copy()
    for r in range(rows.shape[2]):
        key = mix(key ^ rows[:, :, r])
    return key


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to in slices(column(batch, "text")):
            part = batch.slice(at, to - at)
            for lo in range(0, len(part), 1 << 12):
                some = part.slice(lo, 1 << 12)
                of, shingle, weight = bag(column(some, "text"))
                won = signatures(of, shingle, weight, len(some))
                keys = band_keys(won)
                full = np.zeros(len(some), bool)
                full[of] = True
                offsets = np.concatenate([[0], np.cumsum(full * BANDS)])
                bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[full].ravel().view(np.int64)))
                sketch = pa.array([row.tobytes() for row in (won >> np.uint64(8)).astype(np.uint8)], pa.binary())
                size = pa.array(np.bincount(of, weight, len(some)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([column(some, "node"), column(some, "twin"), size, sketch, bands], names=["node", "twin", "size", "sketch", "bands"])


def _verify(similarity: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            b = column(batch, "b_text")
            names, place = np.unique(np.array(column(batch, "a")), return_inverse=True)
            first = np.zeros(len(names), np.int64)
            first[place[::-1]] = np.arange(len(batch))[::-1]
            bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            order = np.argsort(place, kind="stable")
            texts_a, texts_b = column(batch, "a_text").take(pa.array(first)), b.take(pa.array(order))
            place = place[order]
            for at, to in slices(texts_b):
                lo, hi = place[at], place[to - 1]
                bags = {k: v for k, v in bags.items() if k >= lo}
                for k in range(lo, hi + 1):
                    if k not in bags:
                        bags[k] = bag(texts_a.slice(k, 1))[1:]
                of, shingle, weight = bag(texts_b.slice(at, to - at))
                ends = np.searchsorted(of, np.arange(to - at + 1))
                for k in range(at, to):
                    s, w = shingle[ends[k - at] : ends[k - at + 1]], weight[ends[k - at] : ends[k - at + 1]]
                    t, v = bags[place[k]]
                    both = np.searchsorted(t, s)
                    same = (t[np.minimum(both, len(t) - 1)] == s) if len(t) else np.zeros(len(s), bool)
                    shared = np.minimum(w[same], v[both[same]]).sum()
                    keep[order[k]] = shared >= similarity * (w.sum() + v.sum() - shared) and shared > 0
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def _agree(least: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(column(batch, c).to_pylist()), np.uint8).reshape(len(batch), SLOTS) for c in ("a_sketch", "b_sketch"))
                keep = (a == b).sum(axis=1) >= least
                yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' shingle multisets are at least so similar.

    Pairs of too different sizes, and those whose signatures agree in fewer slots than a similar pair does but once in
    10 ** 9 times, go before their texts are fetched. A popular a is a skewed join side, which adaptive execution splits.
    """
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("sketch").alias(f"{x}_sketch"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.where((F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size")))
    least = int(SLOTS * similarity - 6 * (SLOTS * similarity * (1 - similarity)) ** 0.5)
    likely = materialize(both.select("a", "b", "a_sketch", "b_sketch").mapInArrow(_agree(least), "a long, b long"))
    with_b = likely.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a").select("a", "b", "a_text", "b_text")
    return materialize(both.mapInArrow(_verify(similarity), "a long, b long"))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-th time that a text has a shingle is a token of its own."""
    for batch in batches:
        for at, to in slices(column(batch, "text")):
            part = batch.slice(at, to - at)
            of, shingle, weight = bag(column(part, "text"))
            time = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            token = mix(np.repeat(shingle, weight) + _GOLD * time.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([column(part, "node").take(pa.array(np.repeat(of, weight))), pa.array(token.view(np.int64))], names=["node", "token"])


def rare_pairs(apart: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """All pairs of nodes of different classes that can be so similar: those that share one of their rarest tokens.

    Of n tokens two similar texts share so many that one is among the n - ceil(similarity * n) + 1 rarest of each. What
    is common to many texts, such as a passage that fills their buckets, is never among those. No pair is lost.
    """
    nodes = materialize(apart.select("node", "label").distinct())
    tokens = materialize(texts.join(nodes, "node", "left_semi").mapInArrow(_tokens, "node long, token long"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ordered = tokens.join(common, "token", "left").groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token"))).alias("all"))
    size = F.size("all")
    rare = ordered.select("node", size.alias("size"), F.posexplode(F.slice("all", 1, size - F.ceil(size * similarity).cast("int") + 1)).alias("at", "t")).where("t.df > 1")
    rare = materialize(rare.join(nodes, "node").select("node", "label", "size", "at", "t.token"))
    # of a token's holders those of its main class meet only the others, never each other
    # (written tables between the joins, so that both sides of each can be split where one token has many holders)
    held = rare.groupBy("token", "label").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    few = rare.join(materialize(held), "token").where("label != main").select("token", "main", "label", F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("at").alias("a_at"))
    all_of = rare.select("token", F.col("node").alias("b"), F.col("label").alias("other"), F.col("size").alias("b_size"), F.col("at").alias("b_at"))
    apart_now = (F.col("label") < F.col("other")) | ((F.col("label") > F.col("other")) & (F.col("other") == F.col("main")))
    # the first token that two texts share leaves room for enough others after it
    room = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at")) >= similarity / (1 + similarity) * (F.col("a_size") + F.col("b_size")) - 1e-9
    met = materialize(few).join(all_of, "token").where(apart_now & room & (F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that has an edge; label: the least node that it is connected with.

    Goes on until nothing moves; labels only fall, so it ends, after few rounds even for long chains. Alternates taking the least label around with jumping to the label's label; both are partial aggregates and joins,
    nothing is gathered per component.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = labels.join(around, "node").join(jump, "label", "left").select("node", "label", F.least("label", "near", F.coalesce("far", "label")).alias("next"))
        new = materialize(new)
        moved = new.where("next < label").limit(1).count()
        labels = new.select("node", F.col("next").alias("label"))
        if not moved:
            return labels


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links: only the classes that the links join are looked at again, not their members."""
    end = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    ends = links.select("a", "b").join(end("a"), "a", "left").join(end("b"), "b", "left")
    ends = ends.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a != b").distinct()
    top = components(ends)
    moved = labels.join(top.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialize(moved.unionByName(top.join(labels, "node", "left_anti").select("node", "label")))


def _apart(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, node, label) of the buckets whose members are not yet one class."""
    now = buckets.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    split = now.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band")
    return materialize(now.join(split, "band", "left_semi"))


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(text_key, class_id) of every distinct text, class_id being the least id of its class."""
    docs = with_columns_of(docs, id=id_col, text=text_col).where(F.col("text").isNotNull())
    docs = docs.select(F.coalesce(F.col("id").cast("long"), F.lit(_NULL_ID)).alias("node"), "text", F.md5("text").alias("twin"))
    signed = materialize(docs.mapInArrow(_sign, "node long, twin string, size long, sketch binary, bands array<long>"))
    texts_of = materialize(signed.groupBy("twin").agg(F.min("node").alias("rep")))
    reps = signed.join(texts_of.select(F.col("rep").alias("node"), "twin"), ["node", "twin"], "left_semi").select("node", F.explode("bands").alias("band"))
    leaders = reps.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    buckets = materialize(reps.join(leaders, "band").select("band", "a", "node"))
    involved = buckets.select("node").distinct().join(texts_of.select(F.col("rep").alias("node"), "twin"), "node")
    sketches = materialize(signed.join(involved, ["node", "twin"], "left_semi").dropDuplicates(["node", "twin"]).select("node", "size", "sketch"))
    texts = materialize(docs.join(involved, ["node", "twin"], "left_semi").dropDuplicates(["node", "twin"]).select("node", "text"))

    links = verified(buckets.where("a != node").select("a", F.col("node").alias("b")).distinct(), sketches, texts, similarity)
    labels = components(links)
    apart = _apart(buckets.select("band", "node"), labels)
    if not apart.isEmpty():
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
        hub = apart.join(degree, "node", "left").groupBy("band").agg(F.max_by(F.struct("node", "label"), F.struct(F.coalesce("n", F.lit(0)), -F.col("node"))).alias("hub"))
        pairs = apart.join(hub, "band").where("label != hub.label").select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
        labels = extended(labels, verified(pairs, sketches, texts, similarity))
        apart = _apart(apart.select("band", "node"), labels)
    if not apart.isEmpty():
        labels = extended(labels, verified(rare_pairs(apart, texts, similarity), sketches, texts, similarity))
    # texts that share an id are linked as well
    known = signed.select("node", "twin").join(texts_of, "twin").select("node", "rep")
    shared = known.groupBy("node").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a < hi").select("node", "a")
    labels = extended(labels, known.join(shared, "node").where("rep != a").select("a", F.col("rep").alias("b")).distinct())
    return texts_of.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("twin").alias("text_key"), F.coalesce("label", "rep").alias("class_id"))


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: its id and class_id."""
    classes = near_classes(docs, id_col=id_col, text_col=text_col, similarity=similarity)
    keys = with_columns_of(docs, id=id_col, text=text_col).select("id", F.md5("text").alias("text_key"))
    return keys.join(classes, "text_key", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", F.col("id").cast("long")).alias("class_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all their columns, one of each class: that of the least id (of several texts under that id, the
    text of the least MD5). Null texts stay."""
    classes = near_classes(docs, id_col=id_col, text_col=text_col, similarity=similarity)
    packed = pack(docs, text_col).withColumns({"node": F.coalesce(F.col("rest").getField(id_col).cast("long"), F.lit(_NULL_ID)), "text_key": F.md5("text")})
    keys = packed.where(F.col("text").isNotNull()).select("node", "text_key").join(classes, "text_key").where("node = class_id")
    keys = keys.groupBy("node").agg(F.min("text_key").alias("text_key"))
    same = W.partitionBy("node", "text_key").orderBy(F.xxhash64("rest"))
    once = packed.join(keys, ["node", "text_key"]).withColumn("copy", F.row_number().over(same)).where("copy = 1")
    return unpack(once.select("rest", "text").unionByName(packed.where(F.col("text").isNull()).select("rest", "text")), docs.columns, text_col)


def op9_bagminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
