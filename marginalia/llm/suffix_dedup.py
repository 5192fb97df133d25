"""Suffix-array dedup by a logarithmic index family.

Which bytes are covered by a string of `length` bytes that also starts elsewhere, in any text? Only starts whose first
`length` bytes recur matter, so a suffix array here is an array of starts in the order of Karp-Miller-Rosenberg names:
64-bit fingerprints of those bytes, which are the same in every batch and machine. Any order that keeps equal strings
together serves, and arrays in this one can be merged without their texts.

1. Every text is cut at anchors: of each `length` bytes the least fingerprint of GRAM bytes in its first WINDOW places.
   Equal strings have their anchor at the same place, so all starts of an anchor recur only at anchors with the same
   core, the length - WINDOW + 1 bytes that all of them share. Anchors whose core occurs once are done: nothing recurs.
2. Anchors with all the same context (the bytes that their starts span) are counted, not gathered: all starts recur.
   One of them stays to be matched by others.
3. The different contexts of one core go to an index shard, by core. There they come in batches. Each batch gets its
   suffix array, is merge-scanned against the levels already there, and enters as a level; levels of equal size merge,
   so that a shard of n batches has log n levels. A shard holds whole cores and is bounded by the number of shards.
4. A core with more than HOT different contexts (such as the edge of a passage that a third of all texts have) would
   outgrow a shard. Its starts are counted by name instead, as partial aggregates, which is exact as well.

Defined results: a null text counts as empty; texts under `length` bytes lose nothing but can't be matched either;
repeated rows and equal texts match each other; overlapping repeats inside one text count; strings are judged on the
input, not on what is left; empty tables give empty results; further columns are ignored. Strings count as equal if
their 64-bit fingerprints are, within one core: among the 1.6e7 starts of a shard two others agree with a chance of 1e-5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import column, materialize, mix, pack, raw_bytes, slices, unpack
from .words import powers

LENGTH, WINDOW, GRAM = 400, 256, 16
#: Bytes of contexts in an index shard (on average) and in a batch; different contexts of one core that fill a shard.
SHARD_BYTES, BATCH_BYTES = 16 << 20, 1 << 20
HOT = SHARD_BYTES // (LENGTH + WINDOW)
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 1 << 64)


class Names:
    """Fingerprints of any spans of a buffer, from one running polynomial."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * powers(_BASE, len(data)), out=self.total[1:])
        self.back = powers(_UNBASE, len(data) + 1)

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.total[start + length] - self.total[start]) * self.back[start])


def anchors(data: np.ndarray, offsets: np.ndarray, names: Names, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all texts, and the first and last start that each stands for; starts of a text never skip."""
    valid = np.zeros(len(data), bool)
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        valid[s : max(s, e - length + 1)] = True
    starts = np.flatnonzero(valid)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none
    n = len(data) - GRAM + 1
    gram = mix((names.total[GRAM:] - names.total[:-GRAM]) * names.back[:n])
    blocks = -(-n // window) + 1
    padded = np.full(blocks * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = gram
    grid = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[starts], ahead[starts + window - 1])
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)])
    text_starts = np.isin(starts, offsets[:-1])
    first = np.flatnonzero(new | text_starts)
    lo, hi, value = starts[first], starts[np.concatenate([first[1:], [len(starts)]]) - 1], least[first]
    anchor = np.empty(len(lo), np.int64)
    for at in range(0, len(lo), 4096):
        view = padded[lo[at : at + 4096, None] + np.arange(window)]
        anchor[at : at + 4096] = lo[at : at + 4096] + (view == value[at : at + 4096, None]).argmax(axis=1)
    tied = anchor < hi  # the same fingerprint again before the run ends: each occurrence takes the starts up to it
    if tied.any():
        size = hi[tied] - lo[tied] + window
        place = np.repeat(lo[tied] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        run = np.repeat(np.arange(tied.sum()), size)
        same = padded[place] == value[tied][run]
        place, run = place[same], run[same]
        opens = np.concatenate([[True], run[1:] != run[:-1]])
        after = np.concatenate([[0], place[:-1] + 1])
        lo2, hi2 = np.where(opens, lo[tied][run], after), np.minimum(place, hi[tied][run])
        keep = lo2 <= hi2
        anchor, lo, hi = (np.concatenate([x[~tied], y[keep]]) for x, y in ((anchor, place), (lo, lo2), (hi, hi2)))
        order = np.argsort(lo)
        anchor, lo, hi = anchor[order], lo[order], hi[order]
    return anchor, lo, hi


def _cut(length: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(column(batch, "text")):
                part = batch.slice(at, to - at)
                data, offsets = raw_bytes(column(part, "text"))
                names = Names(data)
                anchor, lo, hi = anchors(data, offsets, names, length, window)
                doc = np.searchsorted(offsets, lo, side="right") - 1
                core = names(anchor, length - window + 1)
                context = mix(names(lo, hi - lo + length) ^ ((anchor - lo) * 65536 + hi - lo).astype(np.uint64))
                # equal contexts in one text: the first stands for all, the others are repeats already
                order = np.lexsort((lo, context, core, doc))
                twin = np.zeros(len(order), bool)
                if len(order):
                    d, c, x = doc[order], core[order], context[order]
                    twin[1:] = (d[1:] == d[:-1]) & (c[1:] == c[:-1]) & (x[1:] == x[:-1])
                again = np.zeros(len(order), bool)
                again[order] = twin
                times = np.ones(len(order), np.int64)
                times[order[:-1][twin[1:]]] = 2
                key, size = np.array(column(part, "key")), np.diff(offsets)
                # repeats that touch are one row without a core
                d, s, e = doc[again], lo[again], hi[again]
                joint = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != e[:-1] + 1)]) if len(d) else np.zeros(0, bool)
                opens = np.flatnonzero(joint)
                d, s, e = d[opens], s[opens], e[np.concatenate([opens[1:], [len(joint)]]) - 1] if len(opens) else e
                keep = ~again
                n, m = int(keep.sum()), len(d)
                doc = np.concatenate([doc[keep], d])
                base = offsets[doc]
                lo, hi, off = np.concatenate([lo[keep], s]) - base, np.concatenate([hi[keep], e]) - base, np.concatenate([(anchor - lo)[keep], np.zeros(m, np.int64)])
                mask = np.arange(n + m) >= n
                pad = np.zeros(m, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[doc]), pa.array(size[doc].astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(np.concatenate([core[keep], pad]).view(np.int64), mask=mask), pa.array(np.concatenate([context[keep], pad]).view(np.int64), mask=mask), pa.array(np.concatenate([times[keep], np.full(m, 2)]))],
                    names=["key", "size", "lo", "hi", "off", "core", "context", "times"],
                )

    return run


_ANCHOR = "key long, size long, lo int, hi int, off int, core long, context long, times long"
_OPEN = "key long, size long, lo int, core long, known boolean, hot boolean, bytes binary"


def _contexts(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes of the open anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "open")
            for at, to in slices(column(batch, "text"), 1_000_000):
                rows, text = [], column(batch, "text").slice(at, to - at)
                for k, items in enumerate(lists.slice(at, to - at).to_pylist()):
                    whole = text[k].as_py().encode()
                    rows += [(at + k, x["lo"], x["core"], x["known"], x["hot"], whole[x["lo"] : x["hi"] + length]) for x in items]
                if rows:
                    k, lo, core, known, hot, part = zip(*rows, strict=True)
                    k = pa.array(k)
                    yield pa.RecordBatch.from_arrays([column(batch, "key").take(k), column(batch, "size").take(k), pa.array(lo, pa.int32()), pa.array(core, pa.int64()), pa.array(known), pa.array(hot), pa.array(part, pa.binary())], names=["key", "size", "lo", "core", "known", "hot", "bytes"])

    return run


class Family:
    """The suffix arrays of a shard, each twice as large as the next at least. Starts are numbered as they come."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # names in order, and the number of the start
        self.recurs: list[np.ndarray] = []
        self.count = 0

    def add(self, data: np.ndarray, starts: np.ndarray, known: np.ndarray) -> None:
        """A batch: its suffix array, the merge-scan with every level, then merges of levels of equal size."""
        name = Names(data)(starts, self.length)
        order = np.argsort(name, kind="stable")
        name, number = name[order], order + self.count
        self.recurs.append(known.copy())
        self.count += len(starts)
        same = name[1:] == name[:-1]
        self.mark(number[1:][same])
        self.mark(number[:-1][same])
        for level, numbers in self.levels:
            at = np.minimum(np.searchsorted(level, name), len(level) - 1)
            met = level[at] == name
            self.mark(number[met])
            self.mark(numbers[at[met]])
        first = np.concatenate([[True], ~same])
        array = name[first], number[first]  # of equal strings, all marked, one is enough to meet others
        while self.levels and len(self.levels[-1][0]) < 2 * len(array[0]):
            array = self.merged(self.levels.pop(), array)
        self.levels.append(array)

    @staticmethod
    def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        fresh = a[0][np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)] != b[0]
        name, number = b[0][fresh], b[1][fresh]
        place = np.searchsorted(a[0], name)
        return np.insert(a[0], place, name), np.insert(a[1], place, number)

    def mark(self, numbers: np.ndarray) -> None:
        if len(self.recurs) > 1 and sum(map(len, self.recurs)) == self.count:
            self.recurs = [np.concatenate(self.recurs)]
        self.recurs[0][numbers] = True


def _index(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All contexts of a shard in, in batches; the runs of starts that recur out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, keys, sizes, los, counts, knowns = Family(length), [], [], [], [], []
        for batch in batches:
            if not len(batch):
                continue
            for at, to in slices(column(batch, "bytes"), BATCH_BYTES):
                part = batch.slice(at, to - at)
                blob = pa.concat_arrays([column(part, "bytes")]).cast(pa.large_binary())
                n = np.asarray(pc.binary_length(blob)).astype(np.int64)
                data = np.frombuffer(b"".join(blob.to_pylist()), np.uint8)
                begin = np.concatenate([[0], np.cumsum(n)[:-1]])
                count = n - length + 1
                starts = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                known = np.array(column(part, "known").to_pylist(), bool)
                family.add(data, starts, np.repeat(known, count))
                for to_list, name in ((keys, "key"), (sizes, "size"), (los, "lo")):
                    to_list.append(np.array(column(part, name)))
                counts.append(count)
                knowns.append(known)
        if keys:
            key, size, lo, count, known = map(np.concatenate, (keys, sizes, los, counts, knowns))
            family.mark(np.zeros(0, np.int64))
            recurs = np.concatenate(family.recurs) & ~np.repeat(known, count)
            of = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            runs = recurs.copy()
            runs[1:] &= ~(recurs[:-1] & (of[1:] == of[:-1]))
            ends = recurs.copy()
            ends[:-1] &= ~(recurs[1:] & (of[1:] == of[:-1]))
            s, e = np.flatnonzero(runs), np.flatnonzero(ends)
            yield pa.RecordBatch.from_arrays([pa.array(key[of[s]]), pa.array(size[of[s]]), pa.array((lo[of[s]] + place[s]).astype(np.int32)), pa.array((lo[of[s]] + place[e]).astype(np.int32))], names=["key", "size", "lo", "hi"])

    return run


def _named(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each start of a hot core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                data = np.frombuffer(column(batch, "bytes")[k].as_py(), np.uint8)
                n = len(data) - length + 1
                name = Names(data)(np.arange(n), length)
                one = lambda field, k=k, n=n: pa.array([column(batch, field)[k].as_py()] * n, batch.schema.field(field).type)
                lo = pa.array((np.arange(n) + column(batch, "lo")[k].as_py()).astype(np.int32))
                columns = [one("key"), one("size"), one("lo"), lo, one("core"), one("known"), pa.array(name.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "size", "context", "lo", "core", "known", "name"])

    return run


def _keyed(packed: DataFrame, id_col: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return packed.select("rest", text.alias("text"), F.xxhash64(F.col("rest").getField(id_col), text).alias("key"), F.octet_length(text).cast("long").alias("size"))


def repeated_starts(keyed: DataFrame, length: int = LENGTH, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(key, size, lo, hi): of the texts of keyed (key, size, text), the runs of starts that recur."""
    spark = keyed.sparkSession
    long_texts = keyed.select("key", "size", "text").where(F.col("size") >= length)
    cut = materialize(long_texts.select("key", "text").mapInArrow(_cut(length, window), _ANCHOR))
    # counts are written before they are joined: then a join's sides are plain rows, and Spark can split a hot core
    cores = materialize(cut.where("core is not null").groupBy("core").agg(F.sum("times").alias("n")).where("n > 1").select("core"))
    common = materialize(cut.join(cores, "core", "left_semi"))
    kinds = materialize(common.groupBy("core", "context").agg(F.sum("times").alias("n"), F.min("key").alias("first")))
    mixed = materialize(kinds.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    kinds = materialize(kinds.join(mixed, "core", "left"))
    judged = materialize(common.join(kinds, ["core", "context"]))
    found = cut.where("core is null").select("key", "size", "lo", "hi").unionByName(judged.where("n > 1").select("key", "size", "lo", "hi"))

    still = judged.where("kinds > 1 and key = first").select("key", "size", "lo", "hi", "core", (F.col("n") > 1).alias("known"), (F.col("kinds") > hot).alias("hot"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), still.where("not hot").count() * (length + window) // SHARD_BYTES)
    asked = still.groupBy("key", "size").agg(F.collect_set(F.struct("lo", "hi", "core", "known", "hot")).alias("open"))
    once = long_texts.join(asked, ["key", "size"]).select("key", "size", "text", "open")
    opened = materialize(once.mapInArrow(_contexts(length), _OPEN))
    found = found.unionByName(opened.where("not hot").repartition(shards, "core").mapInArrow(_index(length), "key long, size long, lo int, hi int"))
    if opened.where("hot").isEmpty():
        return found
    named = materialize(opened.where("hot").mapInArrow(_named(length), "key long, size long, context int, lo int, core long, known boolean, name long"))
    names = materialize(named.groupBy("core", "name").agg(F.sum(F.when(F.col("known"), 2).otherwise(1)).alias("n")).where("n > 1").select("core", "name"))
    starts = named.where("not known").join(names, ["core", "name"], "left_semi")
    # the starts of a context, `window` at most, become runs before a text's runs are gathered
    runs = starts.groupBy("key", "size", "context").agg(F.sort_array(F.collect_set("lo")).alias("at")).select("key", "size", F.explode(_runs(F.col("at"))).alias("run"))
    return found.unionByName(runs.select("key", "size", "run.lo", "run.hi"))


def _runs(at: Column) -> Column:
    """Sorted integers as runs (lo, hi) of consecutive ones."""
    opens = F.filter(at, lambda x, k: (k == 0) | (F.get(at, k - 1) != x - 1))
    closes = F.filter(at, lambda x, k: (k == F.size(at) - 1) | (F.get(at, k + 1) != x + 1))
    return F.arrays_zip(opens.alias("lo"), closes.alias("hi"))


def _keep(length: int, digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(column(batch, "text")):
                part = batch.slice(at, to - at)
                text, starts = column(part, "text"), column(part, "starts").to_pylist()
                sizes, removed, spans, kept = [], [], [], []
                for k, runs in enumerate(starts):
                    whole = text[k].as_py()
                    if not runs:
                        data = whole.encode() if digest else None
                        sizes.append(len(data) if digest else 0)
                        removed.append(0)
                        spans.append(0)
                        kept.append(hashlib.sha256(data).hexdigest() if digest else whole)
                        continue
                    data, left, end, n = whole.encode(), [], 0, 0
                    for lo, hi in sorted((r["lo"], r["hi"]) for r in runs):
                        if lo > end or n == 0:
                            left.append(data[end:lo])
                            n += 1
                        end = max(end, hi + length)
                    left.append(data[end:])
                    rest = b"".join(left)
                    sizes.append(len(data))
                    removed.append(len(data) - len(rest))
                    spans.append(n)
                    kept.append(hashlib.sha256(rest).hexdigest() if digest else rest.decode("utf-8", "ignore"))
                kept = pa.array(kept, pa.string())
                if digest:
                    yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), kept], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([column(part, "rest"), kept], names=["rest", "text"])

    return run


def _joined(docs: DataFrame, id_col: str, text_col: str, length: int, **options: int) -> DataFrame:
    keyed = _keyed(pack(docs, text_col), id_col)
    runs = repeated_starts(keyed, length, **options)
    runs = runs.groupBy("key", "size").agg(F.collect_set(F.struct("lo", "hi")).alias("starts"))
    return keyed.join(runs, ["key", "size"], "left")


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options: int) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of what remains)."""
    docs = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    joined = _joined(docs, id_col, text_col, length, **options).select(F.col("rest").getField(id_col).alias("id"), "text", "starts")
    kind = joined.schema["id"].dataType.simpleString()
    return joined.mapInArrow(_keep(length, True), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options: int) -> DataFrame:
    """The documents, all their columns, without the repeated bytes. A character of which a cut leaves only part goes
    with it; a null text becomes empty."""
    joined = _joined(docs, id_col, text_col, length, **options).select("rest", "text", "starts")
    out = T.StructType([joined.schema["rest"], T.StructField("text", T.StringType())])
    return unpack(joined.mapInArrow(_keep(length, False), out), docs.columns, text_col)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = """
with d as materialized (select row_number() over () as rid, doc_id, encode(coalesce(text, '')) as b from documents),
w as materialized (select rid, p, md5(b[p:p + 399]) as k from (select rid, b, unnest(range(1, octet_length(b) - 398)) as p from d where octet_length(b) >= 400)),
hit as (select rid, p from w where k in (select k from w group by k having count(*) > 1)),
cut as (select rid, p, case when p <= lag(p) over (partition by rid order by p) + 400 then 0 else 1 end as new from hit),
run as (select rid, min(p) as s, max(p) + 399 as e from (select rid, p, sum(new) over (partition by rid order by p) as n from cut) group by rid, n),
gap as (select rid, s, e, coalesce(lag(e) over (partition by rid order by s), 0) as before from run),
kept as (select g.rid, count(*) as n_spans, sum(e - s + 1) as n_removed, string_agg(case when s > before + 1 then hex(b[before + 1:s - 1]) else '' end, '' order by s) || case when max(e) < octet_length(any_value(b)) then hex(any_value(b)[max(e) + 1:octet_length(any_value(b))]) else '' end as rest
  from gap g join d on d.rid = g.rid group by g.rid)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(coalesce(unhex(rest), b)) as kept_sha256
from d left join kept using (rid)"""
