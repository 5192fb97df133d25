"""Benchmark decontamination by training suffix arrays.

Every shard (a slice of whole documents) gets a suffix array over its words. Each suffix of the test texts is looked up
in it by binary search; the interval found gives every verbatim occurrence and its place, and occurrences that follow
each other are joined to longest matches. No shuffle: shards never exchange rows, and only the test texts travel, as
blocks of at most `block_bytes`. A pass carries PASS_BLOCKS of them: each batch of documents builds its suffix arrays
once and looks the blocks up in turn, so a worker holds the windows of one block at a time. Test texts beyond a pass
take further map-only passes, never a larger broadcast.

Defined results: a null or empty text has no words, is never contaminated and no item; repeated documents are judged
each; rows of an item that share an id count as one item, a null id makes its windows hit but is not listed; empty
tables give empty results or no hits; further columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import column, materialize, mix, pack, slices, small_batches, unpack, with_columns_of
from .words import words

#: Test text whose windows a worker holds at a time.
BLOCK_BYTES = 2 << 20
#: Blocks that are sent to the executors at a time.
PASS_BLOCKS = 16
_HITS = "item:string,item_null:boolean,at:long,words:long,item_at:long"


class Probes:
    """The windows of a block of test items: distinct runs of `window` words, and who has them where."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.names = [i for i, _ in items]
        fp, off = words(pa.array([t for _, t in items], pa.string()))
        rows, where, length = [], [], []
        for k in range(len(items)):
            n = int(off[k + 1] - off[k])
            w = min(n, window)
            for at in range(n - w + 1 if n else 0):
                rows.append((k, at))
                where.append(off[k] + at)
                length.append(w)
        self.window = window
        where, length = np.array(where, np.int64), np.array(length, np.int64)
        keys = np.zeros((len(rows), window), np.uint64)
        for d in range(window):
            has = length > d
            keys[has, d] = fp[where[has] + d]
        table, back = np.unique(np.column_stack([length.astype(np.uint64), keys]), axis=0, return_inverse=True) if len(rows) else (np.zeros((0, window + 1), np.uint64), np.zeros(0, np.int64))
        self.length, self.keys = table[:, 0].astype(np.int64), table[:, 1:]
        order = np.argsort(back.ravel(), kind="stable")
        self.owner = np.array(rows, np.int64).reshape(-1, 2)[order]
        self.first = np.searchsorted(back.ravel()[order], np.arange(len(table) + 1))


def suffix_array(fp: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all texts ordered by their first `depth` words or more (prefix doubling), and the words with a
    terminator of its own after each text, so that no match crosses from one text into the next."""
    counts = np.diff(offsets)
    text = np.zeros(len(fp) + len(counts), np.uint64)
    place = np.arange(len(fp)) + np.repeat(np.arange(len(counts)), counts)
    text[place] = fp
    text[offsets[1:] + np.arange(len(counts))] = mix(np.arange(len(counts), dtype=np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    n = len(text)
    order = np.argsort(text)
    rank = np.zeros(n, np.int64)

    def ranked(order: np.ndarray, keys: np.ndarray) -> None:
        sorted_keys = keys[order]
        rank[order] = np.cumsum(np.concatenate([[0], sorted_keys[1:] != sorted_keys[:-1]]))

    if n:
        ranked(order, text)
    step = 1
    while step < depth and n:
        following = np.zeros(n, np.int64)
        following[: max(n - step, 0)] = rank[step:] + 1
        keys = (rank << 32) | following
        order = np.argsort(keys)
        ranked(order, keys)
        step *= 2
    return order, text


def intervals(order: np.ndarray, text: np.ndarray, keys: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, the interval of the suffix array whose suffixes begin with its first `length` words: two binary
    searches, all keys at once."""

    def compare(q: np.ndarray, places: np.ndarray) -> np.ndarray:
        """-1, 0, 1: the suffix at each place is below, begins with, is above the key."""
        out = np.zeros(len(q), np.int8)
        live = np.arange(len(q))
        for d in range(keys.shape[1]):
            live = live[length[q[live]] > d]
            if not len(live):
                break
            at = places[live] + d
            word = text[np.minimum(at, len(text) - 1)]
            key = keys[q[live], d]
            less, more = (word < key) | (at >= len(text)), (word > key) & (at < len(text))
            out[live[less]], out[live[more]] = -1, 1
            live = live[~less & ~more]
        return out

    def bound(after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(order), np.int64)
        while len(q := np.flatnonzero(lo < hi)):
            mid = (lo[q] + hi[q]) // 2
            c = compare(q, order[mid])
            right = (c < 0) | ((c == 0) & after)
            lo[q[right]] = mid[right] + 1
            hi[q[~right]] = mid[~right]
        return lo

    return bound(False), bound(True)


def matches(order: np.ndarray, text: np.ndarray, offsets: np.ndarray, probes: Probes) -> tuple[np.ndarray, ...]:
    """Longest runs of words that a text of a suffix array shares with an item: text, word there, words, item, word in
    the item."""
    none = (np.zeros(0, np.int64),) * 5
    if not offsets[-1] or not len(probes.keys):
        return none
    low, high = intervals(order, text, probes.keys, probes.length)
    count = high - low
    found = np.flatnonzero(count)
    if not len(found):
        return none
    n = count[found]
    hit = np.repeat(found, n)
    place = order[np.repeat(low[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
    doc = np.searchsorted(offsets[1:] + np.arange(1, len(offsets)), place, side="right")
    place = place - doc
    owners = probes.first[hit + 1] - probes.first[hit]
    pick = np.repeat(probes.first[hit] - np.concatenate([[0], np.cumsum(owners)[:-1]]), owners) + np.arange(owners.sum())
    doc, place, width = np.repeat(doc, owners), np.repeat(place, owners), np.repeat(probes.length[hit], owners)
    item, item_at = probes.owner[pick].T
    sort = np.lexsort((place, place - item_at, item, doc))
    doc, place, width, item, item_at = (x[sort] for x in (doc, place, width, item, item_at))
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] - item_at[1:] != place[:-1] - item_at[:-1]) | (place[1:] != place[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(new)]]) - 1
    return doc[first], place[first] - offsets[doc[first]], place[last] - place[first] + width[first], item[first], item_at[first]


Block = list[tuple[str | None, str | None]]


def _search(blocks: object, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Probes(blocks.value[0], window) if len(blocks.value) == 1 else None
        for batch in batches:
            texts = column(batch, "text")
            shards = []
            for at, to in slices(texts):
                fp, off = words(texts.slice(at, to - at))
                shards.append((at, off, *suffix_array(fp, off, window)))
            hits = [x or [] for x in column(batch, "hits").to_pylist()]
            for block in blocks.value:
                probes = held or Probes(block, window)
                for first, off, order, text in shards:
                    doc, place, n, item, item_at = matches(order, text, off, probes)
                    for k in range(len(doc)):
                        name = probes.names[item[k]]
                        hits[first + doc[k]].append({"item": name or "", "item_null": name is None, "at": int(place[k]), "words": int(n[k]), "item_at": int(item_at[k])})
            counts = np.concatenate([np.zeros(0, np.int64), *[np.diff(off) for _, off, _, _ in shards]])
            cols = {"n_words": pa.array(counts, pa.int64()), "hits": pa.array(hits, batch.schema.field("hits").type)}
            yield pa.RecordBatch.from_arrays([cols.get(f.name, batch.column(k)) for k, f in enumerate(batch.schema)], schema=batch.schema)

    return run


def _passes(items: DataFrame, block_bytes: int) -> Iterator[list[Block]]:
    """The items (item, text) in blocks by hash, as many at a time as a pass carries; the driver holds no more."""
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size * 2 // block_bytes)) if size > block_bytes else 1
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for at in range(0, n, PASS_BLOCKS):
        found: list[Block] = [[] for _ in range(min(PASS_BLOCKS, n - at))]
        for r in items.select("item", "text", block.alias("block")).where(block.between(at, at + PASS_BLOCKS - 1)).toLocalIterator():
            found[r.block - at].append((r.item, r.text))
        yield found


def find_matches(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """Per document: id, n_words and hits, the longest verbatim matches of at least `window` words with any item, as
    structs (item, at, words, item_at); an item of fewer words matches whole."""
    spark = small_batches(docs.sparkSession)  # a batch's suffix arrays are held together
    items = with_columns_of(items, item=item_col, text=item_text_col).select(F.col("item").cast("string"), "text").where(F.col("text").isNotNull()).distinct()
    out = with_columns_of(docs, id=id_col, text=text_col).select("id", "text", F.lit(0).cast("long").alias("n_words"), F.expr(f"cast(array() as array<struct<{_HITS}>>)").alias("hits"))
    schema = out.schema
    for k, blocks in enumerate(_passes(items, block_bytes)):
        out = (materialize(out) if k else out).mapInArrow(_search(spark.sparkContext.broadcast(blocks), window), schema)
    return out.select(F.col("id").alias(id_col), *[F.col("text").alias(text_col)] * keep_text, "n_words", "hits")


def _digest(found: DataFrame) -> DataFrame:
    """Replaces hits by figures."""
    spans = F.array_sort(F.transform("hits", lambda h: F.struct(h["at"].alias("s"), (h["at"] + h["words"]).alias("e"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    joined = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["end"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end"))
    names = F.array_sort(F.array_distinct(F.transform(F.filter("hits", lambda h: ~h["item_null"]), lambda h: h["item"])))
    best = F.array_min(F.transform("hits", lambda h: F.struct((-h["words"]).alias("n"), h["at"].alias("at"))))
    return (
        found.withColumns({"n_hit": F.aggregate(spans, zero, joined, lambda a: a["n"]), "_names": names, "_best": best})
        .withColumns({"n_items": F.size("_names").cast("long"), "items_sha256": F.sha2(F.array_join("_names", ","), 256), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})
        .withColumns({"longest_words": F.coalesce(-F.col("_best.n"), F.lit(0).cast("long")), "longest_at": F.col("_best.at")})
        .drop("hits", "_names", "_best")
    )


def contamination(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """Per document: id, n_words, n_hit (words inside any match), n_items, items_sha256 (of the ids as sorted strings,
    comma-joined), contaminated (n_hit > 0 and 20 * n_hit >= n_words), the longest match's words and place."""
    return _digest(find_matches(docs, items, **options))


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **options: object) -> DataFrame:
    """The documents, all their columns, without those that are contaminated.

    Judged row by row in the pass that reads them, so repeated rows and ids need no join.
    """
    judged = contamination(pack(docs, text_col), items, id_col="rest", text_col="text", keep_text=True, **options)
    return unpack(judged.where(~F.col("contaminated")), docs.columns, text_col)


def op1_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP1_SQL = rf"""
with lowered as (select *, row_number() over () as rid from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)),
dw as (select rid, doc_id, regexp_extract_all(t, '{W}') as w from lowered),
iw as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}') as w from benchmark where text is not null),
iwin as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') as k
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as p from iw where len(w) > 0)),
sizes as (select distinct n from iwin),
dpos as (select rid, w, n, unnest(range(1, len(w) - n + 2)) as p from dw, sizes where len(w) >= n),
hits as (select d.rid, d.p, d.n, i.item_id from (select rid, p, n, array_to_string(w[p:p + n - 1], ' ') as k from dpos) d join iwin i on i.n = d.n and i.k = d.k),
cov as (select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + n)) as q from hits) group by rid),
its as (select rid, count(*) as n_items, string_agg(s, ',' order by s) as names from (select distinct rid, cast(item_id as varchar) as s from hits where item_id is not null) group by rid)
select dw.doc_id, cast(len(dw.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(dw.w) as contaminated
from dw left join cov using (rid) left join its using (rid)"""
