"""Sharding by k-d tree partitioning.

A node is split along its widest metadata dimension at the weighted median of bytes, until there are as many leaves as
shards (or until leaves reach a target of bytes). Medians are distributed: a row's key is its coordinate followed by a
hash, and the median is found digit by digit, each digit by one aggregate of at most 2 ** DIGIT sums a node, so the
driver holds a fixed number of sums whatever the input. Only splits are kept on the driver.

Equal texts form a group: they get one coordinate and one hash, so a split never parts them, unless the group alone
outweighs a 64th of a shard and two of the largest texts (which can't be parted either). Near equal bytes come first
then, and its rows get hashes of all their columns: where they go depends on what they hold, not on files or partitions,
and rows equal in all columns are one unit. Slots are numbered from partition offsets, without gathering a shard in one
task.

Defined results: a null text has no bytes and size 1; null metadata are the least coordinate; repeated rows each get a
slot; fewer rows than shards leave shards empty; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import column, materialize

DIMENSIONS, DIGIT, COORDINATE, HASH = ("n_chars", "lang", "source"), 16, 31, 31


#: A group of more than one row in so many is looked up in a broadcast of all such groups, at most that many.
HOT_SHARE = 4096


def coordinate(kind: T.DataType, value: F.Column, common: int) -> F.Column:
    """A number in the order of the values: numbers themselves, of strings the six bytes after those that all share."""
    if isinstance(kind, T.NumericType):
        return F.when(~F.isnan(value.cast("double")), value.cast("double"))
    after = F.substring(F.concat(F.hex(value.cast("string")), F.lit("0" * 12)), 2 * common + 1, 12)
    return F.conv(F.rpad(after, 12, "0"), 16, 10).cast("double")


def shared_bytes(least: str | None, most: str | None) -> int:
    """Bytes that all strings between these two begin with."""
    a, b = (least or "").encode(), (most or "").encode()
    return next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def split_rows(docs: DataFrame, shards: int, dimensions: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    """(doc, size, crc, weight key columns): what the tree needs of each row, written once."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    text = F.col(f"`{text_col}`")
    words = [d for d in dimensions if not isinstance(kinds[d], T.NumericType)]
    edges = [f(F.col(f"`{d}`").cast("string")).alias(f"{n}{k}") for k, d in enumerate(words) for n, f in (("lo", F.min), ("hi", F.max))]
    found = docs.agg(F.lit(0).alias("none"), *edges).first()
    common = {d: shared_bytes(found[f"lo{k}"], found[f"hi{k}"]) for k, d in enumerate(words)}
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
        F.xxhash64(F.lit(1), F.coalesce(text, F.lit(""))).alias("group"),
        F.xxhash64(*[F.col(f"`{c}`") for c in dict.fromkeys((id_col, *dimensions, text_col))]).alias("salt"),
        *[F.coalesce(coordinate(kinds[d], F.col(f"`{d}`"), common.get(d, 0)), F.lit(-1.0)).alias(f"x{k}") for k, d in enumerate(dimensions)],
    )
    rows = materialize(rows)
    x = [f"x{k}" for k in range(len(dimensions))]
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("size").alias("most"), *[F.min(c).alias(f"lo_{c}") for c in x], *[F.max(c).alias(f"hi_{c}") for c in x]).first()
    heavy = max((total["size"] or 0) // (64 * shards), 2 * (total["most"] or 0))
    groups = materialize(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in x]))
    hot = groups.where(F.col("n") * HOT_SHARE > total["n"])  # fewer than HOT_SHARE groups, whatever the input
    by_table = rows.drop(*x).join(F.broadcast(hot.drop("n")), "group")
    others = rows.drop(*x).join(F.broadcast(hot.select("group")), "group", "left_anti")
    joined = by_table.unionByName(others.join(groups.drop("n"), "group"))
    most = (1 << COORDINATE) - 1
    scaled = [F.floor((F.col(c) - F.lit(total[f"lo_{c}"] or 0.0)) / F.lit(max((total[f"hi_{c}"] or 0.0) - (total[f"lo_{c}"] or 0.0), 1e-9)) * most).cast("long").alias(c) for c in x]
    tie = F.shiftrightunsigned(F.when(F.col("bytes") > heavy, F.col("salt")).otherwise(F.col("group")), 64 - HASH)
    return materialize(joined.select("doc", "size", "crc", tie.alias("tie"), *scaled))


def tree(rows: DataFrame, shards: int, dimensions: int) -> DataFrame:
    """rows with their shard, an expression over the splits found."""
    rows = rows.withColumn("node", F.lit(0))
    leaves = {0: shards}  # first leaf of a node: its number of leaves
    while any(k > 1 for k in leaves.values()):
        spread = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[(F.max(f"x{d}") - F.min(f"x{d}")).alias(f"w{d}") for d in range(dimensions)]).collect()}
        cuts = {}
        key = F.lit(None).cast("long")
        for node, k in leaves.items():
            if k > 1 and node in spread:
                widest = max(range(dimensions), key=lambda d: (spread[node][f"w{d}"], -d))
                key = F.when(F.col("node") == node, F.shiftleft(F.col(f"x{widest}"), HASH) + F.col("tie")).otherwise(key)
                cuts[node] = [0, 0, spread[node]["bytes"] * (k // 2) / k]  # digits found, bytes before them, bytes wanted
        keyed, left = rows.withColumn("key", key), COORDINATE + HASH
        while left and cuts:
            step = min(DIGIT, left)
            prefix = F.lit(False)
            for node, (digits, _, _) in cuts.items():
                prefix |= (F.col("node") == node) & (F.shiftright("key", left) == digits)
            left -= step
            sums = keyed.where(prefix).groupBy("node", F.shiftright("key", left).alias("digit")).agg(F.sum("size").alias("bytes")).collect()
            for node, cut in cuts.items():
                for digit, size in sorted((r["digit"], r["bytes"]) for r in sums if r["node"] == node):
                    cut[0] = digit
                    if cut[1] + size >= cut[2]:
                        break
                    cut[1] += size
                if not left:  # the key at the median goes to the side that comes nearer
                    cut[0] += cut[1] + size - cut[2] < cut[2] - cut[1]
        side = F.col("node")
        for node, (cut, _, _) in cuts.items():
            side = F.when((F.col("node") == node) & (F.col("key") >= cut), F.lit(node + leaves[node] // 2)).otherwise(side)
        rows = keyed.withColumn("node", side).drop("key")
        leaves = {n: m for node, k in leaves.items() for n, m in (((node, k // 2), (node + k // 2, k - k // 2)) if k > 1 else ((node, k),))}
    return rows.withColumnRenamed("node", "shard")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        shard = np.array(column(batch, "shard"))
        order = np.argsort(shard, kind="stable")
        names, first, count = np.unique(shard[order], return_index=True, return_counts=True)
        place = np.empty(len(shard), np.int64)
        for s, f, n in zip(names.tolist(), first, count, strict=True):
            place[order[f : f + n]] = np.arange(n) + seen.get(s, 0)
            seen[s] = seen.get(s, 0) + int(n)
        yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in ("doc", "size", "crc", "shard")], pa.array(np.full(len(shard), part)), pa.array(place)], names=["doc", "size", "crc", "shard", "part", "place"])


def with_slots(rows: DataFrame) -> DataFrame:
    """Gapless slots from 0 in each shard: a row's place in its partition, after the rows of earlier partitions."""
    kind = rows.schema["doc"].dataType.simpleString()
    numbered = materialize(rows.select("doc", "size", "crc", F.col("shard").cast("int").alias("shard")).mapInArrow(_number, f"doc {kind}, size long, crc long, shard int, part long, place long"))
    counts = numbered.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return numbered.join(offsets, ["shard", "part"]).withColumn("slot", F.col("offset") + F.col("place"))


def kd_shards(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot of every row; give the number of shards or the bytes of a leaf."""
    if shards is None:
        total = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 1)).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    rows = split_rows(docs, shards, dimensions, id_col, text_col)
    placed = with_slots(tree(rows, shards, len(dimensions)))
    return placed.select(F.col("doc").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def op3_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
