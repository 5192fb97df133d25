"""Exact top-k search by inner product, with multi-resolution segment statistics.

A vector is cut into segments; of each only its mean and deviation are looked at first. With the statistics of a query
they bound the distance from below, and so the inner product from above: over a segment of n components the product is
at most n * (mean * mean + deviation * deviation). Those bounds are inner products of short vectors, so a level is one
matrix product. Levels go from few segments to many; a pair that cannot reach the query's k-th best score is dropped,
and exact integer scores are computed for the survivors only. The k-th best score is known from the start: in every
chunk the candidates of the best coarse bounds are scored first. Bounds are never too low: a pair that could tie stays.

Queries travel in blocks of at most BLOCK_BYTES, all rows stay where they are; per partition and query only k rows
leave. A block is a pass over the rows, whose result is written before the next begins, so plans don't grow with the
blocks.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part;
every row is a candidate of its own, also repeated ones, but rows with the query's id are not; a query id that occurs
more than once is asked once, with its least vector; vectors of different lengths are compared with those of the query's
length only; scores beyond 2 ** 53 are rounded to that precision; empty tables give empty results; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import appended, column, materialize, with_columns_of

#: Queries and candidates that meet at a time; bytes of the queries that travel in a block.
K, SCALE, SEGMENTS, GROUP, CHUNK, BLOCK_BYTES = 5, 256, (4, 16, 32, 128, 512), 1024, 2048, 16 << 20


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that an inner product of two rows bounds that of the vectors."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    sums = np.add.reduceat(x, [p[0] for p in parts], axis=1)
    squares = np.add.reduceat(x * x, [p[0] for p in parts], axis=1)
    n = np.array([len(p) for p in parts], float)
    return np.column_stack([sums / np.sqrt(n), np.sqrt(np.maximum(squares - sums * sums / n, 0))])


def survivors(bound: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Pairs whose bound, with room for rounding, reaches the score that counts."""
    return bound + np.abs(bound) * 1e-9 + 1e-3 >= least


class Queries:
    """A group of queries of one length with their statistics, and the best rows so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, segments: tuple[int, ...] = SEGMENTS):
        self.ids, self.x, self.k = ids, x, k
        self.segments = tuple(s for s in segments if s < x.shape[1]) or segments[:1]
        self.levels = [statistics(x, s) for s in self.segments]
        self.score = np.full((len(ids), k), -np.inf)  # best first
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        #: Pairs in all, after each level, and those scored exactly.
        self.survived = np.zeros(len(self.segments) + 1, np.int64)

    def exact(self, q: np.ndarray, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Scores of pairs, a few MB of vectors at a time."""
        out, step = np.empty(len(q)), max(1, (1 << 18) // max(1, x.shape[1]))
        for at in range(0, len(q), step):
            out[at : at + step] = np.einsum("ij,ij->i", self.x[q[at : at + step]], x[c[at : at + step]])
        return out

    def search(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Takes a chunk of candidates into account."""
        pairs = self.ids[:, None] != ids[None, :]
        self.survived[0] += pairs.sum()
        bound = self.levels[0] @ statistics(x, self.segments[0]).T
        least = self.score[:, -1].copy()
        if len(ids) >= self.k:  # the k candidates of the best bounds settle what the others must reach
            seeds = np.argpartition(np.where(pairs, -bound, np.inf), self.k - 1, axis=1)[:, : self.k]
            q, c = np.repeat(np.arange(len(seeds)), self.k), seeds.ravel()
            seeded = np.where(pairs[q, c], self.exact(q, x, c), -np.inf).reshape(seeds.shape)
            least = np.maximum(least, seeded.min(axis=1))
        pairs &= survivors(bound, least[:, None])
        self.survived[1] += pairs.sum()
        rows = np.flatnonzero(pairs.any(axis=0))
        for level in range(1, len(self.levels)):
            if not len(rows):
                return
            pairs[:, rows] &= survivors(self.levels[level] @ statistics(x[rows], self.segments[level]).T, least[:, None])
            rows = np.flatnonzero(pairs.any(axis=0))
            self.survived[level + 1] += pairs.sum()
        q, c = np.nonzero(pairs)
        value = self.exact(q, x, c)
        keep = value >= least[q]
        q, c, value = q[keep], c[keep], value[keep]
        if not len(q):
            return
        who = np.unique(q)
        q = np.concatenate([q, np.repeat(who, self.k)])
        value = np.concatenate([value, self.score[who].ravel()])
        name = np.concatenate([ids[c], self.found[who].ravel()])
        order = np.lexsort((name, -value, q))
        q, value, name = q[order], value[order], name[order]
        take = np.searchsorted(q, who)[:, None] + np.arange(self.k)
        self.score[who], self.found[who] = value[take], name[take]


def _search(block: object, k: int, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [Queries(ids[at : at + GROUP], x[at : at + GROUP], k) for ids, x in block.value for at in range(0, len(ids), GROUP)]
        for batch in batches:
            vectors, ids = column(batch, "v"), np.array(column(batch, "id"))
            sizes = np.asarray(pc.list_value_length(vectors))
            for n in sorted({g.x.shape[1] for g in groups}):
                fit = np.flatnonzero(sizes == n)
                for at in range(0, len(fit), chunk):
                    some = fit[at : at + chunk]
                    x = np.asarray(pc.list_flatten(vectors.take(pa.array(some)))).reshape(len(some), n).astype(np.float64)
                    for g in groups:
                        if g.x.shape[1] == n:
                            g.search(ids[some], x)
        for g in groups:
            q, r = np.nonzero(np.isfinite(g.score))
            columns = [pa.array(g.ids[q]), pa.array(g.found[q, r]), pa.array(g.score[q, r].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame,
    is_query: F.Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    block_bytes: int = BLOCK_BYTES,
    chunk: int = CHUNK,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query (a condition on its column id) holds for, the k rows of
    the highest inner product of components floor(scale * x), ties to the smaller id."""
    spark = vectors.sparkSession
    whole = with_columns_of(vectors, id=id_col, v=vector_col)
    whole = whole.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = whole.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    whole = whole.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    asked = materialize(whole.where(is_query).groupBy("id").agg(F.min("v").alias("v")))
    size = asked.agg(F.sum(8 * F.size("v") + 64)).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1

    def found() -> Iterator[DataFrame]:
        for b in range(blocks):  # ids are distinct, so a hash deals them into blocks of about equal size
            mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
            by_length: dict[int, list] = {}
            for r in mine.toLocalIterator():
                by_length.setdefault(len(r.v), []).append(r)
            groups = [(np.array([r.id for r in rows], np.int64), np.array([r.v for r in rows], np.float64)) for _, rows in sorted(by_length.items())]
            block = spark.sparkContext.broadcast(groups)
            yield whole.mapInArrow(_search(block, k, chunk), "query_id long, vec_id long, score long")

    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = appended(found()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op2_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


OP2_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""
