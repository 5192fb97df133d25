"""Where intermediate tables go, and small helpers that every operator here shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once (one longer text is handled alone).
SLICE_BYTES = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one if the master
    is local (tests); on a cluster executors could not see that, so there it is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="marginalia-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


_scopes: list[list[tuple[SparkSession, str]]] = []


def table_path(spark: SparkSession) -> str:
    """A new path in the shared folder; it goes when the scope() around it ends, or else when the application ends."""
    path = f"{shared_dir(spark)}/marginalia-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    if _scopes:
        _scopes[-1].append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of table_path()."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Intermediate tables written inside go when it ends: write what an operator returns before that."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            remove(spark, path)


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, is computed once."""
    return appended([df])


def appended(parts: Iterable[DataFrame]) -> DataFrame:
    """One table of all parts, each written before the next is asked for."""
    path = None
    for df in parts:
        path = path or table_path(df.sparkSession)
        df.write.mode("append").option("compression", "snappy").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: str = "8m") -> SparkSession:
    """Sets Arrow batches to a few MB where the session has Spark's default: a Python worker then holds less at once.

    The setting stays: queries are lazy, and Spark reads it when they run.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, size)
    return spark


def with_columns_of(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under fixed names: extra columns with clashing names never reach an operator."""
    return df.select(*[F.col(f"`{v}`").alias(k) for k, v in names.items()])


def pack(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(rest, text): all other columns in one struct, so that none can clash with what an operator adds."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != text_col] or [F.lit(0).alias("none")]
    return df.select(F.struct(*rest).alias("rest"), F.col(f"`{text_col}`").alias("text"))


def unpack(df: DataFrame, names: list[str], text_col: str = "text", **more: str) -> DataFrame:
    """What pack() was given, in its order; more: new column names and where they come from."""
    return df.select(*[(F.col("text") if c == text_col else F.col("rest").getField(c)).alias(c) for c in names], *[F.col(v).alias(k) for k, v in more.items()])


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text; a longer text stands alone."""
    if not len(texts):
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield at, to
        at = to


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offsets of each (null: empty)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if texts.offset or not len(texts):
        texts = pa.concat_arrays([texts, pa.array([], pa.large_string())])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :] if offsets and len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
