"""Reference corpora as a numbered sentence table, and bibliography titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MIN_CORPUS_CHARS
from ..functions import text as X


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, source_label, text) of the .txt and .tex files under a folder; TeX is cleaned."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))
    suffix = F.lower(F.regexp_extract("source_path", r"\.([^./]+)$", 1))
    label = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"\.[^.]*$", "")
    files = files.where(suffix.isin("txt", "tex"))
    return files.select("source_path", label.alias("source_label"), F.when(suffix == "tex", X.clean_tex(F.col("text"))).otherwise(F.col("text")).alias("text"))


def numbered(sizes: DataFrame, ranges: int = 256, small: int = 20_000) -> DataFrame:
    """Adds first: how many sentences the sources before have, of (source_path, n). Many sources are cut into ranges of
    paths, so that each task orders one range and only the ranges' sums meet in one place."""
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    count = sizes.count()
    if count <= small:
        return sizes.withColumn("first", before(W.partitionBy(F.lit(0)).orderBy("source_path"))).drop("n")
    some = sorted(r.source_path for r in sizes.sample(False, min(1.0, 8.0 * ranges / count), 3).select("source_path").limit(16 * ranges).toLocalIterator())
    cuts = F.array(*[F.lit(p) for p in some[:: max(1, len(some) // ranges)]])
    sizes = sizes.withColumn("range", F.size(F.filter(cuts, lambda c: c <= F.col("source_path"))))
    sums = sizes.groupBy("range").agg(F.sum("n").alias("n")).withColumn("base", before(W.partitionBy(F.lit(0)).orderBy("range"))).drop("n")
    inside = sizes.withColumn("inside", before(W.partitionBy("range").orderBy("source_path")))
    return inside.join(sums, "range").select("source_path", (F.col("base") + F.col("inside")).alias("first"))


def corpus_sentences(texts: DataFrame) -> DataFrame:
    """(corpus_idx, source_path, source_label, text): sentences of MIN_CORPUS_CHARS or more, numbered by path and place."""
    rows = texts.select("source_path", "source_label", F.posexplode(X.split_sentences(F.col("text"))).alias("pos", "text")).where(F.length("text") >= MIN_CORPUS_CHARS)
    rows = rows.withColumn("at", F.row_number().over(W.partitionBy("source_path").orderBy("pos")) - 1)
    first = numbered(rows.groupBy("source_path").agg(F.count("*").alias("n")))
    return rows.join(first, "source_path").select((F.col("first") + F.col("at")).alias("corpus_idx"), "source_path", "source_label", "text")


def bib_titles(files: DataFrame) -> DataFrame:
    """(path, pos, title) of the title fields of bibliography files (path, text)."""
    return files.select("path", F.posexplode(X.bib_titles(F.col("text"))).alias("pos", "title"))
