"""From documents to token ids: five stages, each written as Parquet and read again by the next.

1. quality: documents that the line classifier rejects go.
2. near_dedup: of each class of near copies the document with the least id stays.
3. cut_repeats: bytes covered by a string of 250 bytes (51 words of under five bytes with a separator) that starts
   elsewhere too go; the document stays.
4. decontaminate: documents go of which a twentieth of the words or more lie in benchmark passages.
5. encode: piece ids of what is left.

Defined results, of all stages: columns beyond those of documents, also with names that an operator uses, are carried
through the first four; an empty table gives an empty one. A null or empty text is scored as an empty line by the first
stage; is never a near copy or contaminated (equal empty texts are copies); becomes empty in the third; has no pieces.
Rows repeated whole are copies, one stays; ties among copies go to the least id, then to the text of the least MD5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, near_dups, pieces, quality, suffix_dedup
from marginalia.llm.scratch import materialize, small_batches


#: Bytes of a repeat, shorter than most passages of 51 words; op10 has 400 by contract.
REPEAT, REPEAT_WINDOW = 250, 160


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score at least the classifier's threshold; it is fitted on labels outside the held-out fold."""
    return quality.keep_good(docs, quality.fitted(spark, docs, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (multisets of five words, similarity 0.8 or more)."""
    return near_dups.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of REPEAT bytes that start anywhere else too; n_chars follows."""
    cut = suffix_dedup.cut_repeats(docs, length=REPEAT, window=REPEAT_WINDOW)
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which less than a twentieth of the words lie in windows of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether these decode to the very text."""
    return pieces.encode(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _prepared(stage: Stage) -> Stage:
    return lambda spark, docs, sf_dir: stage(small_batches(spark), docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", _prepared(keep_good)),
    ("near dedup", _prepared(near_dedup)),
    ("suffix dedup", _prepared(cut_repeats)),
    ("decontamination", _prepared(remove_contaminated)),
    ("piece encoding", _prepared(encode)),
]

#: SQL can express neither the classifier nor the encoder; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
