"""Audits of manuscripts as they arrive: an extension for files that land in a folder. Each micro-batch runs the batch
plan; a checkpoint folder makes a restart go on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import AuditConfig
from ..operators.index import CorpusIndex
from ..plans.audit import audit_sentences
from ..sources.sinks import flat_table
from ..sources.tex import paragraphs, sentences


def watch_folder(spark: SparkSession, path: str, out: str, checkpoint: str, index: CorpusIndex | None = None, config: AuditConfig | None = None) -> StreamingQuery:
    """Audits (doc_id, text) Parquet files of a folder; results are appended to `out`."""
    config = config or AuditConfig()

    def one(batch: DataFrame, number: int) -> None:
        rows = sentences(paragraphs(batch.select("doc_id", "text")), config.min_sentence_chars)
        flat_table(audit_sentences(rows, index, config)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema("doc_id string, text string").parquet(path).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
