"""Roll-ups of the audit table to paragraphs, sections and documents.

The audit table has a row a sentence: doc_id, ord, sentence_id, paragraph_id, section, text, overlap, rhetoric, the
category scores, categories and finding_summary. Lists come out in document order. Aggregates are partial before the
shuffle; only a document's own lists are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CATEGORY, TOP_SENTENCES
from .rhetoric import CATEGORIES


def in_order(value: Column | str, order: str = "ord") -> Column:
    """The values of a group as a list in document order."""
    value = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda s: s["v"])


def by_label(audit: DataFrame, label: str) -> DataFrame:
    """(doc_id, label, means and maxima of both scores, sentence_ids) by a column: paragraph_id, or section by title."""
    return audit.groupBy("doc_id", F.col(label).alias("label")).agg(
        F.avg("overlap").alias("mean_overlap"), F.avg("rhetoric").alias("mean_rhetoric"), F.max("overlap").alias("max_overlap"), F.max("rhetoric").alias("max_rhetoric"), in_order("sentence_id").alias("sentence_ids")
    )


def by_paragraph(audit: DataFrame) -> DataFrame:
    return by_label(audit, "paragraph_id")


def by_section(audit: DataFrame) -> DataFrame:
    return by_label(audit, "section")


def category_counts() -> list[Column]:
    return [F.count_if(F.col(c) >= CATEGORY).alias(c) for c in sorted(CATEGORIES)]


def category_totals(audit: DataFrame) -> DataFrame:
    """(doc_id, category, n): sentences whose category score is at least CATEGORY; categories without any are left out."""
    counts = audit.groupBy("doc_id").agg(*category_counts())
    rows = counts.select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in sorted(CATEGORIES)])).alias("t"))
    return rows.select("doc_id", "t.category", "t.n").where("n > 0")


def top_sentences(audit: DataFrame, score: str, k: int = TOP_SENTENCES) -> DataFrame:
    """(doc_id, rank, sentence_id, section, text, score): the k highest, ties in document order."""
    w = W.partitionBy("doc_id").orderBy(F.col(score).desc(), "ord")
    ranked = audit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("doc_id", "rank", "sentence_id", "section", "text", F.col(score).alias("score"))


def document_summary(audit: DataFrame, docs: DataFrame) -> DataFrame:
    """A row for each of docs (doc_id), also of documents without sentences: sentence_count, both means, totals (a map
    of the categories that occur) and the top lists."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in sorted(CATEGORIES)])
    counts = audit.groupBy("doc_id").agg(F.count("*").alias("sentence_count"), F.avg("overlap").alias("mean_overlap"), F.avg("rhetoric").alias("mean_rhetoric"), *category_counts())
    counts = counts.withColumn("category_totals", F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0))).drop(*CATEGORIES)

    def tops(score: str, name: str, *more: str) -> DataFrame:
        w = W.partitionBy("doc_id").orderBy(F.col(score).desc(), "ord")
        ranked = audit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP_SENTENCES)
        return ranked.groupBy("doc_id").agg(in_order(F.struct("sentence_id", "section", "text", F.col(score).alias("score"), *more), "rank").alias(name))

    out = docs.select("doc_id").join(counts, "doc_id", "left")
    out = out.join(tops("rhetoric", "top_findings", "finding_summary", "categories"), "doc_id", "left").join(tops("overlap", "top_overlap_sentences"), "doc_id", "left").join(tops("rhetoric", "top_rhetoric_sentences"), "doc_id", "left")
    empty = F.from_json(F.lit("{}"), "map<string,bigint>")
    return out.withColumns({
        "sentence_count": F.coalesce("sentence_count", F.lit(0)), "mean_overlap": F.coalesce("mean_overlap", F.lit(0.0)), "mean_rhetoric": F.coalesce("mean_rhetoric", F.lit(0.0)), "category_totals": F.coalesce("category_totals", empty),
        **{c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("top_findings", "top_overlap_sentences", "top_rhetoric_sentences")},
    })
