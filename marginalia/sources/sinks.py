"""What an audit writes: the flat table, nested results, and a self-contained HTML page of one document."""

from __future__ import annotations

import html
import json

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FLAGGED, SUSPICIOUS
from ..functions import text as X
from ..operators.review import tell_overview

if TYPE_CHECKING:
    from ..plans.audit import Audit


def flat_table(audit: DataFrame) -> DataFrame:
    """A row a sentence in document order: ids, titles, text, both scores to 4 decimals, lists joined by '; ' and the
    best match, empty where there is none. The names after doc_id are a fixed format that readers rely on."""
    best = F.get("matches", 0)
    return audit.orderBy("doc_id", "ord").select(
        "doc_id",
        "sentence_id",
        "section",
        "subsection",
        F.col("text").alias("clean_text"),
        X.rounded(F.col("overlap"), 4).alias("plagiarism_risk_score"),
        X.rounded(F.col("rhetoric"), 4).alias("ai_rhetoric_risk_score"),
        F.array_join("phrases", "; ").alias("triggered_phrases"),
        F.array_join("categories", "; ").alias("triggered_categories"),
        "finding_summary",
        F.coalesce(best["source_label"], F.lit("")).alias("top_match_label"),
        F.coalesce(best["matched_text"], F.lit("")).alias("top_match_text"),
    )


def write_csv(audit: DataFrame, path: str) -> None:
    flat_table(audit).write.option("header", True).option("escape", '"').csv(path)


def nested(audit: DataFrame, summary: DataFrame) -> DataFrame:
    """A row a document: its summary and its sentences, with all evidence, as one array."""
    rows = audit.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in audit.columns if c not in ("doc_id", "ord")]))).alias("sentences"))
    return summary.join(rows, "doc_id", "left")


def write_json(audit: DataFrame, summary: DataFrame, path: str) -> None:
    nested(audit, summary).write.json(path)


def review_payload(docs: DataFrame, one: dict[str, DataFrame] | None = None, fixed: dict[str, object] | None = None, **relations: DataFrame) -> DataFrame:
    """(doc_id, payload): for each of docs one JSON text. Of `one` a document's row becomes an object (null if there is
    none), `fixed` is the same in all, and each of the relations is a list in its own order (by `position`, `ord`,
    `paragraph_index` or `rank`, whichever it has)."""
    out, parts = docs.select("doc_id"), []
    for name, rows in (one or {}).items():
        item = F.to_json(F.struct(*[c for c in rows.columns if c != "doc_id"]))
        out = out.join(rows.select("doc_id", item.alias(name)), "doc_id", "left")
        parts.append(F.concat(F.lit(f'"{name}":'), F.coalesce(name, F.lit("null"))))
    for name, rows in relations.items():
        order = next((c for c in ("position", "ord", "paragraph_index", "rank") if c in rows.columns), None)
        item = F.struct(*[c for c in rows.columns if c != "doc_id"])
        items = F.transform(F.array_sort(F.collect_list(F.struct((F.col(order) if order else F.lit(0)).alias("o"), F.to_json(item).alias("v")))), lambda s: s["v"])
        listed = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
        out = out.join(rows.groupBy("doc_id").agg(listed.alias(name)), "doc_id", "left")
        parts.append(F.concat(F.lit(f'"{name}":'), F.coalesce(name, F.lit("[]"))))
    parts += [F.lit(f'"{name}":{json.dumps(value)}') for name, value in (fixed or {}).items()]
    return out.select("doc_id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("payload"))


#: What a reader of a review is told about its figures.
LEGEND = {
    "plagiarism_label": "Estimated overlap risk",
    "ai_label": "Estimated AI-assisted tell risk",
    "caveat": "Both scores are heuristics that help a reviewer. They prove neither authorship nor copying nor misconduct.",
}


def document_cards(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, title, input_name, sentence_count, paragraph_count, sections) of each of docs; rows: its review rows."""
    sections = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "section"))), lambda s: s["section"]))
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("sentence_count"), F.countDistinct("paragraph_id").alias("paragraph_count"), sections.alias("sections"))
    name = F.element_at(F.split(F.col("doc_id").cast("string"), "/"), -1)
    title = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "[_-]", " ")))
    out = docs.select("doc_id").join(counts, "doc_id", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        F.when(title == "", "Untitled Review").otherwise(title).alias("title"),
        name.alias("input_name"),
        F.coalesce("sentence_count", zero).alias("sentence_count"),
        F.coalesce("paragraph_count", zero).alias("paragraph_count"),
        F.coalesce("sections", F.array().cast("array<string>")).alias("sections"),
    )


def audit_payload(audit: Audit) -> DataFrame:
    """(doc_id, payload): the whole review of each document, with what a viewer starts from."""
    cards = document_cards(audit.docs, audit.review_rows)
    summary = audit.summary()
    findings = summary.select("doc_id", F.posexplode("top_findings").alias("rank", "f")).select("doc_id", "rank", "f.*")
    return review_payload(
        audit.docs,
        one={"document": cards.drop("sections"), "summary": summary, "metrics": audit.metrics(), "filters": cards.select("doc_id", "sections", F.lit(SUSPICIOUS).alias("default_plagiarism_threshold"), F.lit(SUSPICIOUS).alias("default_ai_threshold"), F.lit(FLAGGED).alias("flagged_threshold"))},
        fixed={"legend": LEGEND},
        rows=audit.review_rows,
        paragraphs=audit.paragraphs,
        outline=audit.outline(),
        suspicious_spans=audit.spans,
        dominant_categories=tell_overview(audit.facts),
        top_findings=findings,
    )


PAGE = "<!doctype html><meta charset=utf-8><title>{title}</title><h1>{title}</h1><table border=1><tr><th>Sentence<th>Lines<th>Overlap<th>Rhetoric<th>Why<th>Text</tr>{rows}</table><script type=application/json id=payload>{data}</script>"


def title_of(path: str) -> str:
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return stem.replace("_", " ").replace("-", " ").strip().title() or "Untitled Review"


def html_page(review_rows: DataFrame, doc_id: object, title: str) -> str:
    """The review of one document as a page. Text is escaped, and the data cannot end its script element."""
    shown = ["sentence_id", "line_label", "overlap_risk", "rhetoric_risk", "flag_reason", "text"]
    rows = [r.asDict() for r in review_rows.where(F.col("doc_id") == doc_id).orderBy("ord").select(*shown).toLocalIterator()]
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[c]))}" for c in shown) + "</tr>" for r in rows)
    return PAGE.format(title=html.escape(title), rows=body, data=json.dumps(rows).replace("<", "\\u003c"))
