"""Review relations: rows, paragraphs, outline, suspicious spans, metrics, overview, and the workspace query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import FLAGGED, HIGH, MAX_SPANS, MEDIUM, SUSPICIOUS, TOP_CATEGORIES
from ..functions import text as X
from .rollups import category_totals, in_order


def band(x: Column) -> Column:
    return X.band(x, HIGH, MEDIUM)


def location_label(section: Column, subsection: Column, start: Column, end: Column) -> Column:
    name = F.coalesce(F.nullif(subsection, F.lit("")), F.nullif(section, F.lit("")), F.lit("Untitled"))
    return F.concat(name, F.lit(" · "), X.line_label(start, end))


def flag_reason(overlap: Column, rhetoric: Column, match: Column, trigger: Column) -> Column:
    o, r = overlap >= FLAGGED, rhetoric >= FLAGGED
    return (
        F.when(o & r, "Review required for overlap and AI-assisted tell signals.")
        .when(o, "Review required for elevated overlap evidence.")
        .when(r, "Review required for elevated AI-assisted tell signals.")
        .when(match, "External match evidence is available for review.")
        .when(trigger, "AI-assisted tell triggers are available for review.")
        .otherwise("No elevated review flag.")
    )


def sentence_summary() -> Column:
    """One line about a row of the audit, by its unrounded scores."""
    label, matched, triggered = F.get("matches", 0)["source_label"], F.size("matches") > 0, F.size("phrases") > 0
    two = F.array_join(F.slice("phrases", 1, 2), ", ")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when((F.col("overlap") >= FLAGGED) & matched, say("Elevated overlap signal with strongest local match in ", label, "."))
        .when((F.col("rhetoric") >= FLAGGED) & triggered, say("Elevated AI-assisted tell signal with triggers such as ", two, "."))
        .when(F.col("finding_summary") != "", say("AI-assisted tell evidence available: ", F.col("finding_summary"), "."))
        .when(matched, say("Overlap evidence available from ", label, " for reviewer inspection."))
        .when(triggered, say("AI-assisted tell triggers detected: ", two, "."))
        .otherwise("Lower-signal sentence; review only if needed in context.")
    )


#: Labels of a row's figures, in the order they are shown in.
BREAKDOWN = {
    "overlap": {"Vector similarity": "vector", "Lexical overlap": "lexical", "Rare phrase overlap": "rare", "Boilerplate discount": "discount"},
    "rhetoric": {
        "Phrase-pattern score": "phrase_score", "Semantic thinness": "thinness", "Style shift": "style_shift", "Smoothness": "smoothness", "Heuristic classifier": "classifier", "Empty transition": "empty_transition",
        "Framework boilerplate": "framework_boilerplate", "Unsupported confidence": "unsupported_confidence", "Balanced summary": "balanced_summary", "Low specificity": "low_specificity", "Content ratio": "content_ratio", "Abstract word ratio": "abstract_ratio",
    },
}


def breakdown(kind: str) -> Column:
    return F.array(*[F.struct(F.lit(label).alias("label"), X.rounded(F.col(c), 3).alias("value")) for label, c in BREAKDOWN[kind].items()])


def review_rows(audit: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """The audit with rounded scores, bands, flags, reasons, lines and labels. sources: (doc_id, text) for line numbers;
    without a text, lines are 1."""
    rows = audit.join(sources.select("doc_id", F.col("text").alias("_source")), "doc_id", "left") if sources else audit.withColumn("_source", F.lit(None).cast("string"))
    size = F.length("_source")
    start = F.greatest(F.lit(0), F.least(F.col("start"), size))
    end = F.greatest(start, F.least(F.col("end"), size))
    has = F.coalesce(size > 0, F.lit(False))
    rows = rows.withColumns({
        "line_start": F.when(has, X.line_number(F.col("_source"), start)).otherwise(1), "line_end": F.when(has, X.line_number(F.col("_source"), F.greatest(start, end - 1))).otherwise(1),
        "overlap_risk": X.rounded(F.col("overlap"), 3), "rhetoric_risk": X.rounded(F.col("rhetoric"), 3), "has_match": F.exists("matches", lambda m: m["vector"] > 0), "has_trigger": F.size("phrases") > 0,
    }).drop("_source")
    rows = rows.withColumns({"combined_risk": F.greatest("overlap_risk", "rhetoric_risk"), "is_flagged": (F.col("overlap_risk") >= FLAGGED) | (F.col("rhetoric_risk") >= FLAGGED)})
    lines = F.col("line_start"), F.col("line_end")
    return rows.withColumns({
        "overlap_band": band(F.col("overlap_risk")), "rhetoric_band": band(F.col("rhetoric_risk")), "combined_band": band(F.col("combined_risk")),
        "flag_reason": flag_reason(F.col("overlap_risk"), F.col("rhetoric_risk"), F.col("has_match"), F.col("has_trigger")), "summary": sentence_summary(),
        "line_label": X.line_label(*lines), "context_label": X.line_label(*lines, "Context "), "location_label": location_label(F.col("section"), F.col("subsection"), *lines),
        "overlap_breakdown": breakdown("overlap"), "rhetoric_breakdown": breakdown("rhetoric"),
    })


def review_paragraphs(rows: DataFrame) -> DataFrame:
    first = lambda c: F.min_by(c, "sentence_index").alias(c)
    out = rows.groupBy("doc_id", "paragraph_id").agg(
        first("paragraph_index"), first("section"), first("subsection"), first("raw_tex"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"),
        F.max("combined_risk").alias("combined_risk"), F.max("overlap_risk").alias("overlap_risk"), F.max("rhetoric_risk").alias("rhetoric_risk"), F.count("*").alias("sentence_count"),
        F.bool_or("has_match").alias("has_match"), F.bool_or("has_trigger").alias("has_trigger"), F.bool_or("is_flagged").alias("is_flagged"),
        in_order("sentence_id", "sentence_index").alias("sentence_ids"), F.array_join(in_order("text", "sentence_index"), " ").alias("display_text"),
    )
    return out.withColumns({"band": band(F.col("combined_risk")), "location_label": location_label(F.col("section"), F.col("subsection"), F.col("line_start"), F.col("line_end"))})


def outline(rows: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """A row for each (doc_id, section) by title, with its subsections as structs by first line; suspicious counts
    paragraphs that reach SUSPICIOUS. Rows of equal first line keep the order they appear in."""
    rows = rows.withColumn("label", F.coalesce(F.nullif("section", F.lit("")), F.lit("Untitled")))
    ids = F.transform(F.array_sort(F.collect_set(F.struct("paragraph_index", "paragraph_id"))), lambda s: s["paragraph_id"])
    figures = [F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.count("*").alias("sentence_count"), F.count_if("is_flagged").alias("flagged_count"), ids.alias("paragraph_ids"), F.min("ord").alias("first")]
    subs = rows.where("subsection != ''").groupBy("doc_id", "label", "subsection").agg(*figures)
    item = F.struct(F.col("line_start").alias("s"), F.col("first").alias("f"), F.struct(F.col("subsection").alias("label"), "line_start", "sentence_count", "flagged_count", "paragraph_ids").alias("v"))
    subs = subs.groupBy("doc_id", "label").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["v"]).alias("subsections"))
    known = rows.select("doc_id", "label", "paragraph_id").distinct().join(paragraphs.select("doc_id", "paragraph_id", "combined_risk"), ["doc_id", "paragraph_id"])
    bad = known.groupBy("doc_id", "label").agg(F.count_if(F.col("combined_risk") >= SUSPICIOUS).alias("suspicious_paragraph_count"))
    out = rows.groupBy("doc_id", "label").agg(*figures).join(bad, ["doc_id", "label"]).join(subs, ["doc_id", "label"], "left")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("line_start", "first"))
    none = F.array().cast(subs.schema["subsections"].dataType)
    return out.select("doc_id", place.alias("position"), "label", "line_start", "line_end", "sentence_count", F.size("paragraph_ids").alias("paragraph_count"), "flagged_count", "suspicious_paragraph_count", "paragraph_ids", F.coalesce("subsections", none).alias("subsections"))


def suspicious_spans(paragraphs: DataFrame, limit: int = MAX_SPANS) -> DataFrame:
    """Runs of suspicious paragraphs of one section with consecutive numbers (gaps and islands), the first `limit` of
    each document. line_end is that of the last paragraph."""
    rows = paragraphs.where((F.col("combined_risk") >= SUSPICIOUS) | F.col("has_match") | F.col("has_trigger"))
    rows = rows.withColumn("island", F.col("paragraph_index") - F.row_number().over(W.partitionBy("doc_id", "section").orderBy("paragraph_index")))
    spans = rows.groupBy("doc_id", "section", "island").agg(
        F.min("paragraph_index").alias("start_paragraph"), F.max("paragraph_index").alias("end_paragraph"), F.min_by("line_start", "paragraph_index").alias("line_start"), F.max_by("line_end", "paragraph_index").alias("line_end"),
        F.max("combined_risk").alias("max_combined_risk"), F.max("overlap_risk").alias("max_overlap_risk"), F.max("rhetoric_risk").alias("max_rhetoric_risk"), F.count_if("is_flagged").alias("flagged_count"), F.count("*").alias("paragraph_count"),
        in_order("paragraph_id", "paragraph_index").alias("paragraph_ids"), F.flatten(in_order("sentence_ids", "paragraph_index")).alias("sentence_ids"),
    )
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("start_paragraph"))
    spans = spans.withColumn("position", place).where(F.col("position") <= limit).drop("island")
    a, b = F.col("start_paragraph").cast("string"), F.col("end_paragraph").cast("string")
    label = F.concat(F.col("section"), F.lit(" · P"), F.when(F.col("start_paragraph") == F.col("end_paragraph"), a).otherwise(F.concat(a, F.lit("-P"), b)))
    return spans.withColumns({"span_id": F.concat_ws("-", F.lit("span"), a, b, F.col("line_start").cast("string")), "label": label, "line_label": X.line_label(F.col("line_start"), F.col("line_end")), "band": band(F.col("max_combined_risk"))})


def metrics(rows: DataFrame, spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Counts and maxima of each of docs; spans are counted after their limit."""
    out = rows.groupBy("doc_id").agg(
        F.count_if("is_flagged").alias("flagged_sentence_count"), F.count_if("has_match").alias("external_match_count"), F.count_if("has_trigger").alias("triggered_sentence_count"),
        F.max("overlap_risk").alias("max_overlap_risk"), F.max("rhetoric_risk").alias("max_rhetoric_risk"), F.countDistinct("section").alias("section_count"),
    )
    out = docs.select("doc_id").join(out, "doc_id", "left").join(spans.groupBy("doc_id").agg(F.count("*").alias("suspicious_span_count")), "doc_id", "left")
    return out.na.fill(0)


def tell_overview(audit: DataFrame, k: int = TOP_CATEGORIES) -> DataFrame:
    """(doc_id, rank, label, count): the k categories of most sentences, ties by name."""
    w = W.partitionBy("doc_id").orderBy(F.col("n").desc(), "category")
    ranked = category_totals(audit).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("doc_id", "rank", F.replace("category", F.lit("_"), F.lit(" ")).alias("label"), F.col("n").alias("count"))


def searchable() -> Column:
    """What a search looks in: lower-case ids, titles, texts and the best match of a row."""
    best = F.get("matches", 0)
    parts = [F.col(c) for c in ("sentence_id", "section", "subsection", "text", "raw_tex_fragment", "summary", "source_file")]
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in [*parts, best["source_label"], best["matched_text"]]]))


def workspace(rows: DataFrame, *, section: str | None = None, overlap: float = SUSPICIOUS, rhetoric: float = SUSPICIOUS, flagged: bool = False, matched: bool = False, triggered: bool = False, search: str = "", sort: str = "document") -> DataFrame:
    """The rows that pass all filters, in order: document, combined, overlap or rhetoric (highest first, ties by place).
    By default a row has to reach both thresholds."""
    out = rows.where((F.col("overlap_risk") >= overlap) & (F.col("rhetoric_risk") >= rhetoric))
    if section is not None:
        out = out.where(F.col("section") == section)
    for wanted, column in ((flagged, "is_flagged"), (matched, "has_match"), (triggered, "has_trigger")):
        if wanted:
            out = out.where(column)
    if search.strip():
        out = out.where(searchable().contains(search.strip().lower()))
    by = {"combined": "combined_risk", "overlap": "overlap_risk", "rhetoric": "rhetoric_risk"}.get(sort)
    return out.orderBy("doc_id", *([F.col(by).desc()] if by else []), "ord")


def section_runs(rows: DataFrame) -> DataFrame:
    """Adds run: the number of the stretch of consecutive rows of one section."""
    w = W.partitionBy("doc_id").orderBy("ord")
    new = F.coalesce((F.col("section") != F.lag("section").over(w)).cast("int"), F.lit(1))
    return rows.withColumn("run", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)))


def visible_paragraphs(paragraphs: DataFrame, visible: DataFrame) -> DataFrame:
    """Paragraphs of which a row is visible, with only the visible sentences' ids."""
    shown = visible.groupBy("doc_id", "paragraph_id").agg(in_order("sentence_id", "sentence_index").alias("visible_ids"))
    return paragraphs.join(shown, ["doc_id", "paragraph_id"])
