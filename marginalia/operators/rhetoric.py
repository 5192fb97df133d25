"""Formulaic-rhetoric risk of sentences: phrase hits, thinness, and style against the neighbours.

Neighbours are the two sentences before and after in the document, across paragraphs. One window by document serves all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import lexicons as L
from ..config import FINDING, AuditConfig
from ..functions import text as X

STYLE = ("length", "content_ratio", "entropy")


def token_features(rows: DataFrame) -> DataFrame:
    """Adds what depends on the sentence alone: tok, length, content_ratio, abstract_ratio, entropy, thinness..."""
    # words of the lists are picked by one pattern each: a lambda over all tokens is far dearer
    rows = rows.withColumn("_low", F.lower("text"))
    rows = rows.withColumns({"tok": X.tokens(F.col("_low")), "_stop": F.size(X.listed(F.col("_low"), L.STOPWORDS)), "_abstract": X.listed(F.col("_low"), L.ABSTRACT_WORDS)}).drop("_low")
    marks = {f"_mark{k}": n for k, n in enumerate(X.mark_counts(F.col("text")))}  # columns, since the entropy names each many times
    rows = rows.withColumns(marks)
    tok, vague = F.col("tok"), F.size(F.filter("_abstract", lambda t: t.isin(L.VAGUE_WORDS)))
    rows = rows.withColumns({
        "length": F.size(tok), "content_ratio": X.ratio(F.size(tok) - F.col("_stop"), tok), "abstract_ratio": X.ratio(F.size("_abstract"), tok), "entropy": X.punctuation_entropy(F.col("text"), [F.col(n) for n in marks]),
        "discourse": X.starts_with_marker(tok), "_vague": X.ratio(vague, tok),
    }).drop("_stop", "_abstract", *marks)
    ratios = F.col("content_ratio"), F.col("abstract_ratio")
    rows = rows.withColumn("low_specificity", X.low_specificity(tok, *ratios, F.col("_vague"))).drop("_vague")
    return rows.withColumn("thinness", X.thinness(tok, *ratios, F.col("low_specificity")))


def style(rows: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """Adds style_shift (distance of the style vector from the neighbours' mean, over 18, at most 1) and smoothness
    (1 less a fortieth of the variance of lengths with the neighbours'); both 0 without neighbours."""
    w = W.partitionBy(doc).orderBy(order)
    near = [F.lag(F.struct(*STYLE), d).over(w).alias(f"_p{d}") for d in (2, 1)] + [F.lead(F.struct(*STYLE), d).over(w).alias(f"_n{d}") for d in (1, 2)]
    rows, names = rows.select("*", *near), ["_p2", "_p1", "_n1", "_n2"]
    # sums are written out, with 0 for a neighbour that is not there: lambdas over a list of neighbours are dearer
    add = lambda terms: reduce(Column.__add__, terms)
    total = lambda c: add([F.coalesce(F.col(p)[c].cast("double"), F.lit(0.0)) for p in names])
    rows = rows.withColumns({"_n": add([F.col(p).isNotNull().cast("int") for p in names]), **{f"_sum_{c}": total(c) for c in STYLE}})
    n, own = F.col("_n"), F.col("length").cast("double")
    rows = rows.withColumns({"_mean": (F.col("_sum_length") + own) / (n + 1), **{f"_gap_{c}": F.col(c).cast("double") - F.col(f"_sum_{c}") / F.greatest(n, F.lit(1)) for c in STYLE}})
    shift = F.least(F.lit(1.0), F.sqrt(add([F.col(f"_gap_{c}") * F.col(f"_gap_{c}") for c in STYLE])) / 18.0)
    off = [F.col(p)["length"].cast("double") - F.col("_mean") for p in names]
    variance = (add([F.coalesce(x * x, F.lit(0.0)) for x in off]) + (own - F.col("_mean")) * (own - F.col("_mean"))) / (n + 1)
    smooth = X.clamp(1.0 - F.least(variance / 40.0, F.lit(1.0)))
    rows = rows.withColumns({"style_shift": F.when(n > 0, shift).otherwise(0.0), "smoothness": F.when(n > 0, smooth).otherwise(0.0)})
    return rows.drop(*names, "_n", "_mean", *[f"_{k}_{c}" for k in ("sum", "gap") for c in STYLE])


def phrase_hits(rows: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds phrases, categories (canonical names) and a score for each category: half a point a hit, at most 1.

    Categories of a lexicon of one's own that have no canonical name are listed under theirs and have no score."""
    lexicon = L.PHRASES if lexicon is None else lexicon
    if not lexicon:
        none = F.array().cast("array<string>")
        return rows.withColumns({"phrases": none, "categories": none, **{c: F.lit(0.0) for c in CATEGORIES[:-1]}})
    names = {c: f"_hits{k}" for k, c in enumerate(lexicon)}
    rows = rows.withColumn("_low", F.lower("text"))
    rows = rows.withColumns({n: X.matched_phrases(F.col("_low"), c, lexicon) for c, n in names.items()}).drop("_low")
    score = lambda c: F.least(F.lit(1.0), F.size(names[c]) / 2.0) if c in names else F.lit(0.0)
    found = F.array(*[F.when(F.size(n) > 0, F.lit(L.CANONICAL.get(c, c))) for c, n in names.items()])
    return rows.withColumns({
        "phrases": F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(n) for n in names.values()])))),
        "categories": F.array_sort(F.array_distinct(F.array_compact(found))),
        "empty_transition": score("empty_transition"),
        "framework_boilerplate": score("framework_boilerplate"),
        "unsupported_confidence": F.greatest(score("unsupported_confidence"), score("novelty_inflation")),
        "balanced_summary": score("balanced_but_empty_summary"),
    }).drop(*names.values())


CATEGORIES = ("empty_transition", "framework_boilerplate", "unsupported_confidence", "balanced_summary", "low_specificity")


def rhetoric_scores(rows: DataFrame, config: AuditConfig | None = None) -> DataFrame:
    """rows (doc_id, ord, text, ...) with all features, phrase_score, classifier, rhetoric and finding_summary."""
    config = config or AuditConfig()
    w = config.rhetoric_weights
    rows = phrase_hits(style(token_features(rows)), config.phrases)
    rows = rows.withColumn("phrase_score", F.least(F.lit(1.0), F.size("phrases") / 3.0))
    rows = rows.withColumn("classifier", X.classifier(F.col("phrase_score"), F.col("thinness"), F.col("style_shift")))
    score = w["phrase"] * F.col("phrase_score") + w["thinness"] * F.col("thinness") + w["shift"] * F.col("style_shift") + w["smoothness"] * F.col("smoothness") + w["classifier"] * F.col("classifier")
    return rows.withColumns({"rhetoric": X.clamp(score), "finding_summary": X.finding_summary({c: F.col(c) for c in CATEGORIES}, FINDING)}).drop("tok")
