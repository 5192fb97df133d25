"""Overlap risk of sentences against a corpus: cosine, lexical overlap, rare shared phrases, boilerplate discount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SHOWN_PHRASES, AuditConfig
from ..functions import text as X
from .index import CorpusIndex
from .matching import TYPES, match_column


def match_evidence(rows: DataFrame, key: str, index: CorpusIndex, config: AuditConfig) -> DataFrame:
    """(key, rank, corpus_idx, source_path, source_label, matched_text, vector, lexical, rare, phrases) of each match.

    phrases: shared n-grams, longest first, equally long ones alphabetically, at most SHOWN_PHRASES; rare looks at all.
    """
    if index.small:
        found = rows.select(key, F.posexplode(match_column(index.matcher(config), F.col("text"))).alias("rank", "m"))
        return found.select(key, (F.col("rank") + 1).alias("rank"), "m.*")
    low, high = config.phrase_ngrams
    parts = lambda c: {"long": X.long_tokens(X.tokens(F.col(c))), "grams": X.phrases(F.col(c), low, high, config.min_tokens_for_overlap)}
    theirs = index.sentences.withColumnRenamed("text", "matched_text")
    theirs = theirs.withColumns({f"c_{k}": v for k, v in parts("matched_text").items()})
    found = index.joined_matches(rows, key, config.max_matches)
    pairs = found.join(theirs, "corpus_idx").join(rows.select(key, "text").withColumns(parts("text")), key)
    pairs = pairs.withColumns({"lexical": X.lexical_overlap(F.col("long"), F.col("c_long"), config.min_tokens_for_overlap), "shared": F.array_intersect("grams", "c_grams")}).drop("long", "c_long", "grams", "c_grams")
    rarity = 0.5 * (1.0 - F.least(F.lit(1.0), F.coalesce("df", F.lit(1)) / max(index.size, 1)))
    length = 0.5 * F.least(F.lit(1.0), F.size(F.split("phrase", " ")) / 5.0)
    rare = pairs.select(key, "rank", F.explode("shared").alias("phrase")).join(index.phrases, "phrase", "left").groupBy(key, "rank").agg(F.max(rarity + length).alias("rare"))
    return pairs.join(rare, [key, "rank"], "left").select(
        key, "rank", "corpus_idx", "source_path", "source_label", "matched_text", F.col("cosine").alias("vector"), "lexical", F.coalesce("rare", F.lit(0.0)).alias("rare"), F.slice(X.longest_first(F.col("shared")), 1, SHOWN_PHRASES).alias("phrases")
    )


def no_matches(fields: tuple[str, ...] = tuple(TYPES)) -> Column:
    return F.array().cast(f"array<struct<{','.join(f'{f}:{TYPES[f][0]}' for f in fields)}>>")


def with_overlap(rows: DataFrame, index: CorpusIndex | None, config: AuditConfig | None = None, fields: tuple[str, ...] = tuple(TYPES)) -> DataFrame:
    """Adds to rows (text, ...) vector, lexical, rare, discount, overlap and matches: evidence maxima over the matches,
    each on its own, the clamped weighted score and the matches in rank order. Without a corpus all are 0 and there are
    no matches. Rows stay where they are, unless the corpus is too large for the workers: then equal texts, whose overlap
    does not depend on their place, are matched once. fields: what is shown of a match, vector, lexical and rare at least."""
    config = config or AuditConfig()
    if index is None or not index.size:
        return rows.withColumns({**{c: F.lit(0.0) for c in ("vector", "lexical", "rare", "discount", "overlap")}, "matches": no_matches(fields)})
    if index.small:
        return scored(rows.withColumn("matches", match_column(index.matcher(config), F.col("text"), fields)), config)
    texts = rows.select("text").distinct().withColumn("key", X.text_key(F.col("text")))
    evidence = match_evidence(texts, "key", index, config)
    packed = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("m")))), lambda s: s["m"])
    found = texts.join(evidence.groupBy("key").agg(packed.alias("matches")), "key", "left").select("text", F.coalesce("matches", no_matches(fields)).alias("matches"))
    return scored(rows.join(found, "text"), config)


def scored(rows: DataFrame, config: AuditConfig) -> DataFrame:
    """Adds the figures of rows (text, matches, ...)."""
    best = {c: F.coalesce(F.array_max(f"matches.{c}"), F.lit(0.0)) for c in ("vector", "lexical", "rare")}
    rows = rows.withColumns({**best, "discount": X.boilerplate_discount(F.col("text"), X.tokens(F.col("text")))})
    w = config.overlap_weights
    score = X.clamp(w["vector"] * F.col("vector") + w["lexical"] * F.col("lexical") + w["rare"] * F.col("rare") + w["boilerplate"] * F.col("discount"))
    return rows.withColumn("overlap", score)


def overlap_scores(rows: DataFrame, key: str, index: CorpusIndex | None, config: AuditConfig | None = None) -> DataFrame:
    """(key, vector, lexical, rare, discount, overlap, matches) of rows (key, text), as with_overlap() says."""
    return with_overlap(rows.select(key, "text"), index, config).select(key, "vector", "lexical", "rare", "discount", "overlap", "matches")
