"""TF-IDF index of a corpus and exact top-k cosine matches by an inverted index: in the workers, or by a join.

idf is at least 1, so a cosine is above 0 exactly if a feature is shared: the equi-join on features loses nothing.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions import text as X
from .matching import SMALL, Matcher, match_column


def feature_counts(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, feature, tf): each feature's share of all features of the row's text."""
    found = rows.select(key, X.features(X.tokens(F.col(text))).alias("all")).where(F.size("all") > 0)
    exploded = found.select(key, F.size("all").alias("total"), F.explode("all").alias("feature"))
    return exploded.groupBy(key, "total", "feature").agg(F.count("*").alias("n")).select(key, "feature", (F.col("n") / F.col("total")).alias("tf"))


def feature_df(counts: DataFrame) -> DataFrame:
    """(feature, df): in how many rows a feature occurs."""
    return counts.groupBy("feature").agg(F.count("*").alias("df"))


def phrase_df(corpus: DataFrame, low: int = 3, high: int = 5, min_tokens: int = 5) -> DataFrame:
    """(phrase, df): in how many corpus sentences an n-gram occurs."""
    return corpus.select(F.explode(X.phrases(F.col("text"), low, high, min_tokens)).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("df"))


def idf(total: Column, df: Column) -> Column:
    return F.log((1.0 + total) / (1.0 + df)) + 1.0


def weighted(counts: DataFrame, key: str, df: DataFrame, total: int) -> DataFrame:
    """(key, feature, weight): tf * idf over the row's norm; features that the corpus lacks stay in the norm."""
    w = counts.join(df, "feature", "left").withColumn("weight", F.col("tf") * idf(F.lit(float(total)), F.coalesce("df", F.lit(0))))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy(key)))
    return w.select(key, "feature", (F.col("weight") / norm).alias("weight"))


class CorpusIndex:
    """Corpus sentences (corpus_idx, source_path, source_label, text) with document frequencies and vectors."""

    def __init__(self, corpus: DataFrame, phrase_range: tuple[int, int] = (3, 5), min_tokens: int = 5):
        self.sentences = corpus.persist()
        self.size = self.sentences.count()
        counts = feature_counts(self.sentences, "corpus_idx")
        self.df = feature_df(counts).persist()
        self.vectors = weighted(counts, "corpus_idx", self.df, self.size).persist()
        self.phrases = phrase_df(self.sentences, *phrase_range, min_tokens)
        self._matchers: dict[tuple, Broadcast[Matcher]] = {}

    @cached_property
    def small(self) -> bool:
        """Whether the corpus is to be handed to the workers whole; it has to have a feature."""
        size = self.sentences.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        return size <= 64 * SMALL and 0 < self.vectors.count() <= SMALL

    def matcher(self, config: AuditConfig) -> Broadcast[Matcher]:
        """The corpus for the workers, with what the config says about matches; only of a small one."""
        key = (config.max_matches, config.min_tokens_for_overlap, config.phrase_ngrams)
        if key not in self._matchers:
            rows = self.sentences.select("corpus_idx", "source_path", "source_label", "text", F.lower("text")).collect()
            self._matchers[key] = self.sentences.sparkSession.sparkContext.broadcast(Matcher(sorted(map(tuple, rows), key=lambda r: r[0]), config))
        return self._matchers[key]

    def top_matches(self, rows: DataFrame, key: str, k: int = 3) -> DataFrame:
        """(key, rank, corpus_idx, cosine) of rows (key, text): the k best, ties to the smaller corpus_idx.

        Against a small corpus rows stay where they are; else equal texts are matched once, by a join."""
        if self.small:
            found = match_column(self.matcher(AuditConfig(max_matches=k)), F.col("text"), ("corpus_idx", "vector"))
            out = rows.select(key, F.posexplode(found).alias("rank", "m"))
            return out.select(key, (F.col("rank") + 1).alias("rank"), "m.corpus_idx", F.col("m.vector").alias("cosine"))
        texts = rows.select("text").distinct().withColumn("_key", X.text_key(F.col("text")))
        found = self.joined_matches(texts, "_key", k)
        return rows.select(key, X.text_key(F.col("text")).alias("_key")).join(found, "_key").drop("_key")

    def joined_matches(self, rows: DataFrame, key: str, k: int = 3) -> DataFrame:
        """The same by a join on features, for a corpus of any size.

        Rows are dealt by key first. Where Spark broadcasts the index, the sum and the ranking then need no further
        shuffle; else it shuffles by feature and splits skewed ones.
        """
        dealt = rows.select(key, "text").repartition(F.col(key))
        mine = weighted(feature_counts(dealt, key), key, self.df, self.size)
        theirs = self.vectors.select("feature", "corpus_idx", F.col("weight").alias("other"))
        cosine = mine.join(theirs, "feature").groupBy(key, "corpus_idx").agg(F.sum(F.col("weight") * F.col("other")).alias("cosine"))
        order = W.partitionBy(key).orderBy(F.round("cosine", 12).desc(), "corpus_idx")
        ranked = cosine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select(key, "rank", "corpus_idx", F.least("cosine", F.lit(1.0)).alias("cosine"))
