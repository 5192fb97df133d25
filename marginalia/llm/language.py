"""Language identification of pages by Bayesian evidence fusion.

Evidence of a page: the likelihood of its visible text under byte-trigram models, one per language, counted over all
labelled documents; the language that its markup declares; the suffix of its host; and a prior of its host, smoothed
towards the host's domain, and that towards all pages. How much a declaration or a suffix says is counted too, by
grouped aggregation of the text's own posteriors; a page's own share is taken out of every count before it is used. The
log evidence is summed and normalised.

Counts cover all documents and pages and are sums, so they are pre-aggregated before any shuffle. Every label takes part:
the driver holds one trigram table per language (2 ** BITS numbers), and texts are scored against BLOCK languages at a
time, a broadcast and a pass each; likelihoods are merged before they are compared.

Defined results: a null page or one without text falls back on the other evidence; without labelled documents the
language is null and the probability 0; null languages in the labels are ignored; repeated pages count each; pages
without a host share the empty one; ties go to the alphabetically first language; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import column, materialize, raw_bytes, slices, with_columns_of

BITS, BLOCK = 14, 256
#: Pseudo-counts: of a trigram, of a host's and a domain's prior, of what a declaration or suffix says. Trigrams of a
#: text depend on each other, so their log-likelihood is tempered.
TRIGRAM, HOST, DOMAIN, CLUE, TEMPER = 0.5, 8.0, 32.0, 4.0, 0.25
#: Elements whose content is not shown, and where they end.
_HIDDEN = {n: re.compile(rf"(?i)</{n}\s*>") for n in ("script", "style", "nav", "noscript")}
_OPENS = re.compile(r"(?i)(script|style|nav|noscript)\b")
_HTML, _LANG = re.compile(r"(?i)<html\b"), re.compile(r"(?i)\blang\s*=\s*[\"']?([a-z]{2,8})")
_SEEN = ["id", "host", "domain", "suffix", "declared", "text", "ll"]
_ENTITY = re.compile(r"&[#\w]{1,10};")


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all texts in lower case, and the text of each; none crosses texts."""
    data, offsets = raw_bytes(texts)
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    low[(low < 97) | ((low > 122) & (low < 128))] = 32
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (low[:-2].astype(np.uint32) << 16) | (low[1:-1].astype(np.uint32) << 8) | low[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = of[:-2] == of[2:]
    blank = code == 0x202020
    return bucket[inside & ~blank], of[:-2][inside & ~blank]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of a partition, one row a language."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for at, to in slices(column(batch, "text")):
            part = batch.slice(at, to - at)
            names = np.array(column(part, "lang").to_pylist(), object)
            bucket, of = trigrams(column(part, "text"))
            kinds, which = np.unique(names.astype(str), return_inverse=True)
            both = np.bincount(which[of] * (1 << BITS) + bucket, minlength=len(kinds) << BITS).reshape(len(kinds), -1)
            for k, name in enumerate(kinds.tolist()):
                total[name] = total.get(name, 0) + both[k]
    for name, counts in total.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["lang", "bucket", "n"])


class Model:
    """log P(trigram | language) of every bucket, in blocks of languages."""

    def __init__(self, langs: list[str], blocks: list[np.ndarray]):
        self.langs, self.blocks = langs, blocks or [np.zeros((1 << BITS, 0), np.float32)]


def log_shares(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + TRIGRAM) / (counts + TRIGRAM).sum(axis=1, keepdims=True)).astype(np.float32).T


def likelihoods(log: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Tempered, of each text under each language of a block."""
    bucket, of = trigrams(texts)
    return TEMPER * np.column_stack([np.bincount(of, log[bucket, k], len(texts)) for k in range(log.shape[1])]) if log.shape[1] else np.zeros((len(texts), 0))


def from_best(ll: np.ndarray) -> np.ndarray:
    return ll - ll.max(axis=1, keepdims=True) if ll.size else ll


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram counts over all labelled documents."""
    rows = with_columns_of(labelled, lang=lang_col, text=text_col).where("lang is not null and text is not null").select(F.lower("lang").alias("lang"), "text")
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = materialize(counts)
    langs, blocks = sorted(r.lang for r in counts.select("lang").distinct().collect()), []
    for at in range(0, len(langs), BLOCK):
        place = {name: k for k, name in enumerate(langs[at : at + BLOCK])}
        table = np.zeros((len(place), 1 << BITS))
        for r in counts.where(F.col("lang").isin(list(place))).toLocalIterator():
            table[place[r.lang], r.bucket] = r.n
        blocks.append(log_shares(table))
    return Model(langs, blocks)


def visible(html: str) -> str:
    """The text outside of tags, comments and hidden elements; what never ends is no tag. One pass: what is not found from
    one place on is not looked for again."""
    out, at, never = [], 0, set()

    def end_of(name: str, place: int) -> int:
        """Where `name` next ends, or -1."""
        if name in never:
            return -1
        if name in _HIDDEN:
            found = _HIDDEN[name].search(html, place)
            end = found.end() if found else -1
        else:
            found = html.find(name, place)
            end = found + len(name) if found >= 0 else -1
        if end < 0:
            never.add(name)
        return end

    while (tag := html.find("<", at)) >= 0:
        end = end_of("-->", tag + 4) if html.startswith("<!--", tag) else -1
        if end < 0 and (opens := _OPENS.match(html, tag + 1)):
            end = end_of(opens[1].lower(), opens.end())
        if end < 0:
            end = end_of(">", tag + 1)
        if end < 0:
            break
        out += [html[at:tag], " "]
        at = end
    return _ENTITY.sub(" ", "".join([*out, html[at:]]))


def declared_language(html: str) -> str:
    """The primary subtag that an html tag declares, in lower case; empty if none does."""
    at = 0
    while found := _HTML.search(html, at):
        at = html.find(">", found.end())
        at = len(html) if at < 0 else at
        if lang := _LANG.search(html, found.end(), at):
            return lang[1].lower()
    return ""


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _evidence(block: object, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Clues and likelihoods under the first block; the visible text goes on to further blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                html, urls = [h or "" for h in column(part, "html").to_pylist()], column(part, "url").to_pylist()
                declared = [declared_language(h) for h in html]
                hosts = [host_of(u) for u in urls]
                texts = pa.array([visible(h) for h in html], pa.string())
                ll = likelihoods(block.value, texts)
                ll, texts = (from_best(ll), pa.nulls(len(part), pa.string())) if last else (ll, texts)
                yield pa.RecordBatch.from_arrays(
                    [column(part, "id"), pa.array(hosts), pa.array([".".join(h.split(".")[-2:]) for h in hosts]), pa.array([h.rpartition(".")[2] for h in hosts]), pa.array(declared), texts, pa.array(list(ll), pa.list_(pa.float64()))],
                    names=_SEEN,
                )

    return run


def _further(block: object, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Likelihoods under one more block, after those so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = column(part, "text")
                ll = np.hstack([np.array(column(part, "ll").to_pylist()), likelihoods(block.value, texts)])
                ll, texts = (from_best(ll), pa.nulls(len(part), pa.string())) if last else (ll, texts)
                yield pa.RecordBatch.from_arrays([*[column(part, c) for c in _SEEN[:-2]], texts, pa.array(list(ll), pa.list_(pa.float64()))], names=_SEEN)

    return run


def identify(pages: DataFrame, model: Model, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, host, declared, text_lang (text alone), lang, probability."""
    spark, n = pages.sparkSession, len(model.langs)
    raw = with_columns_of(pages, id=id_col, url=url_col, html=html_col)
    kind = raw.schema["id"].dataType.simpleString()
    fields, last = f"id {kind}, host string, domain string, suffix string, declared string, text string, ll array<double>", len(model.blocks) - 1
    seen = raw.mapInArrow(_evidence(spark.sparkContext.broadcast(model.blocks[0]), not last), fields)
    for k, block in enumerate(model.blocks[1:], 1):
        seen = materialize(seen).mapInArrow(_further(spark.sparkContext.broadcast(block), k == last), fields)
    seen = seen.drop("text")
    # the text's own posterior under equal priors: what all counts are sums of
    odds = F.transform("ll", F.exp)
    share = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    seen = materialize(seen.withColumn("post", F.transform(odds, lambda x: x / share)))
    if not n:
        return seen.select(F.col("id").alias(id_col), "host", "declared", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"))

    def sums(*by: str) -> DataFrame:
        return seen.groupBy(*by).agg(F.array(*[F.sum(F.get("post", k)) for k in range(n)]).alias("_".join(["n", *by])))

    langs = F.array(*[F.lit(x) for x in model.langs])
    everything = seen.agg(*[F.sum(F.get("post", k)).alias(f"n{k}") for k in range(n)]).first()
    overall = F.array(*[F.lit(float(everything[k] or 0.0)) for k in range(n)])
    # hosts and domains are written first: a join of plain rows can be split where one host has many pages
    out = seen.join(materialize(sums("host")), "host").join(materialize(sums("domain")), "domain").join(sums("declared"), "declared").join(sums("suffix"), "suffix")

    total = lambda counts: F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    less = lambda counts: F.transform(F.arrays_zip(F.col(counts).alias("c") if isinstance(counts, str) else counts.alias("c"), F.col("post").alias("p")), lambda z: F.greatest(F.lit(0.0), z["c"] - z["p"]))

    def smoothed(out: DataFrame, name: str, counts: F.Column, parent: str | None, weight: float) -> DataFrame:
        """Adds the column `name`: shares of the counts without this page, drawn towards the parent's."""
        out = out.withColumn("_c", less(counts))
        base = F.col(parent) if parent else F.array_repeat(F.lit(1.0 / n), n)
        out = out.withColumn("_b", base).withColumn("_t", total(F.col("_c")) + weight)
        return out.withColumn(name, F.zip_with("_c", "_b", lambda c, b: (c + weight * b) / F.col("_t"))).drop("_c", "_b", "_t")

    out = smoothed(out, "global", overall, None, 1.0)
    out = smoothed(out, "by_domain", F.col("n_domain"), "global", DOMAIN)
    out = smoothed(out, "prior", F.col("n_host"), "by_domain", HOST)
    # P(clue | language) is P(language | clue) * P(clue) / P(language): the clue's own share cancels out
    out = smoothed(out, "by_declared", F.col("n_declared"), "global", CLUE)
    out = smoothed(out, "by_suffix", F.col("n_suffix"), "global", CLUE)
    log = lambda c: F.transform(c, lambda x: F.log(F.greatest(x, F.lit(1e-12))))
    ratio = lambda a: F.zip_with(log(F.col(a)), log(F.col("global")), lambda x, y: x - y)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    score = add(add(add(F.col("ll"), log(F.col("prior"))), ratio("by_declared")), ratio("by_suffix"))
    out = out.withColumn("score", score).withColumn("best", F.array_max("score"))
    norm = F.aggregate(F.transform("score", lambda x: F.exp(x - F.col("best"))), F.lit(0.0), lambda a, x: a + x)
    first = lambda c, m: F.get(langs, F.array_position(c, m).cast("int") - 1)
    has_text = F.array_max("ll") > F.array_min("ll")
    return out.select(
        F.col("id").alias(id_col), "host", "declared", F.when(has_text | F.lit(n == 1), first(F.col("ll"), F.array_max("ll"))).alias("text_lang"), first(F.col("score"), F.col("best")).alias("lang"), (1.0 / norm).alias("probability")
    )


def op8_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)
