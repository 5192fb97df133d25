"""Quality classifier: a linear-chain conditional random field labels every line of a text good or bad.

A line's potentials come from tables over binned figures of the line itself, of the line before and of the line after;
the chain adds what it costs to change or keep the label. Forward-backward gives each line's marginal probability of
good, and their mean weighted by line length is the score of the text. Labels exist for documents only, so in training
all lines of a document carry its label. The mean is brought to the scale of the labels by a two-parameter logistic.

Fitting uses at most `sample_rows` labelled rows, taken by a hash over all of them. Everything else covers whole texts
and all rows, in one map-only pass. Neither labels nor lang, source or id enter a score.

Defined results: a null text counts as empty, and an empty text is one empty line and gets a score; without any
labelled row the score is 0.5; repeated rows are scored each; null labels are ignored, of rows that share an id the least text is learnt from; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import column, pack, raw_bytes, slices, unpack, with_columns_of
from .words import fingerprints, spans

#: Labelled rows that a model is fitted on at most; bins of a figure; the threshold of `predicted`.
SAMPLE_ROWS, BINS, THRESHOLD = 4096, 12, 0.3
#: Where the bins of a figure end, as shares of the sample's lines: junk is rare, so the tails are fine.
LEVELS = (0.005, 0.02, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.98, 0.995)
FIGURES = ("log_length", "letters", "upper", "digits", "blanks", "points", "symbols", "same_byte", "same_word", "distinct_words", "word_length", "longest_word", "line_again", "first_or_last")


def line_figures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of FIGURES for each line, the offsets of each text's lines, and each line's length in bytes plus one."""
    data, offsets = raw_bytes(texts)
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    # a text that ends in a break is followed by the next text's start: both are line starts at one place, in text order
    of = np.searchsorted(breaks, offsets, side="left") + np.arange(len(offsets))
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    last = of[1:] - 1
    ends[last] = offsets[1:]
    length = (ends - starts).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(of))

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return (total[ends] - total[starts]).astype(np.float32)

    n = np.maximum(length, 1).astype(np.float32)
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    blank = (data == 32) | (data == 9) | (data == 13) | (data == 10)
    point = np.isin(data, np.frombuffer(b".,;:!?'\"()-", np.uint8))
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & ~blank[1:]
    ws, we = spans(data, offsets)
    fp = fingerprints(data, ws, we)
    line = np.searchsorted(starts, ws, side="right") - 1
    words = np.bincount(line, minlength=len(starts)).astype(np.float32)
    many = np.maximum(words, 1)
    again = np.zeros(len(fp), bool)
    again[1:] = (fp[1:] == fp[:-1]) & (line[1:] == line[:-1])
    keys = np.sort((line.astype(np.uint64) << np.uint64(36)) | (fp >> np.uint64(28)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount((keys[new] >> np.uint64(36)).astype(np.int64), minlength=len(starts))
    longest = np.zeros(len(starts), np.float32)
    if len(ws):
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        longest[line[first]] = np.maximum.reduceat(we - ws, first)
    whole = fingerprints(data, starts, ends)
    order = np.lexsort((whole, doc))
    twin = (whole[order][1:] == whole[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    repeated = np.zeros(len(starts), bool)
    repeated[order[1:]] |= twin
    repeated[order[:-1]] |= twin
    edge = np.zeros(len(starts), np.float32)
    edge[of[:-1]] += 1
    edge[last] += 2
    cols = [np.log1p(length), per_line(letter) / n, per_line(upper) / n, per_line(digit) / n, per_line(blank) / n, per_line(point) / n, per_line(~(letter | digit | blank | point)) / n, per_line(same) / n]
    cols += [np.bincount(line[again], minlength=len(starts)) / many, distinct / many, per_line(letter | digit) / many, longest, repeated & (length > 0), edge]
    return np.column_stack(cols).astype(np.float32), of.astype(np.int64), length + 1


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Chain:
    """The random field: edges of the bins, tables of log-odds (this line, before, after) and the two chain weights."""

    def __init__(self, edges: np.ndarray):
        self.edges = edges
        self.tables = np.zeros((3, len(edges), BINS + 1))
        self.stay = np.zeros(2)
        self.bias = 0.0
        self.scale = (1.0, 0.0)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)]).astype(np.int8)

    @staticmethod
    def near(b: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bins of the line before and after; BINS where there is none."""
        before, after = np.full_like(b, BINS), np.full_like(b, BINS)
        before[1:], after[:-1] = b[:-1], b[1:]
        before[of[:-1]] = BINS
        after[of[1:] - 1] = BINS
        return before, after

    def odds(self, views: tuple[np.ndarray, ...]) -> np.ndarray:
        out = np.full(len(views[0]), self.bias)
        for table, b in zip(self.tables, views, strict=True):
            for k in range(b.shape[1]):
                out += table[k][b[:, k]]
        return out

    def marginals(self, odds: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over all texts at once: each line's P(good), log Z of each text, and the expected number of
        kept labels (bad, good) of each text."""
        counts = np.diff(of)
        order = np.argsort(-counts, kind="stable")
        first, counts = of[:-1][order], counts[order]
        up, down = np.zeros((len(odds), 2)), np.zeros((len(odds), 2))
        pot = np.column_stack([np.zeros(len(odds)), odds])
        up[first] = pot[first]
        most = int(counts.max(initial=0))
        live = np.searchsorted(-counts, -np.arange(most), side="left")  # texts of more than t lines
        for t in range(1, most):
            at = first[: live[t]] + t
            p = up[at - 1]
            up[at, 0] = np.logaddexp(p[:, 0] + self.stay[0], p[:, 1])
            up[at, 1] = np.logaddexp(p[:, 0], p[:, 1] + self.stay[1])
            up[at] += pot[at]
        for t in range(most - 2, -1, -1):
            at = first[: live[t + 1]] + t
            q = down[at + 1] + pot[at + 1]
            down[at, 0] = np.logaddexp(q[:, 0] + self.stay[0], q[:, 1])
            down[at, 1] = np.logaddexp(q[:, 0], q[:, 1] + self.stay[1])
        z = np.logaddexp(*up[of[1:] - 1].T)
        line_z = np.repeat(z, np.diff(of))
        good = np.exp(up[:, 1] + down[:, 1] - line_z)
        kept = np.zeros((len(odds), 2))
        inner = np.ones(len(odds), bool)
        inner[of[1:] - 1] = False
        at = np.flatnonzero(inner)
        for s in (0, 1):
            kept[at, s] = np.exp(up[at, s] + self.stay[s] + pot[at + 1, s] + down[at + 1, s] - line_z[at])
        return np.clip(good, 0, 1), z, kept

    def fit(self, x: np.ndarray, of: np.ndarray, length: np.ndarray, label: np.ndarray, rounds: int = 60, rate: float = 0.15, decay: float = 2e-3) -> None:
        """Adam on the conditional likelihood of the lines' labels, each text weighing the same."""
        b = self.bins(x)
        views = (b, *self.near(b, of))
        counts = np.diff(of)
        y, weight = np.repeat(label, counts).astype(float), np.repeat(1 / counts, counts)
        params = np.concatenate([self.tables.ravel(), self.stay, [self.bias]])
        m, v = np.zeros_like(params), np.zeros_like(params)
        n = len(label)
        for step in range(1, rounds + 1):
            self._set(params)
            good, _, kept = self.marginals(self.odds(views), of)
            gap = (y - good) * weight
            grad = np.zeros_like(self.tables)
            for i, view in enumerate(views):
                for k in range(view.shape[1]):
                    grad[i, k] = np.bincount(view[:, k], gap, BINS + 1)
            stayed = np.where(np.diff(of) > 1, np.diff(of) - 1, 0) / counts
            chain = [(stayed * (label == s)).sum() - (kept[:, s] * weight).sum() for s in (0, 1)]
            g = np.concatenate([grad.ravel(), chain, [gap.sum()]]) / n - decay * params
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self._set(params)
        self.calibrate(self.share(b, of, length), label)

    def calibrate(self, share: np.ndarray, label: np.ndarray) -> None:
        """A two-parameter logistic from the share of good text to the label (Newton steps, lightly pulled to identity)."""
        z, w = logit(share), np.array([1.0, 0.0])
        design = np.column_stack([z, np.ones_like(z)])
        for _ in range(25):
            p = 1 / (1 + np.exp(-design @ w))
            slope = design.T @ (label - p) - 2.0 * (w - [1.0, 0.0])
            w = w + np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 2.0 * np.eye(2), slope)
        self.scale = tuple(w) if w[0] > 0 else (1.0, 0.0)

    def share(self, b: np.ndarray, of: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each text's share of good lines, by length."""
        good, _, _ = self.marginals(self.odds((b, *self.near(b, of))), of)
        return np.add.reduceat(good * length, of[:-1]) / np.add.reduceat(length, of[:-1])

    def _set(self, params: np.ndarray) -> None:
        self.tables = params[:-3].reshape(self.tables.shape)
        self.stay, self.bias = params[-3:-1], params[-1]

    def score(self, texts: pa.Array) -> np.ndarray:
        x, of, length = line_figures(texts)
        return 1 / (1 + np.exp(-self.scale[0] * logit(self.share(self.bins(x), of, length)) - self.scale[1]))


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to in slices(column(batch, "text")):
            part = batch.slice(at, to - at)
            x, of, _ = line_figures(column(part, "text"))
            rows = [x[of[k] : of[k + 1]].tobytes() for k in range(len(part))]
            yield pa.RecordBatch.from_arrays([part.column(0), column(part, "label"), pa.array(rows, pa.binary())], names=["id", "label", "x"])


def fit_chain(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Chain:
    """A chain fitted on at most sample_rows rows of labels that have a document."""
    picked = with_columns_of(labels, id=id_col, label=label_col).where("id is not null and label in (0, 1)")
    picked = picked.select("id", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)
    texts = with_columns_of(docs, id=id_col, text=text_col)
    found = texts.join(F.broadcast(picked.distinct()), "id")  # at most sample_rows small rows
    found = found.groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("id", "label", "text")
    rows = sorted(found.mapInArrow(_figures, f"id {found.schema['id'].dataType.simpleString()}, label int, x binary").collect(), key=lambda r: (r.id, r.label))
    if not rows:
        return Chain(np.zeros((len(FIGURES), BINS - 1)))
    parts = [np.frombuffer(r.x, np.float32).reshape(-1, len(FIGURES)) for r in rows]
    x, of = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    chain = Chain(np.quantile(x, LEVELS, axis=0).T)
    chain.fit(x, of, np.rint(np.expm1(x[:, 0])) + 1, np.array([r.label for r in rows]))
    return chain


def _scores(chain: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(column(batch, "text")):
                part = batch.slice(at, to - at)
                score = pa.array(chain.value.score(column(part, "text")), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, score], names=[*part.schema.names, "score"])

    return run


def score_documents(docs: DataFrame, chain: Chain) -> DataFrame:
    """(rest, text, score) from the (rest, text) of pack()."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    return docs.mapInArrow(_scores(sent), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, chain: Chain, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all their columns, that score at least the threshold."""
    return unpack(score_documents(pack(docs, text_col), chain).where(F.col("score") >= threshold), docs.columns, text_col)


def in_training(column: str) -> F.Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) != 0


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Chain:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit_chain(docs, labels.where(in_training("doc_id")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_documents(pack(docs), fitted(spark, docs, sf_dir)).select("rest.doc_id", "score")
    return scored.select("doc_id", F.coalesce(~in_training("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
