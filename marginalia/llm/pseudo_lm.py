"""Language-model scoring by masked pseudo-likelihood.

Every word is predicted from the WINDOW words on both of its sides. A text's score is the sum of the log-probabilities of
its words.

Counts: every word of every text, summed by word (partial aggregates before the shuffle), in a distributed table that
grows with the words. The FREQUENT most frequent words have entries of their own on every worker; all others share
BUCKETS entries there, and their share of a bucket comes from the table by a join, so that every word has its own count.

Network, in numpy: embeddings of the entries around a word, brought through a matrix for each position, are summed; a
tanh layer; a softmax in two levels, over classes of MEMBERS entries and over the entries of the class, both given the
context. Logits start from the logs of the counts, so an untrained network is the unigram model.

Training: of every text a part of the words, chosen by a hash (MASKED of 1), is masked and learnt in one pass. The masked
words with what surrounds them go to shards of about SHARD_WORDS words by a hash of the row; each shard trains from the
same start in a fixed order, and parameters are averaged by words seen. So scores don't depend on files or partitions.

Defined results: a null text counts as empty; a text without words has score 0, no mean and perplexity null; repeated
rows are counted and scored each; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import column, materialize, mix, slices, with_columns_of
from .words import words

WINDOW, CLASSES, MEMBERS, WIDTH = 2, 128, 256, 16
ENTRIES = CLASSES * MEMBERS
FREQUENT = BUCKETS = ENTRIES // 2
#: One word in MASKED is learnt; words of the corpus in a training shard; words of a step; learning rate; the largest
#: weight, with which a logit stays below 88, where 32-bit floats end.
MASKED, SHARD_WORDS, STEP, RATE, BOUND = 4, 1 << 22, 8192, 0.25, 5.0
_FIELDS = (
    ("embeddings", (ENTRIES + 1, WIDTH)),
    ("places", (2 * WINDOW, WIDTH, WIDTH)),
    ("hidden", (WIDTH,)),
    ("to_class", (WIDTH, CLASSES)),
    ("class_bias", (CLASSES,)),
    ("to_member", (ENTRIES, WIDTH)),
)
_BLOCK, _ROWS = 1 << 12, 512


class Vocabulary:
    """Entries by falling count: MEMBERS at a time make a class. log_own: log of a word's share of its entry, which for
    a bucket lacks the log of the word's own count."""

    def __init__(self, frequent: np.ndarray, frequent_n: np.ndarray, bucket_n: np.ndarray):
        order = np.argsort(frequent)
        self.frequent, self.buckets = frequent[order], len(bucket_n)
        counts = np.zeros(ENTRIES)
        counts[: len(frequent)] = frequent_n[order]
        counts[len(frequent) : len(frequent) + len(bucket_n)] = bucket_n
        by_count = np.argsort(-counts, kind="stable")
        self.rank = np.empty(ENTRIES, np.int64)
        self.rank[by_count] = np.arange(ENTRIES)
        self.is_bucket = np.arange(ENTRIES) >= len(frequent)
        self.is_bucket = self.is_bucket[by_count]
        counts = counts[by_count].reshape(CLASSES, MEMBERS)
        mass = counts.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            self.members = np.maximum(np.log(counts) - np.log(np.maximum(mass, 1)), -30).astype(np.float32)
            self.classes = np.maximum(np.log(mass[:, 0]) - np.log(max(mass.sum(), 1)), -30).astype(np.float32)
            self.log_own = np.where(self.is_bucket, -np.log(np.maximum(counts.ravel(), 1)), 0.0)

    def entries(self, fp: np.ndarray) -> np.ndarray:
        out = (fp & np.uint64(self.buckets - 1)).astype(np.int64) + len(self.frequent)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, fp), len(self.frequent) - 1)
            hit = self.frequent[at] == fp
            out[hit] = at[hit]
        return self.rank[out]


def by_class(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each class that occurs, and where."""
    kind = target // MEMBERS
    order = np.argsort(kind, kind="stable")
    kinds, first = np.unique(kind[order], return_index=True)
    for c, some in zip(kinds.tolist(), np.split(order, first[1:]), strict=True):
        yield c, some


def log_share(x: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Of each row of logits (overwritten) the log of the softmax at one place. Logits are bounded, so exp can't overflow."""
    out = x[np.arange(len(x)), pick]
    return out - np.log(np.exp(x, out=x).sum(axis=1))


def blame(x: np.ndarray, pick: np.ndarray, n: int) -> np.ndarray:
    """The gradient of a mean over n of minus log_share by the logits (overwritten)."""
    np.exp(x, out=x)
    x *= (1 / (n * x.sum(axis=1)))[:, None]
    x[np.arange(len(x)), pick] -= np.float32(1 / n)
    return x


class Network:
    """p(entry of a word | entries around it)."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None):
        if flat is None:
            rng = np.random.default_rng(11)
            scale = {"embeddings": 0.3, "places": WIDTH**-0.5}
            flat = np.concatenate([(rng.standard_normal(shape) * scale[name] if name in scale else np.zeros(shape)).ravel() for name, shape in _FIELDS])
        self.vocabulary, self.flat = vocabulary, np.array(flat, np.float32)
        self.squares = np.full(len(self.flat), 1e-8, np.float32)
        self.views = {}
        at = 0
        for name, shape in _FIELDS:
            size = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + size].reshape(shape))
            self.views[name] = self.squares[at : at + size].reshape(shape)
            at += size

    def forward(self, context: np.ndarray) -> np.ndarray:
        h = np.repeat(self.hidden[None, :], context.shape[1], axis=0)
        for p in range(2 * WINDOW):
            h += self.embeddings[context[p]] @ self.places[p]
        return np.tanh(h, out=h)

    def class_logits(self, h: np.ndarray) -> np.ndarray:
        return h @ self.to_class + (self.class_bias + self.vocabulary.classes)

    def member_logits(self, h: np.ndarray, c: int) -> np.ndarray:
        out = h @ self.to_member[c * MEMBERS : (c + 1) * MEMBERS].T
        out += self.vocabulary.members[c]
        return out

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target in its context. What doesn't depend on them is worked out once, buffers are used again."""
        around = [self.embeddings @ place for place in self.places]
        around[0] += self.hidden
        # a column of ones beside h adds the logs of the counts
        classes = np.vstack([self.to_class, self.class_bias + self.vocabulary.classes])
        members = np.column_stack([self.to_member, self.vocabulary.members.ravel()])
        buffer, out = np.empty((_ROWS, max(CLASSES, MEMBERS)), np.float32), np.empty(len(target))
        for at in range(0, len(target), 1 << 16):
            some = target[at : at + (1 << 16)]
            h = np.ones((len(some), WIDTH + 1), np.float32)
            inner = around[0][context[0, at : at + (1 << 16)]]
            for p in range(1, 2 * WINDOW):
                inner += around[p][context[p, at : at + (1 << 16)]]
            np.tanh(inner, out=h[:, :WIDTH])
            lp = np.empty(len(some))
            for lo in range(0, len(some), _ROWS):
                mine = h[lo : lo + _ROWS]
                x = np.matmul(mine, classes, out=buffer.ravel()[: len(mine) * CLASSES].reshape(len(mine), CLASSES))
                lp[lo : lo + _ROWS] = log_share(x, some[lo : lo + _ROWS] // MEMBERS)
            for c, rows in by_class(some):
                for lo in range(0, len(rows), _ROWS):
                    r = rows[lo : lo + _ROWS]
                    x = np.matmul(h[r], members[c * MEMBERS : (c + 1) * MEMBERS].T, out=buffer.ravel()[: len(r) * MEMBERS].reshape(len(r), MEMBERS))
                    lp[r] += log_share(x, some[r] - c * MEMBERS)
            out[at : at + (1 << 16)] = lp
        return out

    def move(self, name: str, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        """A step down, by Adagrad."""
        squares = self.views[name]
        seen = squares[rows] + gradient * gradient
        squares[rows] = seen
        getattr(self, name)[rows] = np.clip(getattr(self, name)[rows] - RATE * gradient / np.sqrt(seen), -BOUND, BOUND)

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        """One step down the mean cross-entropy of a block of words."""
        n, h = len(target), self.forward(context)
        p = blame(self.class_logits(h), target // MEMBERS, n)
        back = p @ self.to_class.T
        self.move("to_class", h.T @ p)
        self.move("class_bias", p.sum(axis=0))
        for c, rows in by_class(target):
            mine = h[rows]
            p = blame(self.member_logits(mine, c), target[rows] - c * MEMBERS, n)
            members = slice(c * MEMBERS, (c + 1) * MEMBERS)
            back[rows] += p @ self.to_member[members]
            self.move("to_member", p.T @ mine, members)
        back *= 1 - h * h
        self.move("hidden", back.sum(axis=0))
        ahead = [back @ self.places[q].T for q in range(2 * WINDOW)]
        self.move("places", np.stack([self.embeddings[context[q]].T @ back for q in range(2 * WINDOW)]))
        seen = context.ravel()
        order = np.argsort(seen, kind="stable")
        entry, first = np.unique(seen[order], return_index=True)
        self.move("embeddings", np.add.reduceat(np.concatenate(ahead)[order], first, axis=0), entry)


def contexts(entries: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Entries at the places before and after each word; ENTRIES where the text has none."""
    counts = np.diff(offsets)
    padded = np.full(len(entries) + 2 * WINDOW * (len(counts) + 1), ENTRIES, np.int64)
    place = np.arange(len(entries)) + WINDOW * (1 + np.repeat(np.arange(len(counts)), counts))
    padded[place] = entries
    return np.stack([padded[place + d] for d in range(-WINDOW, WINDOW + 1) if d])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to in slices(column(batch, "text")):
            fp, _ = words(column(batch.slice(at, to - at), "text"))
            word, n = np.unique(fp, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def count_vocabulary(texts: DataFrame) -> tuple[Vocabulary, DataFrame, int]:
    """The entries, (word, n) of every word that has none of its own, and how many words there are in all."""
    counts = materialize(texts.mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    top = counts.orderBy(F.col("n").desc(), "word").limit(FREQUENT)
    rows = top.toPandas()
    least = rows.n.min() if len(rows) else 0
    # the rest: below the least frequent entry, or as frequent but later in the order
    last = rows.word[rows.n == least].max() if len(rows) else 0
    rest = counts.where((F.col("n") < int(least)) | ((F.col("n") == int(least)) & (F.col("word") > int(last))))
    buckets = rest.groupBy(F.col("word").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(BUCKETS, np.int64)
    n[buckets.bucket] = buckets.n
    total = int(rows.n.sum() + n.sum())
    return Vocabulary(rows.word.to_numpy(np.int64).view(np.uint64), rows.n.to_numpy(np.int64), n), rest, total


def masked(key: int, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The words of a text that are learnt, each with what surrounds it, a row each; which ones depends on the key."""
    some = mix(np.arange(len(target), dtype=np.uint64) ^ np.uint64(key % (1 << 64))) % np.uint64(MASKED) == 0
    return np.column_stack([target[some], around[:, some].T]).astype(np.uint16)


def _examples(vocabulary: object, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(column(batch, "text")):
                part = batch.slice(at, to - at)
                keys = column(part, "key").to_pylist()
                fp, off = words(column(part, "text"))
                target = vocabulary.value.entries(fp)
                around = contexts(target, off)
                rows = [masked(k, around[:, s:e], target[s:e]).tobytes() for k, s, e in zip(keys, off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([k % shards for k in keys], pa.int32()), pa.array(keys, pa.int64()), pa.array(rows, pa.binary())], names=["shard", "key", "examples"])

    return run


def learn(network: Network, examples: np.ndarray) -> None:
    """One pass over examples, in steps of words from all over them."""
    steps = max(1, len(examples) // STEP)
    for s in range(steps):
        some = examples[s::steps].astype(np.int64)
        if len(some):
            network.step(some[:, 1:].T, some[:, 0])


def _train(vocabulary: object) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A shard in, its parameters out: blocks, times the words seen."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        network = Network(vocabulary.value)
        ordered = rows.sort_values(["key", "examples"])
        examples = np.frombuffer(b"".join(ordered.examples), np.uint16).reshape(-1, 1 + 2 * WINDOW)
        learn(network, examples)
        n = len(examples)
        blocks = [(int(rows.shard.iloc[0]), k, n, (network.flat[at : at + _BLOCK] * np.float32(n)).tobytes()) for k, at in enumerate(range(0, len(network.flat), _BLOCK))]
        return pd.DataFrame(blocks, columns=["shard", "block", "n", "total"])

    return run


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """The sum of some shards' blocks, in a fixed order."""
    rows = rows.sort_values("shard")
    total = np.sum([np.frombuffer(x, np.float32) for x in rows.total], axis=0, dtype=np.float64).astype(np.float32)
    return pd.DataFrame([(int(rows.part.iloc[0]), int(rows.block.iloc[0]), int(rows.n.sum()), total.tobytes())], columns=["shard", "block", "n", "total"])


def train(rows: DataFrame, vocabulary: object, total: int) -> np.ndarray:
    """The averaged parameters, of rows (id, text) with `total` words."""
    shards = max(1, -(-total // SHARD_WORDS))
    keyed = rows.select(F.xxhash64("id", F.coalesce("text", F.lit(""))).alias("key"), "text")
    examples = keyed.mapInArrow(_examples(vocabulary, shards), "shard int, key long, examples binary")
    schema = "shard int, block int, n long, total binary"
    found = materialize(examples.where(F.octet_length("examples") > 0).groupBy("shard").applyInPandas(_train(vocabulary), schema))
    # summed in two levels, so that no task gathers a block of all shards
    groups = max(1, int(shards**0.5))
    parts = found.withColumn("part", F.col("shard") % groups).groupBy("part", "block").applyInPandas(_summed, schema)
    whole = parts.withColumn("part", F.lit(0)).groupBy("part", "block").applyInPandas(_summed, schema)
    flat = Network(vocabulary.value).flat
    for r in whole.toLocalIterator():
        block = np.frombuffer(r.total, np.float32) / r.n
        flat[r.block * _BLOCK : r.block * _BLOCK + len(block)] = block
    return flat


def _score(flat: object, vocabulary: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, row = Network(vocabulary.value, flat.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, to in slices(column(batch, "text")):
                part = batch.slice(at, to - at)
                fp, off = words(column(part, "text"))
                target = vocabulary.value.entries(fp)
                lp = vocabulary.value.log_own[target] + network.log_probability(contexts(target, off), target)
                total = np.concatenate([[0.0], np.cumsum(lp)])
                rare = vocabulary.value.is_bucket[target]
                ends = np.concatenate([[0], np.cumsum(rare)])[off].astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(ends), pa.array(fp[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(part))), column(part, "id"), pa.array(np.diff(off)), pa.array(total[off[1:]] - total[off[:-1]]), rest], names=["row", "id", "n_words", "ll", "rare"])
                row += len(part)

    return run


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, log_likelihood (the sum over its words), mean and perplexity, under a model of docs."""
    rows = with_columns_of(docs, id=id_col, text=text_col)
    texts, sc = rows.select("text"), docs.sparkSession.sparkContext
    entries, rest, total = count_vocabulary(texts)
    vocabulary = sc.broadcast(entries)
    flat = sc.broadcast(train(rows, vocabulary, total))
    kind = rows.schema["id"].dataType.simpleString()
    scored = materialize(rows.mapInArrow(_score(flat, vocabulary), f"row long, id {kind}, n_words long, ll double, rare array<long>"))
    own = scored.select("row", F.explode("rare").alias("word")).join(rest, "word").groupBy("row").agg(F.sum(F.log("n")).alias("own"))
    out = scored.drop("rare").join(own, "row", "left").withColumn("log_likelihood", F.col("ll") + F.coalesce("own", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return out.select(F.col("id").alias(id_col), "n_words", "log_likelihood", mean.alias("mean_log_likelihood"), F.exp(-mean).alias("perplexity"))


def op7_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
