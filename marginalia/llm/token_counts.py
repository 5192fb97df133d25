"""Token counts by a map-side two-tier lookup.

Tier one is a compact table, pre-token to number of tokens, of the pre-tokens that are frequent in a bounded sample; it
is broadcast. Tier two is a cache in each worker: a miss is encoded by the library once and kept. Byte-level BPE never
merges across pre-tokens, so a text's count is the sum over its pre-tokens, and no pre-token is ever shuffled. The
sample decides only what is fast; every text is counted whole and exactly.

Defined results: a null text counts as empty; empty texts have no tokens; repeated rows count each; special strings are
split off first, as the library does by default; further columns of the input are ignored.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import column, with_columns_of

#: Rows of the sample and entries of the broadcast table, of a worker's cache, and bytes of its keys.
SAMPLE_ROWS, FREQUENT, CACHED, CACHED_KEY = 4096, 1 << 16, 1 << 19, 64
#: Scripts in which the pattern's engine here knows letters that the library's does not; texts with them go to the library whole.
NEWER = regex.compile("[\U00011DB0-\U00016FFF]")
_loaded: dict[str, "Counted"] = {}


class Counted:
    """A tokenizer of the library with a worker's cache of pre-token lengths."""

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.lengths: dict[str, int] = {}

    def encode(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special strings stand between them."""
        if not self.special or not self.special.search(text):
            return self.pattern.findall(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.pattern.findall(part)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        if len(self.lengths) > CACHED:
            self.lengths.clear()
        lengths, out = self.lengths, []
        for text in texts:
            if NEWER.search(text):
                out += self.encode([text])
                continue
            pieces, total = self.pieces(text)
            try:
                total += sum(map(lengths.__getitem__, pieces))
            except KeyError:
                missing = list({p for p in pieces if p not in lengths})
                new = dict(zip(missing, self.encode(missing), strict=True))
                lengths.update((p, n) for p, n in new.items() if len(p) <= CACHED_KEY)
                total += sum(new[p] if p in new else lengths[p] for p in pieces)
            out.append(total)
        return out


def counted(path: str) -> Counted:
    if path not in _loaded:
        _loaded[path] = Counted(path)
    return _loaded[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def frequent_lengths(texts: DataFrame, name: str) -> dict[str, int]:
    """Of a bounded sample, spread over the whole input, the most frequent pre-tokens and their numbers of tokens."""
    rows = texts.count()
    if rows > SAMPLE_ROWS:
        texts = texts.sample(False, 1.2 * SAMPLE_ROWS / rows, 7)
    tool, seen = counted(tokenizer_path(name)), Counter()
    for r in texts.where(F.col("text").isNotNull()).limit(SAMPLE_ROWS).toLocalIterator():
        seen.update(tool.pieces(r.text)[0])
    top = [p for p, _ in seen.most_common(FREQUENT) if len(p) <= CACHED_KEY]
    return dict(zip(top, tool.encode(top), strict=True))


def _count(name: str, table: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counted(tokenizer_path(name))
        if len(tool.lengths) < len(table.value):
            tool.lengths = table.value | tool.lengths
        for batch in batches:
            texts = pc.fill_null(column(batch, "text"), "")
            sizes = pc.binary_length(texts).cast(pa.int64())
            counts: list[int] = []
            for at in range(0, len(texts), 256):
                counts += tool.count(texts.slice(at, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8) and n_tokens of every row, as the library for the tokenizer file counts them."""
    docs = with_columns_of(docs, id=id_col, text=text_col)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs.select("text"), tokenizer))
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(_count(tokenizer, table), f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("over_limit", F.col("n_tokens") > 512)
