"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass dynamic program.

The automaton reads a text once. At each place its output links name every piece that ends there, longest first, and
each of them is relaxed from the place where it begins. For a unigram model the best sum of scores wins (Viterbi). A BPE
model's scores are merge ranks, and the best sum of ranks is not what its encoder yields. There a piece is taken if and
only if the encoder, given that piece and the one before it, would keep both; exactly one piece at each place passes,
and the result is what the library gives. Characters without a piece are spelled in byte pieces.

No piece spans a blank that is not at its start, nor a character that is in no longer piece, so texts fall into units
that are encoded alone; a worker keeps the ids of the units it has seen. Texts are encoded whole.

Defined results: a null text counts as empty, and an empty text has no pieces; repeated rows are encoded each; a text
with the meta symbol itself (U+2581) decodes to blanks there, which `exact` reports; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import column, pack, with_columns_of

MODEL = "piece_bpe_32k.model"
#: Units that each of a worker's two generations keeps, pairs of pieces kept, and the longest unit kept.
CACHED, PAIRS, CACHED_KEY = 1 << 18, 1 << 19, 64
_META = "▁"
_loaded: dict[str, "Pieces"] = {}


class Pieces:
    """A model file: vocabulary, automaton, encoder and decoder."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self._set([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type == 2, model.normalizer_spec.add_dummy_prefix)

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], bpe: bool, prefix: bool = True) -> Pieces:
        """A model from (piece, score, type) as in a model file: type 1 normal, 2 unknown, 3 control, 6 byte."""
        self = cls.__new__(cls)
        self._set(pieces, bpe, prefix)
        return self

    def _set(self, pieces: list[tuple[str, float, int]], bpe: bool, prefix: bool) -> None:
        self.bpe, self.prefix = bpe, prefix
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == 2), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (1, 4)}
        self.text = [p for p, _, _ in pieces]
        self.score = [s for _, s, _ in pieces]
        self.raw = [bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else p.replace(_META, " ").encode() for p, _, kind in pieces]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.singles = {p for p in self.ids if len(p) == 1}
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        self.units = re.compile(f"{_META}+[^{_META}\n]*|\n|[^{_META}\n]+" if "\n" not in joined and not any(_META in p.lstrip(_META) for p in self.ids) else r"(?s).+")
        self.kept: dict[str, bytes] = {}  # units seen since the last change of generation; each decodes to itself
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}  # by 32-bit halves: the piece before plus 2, the piece
        self.lowest = min((s for s in self.score), default=0.0) - 10.0

    def merge(self, text: str) -> list[str]:
        """The merges of a BPE encoder: always the best-scored adjacent pair, of equal ones the leftmost. A heap of pairs
        over linked parts, so that long runs of one character take n log n steps."""
        parts: list[str | None] = list(text)
        before, after, heap = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1], []

        def propose(at: int) -> None:
            to = after[at]
            if to >= 0 and (i := self.ids.get(parts[at] + parts[to])) is not None:
                heapq.heappush(heap, (-self.score[i], at, to, i))

        for k in range(len(parts) - 1):
            propose(k)
        while heap:
            _, at, to, i = heapq.heappop(heap)
            if parts[at] is None or after[at] != to or parts[at] + parts[to] != self.text[i]:
                continue  # one of the two has changed meanwhile
            parts[at], parts[to], after[at] = self.text[i], None, after[to]
            if after[to] >= 0:
                before[after[to]] = at
            propose(at)
            if before[at] >= 0:
                propose(before[at])
        return [p for p in parts if p is not None]

    def stays(self, before: int, piece: int) -> bool:
        """Whether a BPE encoder keeps the piece after the one before it (-1: at the start; -2: no piece)."""
        want = [self.text[i] for i in (before, piece) if i >= 0]
        if len(want) == 2 and want[0] + want[1] in self.ids:  # they would merge
            self.pairs[(before + 2) << 32 | piece] = False
            return False
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[(before + 2) << 32 | piece] = self.merge("".join(want)) == want
        return known

    def chain(self, unit: str) -> list[int] | None:
        """BPE pieces of a unit, in one pass over the automaton's matches; None if they don't reach its end."""
        n = len(unit)
        last: list[int | None] = [None] * (n + 1)  # the piece that ends at each place; -2: a character without one
        last[0] = -1
        start, pairs, plain, done = [0] * (n + 1), self.pairs, self.singles.issuperset(unit), 0
        for end, (length, piece) in self.automaton.iter(unit):
            end += 1
            if not plain:
                for at in range(done + 1, end):  # places between matches: characters without a piece
                    if last[at] is None and unit[at - 1] not in self.singles:
                        last[at], start[at] = -2, at - 1
                done = end - 1
            if last[end] is None:
                before = last[end - length]
                if before is not None:
                    keep = pairs.get((before + 2) << 32 | piece)
                    if keep is None:
                        keep = self.stays(before, piece)
                    if keep:
                        last[end], start[end] = piece, end - length
        if not plain:
            for at in range(done + 1, n + 1):
                if last[at] is None and unit[at - 1] not in self.singles:
                    last[at], start[at] = -2, at - 1
        if last[n] is None:
            return None
        out: list[int] = []
        while n:
            if last[n] >= 0:
                out.append(last[n])
            else:
                out += self.spell(unit[n - 1])[::-1]
            n = start[n]
        return out[::-1]

    def viterbi(self, unit: str) -> list[int]:
        """Unigram pieces of a unit: at each place the best sum of scores."""
        n = len(unit)
        last, start, best = [-2] * (n + 1), [0] * (n + 1), [0.0] + [-np.inf] * n
        found: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(unit):
            found[end + 1].append(match)
        for end in range(1, n + 1):
            for length, piece in found[end]:
                if best[end - length] + self.score[piece] > best[end]:
                    last[end], start[end], best[end] = piece, end - length, best[end - length] + self.score[piece]
            if best[end - 1] + self.lowest > best[end] and unit[end - 1] not in self.singles:
                last[end], start[end], best[end] = -2, end - 1, best[end - 1] + self.lowest
        out: list[int] = []
        while n:
            out += [last[n]] if last[n] >= 0 else self.spell(unit[n - 1])[::-1]
            n = start[n]
        return out[::-1]

    def merged(self, unit: str) -> list[int]:
        return [i for part in self.merge(unit) for i in ([self.ids[part]] if part in self.ids else self.spell(part))]

    def encode_unit(self, unit: str) -> list[int]:
        if not self.bpe:
            return self.viterbi(unit)
        # merges of equal score, as in runs of blanks, are not settled by neighbours: there the merges decide
        ids = None if unit.startswith(_META * 2) else self.chain(unit)
        return self.merged(unit) if ids is None else ids

    def spell(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers in a row; afterwards `doubt` tells whether a unit did not decode to
        itself."""
        self.doubt = False
        if not text:
            return b""
        units = self.units.findall((_META if self.prefix else "") + text.replace(" ", _META))
        try:
            return b"".join(map(self.kept.__getitem__, units))
        except KeyError:
            return b"".join([self.kept.get(u) or self.learn(u) for u in units])

    def learn(self, unit: str) -> bytes:
        """The ids of a unit that the younger generation lacks. Only units that decode to themselves are kept."""
        ids = self.older.get(unit)
        if ids is None:
            numbers = self.encode_unit(unit)
            ids = array("i", numbers).tobytes()
            if self.spelled(numbers) != unit.replace(_META, " "):
                self.doubt = True
                return ids
            if len(unit) > CACHED_KEY:
                return ids
        if len(self.kept) >= CACHED:
            self.older, self.kept = self.kept, {}
        self.kept[unit] = ids
        return ids

    def checked(self, text: str) -> tuple[bytes, bool]:
        """The ids of a text, and whether they decode to it. Units decode on their own and each has been decoded, so
        only texts with a doubtful one, or with the meta symbol in them, are decoded whole."""
        ids = self.encode(text)
        return ids, not (self.doubt or _META in text) or self.decode(np.frombuffer(ids, np.int32).tolist()) == text

    def spelled(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        text = self.spelled(ids)
        return text[1:] if self.prefix and text.startswith(" ") else text


def loaded(name: str) -> Pieces:
    if name not in _loaded:
        import public_tokenizers

        _loaded[name] = Pieces(public_tokenizers.path(name))
    return _loaded[name]


def _encode(model: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = loaded(model)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                texts = pc.fill_null(column(part, "text"), "").to_pylist()
                coded = [tool.checked(t) for t in texts]
                exact = [sure for _, sure in coded]
                rows = [np.frombuffer(c, np.int32) for c, _ in coded]
                ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([column(part, "rest"), pa.array(np.diff(ends).astype(np.int64)), ids, pa.array(exact, pa.bool_())], names=["rest", "n_tokens", "ids", "exact"])
        tool.older = {}  # an idle worker holds one generation

    return run


def encode(docs: DataFrame, model: str = MODEL, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, ids and whether they decode to the very text."""
    packed = pack(with_columns_of(docs, id=id_col, text=text_col))
    out = T.StructType([packed.schema["rest"], *T.StructType.fromDDL("n_tokens long, ids array<int>, exact boolean").fields])
    return packed.mapInArrow(_encode(model), out).select(F.col("rest.id").alias(id_col), "n_tokens", "ids", "exact")


def _decode(model: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = loaded(model)
        for batch in batches:
            texts = [tool.decode(i or []) for i in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "rest"), pa.array(texts, pa.string())], names=["rest", "text"])

    return run


def decode(encoded: DataFrame, model: str = MODEL, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the text that its ids spell (null: empty)."""
    packed = encoded.select(F.struct(F.col(f"`{id_col}`").alias("id")).alias("rest"), F.col(f"`{ids_col}`").alias("ids"))
    return packed.mapInArrow(_decode(model), T.StructType([packed.schema["rest"], T.StructField("text", T.StringType())])).select(F.col("rest.id").alias(id_col), "text")


def op6_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
