"""Top-k cosine matches and their evidence against a corpus that fits in a worker: one pass over the sentences, no shuffle.

Features of a sentence are numbers made of its words' ids; the products with the corpus vectors are summed for a few
hundred sentences at once. Sums of a sentence are added up in one order, so equal corpus sentences tie exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SHOWN_PHRASES, AuditConfig

_TOKEN, _PLAIN = re.compile("[a-z0-9']+"), re.compile("[a-z0-9]+")
#: Bits of a word's id in the number of a feature; cells of a block of cosines, and its words (a longer sentence is alone).
_BITS, _CELLS, _WORDS = 21, 1 << 18, 1 << 20
#: Words that the corpus lacks keep their ids between blocks up to so many.
_KEPT = 1 << 17
#: Corpus vectors have at most so many entries where they are handed to the workers.
SMALL = 500_000

TYPES = {
    "corpus_idx": ("bigint", pa.int64()), "source_path": ("string", pa.string()), "source_label": ("string", pa.string()), "matched_text": ("string", pa.string()),
    "vector": ("double", pa.float64()), "lexical": ("double", pa.float64()), "rare": ("double", pa.float64()), "phrases": ("array<string>", pa.list_(pa.string())),
}


class _Ids(dict):
    """Ids of words, from 1; a new word gets the next. long: by id, whether the word has more than two letters."""

    def __init__(self) -> None:
        self.long = bytearray(1)

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self) + 1
        self.long.append(len(word) > 2)
        return found

    def __reduce__(self) -> tuple:
        return _Ids, (), {"long": self.long}, None, iter(self.items())

    def shrink(self, size: int) -> None:
        while len(self) > size:
            self.popitem()
        del self.long[size + 1 :]


class Matcher:
    """The corpus as (corpus_idx, source_path, source_label, text, lower-case text), ordered by corpus_idx."""

    def __init__(self, corpus: list[tuple[int, str, str, str, str]], config: AuditConfig):
        self.k, self.least, (self.low, self.high) = config.max_matches, config.min_tokens_for_overlap, config.phrase_ngrams
        self.ids, self.paths, self.labels, self.texts, lowered = (list(c) for c in zip(*corpus, strict=True))
        self.words, self.n = _Ids(), len(corpus)
        lists = [_TOKEN.findall(s) for s in lowered]
        places, words = self._ids(lists)
        rows, codes, counts = self._features(self.n, places, words)
        self.base = len(self.words)
        self.codes, feature, df = np.unique(codes, return_inverse=True, return_counts=True)
        self.idf, self.idf_none = np.log((1.0 + self.n) / (1.0 + df)) + 1.0, np.log(1.0 + self.n) + 1.0
        weight = counts * self.idf[feature]
        weight /= np.sqrt(np.bincount(rows, weight * weight, self.n))[rows]
        order = np.lexsort((rows, feature))
        self.cid, self.weight, self.size = rows[order], weight[order], df
        self.start = np.cumsum(df) - df
        row, word = self._long(places, words)
        self.long, self.long_size = row * (self.base + 1) + word, np.bincount(row, minlength=self.n)
        self.grams = [self._grams(s) for s in lowered]
        self.phrase_df: dict[tuple[str, ...], int] = {}
        for g in chain.from_iterable(self.grams):
            self.phrase_df[g] = self.phrase_df.get(g, 0) + 1

    def _ids(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(row, id) of all words, as they come."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.repeat(np.arange(len(lists)), sizes), np.fromiter(map(self.words.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))

    def _long(self, rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, id) of the distinct words of more than two letters, ordered."""
        some = np.frombuffer(bytes(self.words.long), np.bool_)[words]
        key = np.unique(rows[some] * (len(self.words) + 1) + words[some])
        return key // (len(self.words) + 1), key % (len(self.words) + 1)

    def _features(self, n: int, rows: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number, count) of the distinct uni-, bi- and trigrams of each of n lists of words, ordered by row and number."""
        zero = np.zeros(min(2, len(a)), np.int64)
        two, three = (rows[1:] == rows[:-1]), (rows[2:] == rows[:-2])
        b = np.concatenate([np.where(two, a[1:], 0), zero[:1]])
        c = np.concatenate([np.where(three, a[2:], 0), zero])[: len(a)]
        row = np.concatenate([rows, rows[b > 0], rows[c > 0]])
        parts = [np.concatenate(p) for p in ((a, a[b > 0], a[c > 0]), (0 * a, b[b > 0], b[c > 0]), (0 * a, 0 * b[b > 0], c[c > 0]))]
        code = parts[0] << 2 * _BITS | parts[1] << _BITS | parts[2]
        if len(self.words) >> _BITS:  # one sentence of millions of words: those beyond are none of the corpus's, a hash tells them apart
            mixed = (parts[0] * 0x1E3779B97F4A7C15 + parts[1]) * 0x3F58476D1CE4E5B9 + parts[2]
            code = np.where(np.maximum.reduce(parts) >> _BITS, mixed | np.int64(-1 << 63), code)
        numbers, inverse = np.unique(code, return_inverse=True)
        key, count = np.unique(row * max(1, len(numbers)) + inverse, return_counts=True)
        return key // max(1, len(numbers)), numbers[key % max(1, len(numbers))], count

    def cosines(self, n: int, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
        rows, codes, count = self._features(n, rows, words)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = self.codes[at] == codes
        weight = count * np.where(hit, self.idf[at], self.idf_none)
        norm = np.sqrt(np.bincount(rows, weight * weight, n))
        rows, at = rows[hit], at[hit]
        weight, size = weight[hit] / norm[rows], self.size[at]
        place = np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        cell = np.repeat(rows * self.n, size) + self.cid[place]
        return np.bincount(cell, np.repeat(weight, size) * self.weight[place], n * self.n).reshape(n, self.n)

    def lexical(self, n: int, rows: np.ndarray, words: np.ndarray, of: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Jaccard similarities of the distinct long words of lists and of corpus sentences; 0 if either has too few.
        The pairs are (of, place), those of a list next to each other."""
        row, word = self._long(rows, words)
        mine, theirs = np.bincount(row, minlength=n)[of], self.long_size[place]
        row, word = row[word <= self.base], word[word <= self.base]
        size = np.bincount(row, minlength=n)
        at = np.repeat((np.cumsum(size) - size)[of] - (np.cumsum(size[of]) - size[of]), size[of]) + np.arange(size[of].sum())
        key = np.repeat(place, size[of]) * (self.base + 1) + word[at]
        found = self.long[np.minimum(np.searchsorted(self.long, key), max(0, len(self.long) - 1))] == key if len(self.long) else key < 0
        both = np.bincount(np.repeat(np.arange(len(of)), size[of])[found], minlength=len(of))
        return np.where((mine >= self.least) & (theirs >= self.least), both / np.maximum(1, mine + theirs - both), 0.0)

    def best(self, lists: list[list[str]], lexical: bool = False) -> Iterator[tuple[list[int], list[int], list[float], list[float]]]:
        """The k best of each list, block by block: how many a list has, their places in the corpus, cosines and, if asked
        for, lexical overlaps, one after the other. By twelve digits, ties to the smaller corpus_idx."""
        step = max(1, _CELLS // self.n)
        begin = 0
        while begin < len(lists):
            end, words = begin + 1, len(lists[begin])
            while end < min(len(lists), begin + step) and words + len(lists[end]) <= _WORDS:
                words, end = words + len(lists[end]), end + 1
            if len(self.words) > max(self.base, _KEPT):
                self.words.shrink(self.base)
            n, (rows, ids) = end - begin, self._ids(lists[begin:end])
            block, begin = self.cosines(n, rows, ids), end
            left = np.where(block > 0, np.rint(block * 1e12), -1.0)
            every, tops, values = np.arange(n), [], []
            for _ in range(min(self.k, self.n)):
                top = left.argmax(axis=1)
                tops.append(top)
                values.append(np.where(left[every, top] >= 0, block[every, top], 0.0))
                left[every, top] = -1.0
            value = np.stack(values, 1)
            place, kept = np.stack(tops, 1)[value > 0], (value > 0).sum(1)
            like = self.lexical(n, rows, ids, np.repeat(every, kept), place).tolist() if lexical else []
            yield kept.tolist(), place.tolist(), np.minimum(value[value > 0], 1.0).tolist(), like

    def _grams(self, lowered: str) -> frozenset[tuple[str, ...]]:
        tok = _PLAIN.findall(lowered)
        return frozenset(chain.from_iterable(zip(*[tok[i:] for i in range(n)], strict=False) for n in range(self.low, self.high + 1))) if len(tok) >= self.least else frozenset()

    def _touches(self, tokens: list[str], lowered: str) -> bool:
        """Whether an n-gram of the shortest kind is the corpus's; longer ones hold one of these."""
        tok = _PLAIN.findall(lowered) if "'" in lowered else tokens
        return not self.phrase_df.keys().isdisjoint(zip(*[tok[i:] for i in range(self.low)], strict=False))

    def matches(self, lowered: list[str], fields: tuple[str, ...]) -> dict[str, list]:
        """The fields of all matches, one after the other, and under "n" how many each text has."""
        lists = [_TOKEN.findall(s) for s in lowered]
        out: dict[str, list] = {f: [] for f in (*fields, "n")}
        places = []
        for kept, place, value, like in self.best(lists, "lexical" in out):
            out["n"] += kept
            places += place
            if "vector" in out:
                out["vector"] += value
            if "lexical" in out:
                out["lexical"] += like
        if "rare" in out or "phrases" in out:
            rare, phrases = [0.0] * len(places), [[] for _ in places] if "phrases" in out else []
            end = 0
            for text, tokens, n in zip(lowered, lists, out["n"], strict=True):
                end += n
                grams = self._grams(text) if n and self._touches(tokens, text) else ()
                for k in range(end - n, end) if grams else ():
                    common = grams & self.grams[places[k]]
                    rare[k] = max((0.5 * (1.0 - min(1.0, self.phrase_df[g] / max(self.n, 1))) + 0.5 * min(1.0, len(g) / 5.0) for g in common), default=0.0)
                    if phrases:
                        phrases[k] = sorted(map(" ".join, common), key=lambda p: (-len(p), p))[:SHOWN_PHRASES]
            out |= {f: v for f, v in (("rare", rare), ("phrases", phrases)) if f in out}
        for name, values in (("corpus_idx", self.ids), ("source_path", self.paths), ("source_label", self.labels), ("matched_text", self.texts)):
            if name in out:
                out[name] = [values[c] for c in places]
        return out


def match_column(matcher: Broadcast[Matcher], text: Column, fields: tuple[str, ...] = tuple(TYPES)) -> Column:
    """The matches of a text, in rank order, as an array of structs of `fields`. Equal texts of a batch are matched once."""
    kind = pa.list_(pa.struct([(f, TYPES[f][1]) for f in fields]))

    def run(batch: pa.Array) -> pa.Array:
        coded = batch.dictionary_encode()
        found = matcher.value.matches([s or "" for s in coded.dictionary.to_pylist()], fields)
        ends = pa.array(np.cumsum([0, *found["n"]]), pa.int32())
        rows = pa.StructArray.from_arrays([pa.array(found[f], TYPES[f][1]) for f in fields], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(ends, rows, type=kind).take(coded.indices)

    run.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(run, f"array<struct<{','.join(f'{f}:{TYPES[f][0]}' for f in fields)}>>")
    return udf.asNondeterministic()(F.lower(F.coalesce(text, F.lit(""))))  # so that no filter makes Spark run it twice
