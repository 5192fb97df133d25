"""Words of whole texts as 64-bit fingerprints, for many texts at once.

A word is a longest run of ASCII letters and digits and of any characters beyond ASCII, with A-Z in lower case. In UTF-8
every byte of a character beyond ASCII is at least 0x80, so words are found on bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .scratch import mix, raw_bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[_LOWER]
_BASE = 0x2545F4914F6CDD1D
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept per worker and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word; no word crosses from one text into the next."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _WORD[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A fingerprint of the bytes of each span: differences of one running polynomial, brought to a common power."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * powers(_BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_UNBASE, len(data) + 1)[starts])


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words in a row, and the offsets of each text in them (null: no words)."""
    data, offsets = raw_bytes(texts)
    starts, ends = spans(data, offsets)
    return fingerprints(data, starts, ends), np.searchsorted(starts, offsets, side="left").astype(np.int64)


def shingles(fp: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the n-word shingles of each text and the text each belongs to.

    A text of fewer than n words, but not none, has one shingle: all its words.
    """
    counts = np.diff(offsets)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(fp)) - np.repeat(offsets[:-1], counts)
    width = np.minimum(counts, n)
    keep = place <= np.repeat(counts - width, counts)
    at, of = np.flatnonzero(keep), doc[keep]
    short = width[of] < n
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        part = fp[np.minimum(at + k, max(len(fp) - 1, 0))] if len(fp) else total
        step = mix(part + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))
        total += np.where(short & (k >= width[of]), np.uint64(0), step)
    return mix(total), of
