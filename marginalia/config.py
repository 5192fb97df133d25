"""Settings of an audit."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class AuditConfig:
    """Thresholds and weights; lengths are in characters. phrases: by category, in place of the lexicon's own."""

    max_matches: int = 3
    min_sentence_chars: int = 25
    min_tokens_for_overlap: int = 5
    phrase_ngrams: tuple[int, int] = (3, 5)
    overlap_weights: dict[str, float] = field(default_factory=lambda: {"vector": 0.45, "lexical": 0.25, "rare": 0.25, "boilerplate": -0.15})
    rhetoric_weights: dict[str, float] = field(default_factory=lambda: {"phrase": 0.35, "thinness": 0.25, "shift": 0.20, "smoothness": 0.10, "classifier": 0.10})
    phrases: dict[str, list[str]] | None = None


#: Not configurable: characters of a corpus sentence and of a paragraph at least.
MIN_CORPUS_CHARS, MIN_PARAGRAPH_CHARS = 25, 20
#: Where findings and category totals, flags, suspicion and the bands begin.
FINDING, CATEGORY, FLAGGED, SUSPICIOUS, HIGH, MEDIUM = 0.25, 0.25, 0.6, 0.45, 0.75, 0.45
MAX_SPANS, TOP_SENTENCES, TOP_CATEGORIES, SHOWN_PHRASES = 24, 5, 4, 5
