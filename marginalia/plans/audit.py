"""The audit from texts to the fact table and its roll-ups."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from ..config import AuditConfig
from ..operators import review, rollups
from ..operators.index import CorpusIndex
from ..operators.matching import TYPES
from ..operators.overlap import with_overlap
from ..operators.rhetoric import rhetoric_scores
from ..sources.corpus import corpus_sentences
from ..sources.tex import project_sentences, sentences


def audit_sentences(rows: DataFrame, index: CorpusIndex | None, config: AuditConfig | None = None, fields: tuple[str, ...] = tuple(TYPES)) -> DataFrame:
    """The fact table: sentences (doc_id, ord, text, ...) with both scores and their evidence, `fields` of each match."""
    return with_overlap(rhetoric_scores(rows, config), index, config, fields)


@dataclass
class Audit:
    """All relations of an audit of many documents; each is computed when asked for, from one persisted fact table.

    keep=False: the fact table is not persisted, so that a relation that reads it once computes only what it shows."""

    docs: DataFrame
    rows: DataFrame
    index: CorpusIndex | None = None
    config: AuditConfig | None = None
    keep: bool = True

    @cached_property
    def facts(self) -> DataFrame:
        facts = audit_sentences(self.rows, self.index, self.config)
        return facts.persist() if self.keep else facts

    @cached_property
    def review_rows(self) -> DataFrame:
        return review.review_rows(self.facts, self.docs if "text" in self.docs.columns else None)

    @cached_property
    def paragraphs(self) -> DataFrame:
        return review.review_paragraphs(self.review_rows)

    @cached_property
    def spans(self) -> DataFrame:
        return review.suspicious_spans(self.paragraphs)

    def outline(self) -> DataFrame:
        return review.outline(self.review_rows, self.paragraphs)

    def metrics(self) -> DataFrame:
        return review.metrics(self.review_rows, self.spans, self.docs)

    def summary(self) -> DataFrame:
        return rollups.document_summary(self.facts, self.docs)


def audit_projects(files: DataFrame, corpus: DataFrame | None = None, config: AuditConfig | None = None) -> Audit:
    """Audits TeX projects (doc_id, path, text) against corpus texts (source_path, source_label, text)."""
    config = config or AuditConfig()
    docs, _, rows = project_sentences(files, config.min_sentence_chars)
    index = CorpusIndex(corpus_sentences(corpus), config.phrase_ngrams, config.min_tokens_for_overlap) if corpus is not None else None
    return Audit(docs, rows, index, config)


def audit_paragraphs(paragraphs: DataFrame, corpus: DataFrame | None = None, config: AuditConfig | None = None) -> Audit:
    """Audits texts that are paragraphs already (see sources.tex.plain_paragraphs)."""
    config = config or AuditConfig()
    index = CorpusIndex(corpus_sentences(corpus), config.phrase_ngrams, config.min_tokens_for_overlap) if corpus is not None else None
    return Audit(paragraphs.select("doc_id").distinct(), sentences(paragraphs, config.min_sentence_chars), index, config)
