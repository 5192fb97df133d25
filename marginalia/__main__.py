"""python -m marginalia PROJECTS --corpus FOLDER --out FOLDER: audits every project folder under PROJECTS."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import AuditConfig
from .lexicons import read_phrases
from .plans.audit import audit_projects
from .sources import sinks
from .sources.corpus import read_corpus
from .sources.tex import read_projects


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="marginalia", description=__doc__)
    parser.add_argument("projects")
    parser.add_argument("--corpus")
    parser.add_argument("--out", required=True)
    parser.add_argument("--matches", type=int, default=AuditConfig.max_matches)
    parser.add_argument("--min-sentence-chars", type=int, default=AuditConfig.min_sentence_chars)
    parser.add_argument("--lexicon", help="a JSON file with phrases by category")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("marginalia").getOrCreate()
    config = AuditConfig(max_matches=given.matches, min_sentence_chars=given.min_sentence_chars, phrases=read_phrases(given.lexicon) if given.lexicon else None)
    audit = audit_projects(read_projects(spark, given.projects), read_corpus(spark, given.corpus) if given.corpus else None, config)
    sinks.write_csv(audit.facts, f"{given.out}/audit_csv")
    sinks.write_json(audit.facts, audit.summary(), f"{given.out}/audit_json")
    sinks.audit_payload(audit).write.parquet(f"{given.out}/review")


if __name__ == "__main__":
    main()
