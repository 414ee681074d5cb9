"""Registers ``corpus_pipeline.run`` as the query ``pipeline``."""

from __future__ import annotations

import corpus_pipeline

from .registry import QUERIES, SQL

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
