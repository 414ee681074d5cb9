"""Queries of this subpackage: ``name -> (spark, sf_dir) -> DataFrame`` and SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def load() -> None:
    from . import (decontaminate, exact_dedup, hard_negatives, lm, mixing, quality, recompress, sharding, simhash,  # noqa: F401
                   suffix_dedup, topk, toxicity, whitening, pipeline_query)


def queries() -> dict:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    load()
    return dict(SQL)
