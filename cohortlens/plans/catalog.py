"""Registry of named queries: ``name -> (spark builder, DuckDB oracle SQL or None)``.

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame.  Oracle SQL names
fixture views and helper relations; :func:`oracle.with_ctes` inlines them.
"""

from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .oracle import with_ctes

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register a query builder under ``name`` (``ids``: SURVEY §2 operator ids)."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        SURVEY_IDS[name] = ids
        if sql is not None:
            ORACLE[name] = with_ctes(nudge_rounding(sql))
        return fn
    return deco


# Doubles are reported at 6 decimals after a 1e-9 nudge: values that sit exactly
# on a rounding tie (common with 2-decimal scores averaged over 2^k rows) then
# round the same way even when two engines' sums differ in the last bit.
NUDGE = 1e-9


def nudge_rounding(sql: str) -> str:
    """Oracle side of :func:`round_doubles`: ``round(x, 6)`` -> ``round(x + 1e-9, 6)``."""
    return re.sub(r",\s*6\)", " + 1e-9, 6)", sql)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns (and arrays of them) for engine-independent comparison."""
    out = []
    for f in df.schema.fields:
        t = f.dataType
        c = F.col(f"`{f.name}`")
        if isinstance(t, (DoubleType, FloatType)):
            c = F.round(c.cast("double") + F.lit(NUDGE), digits)
        elif isinstance(t, ArrayType) and isinstance(t.elementType, (DoubleType, FloatType)):
            c = F.transform(c, lambda x: F.round(x.cast("double") + F.lit(NUDGE), digits))
        out.append(c.alias(f.name))
    return df.select(*out)


def load_all() -> None:
    """Import every query module (each registers itself on import)."""
    from . import (q_relational, q_aggregates, q_windows, q_functions, q_reshape,  # noqa: F401
                   q_scores, q_models, q_sources, q_streaming, q_sampling, q_tagger, q_classifier,
                   q_sentences)


def queries() -> dict[str, Builder]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
