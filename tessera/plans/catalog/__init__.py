"""Registry of named queries over the driver tables.

Each entry pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` with an
equivalent DuckDB SQL text (or ``None`` when the operator is not expressible
in SQL, e.g. iterative model fitting).  ``__spark_entry__`` exposes both.
Doubles are rounded to 6 places on both sides so engines compare equal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    section: str


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, section: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, section)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    from . import (  # noqa: F401  (registration side effects)
        q_aggs,
        q_clean,
        q_eval,
        q_joins,
        q_ml,
        q_pipelines,
        q_resample,
        q_scalars,
        q_seq,
        q_sources,
        q_stats,
        q_text,
    )
    return REGISTRY
