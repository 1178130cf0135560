"""Shared helpers for catalogue entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions._util import r6  # noqa: F401

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def brand_code(c="p_brand"):
    """Driver stand-in for an ICD code: the digits of ``Brand#NN``."""
    return F.regexp_extract(F.col(c), r"#(\d+)", 1)


BRAND_CODE_SQL = "regexp_extract(p_brand, '#(\\d+)', 1)"
