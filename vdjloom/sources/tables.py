"""The repertoire's own Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; timestamps stay without zone (they are UTC)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str, *columns) -> DataFrame:
    """Each `key` once. A repeated delivery is equal in key and content, so the distinct
    rows of (key, columns) are taken: a hash aggregation with map-side combine that carries
    only the columns the caller uses. Rows without a key are kept apart by their content.
    `columns` are names or columns with an alias."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return df.select(F.col(key), *cols).distinct()
