"""Parquet tables of a folder, one file or directory per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corroborate.session import table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name. Timestamps without a zone are read as instants in UTC, the session's zone."""
    df = spark.read.parquet(table_path(sf_dir, name))
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df
