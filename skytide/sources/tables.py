"""Readers of the Parquet tables, with only the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def instants(df: DataFrame) -> DataFrame:
    """df with zoneless timestamps as instants in UTC."""
    zoneless = {f.name: F.col(f"`{f.name}`").cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(zoneless) if zoneless else df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of a data folder. Zoneless timestamps become instants in UTC."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return instants(df.select(*columns) if columns else df)
