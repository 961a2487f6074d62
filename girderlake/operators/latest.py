"""The newest, worst or first row of each key (W1 to W7, U5): a window rank and a filter, which Spark cuts early."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """Rows numbered from 1 within their key; ``order`` should end with a unique column."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return numbered(df, keys, order, "_rn").where("_rn = 1").drop("_rn")
