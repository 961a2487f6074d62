"""Integrity rules as queries: each rule gives the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules of each relation: a name and a SQL condition that must not be false; null passes, as in a CHECK.
CHECKS = {
    "parts": {"length_positive": "length_m > 10", "span_count_set": "span_count IS NOT NULL"},
    "inspections": {"score_in_range": "tenths BETWEEN 10 AND 38", "dated": "inspected_on IS NOT NULL", "cycle_known": "cycle_months IN (12, 36, 72)"},
    "recommendations": {"urgency_known": "urgency IS NOT NULL", "cost_and_target": "(cost IS NULL) = (target_year IS NULL)"},
    "traffic": {"year_of_date": "year(observed_on) = observation_year", "share": "truck_share <= 18"},
}


def broken_checks(relation: str, df: DataFrame) -> DataFrame:
    """(relation, rule, id) of rows for which a rule is false."""
    rules = F.array(*[F.when(~F.expr(condition), F.lit(name)) for name, condition in CHECKS[relation].items()])
    return df.select(F.lit(relation).alias("relation"), F.explode(F.array_compact(rules)).alias("rule"), F.col("id"))


def missing_parents(relation: str, df: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """(relation, rule, id) of rows whose key is no parent's."""
    gone = df.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")
    return gone.select(F.lit(relation).alias("relation"), F.lit(f"{key}_exists").alias("rule"), F.col("id"))


def repeated_keys(relation: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """(relation, rule, n) of keys that should be unique and aren't."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(relation).alias("relation"), F.lit("unique_" + "_".join(keys)).alias("rule"), "n")


def violations(rel) -> DataFrame:
    """How many rows break each rule of each relation."""
    all_broken = reduce(DataFrame.unionByName, [broken_checks(name, getattr(rel, name)) for name in CHECKS])
    return all_broken.groupBy("relation", "rule").agg(F.count("*").alias("n"))
