"""Ranked search over structures, findings and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderlake.functions.text import first_of
from girderlake.sources.cuts import dealt


def checked_text(q: str) -> str:
    """The trimmed text, 2 to 100 characters; ``%`` and ``_`` in it are ordinary characters."""
    q = q.strip()
    if not 2 <= len(q) <= 100:
        raise ValueError("a search text has 2 to 100 characters")
    return q.lower()


def search_text(*columns: str) -> Column:
    """all columns with single spaces between, empty where null."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def matches(df: DataFrame, q: str, searched: list[str], exact: list[str], prefix: list[str]) -> DataFrame:
    """Rows whose text has ``q``, with match_rank: 0 for an exact column, then 1, 2, ... by prefix columns, then the rest."""
    low = F.lit(checked_text(q))
    cases = [(F.lower(c) == low, 0) for c in exact] + [(F.startswith(F.lower(c), low), i) for i, c in enumerate(prefix, 1)]
    return df.where(F.contains(search_text(*searched), low)).withColumn("match_rank", first_of(*cases, (F.lit(True), len(prefix) + 1)))


def ranked(found: DataFrame, name: str, limit: int) -> DataFrame:
    """The best ``limit`` rows (P12: 1 to 10), each with the number of all matches."""
    if not 1 <= limit <= 10:
        raise ValueError("a search gives 1 to 10 rows")
    total = found.agg(F.count("*").alias("total"))
    best = found.orderBy("match_rank", F.lower(F.coalesce(F.col(name), F.lit(""))), "id").limit(limit)
    return best.join(F.broadcast(total))  # one row


def search_findings(findings: DataFrame, structures: DataFrame, q: str, limit: int = 5, tasks: int | None = None) -> DataFrame:
    """Findings with their structure, met in ``tasks`` tasks; an exact key first, then keys and then kinds that begin so."""
    rows = dealt(findings.distinct(), tasks, "structure_id").join(structures.select(F.col("id").alias("structure_id"), "ext_no", "road"), "structure_id")
    return ranked(matches(rows, q, ["id", "description", "status", "ext_no", "road"], ["id"], ["id", "description"]), "id", checked_limit(limit))


def search_recommendations(recommendations: DataFrame, structures: DataFrame, q: str, limit: int = 5) -> DataFrame:
    """Recommendations with their structure; an exact work type first, then work types that begin so."""
    rows = recommendations.join(structures.select(F.col("id").alias("structure_id"), "ext_no", "road"), "structure_id")
    return ranked(matches(rows, q, ["work_type", "urgency", "status", "ext_no", "road"], ["work_type"], ["work_type"]), "work_type", checked_limit(limit))


def checked_limit(limit: int) -> int:
    """1 to 10 rows of each group."""
    if not 1 <= limit <= 10:
        raise ValueError("a search shows 1 to 10 rows of each group")
    return limit


def search_structures(structures: DataFrame, q: str, limit: int = 5) -> DataFrame:
    return ranked(matches(structures, q, ["ext_no", "road", "state", "crossed"], ["ext_no"], ["ext_no", "road"]), "ext_no", checked_limit(limit))
