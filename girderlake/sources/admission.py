"""Rows that come in are judged by what their relation declares, before they are stored: types, NOT NULL, CHECKs, keys, parents.

Every row gets the names of the rules that it breaks. Those that break none are admitted; the others are kept apart as
they came, with their reasons, so nothing is lost. Both are written by one job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from girderlake.sources.cuts import dealt
from girderlake.sources.schemas import schema


@dataclass(frozen=True)
class Parent:
    """A key that must be another relation's; a row with a null in it passes."""

    columns: tuple[str, ...]
    relation: str
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Rules:
    """What a relation declares beyond its types: conditions that must not be false, unique keys, parents."""

    checks: dict[str, str] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = (("id",),)
    parents: tuple[Parent, ...] = ()


_SCOPE = ("structure_id", "partial_structure_id")
_OF_PART = Parent(("partial_structure_id", "structure_id"), "partial_structures", ("id", "structure_id"))


def _none_or_with_unit(values: list[str], unit: str) -> str:
    some = " OR ".join(f"{v} IS NOT NULL" for v in values)
    return f"CASE WHEN {some} THEN coalesce(trim({unit}) <> '', false) ELSE {unit} IS NULL END"


#: The limits and pairs that stored relations keep to.
RULES = {
    "inspections": Rules({"condition_score_range": "condition_score BETWEEN 1.0 AND 4.0", "positive_cycle_months": "cycle_months > 0"}, parents=(_OF_PART,)),
    "findings": Rules(
        {
            "description_not_blank": "trim(description) <> ''",
            "non_negative_measurements": "least(dimension_length, dimension_width, dimension_depth, quantity) >= 0",
            "dimension_unit_pair": _none_or_with_unit(["dimension_length", "dimension_width", "dimension_depth"], "dimension_unit"),
            "quantity_unit_pair": _none_or_with_unit(["quantity"], "quantity_unit"),
            "rating_ranges": "least(stability_rating, traffic_safety_rating, durability_rating) >= 0 AND greatest(stability_rating, traffic_safety_rating, durability_rating) <= 4",
        },
        unique=(("id",), ("inspection_id", "source_identifier")),
        parents=(_OF_PART, Parent(("inspection_id", *_SCOPE), "inspections", ("id", *_SCOPE)), Parent(("component_id", *_SCOPE), "components", ("id", *_SCOPE))),
    ),
    "recommendations": Rules(
        {
            "description_not_blank": "trim(description) <> ''",
            "quantity_unit_pair": f"({_none_or_with_unit(['quantity'], 'unit')}) AND coalesce(quantity >= 0, true)",
            "estimated_cost_pair": "CASE WHEN source_estimated_cost IS NOT NULL THEN source_estimated_cost >= 0 AND coalesce(source_estimated_cost_currency RLIKE '^[A-Z]{3}$', false) ELSE source_estimated_cost_currency IS NULL END",
            "year_ranges": "least(target_year, planned_year) >= 1700 AND greatest(target_year, planned_year) <= 2200",
        },
        parents=(_OF_PART,),
    ),
    "traffic_observations": Rules(
        {
            "year_range": "observation_year BETWEEN 1900 AND 2200",
            "date_matches_year": "year(observed_on) = observation_year",
            "non_negative_counts": "least(daily_traffic, heavy_vehicle_daily) >= 0",
            "truck_share_range": "truck_share_percent BETWEEN 0 AND 100",
        },
        parents=(Parent(("structure_id",), "structures", ("id",)),),
    ),
}

#: A row that repeats another in every column.
REPEATED = "repeated_row"


#: Rows that have no key to stand by are spread over so many groups.
_SPREAD = 1024


def judged(df: DataFrame, relation: str, order: list[str], parents: dict[str, DataFrame], stored: DataFrame | None = None, within: str | None = None, tasks: int | None = None, whole: bool = False) -> DataFrame:
    """The rows of ``df`` as the relation declares them, with ``broken`` (names of broken rules), ``copies`` and ``given``.

    A column that ``df`` lacks is null, one that the relation doesn't have is left out. Rows that agree in every declared column and in
    ``order`` are one row with that many copies. A value that its declared type can't hold is null and breaks ``type_...``.
    ``parents`` has the rows of each parent relation, ``stored`` those that are there already. Of rows with one unique key the
    first in ``order`` that breaks nothing else takes it; ties go by a hash of the row. ``given`` is a row that breaks a rule as
    it came, as JSON.

    All parents of a relation share columns (the scope). Rows and parents' keys are dealt by these once; copies are counted and
    parents looked up there, sorted, without another shuffle. Each unique key takes one more. Between shuffles a row is what came and a
    number with a bit for each broken rule; types, names and JSON are made at the end.

    ``within`` names a column of ``df`` and of all parents by which they lie already, dealt to ``tasks`` tasks; rows of one scope must
    have one value of it. Then nothing is dealt for the parents. ``tasks`` is for the unique keys, too. With ``whole`` rows that break
    something else than a unique key are left out before these are looked at: what is admitted is the same.
    """
    rules, fields, have = RULES[relation], schema(relation).fields, dict(df.dtypes)
    known = [f.name for f in fields if f.name in have]
    other = {f.name for f in fields if f.name in have and have[f.name] != f.dataType.simpleString()}
    declared = {f.name: f.dataType.simpleString() for f in fields}

    def read(name: str) -> Column:
        return F.col(name).try_cast(declared[name]) if name in other else F.col(name) if name in have else F.lit(None).cast(declared[name])

    near = [F.col(within).alias("_within")] if within else []
    rows = _with_parents(df.select(*known, F.struct(*[F.col(c) for c in order]).alias("_order"), *near), rules.parents, parents, read, declared, within)
    names, broken, holds = [], [], []

    def rule(name: str, condition: Column) -> None:
        holds.append(~F.coalesce(condition, F.lit(False)))
        broken.append(F.when(condition, F.lit(1 << len(names)).cast("long")).otherwise(F.lit(0).cast("long")))
        names.append(name)

    raw = lambda name: F.col(f"_raw_{name}" if name in other else name)
    for name in known:
        if name in other:
            rule(f"type_{name}", raw(name).isNotNull() & F.col(name).isNull())
    for f in fields:
        if not f.nullable:
            rule(f"null_{f.name}", raw(f.name).isNull())
    for name, condition in rules.checks.items():
        rule(name, ~F.expr(condition))
    for i, parent in enumerate(rules.parents):
        rule(f"no_{parent.relation}", ~F.col(f"_has_{i}") & _whole([F.col(c) for c in parent.columns]))
    came = [F.col(n).alias(f"_raw_{n}") for n in known if n in other]
    rows = rows.select(*[read(f.name).alias(f.name) for f in fields], *came, "_order", "copies", F.xxhash64(*known).alias("_tie"), *[f"_has_{i}" for i in range(len(rules.parents))])
    mask = F.lit(0).cast("long") if whole else reduce(Column.bitwiseOR, broken)
    for each in holds if whole else []:
        rows = rows.where(each)
    rows = rows.select(*[raw(n).alias(n) for n in known], "_order", "copies", "_tie", mask.alias("_mask"))
    if not whole:  # a row that claims no key needs neither its place among others nor all of its hash, so these don't travel
        free = F.col("_mask") == 0
        rows = rows.withColumns({"_order": F.when(free, F.col("_order")), "_tie": F.when(free, F.col("_tie")).otherwise(F.pmod("_tie", F.lit(_SPREAD)))})
    for key in rules.unique:
        at = [read(c) for c in key]
        if stored is not None:
            there = stored.select(*[F.col(c).cast(declared[c]).alias(f"_of_{c}") for c in key]).distinct().withColumn("_there", F.lit(True))
            rows = rows.join(there, [x == F.col(f"_of_{c}") for x, c in zip(at, key, strict=True)], "left")
            rows = _marked(rows, F.col("_there").isNotNull(), len(names)).drop("_there", *[f"_of_{c}" for c in key])
            names.append("stored_" + "_".join(key))
        # A row that claims no key is told by its hash instead, so that such rows are no group; a CASE keeps the condition in one piece.
        claims = F.when(F.col("_mask") == 0, _whole(at)).otherwise(F.lit(False))
        rows = rows.withColumn("_spread", F.when(claims, F.lit(-1)).otherwise(F.pmod("_tie", F.lit(_SPREAD)))).withColumns({f"_at_{c}": F.when(claims, x) for x, c in zip(at, key, strict=True)})
        rows = dealt(rows, tasks, "_spread", *[f"_at_{c}" for c in key])
        place = F.row_number().over(Window.partitionBy("_spread", *[f"_at_{c}" for c in key]).orderBy("_order", "_tie"))
        rows = _marked(rows.withColumn("_place", place), (F.col("_spread") < 0) & (F.col("_place") > 1), len(names)).drop("_spread", "_place", *[f"_at_{c}" for c in key])
        names.append("unique_" + "_".join(key))
    told = F.array_compact(F.array(*[F.when(F.col("_mask").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(name)) for i, name in enumerate(names)]))
    given = F.when(F.col("_mask") != 0, F.to_json(F.struct(*known)))
    return rows.select(*[read(f.name).alias(f.name) for f in fields], "copies", given.alias("given"), told.alias("broken"))


def _with_parents(rows: DataFrame, rules: tuple[Parent, ...], parents: dict[str, DataFrame], read: Callable[[str], Column], declared: dict[str, str], within: str | None = None) -> DataFrame:
    """Distinct rows with their ``copies`` and, for each parent, ``_has_...``: whether it has the row's key.

    Keys of parents are rows of their own kind among the others; a window over a key sees whether one of them is there.
    """
    came, scope = rows.columns, [c for c in rules[0].columns if all(c in p.columns for p in rules)]
    keys = list(dict.fromkeys(c for p in rules for c in p.columns))
    at = lambda columns: [F.col(f"_key_{c}") for c in columns]
    counted = lambda df: df.groupBy(*df.columns).agg(F.count("*").alias("copies"))
    near, whole = ["_within"] if within else [], _whole(at(scope))
    rows = counted(rows) if within else rows
    rows = rows.select("*", F.lit(-1).alias("_kind"), *[read(c).alias(f"_key_{c}") for c in keys])
    rows = rows.withColumn("_spread", F.when(whole, F.lit(0)).otherwise(F.pmod(F.xxhash64(*came), F.lit(_SPREAD))))
    for i, parent in enumerate(rules):
        of = dict(zip(parent.columns, parent.keys, strict=True))
        one = parents[parent.relation].select(*[F.col(of[c]).cast(declared[c]).alias(f"_key_{c}") if c in of else F.lit(None).cast(declared[c]).alias(f"_key_{c}") for c in keys], F.lit(i).alias("_kind"), F.lit(0).cast("long").alias("_spread"), *[F.col(within).alias(n) for n in near])
        rows = rows.unionByName(one.where(_whole(at(parent.columns))), allowMissingColumns=True)
    if not within:
        rows = counted(rows.repartition("_spread", *at(scope)))
    # Keys begin with the scope, the longest first: a shorter one after it is in order already.
    for i, parent in sorted(enumerate(rules), key=lambda p: -len(p[1].columns)):
        by = [*scope, *[c for c in parent.columns if c not in scope]]
        rows = rows.withColumn(f"_has_{i}", F.max(F.col("_kind") == i).over(Window.partitionBy(*near, "_spread", *at(by))))
    return rows.where("_kind < 0").select(*came, "copies", *[f"_has_{i}" for i in range(len(rules))])


def _marked(rows: DataFrame, broken: Column, bit: int) -> DataFrame:
    return rows.withColumn("_mask", F.when(broken, F.col("_mask").bitwiseOR(F.lit(1 << bit).cast("long"))).otherwise(F.col("_mask")))


def _whole(columns: list[Column]) -> Column:
    """No null in a key."""
    return reduce(Column.__and__, [c.isNotNull() for c in columns])


def admitted(rows: DataFrame, relation: str) -> DataFrame:
    """Judged rows that break nothing, once each."""
    return rows.where(F.size("broken") == 0).select(*[f.name for f in schema(relation).fields])


def rejected(rows: DataFrame) -> DataFrame:
    """(given, broken, n): what was kept out and why; further copies of an admitted row count as repeated."""
    whole = F.size("broken") == 0
    n = F.when(whole, F.col("copies") - 1).otherwise(F.col("copies"))
    return rows.select("*", n.alias("n")).where("n > 0").withColumn("broken", F.when(whole, F.array(F.lit(REPEATED))).otherwise(F.col("broken")))


def store(rows: DataFrame, folder: str, relation: str) -> None:
    """Judged rows in one new folder, admitted and rejected ones in partitions of it; an existing folder is left alone."""
    columns = [f.name for f in schema(relation).fields]
    rows.select(*columns, "broken", "copies", "given", (F.size("broken") == 0).alias("admitted")).write.mode("error").partitionBy("admitted").parquet(folder)


def _read(spark: SparkSession, folder: str, relation: str) -> DataFrame:
    extra = "broken array<string>, copies bigint, given string, admitted boolean"
    shape = schema(relation)
    return spark.read.schema(", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in shape.fields], extra])).parquet(folder)


def read_admitted(spark: SparkSession, folder: str, relation: str) -> DataFrame:
    """The relation from a folder that ``store`` wrote; the rejected partition isn't read."""
    return _read(spark, folder, relation).where("admitted").select(*[f.name for f in schema(relation).fields])


def read_rejected(spark: SparkSession, folder: str, relation: str) -> DataFrame:
    """What ``store`` kept out, as ``rejected`` gives it."""
    return rejected(_read(spark, folder, relation)).select("given", "broken", "n")
