"""Maintenance items, budgets and scenarios: one plan shared by planning, budgeting and what-if allocation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from girderlake.functions import dates, money, policies
from girderlake.functions.text import first_of
from girderlake.operators import portfolio as P
from girderlake.operators.latest import numbered
from girderlake.sources.cuts import cut

#: The list that an intervention's state puts an item on.
VIEWS = {"PLANNED": "planned", "BUDGETED": "budgeted", "TENDER_PREPARATION": "tender", "IN_PROGRESS": "in_progress", "COMPLETED": "completed", "CANCELLED": "cancelled"}
#: Sorts after every year.
NO_YEAR = 2**53 - 1
#: Detours, in tenths of vehicle kilometres, that share a slot of a budget's order.
SLOT = 100_000


def scored_delta(inspections: DataFrame) -> DataFrame:
    """By part the difference of the latest two dated and scored inspections (trap T1: others don't count)."""
    rows = numbered(inspections.where("inspected_on IS NOT NULL AND tenths IS NOT NULL"), ["part_id"], [F.col("inspected_on").desc(), F.col("id")]).where("rn <= 2")
    of = lambda n: F.max(F.when(F.col("rn") == n, F.col("tenths")))
    return rows.groupBy("part_id").agg((of(1) - of(2)).alias("delta_tenths"))


def linked_ratings(findings: DataFrame) -> DataFrame:
    """Highest ratings of the active findings linked to a recommendation (here: by their inspection)."""
    active = F.col("status").isin(*P.ACTIVE)
    return findings.groupBy(F.col("inspection_id").alias("id")).agg(*[F.max(F.when(active, F.col(c))).alias(c) for c in ("stability", "safety", "durability")])


def flood_sides(rel) -> DataFrame:
    """One row per structure with a gauge: what ``portfolio.flood_exposed`` asks, its flood judged by the band, and the gauge's band."""
    gauges = P.gauge_signs(rel.gauges).join(rel.gauges.select("structure_id", P.marked_band().alias("current_band")), "structure_id")
    df = rel.structures.select(F.col("id").alias("structure_id"), "crossed").join(gauges, "structure_id")
    df = df.join(P.finding_signs(rel.findings).select("structure_id", "washed"), "structure_id", "left")
    df = df.join(P.founded(rel.components).withColumn("founded", F.lit(True)), "structure_id", "left")
    return df.join(P.deciding_floods(rel.flood_peaks, rel.special_checks), "structure_id", "left")


def maintenance_items(rel, as_of: str) -> DataFrame:
    """Recommendations that are undone or have an intervention, with view, priority (R3) and estimate."""
    plans = rel.interventions.select(F.col("recommendation_id").alias("id"), F.col("id").alias("intervention_id"), "planned_year", F.col("status").alias("plan_status"), "estimate", "included")
    dues = rel.inspections.select("id", dates.due_status(dates.due_on(F.col("inspected_on"), F.col("cycle_months")), P.day(as_of)).alias("inspection_status"), "part_id")
    net = rel.networks.join(P.latest_traffic(rel.traffic).select("structure_id", "daily_traffic", "heavy_daily", "truck_share"), "structure_id", "left")
    heavy = policies.heavy_vehicles(F.col("heavy_daily"), F.col("daily_traffic"), F.col("truck_share"))
    score = policies.network_points(F.col("daily_traffic"), heavy, F.col("extra_tenths_km"), F.col("alternatives"), F.col("road_class"))
    net = net.select("structure_id", policies.network_band(score).alias("band"), (F.col("extra_tenths_km") * F.col("daily_traffic")).alias("extra_vehicle_tenths_km"))
    df = rel.recommendations.join(plans, "id", "left").where(F.col("intervention_id").isNotNull() | F.col("status").isin(*P.UNDONE))
    df = df.join(dues, "id", "left").join(linked_ratings(rel.findings), "id", "left").join(scored_delta(rel.inspections), "part_id", "left")
    df = df.join(net, "structure_id", "left").join(rel.climates, "structure_id", "left").join(flood_sides(rel), "structure_id", "left")
    c = F.col
    exposed = policies.environmental_exposure(c("durability"), c("freeze_days"), c("rain_days"), c("deicing_days"))
    age = dates.completed_years(c("sourced_on"), P.day(as_of))
    df = df.withColumn("reasons", policies.priority_reasons(c("stability"), c("safety"), c("durability"), c("urgency"), age, c("inspection_status"), c("delta_tenths"), c("band"), P.flood_exposed(), exposed))
    df = df.withColumn("priority", policies.priority_rank(c("reasons")))
    estimate, origin = money.effective_estimate(c("estimate"), c("cost"))
    view = F.coalesce(first_of(*[(c("plan_status") == k, v) for k, v in VIEWS.items()]), F.lit("unplanned"))
    return df.withColumn("view", view).withColumn("estimate_origin", origin).withColumn("estimate", estimate)


def planning_list(items: DataFrame, view: str | None = None) -> DataFrame:
    """O3: most urgent first, then the earliest year, then id."""
    rows = items if view is None else items.where(F.col("view") == view)
    return rows.orderBy(F.col("priority").desc(), F.coalesce("planned_year", "target_year", F.lit(NO_YEAR)), "id")


@dataclass(frozen=True)
class PlanningRequest:
    """A checked request for the planning list."""

    view: str = "unplanned"
    page: int = 1
    page_size: int = 25

    def __post_init__(self):
        if self.view not in ("unplanned", *VIEWS.values()):
            raise ValueError(f"unknown view {self.view!r}")
        if self.page < 1 or not 1 <= self.page_size <= 100:
            raise ValueError("page counts from 1, and a page has 1 to 100 rows")


def planning_page(items: DataFrame, request: PlanningRequest) -> DataFrame:
    """One page of a planning list."""
    return planning_list(items, request.view).offset((request.page - 1) * request.page_size).limit(request.page_size)


def with_membership(interventions: DataFrame, memberships: DataFrame) -> DataFrame:
    """Interventions with ``included``: whether the programme of their own planned year has them.

    The year is part of the join and no filter behind it, so an intervention that only another year's programme has stays, not included.
    """
    of_year = memberships.select(F.col("intervention_id").alias("id"), F.col("planning_year").alias("planned_year")).distinct().withColumn("included", F.lit(True))
    return interventions.drop("included").join(of_year, ["id", "planned_year"], "left").withColumn("included", F.coalesce("included", F.lit(False)))


def view_counts(items: DataFrame) -> DataFrame:
    """Items on every list, before any view is chosen."""
    return items.agg(F.count("*").alias("n"), *[F.count_if(F.col("view") == v).alias(v) for v in ("unplanned", *VIEWS.values())])


def _band_rank():
    return F.coalesce(first_of((F.col("band") == "HIGH", 3), (F.col("band") == "MEDIUM", 2), (F.col("band") == "LOW", 1)), F.lit(0))


def budget_order() -> list:
    """O4; work types sort by codepoint here, which equals the locale's order for ASCII names (trap T12)."""
    return [F.col("priority").desc(), _band_rank().desc(), F.coalesce("extra_vehicle_tenths_km", F.lit(0)).desc(), F.col("work_type"), F.col("id")]


def funded_prefix(items: DataFrame, keys: list[str], stored: bool = False) -> DataFrame:
    """Included items with an estimate in order, and whether the running sum still fits the key's ``budget``.

    A key's order is cut into slots of equal priority and band and similar detour, so that no key is one task: the
    few sums of slots give what stands before each, and rows are summed within their slot. Both read the included items,
    which are stored once, unless they are ``stored`` already.
    """
    slots = {"_priority": F.col("priority"), "_band": _band_rank(), "_detour": F.floor(F.coalesce("extra_vehicle_tenths_km", F.lit(0)) / SLOT)}
    costed = items.where("included = 1 AND estimate IS NOT NULL")
    costed = (costed if stored else cut(costed)).withColumns({**slots, "_cost": F.col("estimate").cast("decimal(28,2)")})
    sums = costed.groupBy(*keys, *slots).agg(F.sum("_cost").alias("_sum"))
    ahead = F.sum("_sum").over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in slots]).rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select(*[F.col(c).alias(f"{c}_of") for c in (*keys, *slots)], F.coalesce(ahead, F.lit(0)).cast("decimal(38,2)").alias("_before"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in (*keys, *slots)])
    run = F.sum("_cost").over(Window.partitionBy(*keys, *slots).orderBy(*budget_order()).rowsBetween(Window.unboundedPreceding, 0))
    df = costed.join(before, same).withColumn("running", (F.col("_before") + run).cast("decimal(38,2)"))
    return df.select(*items.columns, "running", F.coalesce(F.col("running") <= F.col("budget"), F.lit(False)).alias("funded"))


def budget_summary(items: DataFrame, keys: list[str]) -> DataFrame:
    """Value of the included items against the key's ``budget`` (null: not set), and how many its order funds.

    A missing estimate is counted apart, never summed as 0.
    """
    asked = dict.fromkeys([*keys, "budget", "included", "estimate", "priority", "band", "extra_vehicle_tenths_km", "work_type", "id"])
    chosen = cut(items.where("included = 1").select(*asked))
    funded = funded_prefix(chosen, keys, stored=True).groupBy(*keys).agg(F.count_if("funded").alias("n_funded"))
    total = chosen.groupBy(*keys).agg(F.first("budget").alias("budget"), F.coalesce(F.sum(F.col("estimate").cast("decimal(28,2)")), F.lit(0)).cast("decimal(38,2)").alias("selected"), F.count("*").alias("n_included"), F.count_if(F.col("estimate").isNull()).alias("n_missing"))
    rest = F.col("budget") - F.col("selected")
    out = total.join(funded, keys, "left").withColumn("n_funded", F.coalesce("n_funded", F.lit(0)))
    state = first_of((F.col("budget").isNull(), "NOT_SET"), (rest < 0, "OVER_BUDGET")).otherwise("WITHIN_BUDGET")
    return out.select(*keys, "selected", F.when(rest >= 0, rest).cast("decimal(38,2)").alias("remaining"), F.when(rest < 0, -rest).cast("decimal(38,2)").alias("over"), "n_included", "n_missing", "n_funded", state.alias("budget_status"))


def year_spine(scenarios: DataFrame) -> DataFrame:
    """One row for each year of a scenario's horizon (start_year, n_years)."""
    return scenarios.withColumn("year", F.explode(F.sequence(F.col("start_year"), F.col("start_year") + F.col("n_years") - 1)))


def scenario_years(scenarios: DataFrame, assigned: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Every horizon year with its envelope and what is assigned to it, years without any included."""
    sums = assigned.where("assigned_year IS NOT NULL").groupBy("scenario_id", F.col("assigned_year").alias("year")).agg(F.count("*").alias("n_items"), F.sum(F.col("estimate").cast("decimal(28,2)")).cast("decimal(38,2)").alias("value"), F.count_if(F.col("estimate").isNull()).alias("n_missing"))
    df = year_spine(scenarios).join(envelopes, ["scenario_id", "year"], "left").join(sums, ["scenario_id", "year"], "left")
    zero = F.lit(0)
    return df.select("scenario_id", "year", "budget", F.coalesce("n_items", zero).alias("n_items"), F.coalesce("value", zero.cast("decimal(38,2)")).alias("value"), F.coalesce("n_missing", zero).alias("n_missing"))


def scenario_totals(assigned: DataFrame) -> DataFrame:
    """What a scenario assigns and what it leaves."""
    taken = F.col("assigned_year").isNotNull()
    value = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("estimate").cast("decimal(28,2)"))), F.lit(0)).cast("decimal(38,2)")
    return assigned.groupBy("scenario_id").agg(F.count_if(taken).alias("n_assigned"), F.count_if(~taken).alias("n_unassigned"), F.count_if(taken & F.col("estimate").isNull()).alias("n_missing"), value(taken).alias("value"), value(~taken).alias("backlog"))


def effective_year(assigned_year: str, planned_year: str, has_assignment: str, start: str, n_years: str):
    """The assignment if it lies in the horizon, an explicit none as it is, else the planned year if it lies there."""
    inside = lambda y: (F.col(y) >= F.col(start)) & (F.col(y) < F.col(start) + F.col(n_years))
    return first_of((inside(assigned_year), F.col(assigned_year)), (F.col(has_assignment) & F.col(assigned_year).isNull(), None), (inside(planned_year), F.col(planned_year)))


#: Rows of a plan that one task reads in order; what is more goes by prefix sums first. The result is the same.
MOST_STREAMED = 200_000


def _fill_order() -> list[Column]:
    """The order in which a plan's items ask for room."""
    return [F.desc("priority"), F.asc("work_type"), F.asc("id")]


def _streamed(rows: DataFrame) -> DataFrame:
    """Items of each scenario in order through one task, which holds nothing but the room of its years; (scenario_id, id, locked, assigned_year)."""
    rows = rows.repartition("scenario_id").sortWithinPartitions("scenario_id", F.desc("locked"), *_fill_order())
    rows = rows.select("scenario_id", "id", "locked", "preferred", "cents", "start_year", "n_years", "rooms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, room = None, {}
        for batch in batches:
            years = []
            for r in batch.to_pylist():
                if r["scenario_id"] != now:
                    now, room = r["scenario_id"], {x["year"]: x["cents"] for x in r["rooms"] if x["cents"] is not None}
                cost, year = r["cents"], None
                if r["locked"]:
                    year = r["preferred"]
                elif cost is not None:
                    year = next((y for y in range(r["preferred"], r["start_year"] + r["n_years"]) if room.get(y, -1) >= cost), None)
                if cost is not None and year in room:
                    room[year] -= cost
                years.append(year)
            yield pa.record_batch([*batch.columns[:3], pa.array(years, pa.int64())], names=["scenario_id", "id", "locked", "assigned_year"])

    return rows.mapInArrow(run, "scenario_id long, id long, locked boolean, assigned_year long")


def _running(rows: DataFrame) -> DataFrame:
    """Adds ``running``, the sum of costs up to each item in its scenario's order: within slots, after the sums of the slots before."""
    cost = F.col("cents").cast("decimal(28,0)")
    sums = rows.groupBy("scenario_id", "slot").agg(F.sum(cost).alias("_sum"))
    ahead = F.sum("_sum").over(Window.partitionBy("scenario_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select("scenario_id", "slot", F.coalesce(ahead, F.lit(0)).cast("decimal(38,0)").alias("_before"))
    within = F.sum(cost).over(Window.partitionBy("scenario_id", "slot").orderBy(*_fill_order()).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_within", within).join(before, ["scenario_id", "slot"]).withColumn("running", (F.col("_before") + F.col("_within")).cast("decimal(38,0)")).drop("_before", "_within")


def _fill_year(asking: DataFrame, year: Column, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Who of a year's askers gets in, and who is passed on; ``asking`` carries the room of its scenario in that year.

    Costs aren't negative, so room only shrinks: a cost above it is out for good, and of the others those whose running
    sum fits are in. What is left asks again for the rest of the room, until one task can read each plan's rest in order.
    """
    taken, passed = [], []
    while True:
        passed.append(asking.where("cents > room"))
        lined = cut(_running(asking.where("cents <= room")))
        won = lined.where("running <= room")
        taken.append(won.select("scenario_id", "id", "locked", year.alias("assigned_year")))
        used = won.groupBy("scenario_id").agg(F.max("running").alias("_used"))
        asking = lined.where("running > room").drop("running").join(used, "scenario_id", "left")
        asking = asking.withColumn("room", (F.col("room") - F.coalesce("_used", F.lit(0))).cast("long")).drop("_used")
        longest = lined.where("running > room").groupBy("scenario_id").count().agg(F.max("count")).first()[0] or 0
        if longest <= most:
            break
    if longest:
        rooms = F.array(F.struct(year.cast("long").alias("year"), F.col("room").alias("cents")))
        rest = cut(asking)
        done = cut(_streamed(rest.withColumns({"preferred": year, "start_year": year, "n_years": F.lit(1), "rooms": rooms})))
        taken.append(done.where("assigned_year IS NOT NULL"))
        passed.append(rest.join(done.where("assigned_year IS NULL").select("scenario_id", "id"), ["scenario_id", "id"], "left_semi"))
    return taken, cut(reduce(DataFrame.unionByName, passed).drop("room"))


def _filled_by_years(rows: DataFrame, rooms: DataFrame, n_rows: int, most: int) -> DataFrame:
    """The same allocation year by year: who gets into a year depends only on who asks for it, and a year's askers only on the years before."""
    n_slots = max(n_rows // max(most, 1), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    free = rows.where("NOT locked AND cents IS NOT NULL").drop("rooms")
    free = cut(free.repartitionByRange(n_slots, "scenario_id", *_fill_order()).withColumn("slot", F.spark_partition_id()))
    kept = rows.where("locked").groupBy("scenario_id", F.col("preferred").alias("year")).agg(F.sum("cents").alias("_kept"))
    rooms = cut(rooms.join(kept, ["scenario_id", "year"], "left").select("scenario_id", "year", (F.col("cents") - F.coalesce("_kept", F.lit(0))).alias("room")))
    years = F.max("n_years").alias("n")
    out, passed = [rows.where("locked").select("scenario_id", "id", "locked", F.col("preferred").alias("assigned_year"))], None
    for k in range(rows.agg(years).first()["n"]):
        year = F.col("start_year") + k
        asking = free.where(F.col("preferred") == year)
        asking = asking if passed is None else asking.unionByName(passed)
        here = rooms.withColumnRenamed("scenario_id", "_of")
        asking = asking.join(here, (F.col("scenario_id") == F.col("_of")) & (F.col("year") == year), "left").drop("_of", "year")
        taken, passed = _fill_year(asking.withColumn("room", F.coalesce("room", F.lit(-1))), year, most)
        out += taken
    none = F.lit(None).cast("long").alias("assigned_year")
    out += [x.select("scenario_id", "id", "locked", none) for x in (passed, rows.where("NOT locked AND cents IS NULL")) if x is not None]
    return reduce(DataFrame.unionByName, [x.withColumn("assigned_year", F.col("assigned_year").cast("long")) for x in out])


def auto_fill(scenarios: DataFrame, candidates: DataFrame, envelopes: DataFrame, preserve_overrides: bool = True, most: int = MOST_STREAMED) -> DataFrame:
    """G1: greedy allocation; (scenario_id, id, assigned_year, source).

    Items go by priority, work type and id, each into the first year from its preferred one on (G2) with room for its
    cost; overrides with a year in the horizon come first and always fit. A year without envelope has no room; an item without
    estimate stays unassigned; estimates aren't negative. A plan of at most ``most`` items is read in order by one task;
    where any plan has more, all are filled year by year with prefix sums, and a task reads at most that many. Both
    give the same rows. An item is told by (scenario_id, id).
    """
    inside = lambda c: F.col(c).between(F.col("start_year"), F.col("start_year") + F.col("n_years") - 1)
    rooms = scenarios.select("scenario_id", "start_year", "n_years").join(envelopes.where("budget IS NOT NULL"), "scenario_id").where(inside("year"))
    rooms = rooms.select("scenario_id", F.col("year").cast("long").alias("year"), (F.col("budget") * 100).cast("long").alias("cents"))
    listed = rooms.groupBy("scenario_id").agg(F.collect_list(F.struct("year", "cents")).alias("rooms"))
    listed = scenarios.select("scenario_id", "start_year", "n_years").join(listed, "scenario_id", "left").withColumn("rooms", F.coalesce("rooms", F.array().cast("array<struct<year:bigint,cents:bigint>>")))
    locked = F.coalesce((F.col("source") == "USER_OVERRIDE") & inside("assigned_year"), F.lit(False)) if preserve_overrides else F.lit(False)
    rows = candidates.join(listed, "scenario_id").withColumn("locked", locked).withColumn("cents", (F.col("estimate") * 100).cast("long"))
    preferred = first_of((inside("assigned_year"), F.col("assigned_year")), (inside("planned_year"), F.col("planned_year"))).otherwise(F.col("start_year"))
    rows = cut(rows.withColumn("preferred", preferred).select("scenario_id", "id", "priority", "work_type", "locked", "preferred", "cents", "start_year", "n_years", "rooms"))
    sizes = rows.groupBy("scenario_id").count().agg(F.max("count").alias("longest"), F.sum("count").alias("n")).first()
    done = _streamed(rows) if (sizes["longest"] or 0) <= most else _filled_by_years(rows, rooms, sizes["n"], most)
    return done.select("scenario_id", "id", "assigned_year", F.when(F.col("locked"), "USER_OVERRIDE").otherwise("AUTO_FILL").alias("source"))
