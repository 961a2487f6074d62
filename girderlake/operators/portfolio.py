"""The portfolio: every structure with its inspections, findings, recommendations and exposures, one row each.

All parts are aggregated by structure before they are joined, so the star join never fans out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from girderlake.functions import dates, policies
from girderlake.functions.text import contains_any, first_of
from girderlake.operators.latest import first_per_key, numbered

ACTIVE = ("OPEN", "MONITORING")
#: Recommendations that still ask for something.
UNDONE = ("OPEN", "APPROVED", "SCHEDULED", "IN_PROGRESS")
FOUNDATION_WORDS = ["grundung", "pfahl", "widerlager"]
REPAIR_WORDS = [*policies.SCOUR_WORDS, "grundung", "widerlager"]
#: Words of a crossed water.
WATER = r"(?iu)bach|tal|fluss|gewässer|gewasser|river"
#: Months after a flood within which a special inspection answers it.
CHECK_MONTHS = 12


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def numbered_inspections(inspections: DataFrame) -> DataFrame:
    """Newest first per part, undated last."""
    return numbered(inspections, ["part_id"], [F.col("inspected_on").desc_nulls_last(), F.col("id")])


def structure_summary(parts: DataFrame) -> DataFrame:
    """A1"""
    kinds = F.countDistinct("structure_type")
    return parts.groupBy("structure_id").agg(F.count("*").alias("n_parts"), F.min("construction_year").alias("construction_year"), F.when(kinds > 1, "Multiple").otherwise(F.min("structure_type")).alias("structure_type"))


def inspection_summary(inspections: DataFrame) -> DataFrame:
    """A2: over the newest inspection of each part."""
    now = numbered_inspections(inspections).where("rn = 1").withColumn("due_on", dates.due_on(F.col("inspected_on"), F.col("cycle_months")))
    return now.groupBy("structure_id").agg(F.max("inspected_on").alias("last_on"), F.min("due_on").alias("due_on"), F.count("*").alias("n_current"), F.count("due_on").alias("n_due"))


def current_and_previous(inspections: DataFrame) -> DataFrame:
    """Each part's newest inspection with the row before it, scored or not (trap T1)."""
    order = Window.partitionBy("part_id").orderBy(F.col("inspected_on").desc_nulls_last(), "id")
    rows = inspections.withColumn("rn", F.row_number().over(order)).withColumn("previous_tenths", F.lead("tenths").over(order))
    now = rows.where("rn = 1").withColumn("delta_tenths", F.col("tenths") - F.col("previous_tenths"))
    return now.withColumn("condition_trend", policies.trend(F.col("delta_tenths"))).drop("rn")


def headline_inspection(inspections: DataFrame) -> DataFrame:
    """Of each structure the worst current score, then the newest."""
    order = [F.col("tenths").desc_nulls_last(), F.col("inspected_on").desc_nulls_last(), F.col("id")]
    return first_per_key(current_and_previous(inspections), ["structure_id"], order)


def finding_summary(findings: DataFrame) -> DataFrame:
    """A3: open findings and their highest ratings."""
    active = F.col("status").isin(*ACTIVE)
    return findings.groupBy("structure_id").agg(F.count_if(active).alias("open_findings"), *[F.max(F.when(active, F.col(c))).alias(f"max_{c}") for c in ("stability", "safety", "durability")])


def finding_signs(findings: DataFrame) -> DataFrame:
    """A3 with what A5 and J12 ask of findings, in one pass: open ones of scour, and any of scour."""
    active = F.col("status").isin(*ACTIVE)
    rows = findings.withColumn("_scour", contains_any(F.col("description"), policies.SCOUR_WORDS))
    highest = [F.max(F.when(active, F.col(c))).alias(f"max_{c}") for c in ("stability", "safety", "durability")]
    return rows.groupBy("structure_id").agg(F.count_if(active).alias("open_findings"), *highest, F.bool_or(active & F.col("_scour")).alias("scour"), F.bool_or("_scour").alias("washed"))


def founded(components: DataFrame) -> DataFrame:
    """Structures with a component of a foundation."""
    return components.where(contains_any(F.col("type"), FOUNDATION_WORDS)).select("structure_id").distinct()


def inspection_overview(inspections: DataFrame) -> DataFrame:
    """A2 and W2 in one pass: dates and counts of each structure's newest inspections, and its headline one with its trend.

    The headline is the greatest by score, date and then the smaller id; a null is less than any value.
    """
    now = current_and_previous(inspections).withColumn("_due", dates.due_on(F.col("inspected_on"), F.col("cycle_months")))
    worst = F.max(F.struct("tenths", "inspected_on", (-F.col("id")).alias("_id"), "delta_tenths", "condition_trend"))
    out = now.groupBy("structure_id").agg(F.max("inspected_on").alias("last_on"), F.min("_due").alias("due_on"), F.count("_due").alias("n_due"), worst.alias("_head"))
    return out.select("structure_id", "last_on", "due_on", "n_due", *[F.col(f"_head.{c}").alias(c) for c in ("tenths", "delta_tenths", "condition_trend")])


def recommendation_summary(recommendations: DataFrame) -> DataFrame:
    """A4"""
    return recommendations.where(F.col("status").isin(*UNDONE)).groupBy("structure_id").agg(F.count("*").alias("open_recommendations"))


def headline_recommendation(recommendations: DataFrame) -> DataFrame:
    """The most urgent open one, then the earliest planned or else target year."""
    ranked = recommendations.where(F.col("status").isin(*UNDONE)).withColumn("urgency_rank", policies.urgency_rank(F.col("urgency")))
    return first_per_key(ranked, ["structure_id"], [F.col("urgency_rank").desc(), F.coalesce("own_planned_year", "target_year").asc_nulls_last(), F.col("id")])


def recommendation_overview(recommendations: DataFrame) -> DataFrame:
    """A4 and the rank of W5 in one pass."""
    undone = recommendations.where(F.col("status").isin(*UNDONE))
    return undone.groupBy("structure_id").agg(F.count("*").alias("open_recommendations"), F.max(policies.urgency_rank(F.col("urgency"))).alias("urgency_rank"))


def latest_traffic(traffic: DataFrame) -> DataFrame:
    """W3 (trap T3)"""
    return first_per_key(traffic, ["structure_id"], [F.col("observation_year").desc(), F.col("observed_on").desc_nulls_last(), F.col("id")])


def open_scour(findings: DataFrame) -> DataFrame:
    """A5: structures with an open finding of scour."""
    return findings.where(F.col("status").isin(*ACTIVE) & contains_any(F.col("description"), policies.SCOUR_WORDS)).select("structure_id").distinct()


def scour_sensitive(structures: DataFrame, findings: DataFrame, components: DataFrame) -> DataFrame:
    """Structures over water with any finding of scour, or with a component of a foundation."""
    scour = findings.where(contains_any(F.col("description"), policies.SCOUR_WORDS)).select("structure_id").distinct()
    keys = scour.union(founded(components)).withColumnRenamed("structure_id", "id")
    return structures.where(F.rlike("crossed", F.lit(WATER))).join(keys, "id", "left_semi").select(F.col("id").alias("structure_id"))


def inspection_status(due_on: Column, n_due: Column, n_parts: Column, as_of: Column) -> Column:
    """Like a single inspection's, and UNKNOWN unless every part has a due date."""
    parts = policies.zero(n_parts)
    return first_of((due_on < as_of, "OVERDUE"), (due_on <= F.date_add(as_of, dates.SOON_DAYS), "DUE_SOON"), ((parts == 0) | (policies.zero(n_due) < parts), "UNKNOWN")).otherwise("CURRENT")


def flood_exposed() -> Column:
    """A gauged structure over water, sensitive to scour, whose gauge is above its trigger or whose last flood no one answered."""
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    return scour_prone() & yes("gauged") & (yes("above_trigger") | yes("unmatched"))


def over_water() -> Column:
    return F.coalesce(F.rlike("crossed", F.lit(WATER)), F.lit(False))


def scour_prone() -> Column:
    """Over water, with a finding of scour or a foundation."""
    return over_water() & (F.coalesce("washed", F.lit(False)) | F.coalesce("founded", F.lit(False)))


def gauge_signs(gauges: DataFrame) -> DataFrame:
    """(structure_id, gauged, above_trigger) of structures with a gauge; an unknown level is above nothing."""
    above = F.coalesce(F.col("level_cm") >= F.col("trigger_cm"), F.lit(False))
    return gauges.select("structure_id", F.lit(True).alias("gauged"), above.alias("above_trigger"))


def portfolio(rel, as_of: str) -> DataFrame:
    """One row per structure, with attention priority and reasons."""
    parts = {
        "ss": structure_summary(rel.parts),
        "ins": inspection_overview(rel.inspections),
        "fs": finding_signs(rel.findings),
        "rs": recommendation_overview(rel.recommendations),
        "lt": latest_traffic(rel.traffic).select("structure_id", "daily_traffic", "heavy_daily", "truck_share"),
        "le": rel.climates,
        "ln": rel.networks,
        "lh": gauge_signs(rel.gauges),
        "fu": flood_unmatched(rel.flood_peaks, rel.special_checks).withColumn("unmatched", F.lit(True)),
        "fd": founded(rel.components).withColumn("founded", F.lit(True)),
    }
    df = rel.structures.withColumnRenamed("id", "structure_id")
    for part in parts.values():
        df = df.join(part, "structure_id", "left")
    c = F.col
    df = df.withColumns({k: F.coalesce(c(k), F.lit(0)) for k in ("open_findings", "open_recommendations", "urgency_rank")})
    df = df.withColumn("condition_trend", F.coalesce("condition_trend", F.lit("UNKNOWN")))
    df = df.withColumn("inspection_status", inspection_status(c("due_on"), c("n_due"), c("n_parts"), day(as_of)))
    heavy = policies.heavy_vehicles(c("heavy_daily"), c("daily_traffic"), c("truck_share"))
    df = df.withColumn("network_points", policies.network_points(c("daily_traffic"), heavy, c("extra_tenths_km"), c("alternatives"), c("road_class")))
    df = df.withColumn("extra_vehicle_tenths_km", F.coalesce(c("extra_tenths_km") * c("daily_traffic"), F.lit(0)))
    worry = (policies.zero("max_durability") >= 2) | (policies.zero("max_stability") >= 2) | (policies.zero("max_safety") >= 2) | (c("condition_trend") == "DETERIORATING") | (c("urgency_rank") >= 2) | (policies.zero("tenths") >= 25)
    df = df.withColumns({
        "network_consequence": (c("network_points") >= 8) & worry,  # R5
        "environment": policies.environmental_exposure(c("max_durability"), c("freeze_days"), c("rain_days"), c("deicing_days")),
        "flood": flood_exposed(),
        "scour": F.coalesce(c("scour"), F.lit(False)),
    })
    said = [c(x) for x in ("inspection_status", "tenths", "max_stability", "max_safety", "max_durability", "condition_trend", "urgency_rank", "open_findings", "open_recommendations", "environment", "network_consequence", "flood")]
    return df.withColumn("attention_priority", policies.attention_level(*said, c("scour"))).withColumn("reasons", policies.attention_reasons(*said))


SORTS = {"attention": "attention_priority", "name": "ext_no", "condition": "tenths", "construction": "construction_year", "due": "due_on"}


@dataclass(frozen=True)
class PortfolioQuery:
    """A checked request; ranges are inclusive, absent filters are None."""

    road: str | None = None
    least_tenths: int | None = None
    most_tenths: int | None = None
    built_from: int | None = None
    built_to: int | None = None
    inspection_status: str | None = None
    has_open_finding: bool | None = None
    sort: str = "attention"
    descending: bool = True
    page: int = 1
    page_size: int = 25

    def __post_init__(self):
        if self.page < 1 or not 1 <= self.page_size <= 100:
            raise ValueError("page counts from 1, and a page has 1 to 100 rows")
        if self.sort not in SORTS:
            raise ValueError(f"unknown sort {self.sort!r}")
        for low, high in ((self.least_tenths, self.most_tenths), (self.built_from, self.built_to)):
            if low is not None and high is not None and low > high:
                raise ValueError("a range ends before it begins")


def filtered(portfolio_rows: DataFrame, query: PortfolioQuery) -> DataFrame:
    """Rows that all given filters let through; a null never does. Wildcards in ``road`` count (trap T14)."""
    c, df = F.col, portfolio_rows
    if query.road is not None:
        df = df.where(c("road").ilike(f"%{query.road}%"))
    for name, low, high in (("tenths", query.least_tenths, query.most_tenths), ("construction_year", query.built_from, query.built_to)):
        if low is not None:
            df = df.where(c(name) >= low)
        if high is not None:
            df = df.where(c(name) <= high)
    if query.inspection_status is not None:
        df = df.where(c("inspection_status") == query.inspection_status)
    if query.has_open_finding is not None:
        df = df.where(c("open_findings") > 0 if query.has_open_finding else c("open_findings") == 0)
    return df


def page(portfolio_rows: DataFrame, query: PortfolioQuery) -> DataFrame:
    """O1 and O2: one page in the asked order; attention breaks ties by extra vehicle kilometres (trap T8), all by id."""
    key = F.lower(SORTS[query.sort]) if query.sort == "name" else F.col(SORTS[query.sort])
    order = [key.desc_nulls_last() if query.descending else key.asc_nulls_last()]
    if query.sort == "attention":
        order.append(F.col("extra_vehicle_tenths_km").desc_nulls_last())
    return filtered(portfolio_rows, query).orderBy(*order, "structure_id").offset((query.page - 1) * query.page_size).limit(query.page_size)


def summary(portfolio_rows: DataFrame, query: PortfolioQuery) -> DataFrame:
    """Counts over the filtered portfolio."""
    c = F.col
    return filtered(portfolio_rows, query).agg(F.count("*").alias("n"), F.count_if(c("inspection_status") == "OVERDUE").alias("n_overdue"), F.count_if(F.greatest(policies.zero("max_stability"), policies.zero("max_safety")) >= 2).alias("n_severe"), F.count_if(c("open_recommendations") > 0).alias("n_recommended"))


def first_marks(peaks: DataFrame, marks: DataFrame, months: dict[str, int]) -> DataFrame:
    """Each peak with the first mark of each kind on or after it and within so many months: ``kind``_id, ``kind``_on.

    marks: structure_id, on_day, kind, id. All are read once, latest first, per structure: the next mark of a kind is the
    last one seen, so no pair of a peak and a mark is ever made.
    """
    both = peaks.select("structure_id", F.col("peaked_on").alias("on_day"), F.lit("").alias("kind"), F.lit("").alias("mark"), F.struct(*peaks.columns).alias("peak"))
    both = both.unionByName(marks.select("structure_id", "on_day", "kind", F.col("id").cast("string").alias("mark")), allowMissingColumns=True)
    order = Window.partitionBy("structure_id").orderBy(F.col("on_day").desc(), (F.col("kind") != "").desc(), F.col("mark").desc())
    last = {kind: F.last(F.when(F.col("kind") == kind, F.struct("mark", "on_day")), ignorenulls=True).over(order) for kind in months}
    done = both.withColumns({f"_{kind}": x for kind, x in last.items()}).where("kind = ''")
    shown = []
    for kind, n in months.items():
        near = F.col(f"_{kind}.on_day") < F.add_months("on_day", n)
        shown += [F.when(near, F.col(f"_{kind}.mark")).alias(f"{kind}_id"), F.when(near, F.col(f"_{kind}.on_day")).alias(f"{kind}_on")]
    return done.select("peak.*", *shown)


def check_marks(checks: DataFrame) -> DataFrame:
    return checks.select("structure_id", F.col("checked_on").alias("on_day"), F.lit("check").alias("kind"), "id")


def first_check_after(peaks: DataFrame, checks: DataFrame, months: int = CHECK_MONTHS) -> DataFrame:
    """Each peak with the first special inspection within ``months``, if any."""
    return first_marks(peaks, check_marks(checks), {"check": months}).select("id", "structure_id", "peaked_on", F.col("check_id").cast("long").alias("check_id"), F.col("check_on").alias("checked_on"))


def floods_without_check(peaks: DataFrame, checks: DataFrame, months: int = CHECK_MONTHS) -> DataFrame:
    """Peaks that no special inspection follows within ``months``."""
    return first_marks(peaks, check_marks(checks), {"check": months}).where("check_id IS NULL").select(*peaks.columns)


def latest_peaks(peaks: DataFrame) -> DataFrame:
    """Actionable peaks (from their own mark on) that no later actionable one of the structure follows."""
    actionable = peaks.where(F.col("level_cm") >= F.coalesce("mhw_cm", "mark_one_cm", F.lit(0)))
    last = F.max("peaked_on").over(Window.partitionBy("structure_id"))
    return actionable.withColumn("_last", last).where("peaked_on = _last").drop("_last")


def flood_unmatched(peaks: DataFrame, checks: DataFrame) -> DataFrame:
    """Structures whose latest actionable peak no special inspection followed."""
    return floods_without_check(latest_peaks(peaks), checks).select("structure_id").distinct()


def marked_band() -> Column:
    """R7 of a row with a level and marks; Marke I and II stand in for missing MHW and HSW."""
    return policies.flood_band(*(F.col(x) for x in ("level_cm", "mhw_cm", "hsw_cm", "hhw_cm", "mark_one_cm", "mark_two_cm")))


def deciding_floods(peaks: DataFrame, checks: DataFrame) -> DataFrame:
    """Each structure's latest peak of a band above BELOW_TRIGGER, and whether no special inspection followed it.

    (structure_id, event_band, event_on, unmatched). Other than ``flood_unmatched`` this goes by the band, as
    planning, budgets, damage mechanisms and the flood assessment do.
    """
    banded = peaks.withColumn("event_band", marked_band()).where("event_band <> 'BELOW_TRIGGER'")
    last = first_per_key(banded, ["structure_id"], [F.col("peaked_on").desc(), F.col("id")])
    seen = first_marks(last, check_marks(checks), {"check": CHECK_MONTHS})
    return seen.select("structure_id", "event_band", F.col("peaked_on").alias("event_on"), F.col("check_id").isNull().alias("unmatched"))


def flood_history(rel) -> DataFrame:
    """Every peak with its band, the first special inspection and finding of scour within 12 months, and the first repair within 24."""
    dated = rel.inspections.select(F.col("id").alias("inspection_id"), F.col("inspected_on").alias("on_day")).where("on_day IS NOT NULL")
    scour = rel.findings.where(contains_any(F.col("description"), policies.SCOUR_WORDS)).join(dated, "inspection_id").select("structure_id", "on_day", F.lit("scour").alias("kind"), "id")
    repair = rel.works.where(contains_any(F.concat_ws(" ", "title", "reason"), REPAIR_WORDS)).select("structure_id", F.coalesce("started_on", "ended_on").alias("on_day"), F.lit("repair").alias("kind"), "id").where("on_day IS NOT NULL")
    marks = check_marks(rel.special_checks).withColumn("id", F.col("id").cast("string")).union(scour).union(repair.withColumn("id", F.col("id").cast("string")))
    out = first_marks(rel.flood_peaks, marks, {"check": CHECK_MONTHS, "scour": CHECK_MONTHS, "repair": 24})
    return out.withColumn("band", marked_band())
