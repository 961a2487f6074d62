"""Runs, work packages, enrichment and commands: new versions of tables and outcomes as columns, never updates in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from girderlake.functions.text import first_of
from girderlake.operators import portfolio
from girderlake.operators.latest import first_per_key

#: States that may follow each other in an extraction run.
NEXT_STATES = {
    "PENDING": ("CLASSIFYING", "FAILED"),
    "CLASSIFYING": ("EXTRACTING", "FAILED"),
    "EXTRACTING": ("VALIDATING", "FAILED"),
    "VALIDATING": ("PERSISTING", "FAILED"),
    "PERSISTING": ("SUCCEEDED", "FAILED"),
}


def latest_run(runs: DataFrame, statuses: tuple[str, ...] | None = None) -> DataFrame:
    """Each document's run of the highest attempt; with ``statuses`` only those are ranked."""
    own = runs if statuses is None else runs.where(F.col("status").isin(*statuses))
    return first_per_key(own, ["document_id"], [F.col("attempt").desc(), F.col("id").desc()])


def next_attempt(runs: DataFrame) -> DataFrame:
    """A10"""
    return runs.groupBy("document_id").agg((F.max("attempt") + 1).alias("next_attempt"))


def unresolved(runs: DataFrame) -> DataFrame:
    """Documents whose latest run failed."""
    return latest_run(runs).where("status = 'FAILED'").select("document_id")


def bad_transitions(log: DataFrame) -> DataFrame:
    """Steps of a run's log that its state before does not allow, and first steps other than PENDING."""
    before = F.lag("status").over(Window.partitionBy("document_id").orderBy("attempt", "id"))
    known = F.create_map(*[x for k, v in NEXT_STATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    allowed = F.coalesce(F.array_contains(F.try_element_at(known, F.col("before")), F.col("status")), F.col("before").isNull() & (F.col("status") == "PENDING"))
    return log.withColumn("before", before).where(~allowed).select("document_id", "id", "before", "status")


def usage(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens and cost by key; null where no run tells any, and no cost where currencies differ."""
    one = F.count_distinct("currency") <= 1
    return runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.sum("tokens").alias("tokens"), F.when(one, F.sum("cost_micros")).alias("cost_micros"), (~one).alias("mixed_currency"))


def readiness(packages: DataFrame) -> DataFrame:
    """The seven checks of a work package (has_evidence, has_quantity, due_status, has_estimate, has_drawing, traffic_known).

    One row per package and check: state AVAILABLE, MISSING or REQUIRED.
    """
    available = lambda c: F.when(F.coalesce(c, F.lit(False)), "AVAILABLE").otherwise("MISSING")
    checks = [
        ("SOURCE_EVIDENCE_AVAILABLE", available(F.col("has_evidence"))),
        ("QUANTITIES_KNOWN", available(F.col("has_quantity"))),
        ("CURRENT_INSPECTION_AVAILABLE", available(F.col("due_status").isin("CURRENT", "DUE_SOON"))),
        ("COST_ESTIMATE_AVAILABLE", available(F.col("has_estimate"))),
        ("DRAWINGS_AVAILABLE", available(F.col("has_drawing"))),
        ("TRAFFIC_MANAGEMENT_REQUIREMENTS_KNOWN", available(F.col("traffic_known"))),
        ("SITE_VERIFICATION_REQUIRED", F.lit("REQUIRED")),
    ]
    return packages.select("id", F.inline(F.array(*[F.struct(F.lit(code).alias("code"), state.alias("state")) for code, state in checks])))


def traffic_management(extra_tenths_km: Column, alternatives: Column, heavy: Column) -> Column:
    """What a closure asks for, as text; null without a detour's length."""
    diversion = first_of(((extra_tenths_km >= 150) | (alternatives == 0), "Weiträumige Umleitung"), (extra_tenths_km >= 50, "Örtliche Umleitung")).otherwise("Local traffic management")
    km = F.concat(F.floor(extra_tenths_km / 10).cast("string"), F.lit("."), (extra_tenths_km % 10).cast("string"))
    others = first_of((alternatives.isNull(), ""), (alternatives == 0, " No comparable-class alternative crossing."), (alternatives == 1, " 1 comparable-class alternative crossing.")).otherwise(F.concat(F.lit(" "), alternatives.cast("string"), F.lit(" comparable-class alternative crossings.")))
    lorries = F.when(heavy >= 3000, F.concat(F.lit(" Diversion must be HGV-capable ("), F.format_number(heavy, 0), F.lit(" heavy vehicles/day)."))).otherwise("")
    return F.when(extra_tenths_km.isNotNull(), F.concat(diversion, F.lit(" required (additional "), km, F.lit(" km)."), others, lorries))


def enrich(base: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns that are all null filled from the source of the same natural key; others stay."""
    other = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    bare = F.lit(True)
    for c in columns:
        bare = bare & F.col(c).isNull()
    filled = [F.when(bare, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return base.join(other, keys, "left").select(*[c for c in base.columns if c not in columns], *filled)


def plan_outcomes(commands: DataFrame, recommendations: DataFrame, interventions: DataFrame) -> DataFrame:
    """What creating an intervention for each command's recommendation comes to."""
    df = commands.join(recommendations.select(F.col("id").alias("recommendation_id"), F.col("status").alias("_status")), "recommendation_id", "left")
    df = df.join(interventions.select("recommendation_id", F.lit(True).alias("_taken")), "recommendation_id", "left")
    outcome = first_of((F.col("_status").isNull(), "NOT_FOUND"), (~F.col("_status").isin("OPEN", "APPROVED", "SCHEDULED", "IN_PROGRESS"), "NOT_ACTIONABLE"), (F.col("_taken"), "ALREADY_EXISTS")).otherwise("CREATED")
    return df.select("recommendation_id", outcome.alias("outcome"))


def toggle_membership(interventions: DataFrame, commands: DataFrame) -> DataFrame:
    """Every intervention's state after its command (include, year), and what came of it.

    Only a planned one may be included and only a budgeted one taken out, and the programme's year must be its own.
    """
    df = interventions.join(commands, "id", "left")
    ask = F.col("include")
    outcome = first_of((ask.isNull(), "UNTOUCHED"), (F.col("year") != F.col("planned_year"), "YEAR_MISMATCH"), (ask & (F.col("status") == "PLANNED"), "INCLUDED"), (~ask & (F.col("status") == "BUDGETED"), "REMOVED")).otherwise("NOT_ALLOWED")
    df = df.withColumn("outcome", outcome)
    return df.select("id", first_of((F.col("outcome") == "INCLUDED", "BUDGETED"), (F.col("outcome") == "REMOVED", "PLANNED")).otherwise(F.col("status")).alias("status"), "outcome")


def adopt(interventions: DataFrame, assigned: DataFrame) -> DataFrame:
    """Interventions after a plan is adopted: those with a year move there and are budgeted, others go back to planned."""
    df = interventions.join(assigned.select("id", "assigned_year", F.lit(True).alias("_in_plan")), "id", "left")
    open_ = F.col("status").isin("PLANNED", "BUDGETED") & F.col("_in_plan")
    status = first_of((open_ & F.col("assigned_year").isNotNull(), "BUDGETED"), (open_, "PLANNED")).otherwise(F.col("status"))
    return df.select("id", F.when(open_ & F.col("assigned_year").isNotNull(), F.col("assigned_year")).otherwise(F.col("planned_year")).alias("planned_year"), status.alias("status"))


def seed_assignments(scenarios: DataFrame, interventions: DataFrame) -> DataFrame:
    """An assignment for every intervention of a plan's road: its planned year if the horizon has it, else none."""
    inside = F.col("planned_year").between(F.col("start_year"), F.col("start_year") + F.col("n_years") - 1)
    return interventions.join(scenarios, "road").select("scenario_id", "id", F.when(inside, F.col("planned_year")).alias("assigned_year"), F.lit("SEEDED").alias("source"))


def seed_envelopes(scenarios: DataFrame) -> DataFrame:
    """A new plan's yearly amount, the same in each year of its horizon; amount and currency are both there or neither."""
    both = F.col("amount").isNotNull() & F.col("currency").isNotNull()
    year = F.explode(F.sequence(F.col("start_year"), F.col("start_year") + F.col("n_years") - 1))
    return scenarios.select("scenario_id", year.alias("year"), F.when(both, F.col("amount")).alias("budget"), F.when(both, F.col("currency")).alias("currency"))


def newest_scenarios(scenarios: DataFrame, changes: DataFrame) -> DataFrame:
    """Plans by their last change, the newest first, ones without any last, then by id."""
    last = changes.groupBy("scenario_id").agg(F.max("changed_on").alias("updated_on"))
    return scenarios.join(last, "scenario_id", "left").orderBy(F.col("updated_on").desc_nulls_last(), "scenario_id")


def extraction_contexts(runs: DataFrame, pages: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Z3: each document's newest run of the given statuses, with its pages in order, if it has all that the run counted.

    Runs of other statuses are left out before ranking. A run that counted no pages, or another number than there are, gives
    no row, and an older one does not take its place.
    """
    order = [F.col("created_at").desc(), F.col("id").desc()]
    last = first_per_key(runs.where(F.col("status").isin(*statuses)), ["document_id"], order)
    own = pages.groupBy("document_id").agg(F.count("*").alias("n_pages"), F.sort_array(F.collect_list("number")).alias("numbers"))
    return last.join(own, "document_id").where("n_pages = page_count").select("document_id", F.col("id").alias("run_id"), "status", "n_pages", "numbers")


def document_list(documents: DataFrame, runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Every document with its newest processing run of any status and its page numbers in order."""
    last = first_per_key(runs, ["document_id"], [F.col("created_at").desc(), F.col("id").desc()]).select("document_id", F.col("id").alias("run_id"), F.col("status").alias("run_status"))
    own = pages.groupBy("document_id").agg(F.sort_array(F.collect_set("number")).alias("numbers"))
    return documents.join(last, "document_id", "left").join(own, "document_id", "left")


def replace_children(current: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """All children of the incoming parents are replaced, those of others stay."""
    return current.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


def duplicates(files: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """Checksums that several files share, with how many and the first key."""
    summed = files.select(F.sha2(F.col(content).cast("binary"), 256).alias("checksum"), *keys)
    return summed.groupBy("checksum").agg(F.count("*").alias("n"), F.min(keys[0]).alias("first")).where("n > 1")


def with_previous_year(rows: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """Each key's newest year with the year before it."""
    order = Window.partitionBy(key).orderBy(F.col(year).desc())
    return rows.withColumns({"_rn": F.row_number().over(order), "previous_year": F.lead(year).over(order), "previous_value": F.lead(value).over(order)}).where("_rn = 1").drop("_rn")


def flood_assessment(sides: DataFrame, scoured: DataFrame) -> DataFrame:
    """Exposure of every structure with a gauge, from ``maintenance.flood_sides`` and structures with open scour.

    A structure is watched if it is prone to scour and its gauge is above its trigger or its deciding flood was never
    followed by a special inspection. Its band is then the gauge's (MODERATE at least) above the trigger, else the deciding flood's;
    unwatched, the gauge's. The action is an extraordinary inspection after that flood; reasons are codes in a fixed order.
    """
    df = sides.join(scoured.select("structure_id").distinct().withColumn("open_scour", F.lit(True)), "structure_id", "left")
    yes = lambda name: F.coalesce(name, F.lit(False))
    water, prone, above, unmatched = portfolio.over_water(), portfolio.scour_prone(), F.col("above_trigger"), yes("unmatched")
    watch = prone & (above | unmatched)
    raised = F.when(F.col("current_band") == "BELOW_TRIGGER", "MODERATE").otherwise(F.col("current_band"))
    band = F.when(watch, F.when(above, raised).otherwise(F.coalesce("event_band", F.lit("MODERATE")))).otherwise(F.col("current_band"))
    codes = [
        F.lit("NEAREST_GAUGE"),
        F.when(water, "WATERCOURSE"),
        F.when(yes("washed"), "SCOUR_HISTORY").when(yes("founded") & water, "FOUNDATION_TYPE"),
        F.when(above, "TRIGGER_EXCEEDED"),
        F.when(unmatched, "UNMATCHED_FLOOD_EVENT"),
    ]
    action = F.when(prone & unmatched, F.struct(F.lit("EXTRAORDINARY_INSPECTION").alias("kind"), F.year("event_on").alias("event_year"), F.col("event_on").alias("peaked_on")))
    return df.select("structure_id", band.alias("band"), watch.alias("watch"), above.alias("trigger_exceeded"), prone.alias("scour_sensitive"), yes("open_scour").alias("open_scour"), unmatched.alias("unmatched"), action.alias("action"), F.array_compact(F.array(*codes)).alias("reasons"))
