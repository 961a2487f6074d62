"""One query for each operator family, over the relations of a directory; ``oracles`` has the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girderlake.functions import dates, geo, money, pages, policies, text
from girderlake.operators import expectations, lifecycle, maintenance, mechanisms, portfolio, records, search
from girderlake.operators.latest import first_per_key
from girderlake.operators.workflow import finding_health
from girderlake.plans.oracles import ORACLES, oracle
from girderlake.sources.relations import AS_OF, Relations

__all__ = ["QUERIES", "ORACLES", "oracle"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(make: Callable[[Relations], DataFrame]) -> Callable[[Relations], DataFrame]:
    """Register a query under its function's name; whole numbers come out as long."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = make(Relations(spark, sf_dir))
        return df.select(*[F.col(c).cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c) for c, kind in df.dtypes])

    run.__doc__ = make.__doc__
    QUERIES[make.__name__] = run
    return make


def _joined(column: str) -> F.Column:
    return F.array_join(column, ",")


@query
def portfolio_attention(rel):
    """Entry A: all structures, most urgent first."""
    df = portfolio.portfolio(rel, AS_OF)
    return df.select("structure_id", "ext_no", "attention_priority", _joined("reasons").alias("reasons"), "inspection_status", "tenths", "condition_trend", "open_findings", "open_recommendations", "network_points", "extra_vehicle_tenths_km").orderBy(F.col("attention_priority").desc(), F.col("extra_vehicle_tenths_km").desc(), "structure_id")


@query
def portfolio_page(rel):
    """P1 to P5, O1, O2"""
    q = portfolio.PortfolioQuery(road="machin", built_from=1910, has_open_finding=True, page=2, page_size=10)
    return portfolio.page(portfolio.portfolio(rel, AS_OF), q).select("structure_id", "road", "construction_year", "attention_priority")


@query
def portfolio_summary(rel):
    return portfolio.summary(portfolio.portfolio(rel, AS_OF), portfolio.PortfolioQuery(road="b"))


@query
def structure_summary(rel):
    return portfolio.structure_summary(rel.parts)


@query
def inspection_summary(rel):
    return portfolio.inspection_summary(rel.inspections)


@query
def finding_summary(rel):
    return portfolio.finding_summary(rel.findings)


@query
def current_previous_inspection(rel):
    return portfolio.current_and_previous(rel.inspections).select("part_id", "id", "tenths", "previous_tenths", "delta_tenths", "condition_trend")


@query
def headline_inspection(rel):
    return portfolio.headline_inspection(rel.inspections).select("structure_id", "id", "part_id", "tenths", "inspected_on")


@query
def headline_recommendation(rel):
    return portfolio.headline_recommendation(rel.recommendations).select("structure_id", "id", "urgency_rank", "target_year")


@query
def latest_traffic(rel):
    return portfolio.latest_traffic(rel.traffic).select("structure_id", "id", "observation_year", "observed_on", "daily_traffic")


@query
def existential_filters(rel):
    """Structures with an urgent open recommendation and a monitored finding."""
    urgent = rel.recommendations.where(F.col("status").isin(*portfolio.UNDONE) & (F.lower("urgency") == "sofort")).select(F.col("structure_id").alias("id"))
    watched = rel.findings.where("status = 'MONITORING'").select(F.col("structure_id").alias("id"))
    return rel.structures.join(urgent, "id", "left_semi").join(watched, "id", "left_semi").select("id", "ext_no")


@query
def antijoin_latest_event(rel):
    return portfolio.latest_peaks(rel.flood_peaks)


@query
def interval_antijoin(rel):
    return portfolio.floods_without_check(rel.flood_peaks, rel.special_checks)


@query
def interval_first_match(rel):
    return portfolio.first_check_after(rel.flood_peaks, rel.special_checks)


@query
def scour_regex_semijoin(rel):
    return portfolio.scour_sensitive(rel.structures, rel.findings, rel.components)


@query
def due_status(rel):
    due = dates.due_on(F.col("inspected_on"), F.col("cycle_months"))
    return rel.inspections.select("id", due.alias("due_on"), dates.due_status(due, portfolio.day(AS_OF)).alias("due_status"), dates.completed_years(F.col("inspected_on"), portfolio.day(AS_OF)).alias("age_years"))


@query
def condition_delta_scored(rel):
    return maintenance.scored_delta(rel.inspections)


@query
def network_points(rel):
    df = rel.networks.join(portfolio.latest_traffic(rel.traffic), "structure_id", "left")
    heavy = policies.heavy_vehicles(F.col("heavy_daily"), F.col("daily_traffic"), F.col("truck_share"))
    score = policies.network_points(F.col("daily_traffic"), heavy, F.col("extra_tenths_km"), F.col("alternatives"), F.col("road_class"))
    return df.select("structure_id", heavy.alias("heavy"), score.alias("points"), policies.network_band(score).alias("band"))


@query
def flood_band(rel):
    c = F.col
    return rel.gauges.select("structure_id", portfolio.marked_band().alias("band"))


@query
def damage_points(rel):
    """Four mechanisms of every structure."""
    gauges = rel.gauges.select("structure_id", (F.col("level_cm") >= F.col("trigger_cm")).alias("above_trigger"))
    daily = portfolio.latest_traffic(rel.traffic).select("structure_id", "daily_traffic")
    last = portfolio.deciding_floods(rel.flood_peaks, rel.special_checks).where("unmatched")
    return mechanisms.mechanisms(rel.structures, rel.parts, rel.findings, rel.components, rel.climates, daily, gauges, last, int(AS_OF[:4]))


@query
def maintenance_priority(rel):
    items = maintenance.maintenance_items(rel, AS_OF)
    codes = F.array_join(F.transform("reasons", lambda r: r["code"]), ",")
    return items.select("id", "priority", policies.level_name(F.col("priority")).alias("level"), codes.alias("reasons"), "view", "estimate", "estimate_origin")


@query
def planning_list(rel):
    """O3: the most urgent unplanned items; a top-k report."""
    return maintenance.planning_list(maintenance.maintenance_items(rel, AS_OF), "unplanned").select("id", "priority", "target_year").limit(50)


@query
def planning_views(rel):
    return maintenance.view_counts(maintenance.maintenance_items(rel, AS_OF))


def _budget_items(rel) -> DataFrame:
    """Items of each planned year, against a budget that some years have."""
    budget = F.when(F.col("planned_year") % 4 != 0, F.col("planned_year").cast("decimal(16,2)") * 20000).cast("decimal(16,2)")
    return maintenance.maintenance_items(rel, AS_OF).where("intervention_id IS NOT NULL").withColumn("budget", budget)


@query
def budget_summary(rel):
    return maintenance.budget_summary(_budget_items(rel), ["planned_year"])


@query
def funded_prefix(rel):
    return maintenance.funded_prefix(_budget_items(rel), ["planned_year"]).select("planned_year", "id", "running", "funded")


@query
def price_index_restatement(rel):
    source = F.col("target_year") + 8
    amount, beyond = money.restated(F.col("cost"), source, F.lit(2025))
    return rel.recommendations.where("cost IS NOT NULL").select("id", amount.alias("amount"), beyond.alias("extrapolated"))


def _scenarios(rel) -> DataFrame:
    """One what-if plan for each customer segment."""
    names = rel.structures.groupBy("road").agg(F.min("id").alias("scenario_id"))
    return names.withColumns({"start_year": F.lit(1998).cast("long"), "n_years": F.lit(5).cast("long")})


def _envelopes(rel) -> DataFrame:
    rows = maintenance.year_spine(_scenarios(rel)).where("(year + scenario_id) % 4 <> 0")
    return rows.select("scenario_id", "year", (F.col("year").cast("decimal(16,2)") * 3000).cast("decimal(16,2)").alias("budget"))


def _assigned(rel) -> DataFrame:
    items = rel.interventions.join(rel.structures.select(F.col("id").alias("structure_id"), "road"), "structure_id").join(_scenarios(rel), "road")
    items = items.withColumn("asked", F.when(F.col("id") % 4 == 0, F.col("planned_year") + 1)).withColumn("has_row", F.col("id") % 4 <= 1)
    return items.withColumn("assigned_year", maintenance.effective_year("asked", "planned_year", "has_row", "start_year", "n_years"))


@query
def scenario_year_spine(rel):
    return maintenance.scenario_years(_scenarios(rel).drop("road"), _assigned(rel), _envelopes(rel)).drop("start_year", "n_years")


@query
def scenario_totals(rel):
    return maintenance.scenario_totals(_assigned(rel))


@query
def scenario_compare(rel):
    """Two plans side by side by year."""
    years = maintenance.scenario_years(_scenarios(rel).drop("road"), _assigned(rel), _envelopes(rel))
    ids = _scenarios(rel).agg(F.min("scenario_id").alias("lo"), F.max("scenario_id").alias("hi"))
    side = lambda which: years.join(F.broadcast(ids), F.col("scenario_id") == F.col(which)).select("year", F.col("value").alias(f"{which}_value"), F.col("budget").alias(f"{which}_budget"))
    return side("lo").join(side("hi"), "year")


@query
def scenario_autofill(rel):
    """G1; its SQL goes through each plan's items one by one."""
    items = _assigned(rel).withColumn("source", F.when(F.col("id") % 4 == 0, F.lit("USER_OVERRIDE")))
    ranks = maintenance.maintenance_items(rel, AS_OF).where("intervention_id IS NOT NULL").select("id", "priority", "work_type")
    candidates = items.select("scenario_id", "id", "planned_year", F.col("asked").alias("assigned_year"), "source", "estimate").join(ranks, "id")
    return maintenance.auto_fill(_scenarios(rel).drop("road"), candidates, _envelopes(rel))


@query
def search_ranked(rel):
    return search.search_structures(rel.structures, "Customer#00000001", limit=10).select("id", "ext_no", "match_rank", "total")


@query
def history_union(rel):
    return records.history(rel.inspections, rel.recommendations.where("status = 'COMPLETED'"), rel.traffic)


@query
def evidence_union(rel):
    """Evidence of three kinds of entities under one roof."""
    seen = rel.evidence.select("kind", "entity_id", "doc_id", "page")
    second = rel.inspections.where("inspected_on IS NOT NULL").select(F.lit("INSPECTION").alias("kind"), F.col("id").alias("entity_id"), (F.col("id") % 500).alias("doc_id"), (F.col("id") % 30).alias("page"))
    third = rel.traffic.select(F.lit("TRAFFIC").alias("kind"), F.col("id").alias("entity_id"), (F.col("id") % 700).alias("doc_id"), F.lit(None).cast("long").alias("page"))
    return seen.unionByName(second).unionByName(third)


@query
def array_agg_pages(rel):
    df = records.pages_of(rel.evidence, rel.documents, "doc_id")
    return df.select("doc_id", "n_evidence", _joined(F.transform("pages", lambda p: p.cast("string"))).alias("pages"))


@query
def provenance_rollup(rel):
    return records.provenance(rel.evidence, rel.recommendations, "RECOMMENDATION")


@query
def finding_quality_exists(rel):
    return records.finding_quality(rel.findings, rel.evidence)


def _checked(rel: Relations) -> DataFrame:
    """Each structure's findings to review and without a page; findings come dealt by inspection."""
    tasks = rel.tasks("lineitem", "orders")
    return finding_health(rel.dealing(tasks, "l_orderkey", "lineitem").cited_findings, rel.structures, rel.source_evidence, tasks)


def _placed(rel: Relations) -> Relations:
    """The relations made from ``orders`` dealt by structure, which is the document too where they name one."""
    return rel.dealing(rel.tasks("orders"), "o_custkey", "orders")


def _health(rel: Relations, placed: Relations) -> DataFrame:
    return records.data_health(rel, placed, _checked(rel), int(AS_OF[:4]))


@query
def data_health(rel):
    return _health(rel, _placed(rel))


@query
def document_overview(rel):
    """Indicators that need attention, by code, over the whole portfolio."""
    health = _health(rel, _placed(rel))
    return health.groupBy("code").agg(F.count_if(records.needs_attention(F.col("status"))).alias("n_attention"), F.sum("count").alias("total"))


@query
def eligible_antijoin(rel):
    """P10: unfinished recommendations without an intervention."""
    taken = rel.interventions.select(F.col("recommendation_id").alias("id"))
    return rel.recommendations.where("status <> 'COMPLETED'").join(taken, "id", "left_anti").select("id", "work_type")


@query
def parse_decimals(rel):
    c = F.col("number_text")
    return rel.raw_values.select("id", text.decimal_text(c).alias("plain"), text.decimal_text(c, negative=True).alias("signed"), text.integer(c).alias("whole"))


@query
def parse_dates(rel):
    return rel.raw_values.select("id", text.date(F.col("date_text")).alias("day"))


@query
def unit_inference(rel):
    return rel.raw_values.select("id", text.unit(F.col("unit_text")).alias("unit"), text.unit_in(F.col("work_text")).alias("shown"), text.currency(F.col("currency_text")).alias("currency"))


@query
def classify_status(rel):
    c = F.col
    return rel.raw_values.select("id", text.state(c("type_text"), text.INSPECTION_TYPES, "OTHER").alias("type"), text.state(c("finding_text"), text.FINDING_STATES).alias("state"), text.urgency(c("urgency_text")).alias("urgency"), text.rating(c("rating_text")).alias("rating"))


@query
def report_inspectors(rel):
    return records.inspectors(rel.report_pages, "document_id", "number", "id", "text")


@query
def document_kinds(rel):
    """F22, and F17's country codes."""
    return rel.filed.select("id", *[kind.alias(name) for name, kind in pages.document_kinds(F.col("type"), F.col("filename")).items()], geo.country(F.col("country")).alias("country"))


@query
def repaired_findings(rel):
    """E15 on findings as a model might put them out: evidence at the record, at a field, or nowhere."""
    c, i = F.col, F.col("id")
    none = F.array().cast("array<bigint>")
    field = lambda value, held: F.struct(c(value).alias("value"), held.alias("evidence"))
    own = F.when(i % 3 == 0, F.array(i, i + 7)).when(i % 3 == 1, none)
    stability = F.when(i % 7 != 3, field("rating_text", F.when(i % 4 == 0, F.array(i + 1, i + 2)).otherwise(none)))
    status = field("finding_text", F.when(i % 5 != 0, F.array(i + 3)))
    words = field("work_text", F.when(i % 10 == 0, F.array(i + 5)))  # no reader: only its evidence counts
    items = rel.raw_values.select("id", own.alias("evidence"), stability.alias("stability"), status.alias("status"), words.alias("description"))
    done = records.repaired(items, {"stability": text.rating, "status": lambda x: text.state(x, text.FINDING_STATES)})
    told = lambda x: F.coalesce(F.array_join(x, ","), F.lit(""))
    return done.select("id", told("evidence").alias("evidence"), c("stability.value").alias("stability"), told("stability.evidence").alias("stability_evidence"), c("status.value").alias("status"), told("status.evidence").alias("status_evidence"))


@query
def text_features(rel):
    return records.text_metrics(rel.documents.select("doc_id", "text"), "doc_id", "text")


@query
def regex_rows(rel):
    return records.finding_rows(rel.raw_values, "id", "page_text")


@query
def keep_first(rel):
    """The first finding of each part and description, by id."""
    return first_per_key(rel.findings.where("description IS NOT NULL"), ["part_id", "description"], [F.col("id")]).select("part_id", "description", "id")


@query
def coalesce_merge(rel):
    return records.merged(rel.recommendations, ["structure_id"], "id", ["urgency", "cost", "target_year"])


@query
def identity_keys(rel):
    return rel.structures.select("id", records.identity_key("structure", "ext_no", "road", "crossed").alias("identity"))


@query
def reconcile_actions(rel):
    """yesterday's bindings against today's: some changed, some under another key, so gone here and new there."""
    moved = lambda digit: F.when(F.col("id") % 10 == digit, -1 - F.col("id")).otherwise(F.col("id")).alias("key")
    today = rel.recommendations.select(moved(0), F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.coalesce("urgency", F.lit("~"))), 256).alias("fingerprint"))
    before = rel.recommendations.select(moved(1), F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.when(F.col("id") % 7 == 0, F.lit("x")).otherwise(F.coalesce("urgency", F.lit("~")))), 256).alias("fingerprint"))
    return records.reconcile(before.withColumnRenamed("key", "id"), today.withColumnRenamed("key", "id"), ["id"])


@query
def chunk_islands(rel):
    """U10 over all turns, numbered with a gap after every third one; turns without a number form no run."""
    rows = rel.conversations.where("turn IS NOT NULL").select("conv_id", F.expr("turn + turn div 3").alias("turn"))
    return records.chunks(rows, "conv_id", "turn", 2)


@query
def upsert_programme(rel):
    """Budgets by year, some of them set anew."""
    years = rel.interventions.select("planned_year").distinct()
    current = years.select("planned_year", F.lit(100).cast("long").alias("amount"))
    incoming = years.select((F.col("planned_year") + 2).alias("planned_year"), F.lit(250).cast("long").alias("amount"))
    return records.upsert(current, incoming, ["planned_year"])


@query
def expectation_violations(rel):
    return expectations.violations(rel)


@query
def projected_coordinates(rel):
    """M7, M8"""
    points = rel.points.select("id", F.col("east").cast("double").alias("east"), F.col("north").cast("double").alias("north"))
    even = geo.utm(points.where("id % 2 = 0"), F.col("east"), F.col("north"), F.lit(32))
    odd = geo.gauss_krueger(points.where("id % 2 = 1"), F.col("east"), F.col("north"))
    e5 = lambda c: F.round(F.col(c) * 100000).cast("long").alias(f"{c}_e5")
    return even.unionByName(odd).select("id", e5("latitude"), e5("longitude"))


@query
def page_contents(rel):
    """M9, F18, F21, R17, P17"""
    c = F.col
    df = pages.coordinates(rel.book_pages, "text")
    return df.select("id", F.round(c("latitude") * 10000).cast("long").alias("latitude_e4"), F.round(c("longitude") * 10000).cast("long").alias("longitude_e4"), "method", pages.structure_number(c("text")).alias("structure_number"), pages.road(c("text")).alias("road"), _joined(pages.categories(c("text"))).alias("categories"), pages.safe_filename(c("filename")).alias("filename"), pages.page_url(c("url"), c("number")).alias("url"))


@query
def page_labels(rel):
    """What a page's text, file name and address tell."""
    c = F.col
    return rel.book_pages.select("id", pages.structure_number(c("text")).alias("structure_number"), pages.road(c("text")).alias("road"), _joined(pages.categories(c("text"))).alias("categories"), pages.safe_filename(c("filename")).alias("filename"), pages.page_url(c("url"), c("number")).alias("url"))


@query
def photo_page(rel):
    """The page of each document that shows its photo."""
    scored = rel.book_pages.where(F.col("number") <= pages.PHOTO_PAGES).withColumn("score", pages.photo_score(F.col("text"), F.col("number"), F.col("by_sight")))
    return first_per_key(scored.where(F.col("score") >= pages.PHOTO_SCORE), ["document_id"], [F.col("score").desc(), F.col("number"), F.col("id")]).select("document_id", "number", "score")


@query
def latest_runs(rel):
    """By document the latest run, the latest finished one, the next attempt, and whether the latest failed."""
    last = lifecycle.latest_run(rel.runs).select("document_id", F.col("id").alias("run_id"), "status")
    done = lifecycle.latest_run(rel.runs, ("SUCCEEDED", "FAILED")).select("document_id", F.col("id").alias("finished_id"))
    failed = lifecycle.unresolved(rel.runs).withColumn("failed", F.lit(True))
    df = last.join(done, "document_id", "left").join(lifecycle.next_attempt(rel.runs), "document_id").join(failed, "document_id", "left")
    return df.withColumn("failed", F.coalesce("failed", F.lit(False)))


@query
def bad_transitions(rel):
    return lifecycle.bad_transitions(rel.runs)


@query
def model_usage(rel):
    return lifecycle.usage(rel.runs, ["document_id"])


@query
def work_package_readiness(rel):
    """Checks of every intervention in tender preparation."""
    c = F.col
    seen = rel.evidence.select(c("entity_id").alias("id")).distinct().withColumn("has_evidence", F.lit(True))
    due = rel.inspections.select("id", dates.due_status(dates.due_on(c("inspected_on"), c("cycle_months")), portfolio.day(AS_OF)).alias("due_status"))
    df = rel.interventions.where("status = 'TENDER_PREPARATION'").join(seen, "id", "left").join(due, "id", "left").join(rel.networks.select("structure_id", F.lit(True).alias("traffic_known")), "structure_id", "left")
    return lifecycle.readiness(df.withColumns({"has_quantity": c("id") % 2 == 0, "has_estimate": c("estimate").isNotNull(), "has_drawing": c("id") % 4 == 1}))


@query
def traffic_management(rel):
    df = rel.networks.join(portfolio.latest_traffic(rel.traffic), "structure_id", "left")
    heavy = policies.heavy_vehicles(F.col("heavy_daily"), F.col("daily_traffic"), F.col("truck_share"))
    return df.select("structure_id", lifecycle.traffic_management(F.col("extra_tenths_km"), F.col("alternatives"), heavy).alias("requirement"))


@query
def natural_key_enrichment(rel):
    """Coordinates by external number where both are missing."""
    base = rel.structures.select("id", "ext_no", F.when(F.col("id") % 3 == 0, F.col("id") % 90).alias("latitude"), F.when(F.col("id") % 4 == 0, F.col("id") % 180).alias("longitude"))
    source = rel.structures.select(F.when(F.col("id") % 5 != 0, F.col("ext_no")).alias("ext_no"), F.lit(51).cast("long").alias("latitude"), F.lit(7).cast("long").alias("longitude"))
    return lifecycle.enrich(base, source, ["ext_no"], ["latitude", "longitude"])


@query
def plan_intervention_outcomes(rel):
    commands = rel.recommendations.select((F.col("id") + 500).alias("recommendation_id"))
    return lifecycle.plan_outcomes(commands, rel.recommendations, rel.interventions)


@query
def membership_toggle(rel):
    """Every intervention has a command; one that asks for nothing leaves it as it is."""
    commands = rel.interventions.select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 4 == 0).alias("include"), (F.col("planned_year") + F.when(F.col("id") % 10 == 0, 1).otherwise(0)).alias("year"))
    return lifecycle.toggle_membership(rel.interventions, commands)


@query
def scenario_seed(rel):
    items = rel.interventions.join(rel.structures.select(F.col("id").alias("structure_id"), "road"), "structure_id")
    return lifecycle.seed_assignments(_scenarios(rel), items)


@query
def scenario_adopt(rel):
    return lifecycle.adopt(rel.interventions, _assigned(rel))


@query
def replace_pages(rel):
    """Pages of every third document anew."""
    now = rel.book_pages.select("document_id", "number", F.length("text").cast("long").alias("size"))
    fresh = rel.book_pages.where("document_id % 3 = 0 AND number <= 2").select("document_id", "number", F.lit(0).cast("long").alias("size"))
    return lifecycle.replace_children(now, fresh, "document_id")


@query
def checksum_duplicates(rel):
    return lifecycle.duplicates(rel.documents.where("text IS NOT NULL"), "text", ["doc_id"])


@query
def previous_year_companion(rel):
    by_year = rel.traffic.groupBy("structure_id", "observation_year").agg(F.max("daily_traffic").alias("daily"))
    return lifecycle.with_previous_year(by_year, "structure_id", "observation_year", "daily")


@query
def flood_exposure(rel):
    """Assessment of every gauged structure."""
    done = lifecycle.flood_assessment(maintenance.flood_sides(rel), portfolio.open_scour(rel.findings))
    return done.select("structure_id", "band", "watch", "trigger_exceeded", "scour_sensitive", "open_scour", "unmatched", F.col("action.kind").alias("action"), F.col("action.event_year").alias("event_year"), F.col("action.peaked_on").alias("peaked_on"), _joined("reasons").alias("reasons"))


@query
def condition_bands(rel):
    """How many valid scores lie in each band of the condition scale, by year."""
    scored = rel.inspections.where("inspected_on IS NOT NULL AND tenths BETWEEN 10 AND 40")
    band = text.first_of((F.col("tenths") <= 19, "good"), (F.col("tenths") <= 24, "fair"), (F.col("tenths") <= 29, "poor")).otherwise("severe")
    return scored.groupBy(F.year("inspected_on").alias("year"), band.alias("band")).agg(F.count("*").alias("n"))


@query
def budget_years(rel):
    """Years of any programme or intervention, and the chosen one."""
    a = rel.interventions.select(F.col("planned_year").alias("year"))
    b = rel.recommendations.where("target_year IS NOT NULL").select(F.col("target_year").alias("year"))
    return a.unionByName(b).unionByName(rel.spark.range(1).select(F.lit(2026).cast("long").alias("year"))).distinct()


@query
def evidence_sources(rel):
    """Evidence grouped by document and page, with its distinct entities."""
    own = rel.evidence.groupBy("doc_id", "page").agg(F.count_distinct("entity_id").alias("n_entities"), F.array_join(F.array_sort(F.collect_set("origin")), "+").alias("origins"))
    return own.orderBy("doc_id", F.col("page").asc_nulls_last())


@query
def finding_links(rel):
    """References in page texts to findings of the same page, by their first digits."""
    refs = rel.raw_values.select(F.col("id").alias("page_id"), F.explode(F.array_distinct(F.regexp_extract_all("page_text", F.lit(r"\[(\d+)\]"), F.lit(1)))).alias("ref"))
    refs = refs.select("page_id", F.col("ref").cast("long").alias("number"))
    return refs.join(records.finding_rows(rel.raw_values, "id", "page_text"), ["page_id", "number"], "left")


@query
def pair_repair(rel):
    """A value without its unit goes, an amount without currency is in EUR, a missing state is OPEN."""
    v = rel.raw_values
    amount, unit = text.decimal_text(F.col("number_text")), text.unit(F.col("unit_text"))
    return v.select("id", F.when(unit.isNotNull(), amount).alias("quantity"), F.when(amount.isNotNull(), unit).alias("unit"), F.when(amount.isNotNull(), F.coalesce(text.currency(F.col("currency_text")), F.lit("EUR"))).alias("currency"), F.coalesce(text.state(F.col("finding_text"), text.FINDING_STATES), F.lit("OPEN")).alias("state"))


@query
def month_series(rel):
    """X1, X2"""
    c = F.col
    long = F.transform(F.sequence(F.lit(1), F.when(c("short"), 11).otherwise(12)), lambda m: c("base") + m)
    other = F.transform(F.sequence(F.lit(1), F.when(c("structure_id") % 5 == 0, 10).otherwise(12)), lambda m: c("structure_id") % 7 * m)
    df = rel.monthly.withColumns({"a": F.when(c("base").isNotNull(), long), "b": other})
    return df.select("structure_id", F.inline(records.month_structs(c("a"), c("b"))))


@query
def fingerprints(rel):
    df = rel.recommendations.select("id", records.plain_decimal(F.col("cost")).alias("cost"), F.col("sourced_on").cast("string").alias("day"), "urgency")
    return df.select("id", records.fingerprint("urgency", "cost", "day").alias("fingerprint"))


@query
def linked_findings(rel):
    df = records.linked(rel.recommendations, rel.findings, rel.inspections)
    return df.select("id", F.array_join("labels", "; ").alias("labels"), "worst", "n", "inspected_on")


@query
def evidence_dedup(rel):
    rows = rel.evidence.withColumn("slot", F.col("entity_id") % 100)
    return records.deduplicated(rows, ["doc_id", "origin", "slot"], [F.col("page").desc_nulls_last(), F.col("entity_id").desc()]).select("doc_id", "origin", "slot", "page", "entity_id")


@query
def parent_repair(rel):
    """Recommendations of parts that nobody knows go to the structure's first part."""
    children = rel.recommendations.select("id", "structure_id", (F.col("structure_id") * 10 + F.col("id") % 3).alias("part_id"))
    return records.with_parents(children, rel.parts, "part_id", F.col("structure_id") * 10).select("id", "part_id", "repaired")


@query
def finding_descriptions(rel):
    return records.descriptions(rel.raw_values, "id", "page_text")


@query
def pages_by_category(rel):
    df = records.by_category(rel.book_pages, pages.categories(F.col("text")))
    return df.select("document_id", "category", _joined(F.transform("pages", lambda p: p.cast("string"))).alias("pages"))


@query
def text_choice(rel):
    """Recognised text for short pages, and a title that skips what is missing."""
    chosen = records.longer_text(F.col("text"), F.concat(F.lit("erkannt "), F.col("filename"), F.lit(" mit viel mehr Text als vorher, wie er auf der Seite steht, und noch etwas")))
    title = F.concat_ws(" · ", F.nullif(F.regexp_extract("text", "^[A-Za-z]+", 0), F.lit("")), F.coalesce("url", F.lit("Unidentified")))
    return rel.book_pages.select("id", F.length(chosen).alias("size"), title.alias("title"))


@query
def json_properties(rel):
    return rel.events.select("event_id", records.json_number(F.col("props"), "$.k").alias("k"))


from girderlake.plans import admission, extraction, programmes, workflow  # noqa: E402, F401  their queries register themselves above
