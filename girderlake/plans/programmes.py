"""Queries over programmes, plans, histories, documents' runs and repaired records, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from girderlake.functions import text
from girderlake.operators import lifecycle, maintenance, portfolio, records
from girderlake.plans.oracles import ORACLES, VIEWS
from girderlake.plans.queries import _assigned, _scenarios, query
from girderlake.sources.relations import AS_OF, with_relations

SQL: dict[str, str] = {}


def sql(text: str):
    """The SQL of the query below."""

    def keep(made):
        SQL[made.__name__] = text
        return made

    return keep


@sql(
    """SELECT structure_id, 'INSPECTION' AS kind, id, inspected_on AS happened_on, coalesce(CASE type WHEN 'MAIN' THEN 'Main' WHEN 'SIMPLE' THEN 'Simple' WHEN 'SPECIAL' THEN 'Special' END || ' inspection', 'Inspection') AS title, tenths, CAST(NULL AS DATE) AS ended_on, NULL AS reason, NULL AS daily_traffic FROM {inspections}
    UNION ALL SELECT structure_id, 'HISTORICAL_WORK', id, started_on, coalesce(title, 'Historical work'), NULL, ended_on, reason, NULL FROM {works}
    UNION ALL SELECT structure_id, 'TRAFFIC_OBSERVATION', id, observed_on, concat('Traffic observation ', observation_year), NULL, NULL, NULL, daily_traffic FROM {traffic}"""
)
@query
def structure_history(rel):
    """O8, Z12"""
    return records.told_history(rel.inspections, rel.works, rel.traffic)


@sql("SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n FROM (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS chunk FROM (SELECT DISTINCT conv_id, CAST(turn + turn // 3 AS BIGINT) AS turn FROM conversations WHERE turn IS NOT NULL)) GROUP BY conv_id, chunk")
@query
def packed_chunks(rel):
    """U10, packed: three turns to a chunk, across the gaps in their numbers."""
    return records.packed_chunks(rel.conversations.select("conv_id", F.expr("turn + turn div 3").alias("turn")), "conv_id", "turn", 3)


@sql("SELECT scenario_id, year, CASE WHEN scenario_id % 3 > 0 AND scenario_id % 5 > 0 THEN CAST(scenario_id * 1000 AS DECIMAL(16,2)) END AS budget, CASE WHEN scenario_id % 3 > 0 AND scenario_id % 5 > 0 THEN 'EUR' END AS currency FROM {q_scenarios}, (SELECT CAST(unnest(range(1998, 2003)) AS BIGINT) AS year)")
@query
def scenario_seed_envelopes(rel):
    """Envelopes of new plans; some have no yearly amount, some no currency."""
    i = F.col("scenario_id")
    wanted = _scenarios(rel).withColumns({"amount": F.when(i % 3 > 0, (i * 1000).cast("decimal(16,2)")), "currency": F.when(i % 5 > 0, "EUR")})
    return lifecycle.seed_envelopes(wanted)


@sql("SELECT q.scenario_id, road, max(generated_on) AS updated_on FROM {q_scenarios} q JOIN {structures} s USING (road) JOIN {interventions} i ON i.structure_id = s.id GROUP BY ALL")
@query
def scenario_list(rel):
    """Z9"""
    return lifecycle.newest_scenarios(_scenarios(rel).select("scenario_id", "road"), _assigned(rel).select("scenario_id", F.col("generated_on").alias("changed_on")))


@sql("""SELECT document_id, r.id AS run_id, status, n_pages, numbers FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS n FROM {page_runs} WHERE status IN ('EXTRACTION_PENDING', 'EXTRACTED')) r
    JOIN (SELECT document_id, count(*) AS n_pages, array_to_string(list(number ORDER BY number), ',') AS numbers FROM {identity_pages} GROUP BY 1) p USING (document_id) WHERE n = 1 AND n_pages = page_count""")
@query
def extraction_contexts(rel):
    """Z3"""
    df = lifecycle.extraction_contexts(rel.page_runs, rel.identity_pages, ("EXTRACTION_PENDING", "EXTRACTED"))
    return df.withColumn("numbers", F.array_join("numbers", ","))


@sql("""SELECT b.document_id, filename, r.id AS run_id, r.status AS run_status, numbers FROM {bridge_books} b LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS n FROM {page_runs}) r ON r.document_id = b.document_id AND n = 1
    LEFT JOIN (SELECT document_id, array_to_string(list_sort(list(DISTINCT number)), ',') AS numbers FROM {identity_pages} GROUP BY 1) p ON p.document_id = b.document_id""")
@query
def document_list(rel):
    """Z1"""
    df = lifecycle.document_list(rel.bridge_books.select("document_id", "filename"), rel.page_runs, rel.identity_pages)
    return df.withColumn("numbers", F.array_join("numbers", ","))


@sql(
    """SELECT i.id, i.planned_year, m.intervention_id IS NOT NULL AS included FROM {interventions} i JOIN {recommendations} r ON r.id = i.recommendation_id JOIN {structures} s ON s.id = i.structure_id
    LEFT JOIN (SELECT DISTINCT * FROM {memberships}) m ON m.intervention_id = i.id AND m.planning_year = i.planned_year"""
)
@query
def programme_membership(rel):
    """Every year's programme at once; some interventions are in another year's only."""
    whole = rel.interventions.join(rel.recommendations.select(F.col("id").alias("recommendation_id")), "recommendation_id").join(rel.structures.select(F.col("id").alias("structure_id")), "structure_id")
    return maintenance.with_membership(whole, rel.memberships).select("id", "planned_year", "included")


@sql("SELECT structure_id, road, inspection_status, tenths FROM {q_portfolio} WHERE inspection_status = 'OVERDUE' AND tenths BETWEEN 20 AND 38 ORDER BY attention_priority DESC, extra_vehicle_tenths_km DESC, structure_id LIMIT 15")
@query
def overdue_page(rel):
    """P4, and P3 on the score: the first page of structures whose inspection is overdue."""
    q = portfolio.PortfolioQuery(inspection_status="OVERDUE", least_tenths=20, most_tenths=38, page_size=15)
    return portfolio.page(portfolio.portfolio(rel, AS_OF), q).select("structure_id", "road", "inspection_status", "tenths")


@sql("SELECT id, CAST(priority AS BIGINT) AS priority, planned_year, estimate FROM {q_priority} WHERE view = 'tender' ORDER BY priority DESC, coalesce(planned_year, target_year, 9007199254740991), id LIMIT 20 OFFSET 20")
@query
def planning_page(rel):
    """The second page of one planning list."""
    request = maintenance.PlanningRequest("tender", page=2, page_size=20)
    return maintenance.planning_page(maintenance.maintenance_items(rel, AS_OF), request).select("id", "priority", "planned_year", "estimate")


#: What each kind's rows of evidence say besides: the relation, its key, and the value that the source shows.
_SHOWN = {"STRUCTURE": ("structures", "id", "road"), "PART": ("parts", "id", "structure_type"), "INSPECTION": ("inspections", "id", "type"), "FINDING": ("findings", "inspection_id", "description"), "RECOMMENDATION": ("recommendations", "id", "work_type"), "INTERVENTION": ("interventions", "recommendation_id", "status"), "COMPONENT": ("components", "id", "material")}


@sql(" UNION ALL ".join(f"SELECT '{kind}' AS kind, CAST(x.id AS VARCHAR) AS entity_id, x.structure_id, x.{value} AS shown, e.id AS evidence_id, page, nullif(trim(excerpt), '') AS excerpt, review_state FROM (SELECT DISTINCT * FROM {{{rel if rel != 'structures' else 'own_structures'}}}) x JOIN {{source_evidence}} e ON e.id = x.{key}" for kind, (rel, key, value) in _SHOWN.items()))
@query
def evidence_facts(rel):
    """Seven kinds of entities with what they say and the source that shows it, as typed rows told apart by kind."""
    tasks = rel.tasks("lineitem", "orders")
    rel = rel.dealing(tasks, "l_orderkey", "lineitem")  # findings come dealt by inspection: distinct ones are found where they lie
    made = {name: getattr(rel, name).distinct() for name, _, _ in _SHOWN.values()}
    made["structures"] = made["structures"].withColumn("structure_id", F.col("id"))
    return records.evidence_facts({kind: made[name].select(F.col("id").cast("string").alias("entity_id"), "structure_id", F.col(value).alias("shown"), F.col(key).alias("evidence_id")) for kind, (name, key, value) in _SHOWN.items()}, rel.source_evidence, tasks)


def _cited(value: str, held: Column) -> Column:
    return F.struct(F.col(value).alias("value"), held.alias("evidence"))


def _told(evidence) -> Column:
    return F.coalesce(F.array_join(evidence, ","), F.lit(""))


@sql(
    """SELECT id, CASE WHEN id % 4 = 0 THEN CAST(id AS VARCHAR) WHEN id % 3 = 0 THEN CAST(id + 1 AS VARCHAR) ELSE CAST(id + 2 AS VARCHAR) END AS evidence, kind AS type, CASE WHEN kind IS NOT NULL AND id % 3 = 0 THEN CAST(id + 1 AS VARCHAR) ELSE '' END AS type_evidence FROM (
      SELECT id, CASE WHEN type_text = 'OTHER' THEN 'OTHER' WHEN lower(type_text) LIKE '%haupt%' THEN 'MAIN' WHEN lower(type_text) LIKE '%einfach%' THEN 'SIMPLE' WHEN lower(type_text) LIKE '%sonder%' THEN 'SPECIAL' END AS kind FROM {raw_values}) WHERE id % 4 = 0 OR id % 3 = 0 OR id % 5 = 0"""
)
@query
def repaired_inspections(rel):
    """E15 on inspections: their type is read, their day has no reader but its evidence counts."""
    i = F.col("id")
    items = rel.raw_values.select("id", F.when(i % 4 == 0, F.array(i)).alias("evidence"), _cited("type_text", F.when(i % 3 == 0, F.array(i + 1))).alias("type"), _cited("date_text", F.when(i % 5 == 0, F.array(i + 2))).alias("inspected_on"))
    done = records.repaired(items, {"type": lambda x: text.state(x, text.INSPECTION_TYPES, "OTHER")})
    return done.select("id", _told("evidence").alias("evidence"), F.col("type.value").alias("type"), _told("type.evidence").alias("type_evidence"))


@sql(
    """SELECT id, CAST(CASE WHEN id % 7 = 0 THEN id ELSE id + 3 END AS VARCHAR) AS evidence, state AS status, CASE WHEN state IS NOT NULL AND id % 2 = 0 THEN CAST(id + 3 AS VARCHAR) ELSE '' END AS status_evidence FROM (
      SELECT id, CASE finding_text WHEN 'noch offen' THEN 'OPEN' END AS state FROM {raw_values}) WHERE id % 7 = 0 OR id % 2 = 0"""
)
@query
def repaired_recommendations(rel):
    """E15 on recommendations."""
    i = F.col("id")
    items = rel.raw_values.select("id", F.when(i % 7 == 0, F.array(i)).alias("evidence"), _cited("finding_text", F.when(i % 2 == 0, F.array(i + 3))).alias("status"))
    done = records.repaired(items, {"status": lambda x: text.state(x, text.RECOMMENDATION_STATES)})
    return done.select("id", _told("evidence").alias("evidence"), F.col("status.value").alias("status"), _told("status.evidence").alias("status_evidence"))


ORACLES.update({name: with_relations(text, {**VIEWS, "own_structures": "SELECT *, id AS structure_id FROM {structures}"}) for name, text in SQL.items()})
