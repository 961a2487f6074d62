"""Queries over links, evidence, packages, identities and choices, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from girderlake.functions import money, pages
from girderlake.operators import portfolio, records, search, workflow
from girderlake.operators.latest import first_per_key
from girderlake.plans.oracles import ORACLES, SQL as OTHERS, VIEWS
from girderlake.plans.queries import QUERIES, _assigned, _checked, _envelopes, _health, _placed, _scenarios, query
from girderlake.sources.relations import with_relations

SQL: dict[str, str] = {}


def sql(text: str):
    """The SQL of the query below."""

    def keep(made):
        SQL[made.__name__] = text
        return made

    return keep


def _found(match: str, name: str, exact: str, prefix: list[str], rows: str, searched: list[str]) -> str:
    text = "lower(concat_ws(' ', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in searched) + "))"
    ladder = f"CASE WHEN lower({exact}) = '{match}' THEN 0 " + " ".join(f"WHEN starts_with(lower({c}), '{match}') THEN {i}" for i, c in enumerate(prefix, 1)) + f" ELSE {len(prefix) + 1} END"
    return f"SELECT id, CAST({ladder} AS BIGINT) AS match_rank, count(*) OVER () AS total FROM ({rows}) WHERE contains({text}, '{match}') ORDER BY match_rank, lower(coalesce({name}, '')), id LIMIT 10"


@sql(_found("riss", "id", "id", ["id", "description"], "SELECT f.*, s.ext_no, s.road FROM (SELECT DISTINCT * FROM {findings}) f JOIN {structures} s ON s.id = f.structure_id", ["id", "description", "status", "ext_no", "road"]))
@query
def search_findings(rel):
    """O7, F6"""
    tasks = rel.tasks("lineitem", "orders")
    rel = rel.dealing(tasks, "l_orderkey", "lineitem")  # findings come dealt by inspection: distinct ones are found where they lie
    return search.search_findings(rel.findings, rel.structures, "Riss", 10, tasks).select("id", "match_rank", "total")


@sql(_found("lager", "work_type", "work_type", ["work_type"], "SELECT r.*, s.ext_no, s.road FROM {recommendations} r JOIN {structures} s ON s.id = r.structure_id", ["work_type", "urgency", "status", "ext_no", "road"]))
@query
def search_recommendations(rel):
    """O7, F6"""
    return search.search_recommendations(rel.recommendations, rel.structures, "Lager", 10).select("id", "match_rank", "total")


@sql(
    """SELECT * FROM (WITH scour AS (SELECT f.structure_id, inspected_on AS day FROM {findings} f JOIN {inspections} i ON i.id = f.inspection_id WHERE inspected_on IS NOT NULL AND regexp_matches(lower(coalesce(description, '')), 'kolk|scour|unterspül|unterspul')),
    repair AS (SELECT structure_id, coalesce(started_on, ended_on) AS day FROM {works} WHERE regexp_matches(lower(concat_ws(' ', title, reason)), 'kolk|scour|unterspül|unterspul|gründung|grundung|widerlager')),
    firsts AS (SELECT e.*, (SELECT min(checked_on) FROM {special_checks} x WHERE x.structure_id = e.structure_id AND checked_on >= peaked_on AND checked_on < peaked_on + INTERVAL 12 MONTH) AS check_on,
      (SELECT min(day) FROM scour x WHERE x.structure_id = e.structure_id AND day >= peaked_on AND day < peaked_on + INTERVAL 12 MONTH) AS scour_on,
      (SELECT min(day) FROM repair x WHERE x.structure_id = e.structure_id AND day >= peaked_on AND day < peaked_on + INTERVAL 24 MONTH) AS repair_on FROM {flood_peaks} e)
    SELECT id, structure_id, peaked_on, CASE WHEN level_cm >= hhw_cm THEN 'EXTREME' WHEN level_cm >= coalesce(hsw_cm, mark_two_cm) THEN 'HIGH' WHEN level_cm >= coalesce(mhw_cm, mark_one_cm) THEN 'MODERATE' ELSE 'BELOW_TRIGGER' END AS band,
      check_on, scour_on, repair_on FROM firsts)"""
)
@query
def flood_history(rel):
    """What followed each flood."""
    return portfolio.flood_history(rel).select("id", "structure_id", "peaked_on", "band", "check_on", "scour_on", "repair_on")


@sql(
    """SELECT s.id AS structure_id, EXISTS (SELECT 1 FROM {photos} p WHERE p.structure_id = s.id) AS has_photo, CASE WHEN mime = 'image/jpeg' THEN n.id END AS photo_id FROM {structures} s
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY created_on DESC, id DESC) AS n FROM {photos}) n ON n.structure_id = s.id AND n = 1"""
)
@query
def photo_choice(rel):
    """P8, Z4"""
    return workflow.photo_choice(rel.structures, rel.photos)


@sql("""SELECT id, coalesce(json_type(metadata, '$.fixture') = 'BOOLEAN' AND metadata ->> '$.fixture' = 'true', false) AS is_demo, CASE WHEN json_type(metadata, '$.sourceUrl') = 'VARCHAR' THEN metadata ->> '$.sourceUrl' END AS source_url FROM {metadata_rows}""")
@query
def metadata_flags(rel):
    """P16, P18"""
    flag = workflow.json_of_kind(F.col("metadata"), "$.fixture", "BOOLEAN")
    return rel.metadata_rows.select("id", F.coalesce(flag == "true", F.lit(False)).alias("is_demo"), workflow.json_of_kind(F.col("metadata"), "$.sourceUrl", "STRING").alias("source_url"))


@sql(
    """SELECT c.id, c.intervention_id, CASE WHEN i.id IS NULL THEN 'NOT_FOUND' WHEN kind = 'CREATE' AND i.status = 'BUDGETED' THEN 'CREATED' WHEN kind = 'CREATE' THEN 'NOT_BUDGETED' WHEN i.status = 'TENDER_PREPARATION' THEN 'DELETED' ELSE 'NOT_IN_TENDER' END AS outcome,
    CASE WHEN kind = 'CREATE' AND i.status = 'BUDGETED' THEN 'TENDER_PREPARATION' WHEN kind = 'DELETE' AND i.status = 'TENDER_PREPARATION' THEN 'BUDGETED' ELSE i.status END AS status,
    CASE WHEN kind = 'CREATE' AND i.status = 'BUDGETED' THEN coalesce(i.quantity, r.quantity) END AS quantity,
    CASE WHEN kind = 'CREATE' AND i.status = 'BUDGETED' THEN CASE WHEN i.quantity IS NOT NULL THEN 'PLANNED_INTERVENTION' WHEN r.quantity IS NOT NULL THEN 'SOURCE_RECOMMENDATION' END END AS quantity_source,
    CASE WHEN kind = 'CREATE' AND i.status = 'BUDGETED' THEN work_type END AS work_type
    FROM {package_commands} c LEFT JOIN {interventions} i ON i.id = c.intervention_id LEFT JOIN {recommendations} r ON r.id = i.recommendation_id"""
)
@query
def package_commands(rel):
    """U14, R15"""
    df = workflow.package_commands(rel.package_commands, rel.interventions, rel.recommendations)
    return df.select("id", "intervention_id", "outcome", "status", "snapshot.quantity", "snapshot.quantity_source", "snapshot.work_type")


@sql("SELECT f.id, f.part_id, structure_type, inspected_on, c.type AS component FROM {findings} f JOIN {parts} p ON p.id = f.part_id JOIN {inspections} i ON i.id = f.inspection_id LEFT JOIN {components} c ON c.id = f.part_id")
@query
def finding_context(rel):
    """J3"""
    return workflow.finding_context(rel.findings, rel.parts, rel.inspections, rel.components)


@sql("SELECT l.recommendation_id, l.finding_id, urgency, inspected_on FROM {recommendation_findings} l JOIN {recommendations} r ON r.id = l.recommendation_id JOIN (SELECT DISTINCT id, inspection_id FROM {findings}) f ON f.id = l.finding_id JOIN {inspections} i ON i.id = f.inspection_id")
@query
def recommendation_links(rel):
    """J4"""
    tasks = rel.tasks("lineitem", "orders")
    rel = rel.dealing(tasks, "l_orderkey", "lineitem")  # findings and links come dealt by inspection: distinct ones are found where they lie
    return workflow.recommendation_links(rel.recommendation_findings, rel.recommendations, rel.findings, rel.inspections, tasks)


@sql(
    """SELECT f.structure_id, row_number() OVER (PARTITION BY f.structure_id ORDER BY f.id, page NULLS LAST, evidence_id, kind) AS place, f.id AS finding_id, evidence_id, page, kind, filename
    FROM (SELECT DISTINCT * FROM {finding_evidence}) l JOIN (SELECT DISTINCT id, structure_id FROM {findings}) f ON f.id = l.finding_id JOIN {source_evidence} e ON e.id = l.evidence_id JOIN {books} b ON b.id = e.run_id"""
)
@query
def evidence_chain(rel):
    """J16, O11"""
    return workflow.evidence_chain(rel.finding_evidence, rel.findings, rel.source_evidence, rel.books)


@sql("SELECT doc_id, page, array_to_string(list_sort(list(DISTINCT entity_id)), ',') AS entities, count(DISTINCT origin) > 1 AS conflict FROM {evidence} GROUP BY 1, 2")
@query
def evidence_groups(rel):
    """A25"""
    return workflow.evidence_groups(rel.evidence)


@sql("SELECT structure_id, n_review, n_unshown FROM {q_finding_health}")
@query
def finding_health(rel):
    """A9"""
    return _checked(rel)


_BRANCHES = {"STRUCTURE": ("structures", "id"), "PART": ("parts", "id"), "INSPECTION": ("inspections", "id"), "FINDING": ("findings", "inspection_id"), "RECOMMENDATION": ("recommendations", "id"), "INTERVENTION": ("interventions", "recommendation_id"), "COMPONENT": ("components", "id")}


@sql(" UNION ALL ".join(f"SELECT '{kind}' AS kind, count(*) AS n, count(DISTINCT e.id) AS n_sources FROM {{{rel}}} x JOIN {{source_evidence}} e ON e.id = x.{key}" for kind, (rel, key) in _BRANCHES.items()))
@query
def evidence_branches(rel):
    """The sources of seven kinds of entities in one table, told apart by kind; counted by it."""
    sources = rel.source_evidence.select(F.col("id").alias("evidence_id"))
    all_ = None
    for kind, (name, key) in _BRANCHES.items():
        one = getattr(rel, name).select(F.lit(kind).alias("kind"), F.col(key).alias("evidence_id")).join(sources, "evidence_id")
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("evidence_id").alias("n_sources"))


@sql(
    """SELECT count(*) AS n_documents, count(structure_id) AS n_linked, count(*) FILTER (WHERE r.status = 'SUCCEEDED') AS n_succeeded, count(*) FILTER (WHERE r.status IN ('PENDING', 'CLASSIFYING', 'EXTRACTING', 'VALIDATING', 'PERSISTING')) AS n_pending,
    count(*) FILTER (WHERE r.status = 'FAILED') AS n_failed, count(*) FILTER (WHERE p.status = 'FAILED') AS n_processing_failed,
    (SELECT count(DISTINCT structure_id) FROM {q_health} WHERE status NOT IN ('AVAILABLE', 'CURRENT', 'COMPLETE')) AS n_attention, (SELECT CAST(sum(count) AS BIGINT) FROM {q_health} WHERE code = 'EXTRACTED_FINDING_REVIEW') AS n_review
    FROM {books} b LEFT JOIN {q_last_runs} r ON r.document_id = b.id LEFT JOIN {q_last_processing} p ON p.document_id = b.id"""
)
@query
def overview_counts(rel):
    """Seven counts over documents and structures, and the findings to review."""
    order = [F.col("attempt").desc(), F.col("id").desc()]
    last = lambda runs, name: first_per_key(runs, ["document_id"], order).select(F.col("document_id").alias("id"), F.col("status").alias(name))
    placed = _placed(rel)
    df = rel.books.join(last(placed.runs, "run"), "id", "left").join(last(placed.processing, "step"), "id", "left")
    pending = F.col("run").isin("PENDING", "CLASSIFYING", "EXTRACTING", "VALIDATING", "PERSISTING")
    counts = df.agg(F.count("*").alias("n_documents"), F.count("structure_id").alias("n_linked"), F.count_if(F.col("run") == "SUCCEEDED").alias("n_succeeded"), F.count_if(pending).alias("n_pending"), F.count_if(F.col("run") == "FAILED").alias("n_failed"), F.count_if(F.col("step") == "FAILED").alias("n_processing_failed"))
    health = _health(rel, placed)
    shown = health.agg(F.count_distinct(F.when(records.needs_attention(F.col("status")), F.col("structure_id"))).alias("n_attention"), F.sum(F.when(F.col("code") == "EXTRACTED_FINDING_REVIEW", F.col("count"))).alias("n_review"))
    return counts.join(F.broadcast(shown))  # one row each


@sql(f"SELECT id, count(*) FILTER (WHERE state = 'AVAILABLE') AS n_available, count(*) FILTER (WHERE state = 'MISSING') AS n_missing, count(*) FILTER (WHERE state = 'REQUIRED') AS n_required FROM ({OTHERS['work_package_readiness']}) GROUP BY 1")
@query
def readiness_counts(rel):
    """A20"""
    df = QUERIES["work_package_readiness"](rel.spark, rel.sf_dir)
    return df.groupBy("id").agg(*[F.count_if(F.col("state") == state).alias(f"n_{state.lower()}") for state in ("AVAILABLE", "MISSING", "REQUIRED")])


@sql(f"SELECT outcome, count(*) AS n FROM ({OTHERS['plan_intervention_outcomes']}) GROUP BY 1")
@query
def outcome_counts(rel):
    """Commands by what they came to."""
    return QUERIES["plan_intervention_outcomes"](rel.spark, rel.sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@sql("SELECT scenario_id, CAST(sum(budget) AS DECIMAL(38,2)) AS envelope FROM {q_envelopes} GROUP BY 1")
@query
def scenario_envelopes(rel):
    """Null unless some year has an envelope."""
    return _envelopes(rel).groupBy("scenario_id").agg(F.sum(F.col("budget").cast("decimal(28,2)")).cast("decimal(38,2)").alias("envelope"))


@sql("SELECT structure_id, string_agg(strftime(inspected_on, '%Y-%m-%d') || ' ' || tenths, ',' ORDER BY inspected_on, id) AS series FROM {inspections} WHERE inspected_on IS NOT NULL AND tenths BETWEEN 10 AND 40 GROUP BY 1")
@query
def condition_series(rel):
    """Valid scores of a structure in the order of their days."""
    rows = rel.inspections.where("inspected_on IS NOT NULL AND tenths BETWEEN 10 AND 40")
    ordered = F.array_sort(F.collect_list(F.struct("inspected_on", "id", "tenths")))
    return rows.groupBy("structure_id").agg(F.array_join(F.transform(ordered, lambda r: F.concat_ws(" ", r["inspected_on"].cast("string"), r["tenths"].cast("string"))), ",").alias("series"))


@sql("SELECT id, ext_no, road, state FROM {structures} WHERE id = 42")
@query
def structure_by_id(rel):
    """S3, Z5"""
    return rel.structures.where("id = 42").select("id", "ext_no", "road", "state").limit(1)


@sql("SELECT checksum, min(origin) AS origin FROM (SELECT sha256(filename) AS checksum, 'CURRENT' AS origin FROM {books} UNION ALL SELECT sha256(concat('Buch ', CAST(id + 1 AS VARCHAR), '.pdf')), 'NEW' FROM {books}) GROUP BY 1")
@query
def book_catalogue(rel):
    """Incoming files are added if their checksum is not there yet."""
    files = lambda name, origin: rel.books.select(F.sha2(name.cast("binary"), 256).alias("checksum"), F.lit(origin).alias("origin")).distinct()
    return records.insert_absent(files(F.col("filename"), "CURRENT"), files(F.concat(F.lit("Buch "), (F.col("id") + 1).cast("string"), F.lit(".pdf")), "NEW"), ["checksum"])


@sql("""SELECT id, CASE WHEN cost IS NOT NULL AND unit IS NOT NULL THEN cost END AS amount, CASE WHEN cost IS NOT NULL AND unit IS NOT NULL THEN unit END AS tag FROM {recommendations}""")
@query
def paired_values(rel):
    """P14"""
    pair = money.both_or_null(F.col("cost"), F.col("unit"))
    return rel.recommendations.select("id", pair["amount"].alias("amount"), pair["currency"].alias("tag"))


@sql("SELECT id, CASE WHEN length_m IS NOT NULL AND width_m IS NOT NULL AND area_sqm IS NOT NULL AND span_count IS NOT NULL THEN concat_ws(' ', length_m, width_m, area_sqm, span_count) END AS box FROM {parts}")
@query
def whole_boxes(rel):
    """Four measures, or none unless all are known."""
    measures = ["length_m", "width_m", "area_sqm", "span_count"]
    return rel.parts.select("id", F.concat(*[x for m in measures for x in (F.col(m).cast("string"), F.lit(" "))][:-1]).alias("box"))


@sql("SELECT structure_id, observation_year, extra_tenths_km FROM (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY observation_year DESC, id) AS n FROM {network_years}) WHERE n = 1")
@query
def latest_network(rel):
    """W4"""
    return first_per_key(rel.network_years, ["structure_id"], [F.col("observation_year").desc(), F.col("id")]).select("structure_id", "observation_year", "extra_tenths_km")


@sql("SELECT id, generated_on, planned_year FROM {interventions} WHERE status = 'TENDER_PREPARATION' ORDER BY generated_on DESC, id LIMIT 50")
@query
def package_list(rel):
    """Z10 (and Z9): the newest first."""
    return rel.interventions.where("status = 'TENDER_PREPARATION'").orderBy(F.desc("generated_on"), "id").limit(50).select("id", "generated_on", "planned_year")


@sql("SELECT document_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') AS pages FROM (SELECT document_id, list(number) AS a FROM {book_pages} GROUP BY 1) LEFT JOIN (SELECT doc_id, list(page) FILTER (WHERE page IS NOT NULL) AS b FROM {evidence} GROUP BY 1) ON doc_id = document_id")
@query
def related_pages(rel):
    """The pages of a document and those its evidence names, each once, in order."""
    own = rel.book_pages.groupBy("document_id").agg(F.collect_set(F.col("number").cast("long")).alias("a"))
    named = rel.evidence.groupBy(F.col("doc_id").alias("document_id")).agg(F.collect_set(F.col("page").cast("long")).alias("b"))
    both = F.array_sort(F.array_union("a", F.coalesce("b", F.array().cast("array<bigint>"))))
    return own.join(named, "document_id", "left").select("document_id", F.array_join(both, ",").alias("pages"))


@sql("SELECT structure_id, coalesce(arg_max(id, (inspected_on, -id)) FILTER (WHERE inspected_on IS NOT NULL), min(id)) AS id FROM {inspections} GROUP BY 1")
@query
def latest_inspection_key(rel):
    """The newest dated inspection, else the first."""
    newest = F.max_by("id", F.when(F.col("inspected_on").isNotNull(), F.struct("inspected_on", -F.col("id"))))
    return rel.inspections.groupBy("structure_id").agg(F.coalesce(newest, F.min("id")).alias("id"))


@sql("SELECT document_id, CASE WHEN bool_or(id % 11 = 6) THEN array_to_string(list_sort(list(DISTINCT number) FILTER (WHERE id % 11 = 6)), ',') ELSE array_to_string(list_sort(list(DISTINCT number))[1:3], ',') END AS pages FROM {book_pages} GROUP BY 1")
@query
def pages_or_first(rel):
    """The pages of a category, or a document's first three where none has it."""
    has = F.exists(pages.categories(F.col("text")), lambda c: c == "INSPECTIONS")
    df = rel.book_pages.withColumn("has", F.coalesce(has, F.lit(False))).groupBy("document_id").agg(F.collect_set(F.when(F.col("has"), F.col("number"))).alias("own"), F.collect_set("number").alias("every"))
    chosen = F.when(F.size("own") > 0, F.array_sort("own")).otherwise(F.slice(F.array_sort("every"), 1, 3))
    return df.select("document_id", F.array_join(chosen, ",").alias("pages"))


@sql(r"""SELECT DISTINCT id AS page_id, unnest(regexp_extract_all(page_text, '\[(\d+)\]', 1)) AS key FROM {raw_values}""")
@query
def section_keys(rel):
    """The keys that earlier sections gave, one row each."""
    return rel.raw_values.select(F.col("id").alias("page_id"), F.explode(F.regexp_extract_all("page_text", F.lit(r"\[(\d+)\]"), F.lit(1))).alias("key")).distinct()


@sql(r"""SELECT DISTINCT r.id AS recommendation_id, finding_id FROM (SELECT finding_id, CAST(unnest(regexp_extract_all(text, '(?i)ma[sß]nahme(?:nempfehlung)?\s*\x7B(\d+)\x7D', 1)) AS BIGINT) AS id FROM {notes}) n JOIN {recommendations} r ON r.id = n.id""")
@query
def mentioned_links(rel):
    """E4"""
    return workflow.mentioned_links(rel.notes, rel.recommendations)


@sql(r"""SELECT r.id, coalesce(e.source_key, n.source_key) AS target, e.source_key IS NOT NULL AS exact FROM {mentions} r LEFT JOIN {reference_targets} e ON e.source_key = r.ref LEFT JOIN {reference_targets} n ON n.number = try_cast(nullif(regexp_extract(r.ref, '(\d+)', 1), '') AS BIGINT)""")
@query
def resolved_references(rel):
    """J20"""
    return workflow.resolved(rel.mentions, rel.reference_targets)


@sql("SELECT concat('recommendation:', CAST(id AS VARCHAR)) AS old_key, concat('recommendation:', CAST(kept AS VARCHAR)) AS new_key FROM (SELECT id, min(id) OVER (PARTITION BY structure_id, work_type, target_year) AS kept FROM {recommendations}) WHERE id <> kept")
@query
def key_remap(rel):
    """E6"""
    return workflow.key_remap(rel.recommendations, ["structure_id", "work_type", "target_year"], "recommendation:")


@sql("SELECT id, CASE WHEN n > 1 THEN concat(base, '-', CAST(n AS VARCHAR)) ELSE base END AS source_key FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM (SELECT id, concat('structure:', CAST(structure_id AS VARCHAR), '/', lower(coalesce(work_type, 'unknown'))) AS base FROM {recommendations}))")
@query
def identity_plan(rel):
    """E11"""
    return workflow.identity_plan(rel.recommendations, F.concat(F.lit("structure:"), F.col("structure_id").cast("string")), F.lower(F.coalesce("work_type", F.lit("unknown"))))


@sql(
    """SELECT * FROM (WITH stale AS (SELECT id FROM {recommendations} WHERE status = 'COMPLETED') SELECT id, 'REVIEWED_EVIDENCE' AS guard FROM stale WHERE EXISTS (SELECT 1 FROM {source_evidence} e WHERE e.id = stale.id AND review_state = 'CONFIRMED')
    UNION ALL SELECT id, 'PLANNED_USE' FROM stale WHERE EXISTS (SELECT 1 FROM {interventions} i WHERE i.recommendation_id = stale.id) UNION ALL SELECT id, 'SOURCE_DRIFT' FROM stale WHERE EXISTS (SELECT 1 FROM {works} w WHERE w.id = stale.id AND w.reason IS NOT NULL))"""
)
@query
def removal_guards(rel):
    """E14"""
    return workflow.removal_guards(rel.recommendations.where("status = 'COMPLETED'"), rel.source_evidence, rel.interventions, rel.works.where("reason IS NOT NULL"))


@sql(
    """SELECT 'MEMBER' AS kind, assigned_year AS year, id, CAST(NULL AS DECIMAL(16,2)) AS budget FROM {q_assigned_ids} WHERE assigned_year IS NOT NULL AND scenario_id = (SELECT min(scenario_id) FROM {q_scenarios})
    UNION ALL SELECT 'BUDGET', year, NULL, budget FROM {q_envelopes} WHERE budget IS NOT NULL AND scenario_id = (SELECT min(scenario_id) FROM {q_scenarios})"""
)
@query
def adopted_programme(rel):
    """Members and budgets of the programme that the first plan becomes."""
    first = _scenarios(rel).agg(F.min("scenario_id").alias("scenario_id"))
    return workflow.adopted(first, _assigned(rel), _envelopes(rel))


@sql(r"""SELECT id, CASE WHEN regexp_full_match(plain, '\d+(\.\d\d?)?') THEN CAST(CAST(plain AS DECIMAL(30,2)) * 100 AS DECIMAL(38,0)) END AS cents FROM (SELECT id, replace(number_text, ',', '.') AS plain FROM {raw_values})""")
@query
def minor_units(rel):
    """M1: exact amounts in cents; null where a sign, a letter or a third decimal makes them inexact."""
    return rel.raw_values.select("id", workflow.minor_units(F.replace("number_text", F.lit(","), F.lit("."))).alias("cents"))


ORACLES.update({name: with_relations(text, VIEWS) for name, text in SQL.items()})
