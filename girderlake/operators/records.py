"""Provenance, history, documents and the text-to-records pipeline as set operations over all documents at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from girderlake.functions.text import collapsed, contains_any, date, first_of
from girderlake.operators.latest import first_per_key
from girderlake.sources.cuts import dealt

# Provenance and history --------------------------------------------------------------------------------------------


def history(inspections: DataFrame, works: DataFrame, traffic: DataFrame) -> DataFrame:
    """Three kinds of events in one relation, each with the columns of its kind."""
    a = inspections.select("structure_id", F.lit("INSPECTION").alias("kind"), "id", F.col("inspected_on").alias("happened_on"), F.col("type").alias("title"))
    b = works.select("structure_id", F.lit("WORK").alias("kind"), "id", F.col("sourced_on").alias("happened_on"), "work_type", F.coalesce("work_type", F.lit("Historical work")).alias("title"))
    c = traffic.select("structure_id", F.lit("TRAFFIC").alias("kind"), "id", F.col("observed_on").alias("happened_on"), "daily_traffic", F.concat(F.lit("Traffic observation "), F.col("observation_year").cast("string")).alias("title"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


#: Titles of inspections by type in a structure's history.
INSPECTION_TITLES = {"MAIN": "Main inspection", "SIMPLE": "Simple inspection", "SPECIAL": "Special inspection", "OTHER": "Other inspection"}


def told_history(inspections: DataFrame, works: DataFrame, traffic: DataFrame) -> DataFrame:
    """Every structure's events, the newest first and undated ones last; on one day inspections, then works, then traffic.

    Each has its title and the columns of its kind. One range-partitioned sort over all structures, whose key goes on
    to the day and id, so that a structure of very many events is no single task's work.
    """
    c = F.col
    titles = F.create_map(*[F.lit(x) for pair in INSPECTION_TITLES.items() for x in pair])
    title = F.when(c("type").isNull(), "Inspection").otherwise(F.try_element_at(titles, c("type")))
    a = inspections.select("structure_id", F.lit("INSPECTION").alias("kind"), "id", c("inspected_on").alias("happened_on"), title.alias("title"), F.lit(0).alias("_turn"), "tenths")
    b = works.select("structure_id", F.lit("HISTORICAL_WORK").alias("kind"), "id", c("started_on").alias("happened_on"), F.coalesce("title", F.lit("Historical work")).alias("title"), F.lit(1).alias("_turn"), "ended_on", "reason")
    d = traffic.select("structure_id", F.lit("TRAFFIC_OBSERVATION").alias("kind"), "id", c("observed_on").alias("happened_on"), F.concat(F.lit("Traffic observation "), c("observation_year").cast("string")).alias("title"), F.lit(2).alias("_turn"), "daily_traffic")
    rows = a.unionByName(b, allowMissingColumns=True).unionByName(d, allowMissingColumns=True)
    return rows.orderBy("structure_id", c("happened_on").desc_nulls_last(), "_turn", "id").drop("_turn")


def evidence_facts(branches: dict[str, DataFrame], sources: DataFrame, tasks: int | None = None) -> DataFrame:
    """Entities of several kinds with the source that shows each: kind, the branch's columns, page, excerpt (null if blank), review_state.

    Branches have the same columns, ``evidence_id`` among them; they are put under one another first, so the sources are
    read and shuffled once for all of them, to ``tasks`` tasks.
    """
    rows = None
    for kind, branch in branches.items():
        one = branch.select(F.lit(kind).alias("kind"), "*")
        rows = one if rows is None else rows.unionByName(one)
    shown = sources.select(F.col("id").alias("evidence_id"), "page", F.nullif(F.trim("excerpt"), F.lit("")).alias("excerpt"), "review_state")
    return dealt(rows, tasks, "evidence_id").join(shown, "evidence_id")


def pages_of(evidence: DataFrame, documents: DataFrame, id_col: str) -> DataFrame:
    """Of every document the number of its evidence rows and its distinct pages in order; 0 and none without any."""
    own = evidence.groupBy("doc_id").agg(F.count("*").alias("n_evidence"), F.sort_array(F.collect_set("page")).alias("pages"))
    df = documents.select(F.col(id_col).alias("doc_id")).join(own, "doc_id", "left")
    return df.select("doc_id", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce("pages", F.array().cast("array<bigint>")).alias("pages"))


def provenance(evidence: DataFrame, entities: DataFrame, kind: str) -> DataFrame:
    """Of every entity where its facts come from: UNLINKED, SOURCE_FACT, DERIVED or MIXED."""
    own = evidence.where(F.col("kind") == kind).groupBy(F.col("entity_id").alias("id")).agg(F.count_distinct("origin").alias("n"), F.min("origin").alias("one"), F.count("*").alias("links"))
    state = first_of((F.col("n").isNull(), "UNLINKED"), (F.col("n") > 1, "MIXED")).otherwise(F.col("one"))
    return entities.select("id").join(own, "id", "left").select("id", state.alias("origin"), F.coalesce("links", F.lit(0)).alias("links"))


def finding_quality(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """By structure, severe findings with and without page evidence of their inspection; the check is made per finding before counting."""
    shown = evidence.where("page IS NOT NULL").select(F.col("entity_id").alias("inspection_id")).distinct().withColumn("shown", F.lit(True))
    df = findings.join(shown, "inspection_id", "left")
    severe = F.greatest("stability", "safety") >= 3
    n = lambda cond: F.count_distinct(F.when(severe & cond, F.col("id")))
    return df.groupBy("structure_id").agg(n(F.col("shown").isNotNull()).alias("with_evidence"), n(F.col("shown").isNull()).alias("without_evidence"))


#: Words of a document's kind or name that tell of a load recalculation, accents folded (F2).
RECALCULATION = ["nachrechnung", "tragfahigkeitsnachweis", "statische berechnung"]


def documents_with_errors(runs: DataFrame, processing: DataFrame) -> DataFrame:
    """Documents whose latest extraction or latest processing failed."""
    order = [F.col("attempt").desc(), F.col("id").desc()]
    failed = [first_per_key(x, ["document_id"], order).where("status = 'FAILED'").select("document_id") for x in (runs, processing)]
    return failed[0].union(failed[1]).distinct()


def data_health(rel, placed, checked: DataFrame, as_of_year: int, stale_after: int = 5) -> DataFrame:
    """One row per structure and indicator, nine of them: code, status, count.

    ``placed`` are the same relations dealt by structure, so that what is counted by structure or document is counted
    where it lies; ``checked`` are each structure's findings to review and without a page.
    """
    bare = F.lit(False)
    for column in ("length_m", "width_m", "area_sqm", "span_count"):
        bare = bare | F.col(column).isNull()
    geometry = placed.parts.groupBy("structure_id").agg(F.count("*").alias("n_parts"), F.count_if(bare).alias("n_bare"))
    dated = placed.inspections.where("inspected_on IS NOT NULL").groupBy("structure_id").agg(F.max("inspected_on").alias("last_on"))
    year = placed.traffic.groupBy("structure_id").agg(F.max("observation_year").alias("traffic_year"))
    managed = rel.interventions.where("estimate IS NOT NULL").select(F.col("recommendation_id").alias("id"), F.lit(True).alias("managed"))
    # Only recommendations that lack something meet the interventions; a structure without any has zero of both.
    lacking = rel.recommendations.where("status NOT IN ('COMPLETED', 'CANCELLED')").select("id", "structure_id", F.col("cost").isNull().alias("uncosted"), (F.col("quantity").isNull() | F.col("unit").isNull()).alias("unmeasured"))
    undone = lacking.where("uncosted OR unmeasured").join(managed, "id", "left")
    undone = undone.groupBy("structure_id").agg(F.count_if(F.col("uncosted") & F.col("managed").isNull()).alias("n_uncosted"), F.count_if("unmeasured").alias("n_unmeasured"))
    wrong = documents_with_errors(placed.runs, placed.processing).withColumnRenamed("document_id", "id").withColumn("wrong", F.lit(True))
    recalculated = contains_any(F.concat_ws(" ", "type", "filename"), RECALCULATION)
    books = rel.books.where("structure_id IS NOT NULL").join(wrong, "id", "left").groupBy("structure_id").agg(F.count("wrong").alias("n_wrong"), F.bool_or(recalculated).alias("recalculated"))
    df = rel.structures.select(F.col("id").alias("structure_id"))
    for part in (geometry, dated, year, undone, books, checked):
        df = df.join(part, "structure_id", "left")
    c, zero = F.col, F.lit(0)
    age = F.greatest(F.lit(as_of_year) - c("traffic_year"), zero)
    counted = lambda code, n, issue: one(code, F.when(F.coalesce(n, zero) > 0, issue).otherwise("COMPLETE"), c(n))
    load = F.coalesce("recalculated", F.lit(False))
    one = lambda code, status, count: F.struct(F.lit(code).alias("code"), status.alias("status"), F.coalesce(count, zero).cast("long").alias("count"))
    rows = F.array(
        one("LATEST_INSPECTION", F.when(c("last_on").isNull(), "MISSING").otherwise("AVAILABLE"), c("last_on").isNotNull().cast("long")),
        one("TRAFFIC_CURRENCY", first_of((c("traffic_year").isNull(), "MISSING"), (age > stale_after, "STALE")).otherwise("CURRENT"), age),
        one("GEOMETRY_COMPLETENESS", F.when(c("n_parts").isNull() | (c("n_bare") > 0), "MISSING").otherwise("COMPLETE"), F.when(c("n_bare") > 0, c("n_bare")).otherwise(c("n_parts"))),
        counted("EXTRACTION_ERRORS", "n_wrong", "ERROR"),
        counted("RECOMMENDATION_QUANTITIES", "n_unmeasured", "MISSING"),
        counted("RECOMMENDATION_COST_ESTIMATES", "n_uncosted", "MISSING"),
        counted("EXTRACTED_FINDING_REVIEW", "n_review", "REVIEW_REQUIRED"),
        counted("CRITICAL_SOURCE_EVIDENCE", "n_unshown", "ERROR"),
        one("LOAD_RECALCULATION_DOCUMENT", F.when(load, "AVAILABLE").otherwise("MISSING"), load.cast("long")),
    )
    return df.select("structure_id", F.inline(rows))


def needs_attention(status: Column) -> Column:
    return ~status.isin("AVAILABLE", "CURRENT", "COMPLETE")


# Text to records ---------------------------------------------------------------------------------------------------

#: A finding's row in a page: its number and three ratings of 0 to 4.
FINDING_ROW = r"\[(\d+)\] S=([0-4]), V=([0-4]), D=([0-4])"


def finding_rows(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every finding row of every page; the first of a page wins where a number repeats."""
    groups = [F.regexp_extract_all(F.col(text_col), F.lit(FINDING_ROW), F.lit(i)).alias(n) for i, n in enumerate(("number", "s", "v", "d"), 1)]
    zipped = pages.select(F.col(id_col).alias("page_id"), F.arrays_zip(*groups).alias("rows"))
    rows = zipped.select("page_id", F.posexplode("rows").alias("place", "row")).select("page_id", "place", F.col("row.number").cast("long").alias("number"), *[F.col(f"row.{x}").cast("long").alias(n) for x, n in (("s", "stability"), ("v", "safety"), ("d", "durability"))])
    return first_per_key(rows, ["page_id", "number"], [F.col("place")]).drop("place")


#: How a day and an inspector's name are written, and what may stand behind a name.
DAY = r"\d{1,2}\.\d{1,2}\.\d{4}"
INSPECTOR = r"Pr[üu]fer(?:in)?[:.]?\s+([A-ZÄÖÜ][A-Za-zÄÖÜäöüß. \-,/]{1,80})"
BEHIND_NAME = r"(?iu)\s{2,}|\s+(?:Hauptprüfung|Einfache Prüfung|Sonderprüfung|Zustandsnote|Version|Seite)\b"
#: Characters behind and before a day in which its inspector may be named.
AFTER, BEFORE = 220, 80


def inspectors(pages: DataFrame, document: str, number: str, id_col: str, text_col: str) -> DataFrame:
    """Who inspected on each day that a document's pages tell: (document, inspected_on, inspector, number).

    A text is split at its days; a name is looked for in what follows a day, up to the next one, then in what
    precedes it. The first place of a document that names an inspector for a day wins.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.split(t, DAY, -1)
    spots = F.arrays_zip(F.regexp_extract_all(t, F.lit(DAY), F.lit(0)).alias("day"), parts.alias("before"), F.slice(parts, F.lit(2), F.size(parts)).alias("after"))
    rows = pages.select(document, number, id_col, F.posexplode(spots).alias("place", "spot")).where("spot.day IS NOT NULL")
    named = lambda x: F.nullif(F.regexp_extract(x, INSPECTOR, 1), F.lit(""))
    found = F.coalesce(named(F.left(F.col("spot.after"), F.lit(AFTER))), named(F.right(F.col("spot.before"), F.lit(BEFORE))))
    name = F.regexp_replace(collapsed(F.get(F.split(found, BEHIND_NAME), F.lit(0))), r"[.,;:\s]+$", "")
    rows = rows.select(document, number, id_col, "place", date(F.col("spot.day")).alias("inspected_on"), name.alias("inspector"))
    good = rows.where(F.col("inspected_on").isNotNull() & (F.length("inspector") >= 2))
    return first_per_key(good, [document, "inspected_on"], [F.col(number), F.col(id_col), F.col("place")]).select(document, "inspected_on", "inspector", number)


def repaired(items: DataFrame, fields: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """A model's records made fit for checking: ``evidence`` (an array) and sourced fields (structs of value and evidence).

    A record without evidence of its own takes the first that one of its fields has, in the columns' order, whether or not
    the field has a reader; one without any goes. Each field's value is read by its function; a value that it can't read
    becomes null and loses its evidence. A null field stays null, one without a reader as it is.
    """
    cited = [f.name for f in items.schema if isinstance(f.dataType, StructType) and "evidence" in f.dataType.names]
    sourced = [c for c in cited if c in fields]
    lists = [F.col("evidence"), *[F.col(f"{c}.evidence") for c in cited]]
    lifted = F.get(F.filter(F.array(*lists), lambda e: F.size(e) > 0), F.lit(0))
    none = F.array().cast(items.schema["evidence"].dataType)

    def read(name: str) -> Column:
        value = fields[name](F.col(f"{name}.value"))
        return F.when(F.col(name).isNotNull(), F.struct(value.alias("value"), F.when(value.isNotNull(), F.col(f"{name}.evidence")).otherwise(none).alias("evidence")))

    return items.withColumns({"evidence": lifted, **{c: read(c) for c in sourced}}).where("evidence IS NOT NULL")


def merged(records: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """One record per identity; each field is its first value in order that isn't null."""
    return records.groupBy(*keys).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields], F.count("*").alias("n_merged"))


def fill(model: DataFrame, inferred: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Model records, their null fields filled from inferred ones, and inferred ones that have no model."""
    other = inferred.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    return model.join(other, keys, "full").select(*keys, *[F.coalesce(f, f"_{f}").alias(f) for f in fields])


def identity_key(prefix: str, *columns: str) -> Column:
    """A stable key: kind and the first half of a hash of canonical texts; a null is not an empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.lower(F.trim(F.regexp_replace(F.col(c).cast("string"), r"\s+", " ")))), F.lit("~")) for c in columns]
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))


def reconcile(existing: DataFrame, desired: DataFrame, keys: list[str]) -> DataFrame:
    """What would change: keys and action (INSERT, UPDATE, UNCHANGED or STALE), by fingerprint."""
    a, b = existing.select(*keys, F.col("fingerprint").alias("old")), desired.select(*keys, F.col("fingerprint").alias("new"))
    action = first_of((F.col("old").isNull(), "INSERT"), (F.col("new").isNull(), "STALE"), (F.col("old") == F.col("new"), "UNCHANGED")).otherwise("UPDATE")
    return a.join(b, keys, "full").select(*keys, action.alias("action"))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """A new version of a table: incoming rows replace those of their keys, all others stay."""
    return current.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def insert_absent(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose keys aren't there yet are added."""
    return current.unionByName(incoming.join(current.select(*keys), keys, "left_anti"))


def chunks(rows: DataFrame, group: str, number: str, most: int) -> DataFrame:
    """Runs of consecutive numbers within a group, cut into chunks of at most ``most``: (group, first, last, n)."""
    order = Window.partitionBy(group).orderBy(number)
    runs = rows.select(group, number).distinct().withColumn("_run", F.col(number) - F.row_number().over(order))
    place = F.row_number().over(Window.partitionBy(group, "_run").orderBy(number)) - 1
    cut = runs.withColumn("_chunk", F.floor(place / most))
    return cut.groupBy(group, "_run", "_chunk").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("_run", "_chunk")


def packed_chunks(rows: DataFrame, group: str, number: str, most: int) -> DataFrame:
    """U10, packed: a group's numbers in order, ``most`` to a chunk whatever gaps they have: (group, first, last, n)."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(number)) - 1
    cut = rows.where(F.col(number).isNotNull()).select(group, number).distinct().withColumn("_chunk", F.floor(place / most))
    return cut.groupBy(group, "_chunk").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("_chunk")


def text_metrics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """compact length, lines with text, short ones (under 25 characters), and whether a page should be read by sight."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    short = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) < 25))
    df = docs.select(F.col(id_col), F.length(F.regexp_replace(text, r"[ \t\n\r\f\x0B]", "")).alias("n_compact"), F.size(lines).alias("n_lines"), short.alias("n_short"), F.length(text).alias("n_all"), (F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))).alias("n_broken"))
    sight = (F.col("n_compact") < 40) | (F.col("n_broken") * 50 > F.col("n_all")) | ((F.col("n_lines") >= 10) & (F.col("n_short") * 10 >= F.col("n_lines") * 7))
    return df.select(id_col, "n_compact", "n_lines", "n_short", sight.alias("by_sight"))


# Nested values -----------------------------------------------------------------------------------------------------


def month_structs(first: Column, second: Column) -> Column:
    """Two arrays as twelve structs (month, a, b); an array of another length counts as absent, and b then as 0."""
    twelve = lambda a: F.when(F.size(a) == 12, a)
    return F.when(twelve(first).isNotNull(), F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.struct(m.alias("month"), F.get(first, m - 1).alias("a"), F.coalesce(F.get(twelve(second), m - 1), F.lit(0)).alias("b"))))


def fingerprint(*columns: str) -> Column:
    """A hash of JSON with sorted keys and explicit nulls; decimals lose trailing zeros, dates are ISO."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def plain_decimal(amount: Column) -> Column:
    """A decimal's text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(amount.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def linked(recommendations: DataFrame, findings: DataFrame, inspections: DataFrame) -> DataFrame:
    """Each recommendation with its findings (here: of its inspection): first three labels, highest rating, date."""
    own = findings.groupBy(F.col("inspection_id").alias("id")).agg(F.slice(F.sort_array(F.collect_set("description")), 1, 3).alias("labels"), F.max(F.greatest("stability", "safety", "durability")).alias("worst"), F.count("*").alias("n"))
    return recommendations.select("id").join(own, "id", "left").join(inspections.select("id", "inspected_on"), "id", "left")


def deduplicated(evidence: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Evidence with one row for each content; the last in order wins."""
    return first_per_key(evidence, keys, order)


def with_parents(children: DataFrame, parents: DataFrame, key: str, default: Column) -> DataFrame:
    """Children whose parent is absent or unknown go to a default one; ``repaired`` tells which."""
    known = parents.select(F.col("id").alias(key), F.lit(True).alias("_known"))
    return children.join(known, key, "left").withColumn("repaired", F.col("_known").isNull()).withColumn(key, F.when(F.col("_known").isNotNull(), F.col(key)).otherwise(default)).drop("_known")


def descriptions(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each finding row in a page the text up to the next one, white space collapsed, 400 characters at most."""
    parts = F.split(F.col(text_col), r"(?=\[\d+\] S=)")
    rows = pages.select(F.col(id_col).alias("page_id"), F.posexplode(parts).alias("place", "part")).where(F.rlike("part", F.lit(r"^\[\d+\] S=")))
    body = F.trim(F.regexp_replace(F.regexp_replace("part", r"^\[\d+\] S=[^ ]* V=[^ ]* D=\d+", ""), r"\s+", " "))
    return rows.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("place")).alias("n"), F.regexp_extract("part", r"^\[(\d+)\]", 1).cast("long").alias("number"), F.nullif(F.substring(body, 1, 400), F.lit("")).alias("description"))


def by_category(pages: DataFrame, categories: Column) -> DataFrame:
    """Pages of each document and category, in order; a page may be in several."""
    return pages.select("document_id", "number", F.explode(categories).alias("category")).groupBy("document_id", "category").agg(F.sort_array(F.collect_set("number")).alias("pages"))


def longer_text(parsed: Column, recognised: Column, least: int = 40) -> Column:
    """Recognised text where the parsed one has under ``least`` characters and is the shorter."""
    size = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", ""))
    return F.when((size(parsed) < least) & (F.length(recognised) > F.length(F.coalesce(parsed, F.lit("")))), recognised).otherwise(parsed)


def json_number(text: Column, path: str) -> Column:
    """A JSON property as a whole number only if it is one; text, other types and broken JSON give null."""
    value = F.try_parse_json(text)
    is_number = F.schema_of_variant(F.try_variant_get(value, path, "variant")).isin("BIGINT")
    return F.when(is_number, F.try_variant_get(value, path, "bigint"))
