"""From sections and page text to typed records: routing (E5), segments between markers (E1), coordinate blocks (M9)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderlake.functions import geo, pages, text
from girderlake.functions.text import collapsed, first_of
from girderlake.operators.latest import first_per_key

# Routing of sections (E5) -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Route:
    """Where a section's records go: the list that holds them, how each field is read, and what must not be false of a record."""

    category: str
    path: str
    fields: dict[str, Callable[[Column], Column]]
    rules: tuple[str, ...] = ()
    needed: tuple[str, ...] = ()
    derived: dict[str, str] = field(default_factory=dict)
    one: bool = False


def _once(x: Column, read: Callable[[Column], Column]) -> Column:
    """What a reader makes of a value that it names many times, worked out once: without this the plan's code outgrows its limit."""
    return F.get(F.transform(F.array(x), read), F.lit(0))


def _decimal(x: Column) -> Column:
    return text.decimal_text(x).cast("double")


def _degrees(most: float) -> Callable[[Column], Column]:
    return lambda x: geo.clamped(text.decimal_text(x, negative=True).cast("double"), most)


def _finding_state(x: Column) -> Column:
    return F.coalesce(text.state(x, text.FINDING_STATES), F.lit("OPEN"))


def _recommendation_state(x: Column) -> Column:
    return F.coalesce(text.state(x, text.RECOMMENDATION_STATES), F.lit("OPEN"))


_YEAR = "BETWEEN 1700 AND 2200"
#: The eight kinds of sections. A value that its reader can't read is null, which no rule forbids unless it is needed.
ROUTES = {
    "bridges": Route("IDENTITY_OVERVIEW", "$.bridge", {"structure_number": collapsed, "name": collapsed, "country": geo.country, "latitude": _degrees(90), "longitude": _degrees(180)}, one=True),
    "partials": Route("STRUCTURE_GEOMETRY", "$.partialStructures", {"part_number": collapsed, "construction_year": text.integer, "length_m": _decimal, "span_count": text.integer}, (f"construction_year {_YEAR}", "span_count >= 0")),
    "components": Route("COMPONENTS_MATERIALS", "$.components", {"type": collapsed, "material": collapsed, "install_year": text.integer}, (f"install_year {_YEAR}",)),
    "inspections": Route("INSPECTIONS", "$.inspections", {"type": lambda x: text.state(x, text.INSPECTION_TYPES, "OTHER"), "inspected_on": text.date, "score": _decimal, "cycle_months": text.integer}, ("score BETWEEN 1 AND 4", "cycle_months > 0")),
    "findings": Route("FINDINGS_DAMAGE", "$.findings", {"number": collapsed, "description": collapsed, "quantity": _decimal, "quantity_unit": text.unit, "stability": text.rating, "safety": text.rating, "durability": text.rating, "status": _finding_state},
        derived={"quantity_unit": "CASE WHEN quantity IS NOT NULL THEN coalesce(quantity_unit, shown_unit) END", "quantity": "CASE WHEN quantity_unit IS NOT NULL THEN quantity END"}),
    "recommendations": Route("RECOMMENDATIONS", "$.recommendations", {"work_type": collapsed, "urgency": text.urgency, "cost": _decimal, "currency": text.currency, "target_year": text.integer, "status": _recommendation_state}, (f"target_year {_YEAR}",),
        derived={"currency": "CASE WHEN cost IS NOT NULL THEN coalesce(currency, 'EUR') END"}),
    "works": Route("HISTORICAL_WORKS_COSTS", "$.historicalWorks", {"title": collapsed, "started_on": text.date, "ended_on": text.date, "amount": _decimal}, ("ended_on >= started_on",)),
    "observations": Route("TRAFFIC_NETWORK", "$.trafficObservations", {"observation_year": text.integer, "observed_on": text.date, "daily_traffic": text.integer, "truck_share": _decimal},
        ("observation_year BETWEEN 1900 AND 2200", "year(observed_on) = observation_year", "daily_traffic >= 0", "truck_share <= 100"), ("observation_year",), {"heavy_daily": "CAST(floor(daily_traffic * truck_share / 100 + 0.5) AS BIGINT)"}),
}


def section_records(sections: DataFrame) -> DataFrame:
    """(document_id, section_id, category, place, record): the records of every section's list, as VARIANT; a payload that is no JSON has none."""
    parsed = sections.withColumn("_v", F.try_parse_json("payload"))
    lists = []
    for route in ROUTES.values():
        held = F.try_variant_get("_v", route.path, "variant")
        found = F.array(held) if route.one else F.try_variant_get("_v", route.path, "array<variant>")
        lists.append((F.col("category") == route.category, found))
    rows = parsed.withColumn("_list", first_of(*lists)).select("document_id", F.col("id").alias("section_id"), "category", F.posexplode_outer("_list").alias("place", "record"))
    return rows.where("record IS NOT NULL AND NOT is_variant_null(record)")


def routed(records: DataFrame, kind: str) -> DataFrame:
    """E5: the records of one kind, read and judged: document_id, section_id, place, source_key, the kind's fields, and valid.

    A record without a source key, without a needed value, or of which a rule is false, isn't valid; others of its section stay.
    """
    route = ROUTES[kind]
    value = lambda name: F.try_variant_get("record", f"$.{name}.value", "string")
    key = F.lit("$bridge") if route.one else F.nullif(F.try_variant_get("record", "$.sourceKey", "string"), F.lit(""))
    df = records.where(F.col("category") == route.category).select("document_id", "section_id", "place", key.alias("source_key"), *[value(n).alias(n) for n in route.fields])
    if "quantity_unit" in route.fields:
        df = df.withColumn("shown_unit", text.unit_in(F.col("description")))
    df = df.withColumns({n: _once(F.col(n), read) for n, read in route.fields.items()})
    for name, sql in route.derived.items():
        df = df.withColumn(name, F.expr(sql))
    good = F.col("source_key").isNotNull()
    for name in route.needed:
        good &= F.col(name).isNotNull()
    for rule in route.rules:
        good &= F.coalesce(F.expr(rule), F.lit(True))
    names = [*route.fields, *(n for n in route.derived if n not in route.fields)]
    return df.select("document_id", "section_id", "place", "source_key", *names, good.alias("valid"))


def kept(judged: DataFrame) -> DataFrame:
    """Of a document's valid records with one source key the first, by section and place."""
    order = [F.col("section_id"), F.col("place")]
    return first_per_key(judged.where("valid"), ["document_id", "source_key"], order).drop("valid")


def routing_counts(sections: DataFrame, records: DataFrame) -> DataFrame:
    """(category, n_sections, n_records, n_valid) of every category that sections name, known or not."""
    rows = sections.select("category", F.lit(1).alias("section"), F.lit(0).alias("n"), F.lit(False).alias("valid"))
    for kind, route in ROUTES.items():
        rows = rows.union(routed(records, kind).select(F.lit(route.category), F.lit(0), F.lit(1), "valid"))
    return rows.groupBy("category").agg(F.sum("section").alias("n_sections"), F.sum("n").alias("n_records"), F.count_if("valid").alias("n_valid"))


# Segments of text (E1) ----------------------------------------------------------------------------------------------

#: How a page shows an inspection and a recommended measure, and what stands in a measure's block.
INSPECTION_ROW = r"(?iu)(?:H\d+\s+)?(?:\d+\.\s+)?(Hauptprüfung(?:\s+vor der Abnahme)?|Einfache Prüfung|Sonderprüfung)\s+(\d{1,2}\.\d{1,2}\.\d{4})(?:\s+(\d+)\s+Monate)?(?:\s+(\d+,\d+))?"
MEASURE = r"(?i)Ma[sß]nahmenempfehlung\s*\{\s*(\d+)\s*\}"
NUMBER = r"--|\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:[.,]\d+)?"
WORK_LINE = r"(?i)Art der Leistung\s+([^\n]+)"
QUANTITY = rf"(?i)Menge[:\s]*({NUMBER})"
COST = rf"(?i)Gesch[äa]tzte Kosten[:\s]*({NUMBER})\s*(?:EURO|EUR|€)?"
URGENCY = r"(?i)Dringlichkeit\s+(Sofort|Kurzfristig|Mittelfristig|Langfristig)"
ASSIGNED = r"(?is)Zugeordnete Sch[äa]den:\s*(.*?)(?:Ma[sß]nahmenempfehlung\s*\{|Art der Leistung|\z)"


def _first(body: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(body, pattern, 1), F.lit(""))


def page_inspections(book: DataFrame, document: str, number: str, id_col: str, text_col: str) -> DataFrame:
    """Inspections that a document's pages list: document, source_key, type, inspected_on, cycle_months, score, page.

    A row is one match; of rows of one day and type the first in page order stays, a day that the calendar lacks included as written.
    """
    groups = [F.regexp_extract_all(F.col(text_col), F.lit(INSPECTION_ROW), F.lit(i)).alias(n) for i, n in enumerate(("label", "day", "cycle", "score"), 1)]
    rows = book.select(document, number, id_col, F.posexplode(F.arrays_zip(*groups)).alias("place", "row"))
    kind = text.state(F.col("row.label"), text.INSPECTION_TYPES, "OTHER")
    day = text.date(F.col("row.day"))
    key = F.concat(F.lit("inspection:"), F.coalesce(day.cast("string"), F.col("row.day")), F.lit(":"), F.coalesce(kind, F.lit("OTHER")))
    df = rows.select(document, number, id_col, "place", key.alias("source_key"), kind.alias("type"), day.alias("inspected_on"), _once(F.nullif(F.col("row.cycle"), F.lit("")), text.integer).alias("cycle_months"), _once(F.nullif(F.col("row.score"), F.lit("")), _decimal).alias("score"))
    return first_per_key(df, [document, "source_key"], [F.col(number), F.col(id_col), F.col("place")]).drop("place", id_col)


def page_measures(book: DataFrame, document: str, number: str, id_col: str, text_col: str) -> DataFrame:
    """Recommended measures: document, source_key, work_type, urgency, quantity, unit, cost, currency, findings, page.

    A page's text is cut at its markers; what follows one, up to the next, is its block. The first block of a number, in
    page order, stays. findings: numbers in brackets of the assigned part, else of the block, in order and once each.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    bodies = F.split(t, MEASURE, -1)
    spots = F.arrays_zip(F.regexp_extract_all(t, F.lit(MEASURE), F.lit(1)).alias("measure"), F.slice(bodies, F.lit(2), F.size(bodies)).alias("body"))
    rows = book.select(document, number, id_col, F.posexplode(spots).alias("place", "spot")).select(document, number, id_col, "place", F.concat(F.lit("recommendation:"), F.col("spot.measure")).alias("source_key"), F.col("spot.body").alias("body"))
    rows = first_per_key(rows, [document, "source_key"], [F.col(number), F.col(id_col), F.col("place")])
    body = F.col("body")
    assigned = F.when(F.rlike(body, F.lit(ASSIGNED)), F.regexp_extract(body, ASSIGNED, 1)).otherwise(body)
    texts = {"_work": WORK_LINE, "_urgency": URGENCY, "_quantity": QUANTITY, "_cost": COST, "_named": r"(?i)(EURO|EUR|€)"}
    df = rows.withColumns({n: _first(body, p) for n, p in texts.items()} | {"findings": F.array_distinct(F.regexp_extract_all(assigned, F.lit(r"\[(\d+)\]"), F.lit(1)))})
    number_of = lambda n: _once(F.nullif(F.col(n), F.lit("--")), _decimal)
    df = df.withColumns({"work_type": collapsed(F.col("_work")), "urgency": text.urgency(F.col("_urgency")), "quantity": number_of("_quantity"), "cost": number_of("_cost")})
    unit = F.coalesce(text.unit_in(F.col("work_type")), text.unit_in(body), F.lit("Stk"))
    df = df.withColumns({"unit": F.when(F.col("quantity").isNotNull(), unit), "currency": F.when(F.col("cost").isNotNull(), text.currency(F.coalesce("_named", F.lit("EUR"))))})
    return df.select(document, "source_key", "work_type", "urgency", "quantity", "unit", "cost", "currency", "findings", number)


# Coordinate blocks (M9) ---------------------------------------------------------------------------------------------

#: Blocks of coordinates, headings that allow a pair anywhere, a labelled value.
UTM_BLOCK = r"(?is)utm[- ]koordinaten(.{0,500}?)(?=gau[sß][- ]kr[uü]ger|gesamtl[aä]nge|5\.\d|\z)"
GK_BLOCK = r"(?is)gau[sß][- ]kr[uü]ger[- ]koordinaten(.{0,500}?)(?=utm[- ]koordinaten|gesamtl[aä]nge|5\.\d|\z)"
GIS_HEADING = r"(?i)gis[- ]koordinaten|utm[- ]koordinaten|gau[sß][- ]kr[uü]ger"
LABELLED = r"(?i)(rechtswert|hochwert)\s*:?\s*([0-9]{1,3}(?:\.[0-9]{3})+,[0-9]+|[0-9]+(?:[.,][0-9]+)?)"
#: Metres of eastings in UTM's zone 32 and in Gauss-Krueger's strips, and of northings.
UTM_EAST, GK_EAST, NORTH = (250_000, 850_000), (2_400_000, 5_600_000), (5_200_000, 6_200_000)

_PAIR = "struct<one:double,two:double>"
_FOLD = f"""aggregate({{values}}, named_struct('r', CAST(NULL AS DOUBLE), 'h', CAST(NULL AS DOUBLE), 'pairs', CAST(array() AS array<{_PAIR}>)), (s, x) -> CASE
    WHEN x.label = 'rechtswert' AND s.h IS NOT NULL THEN named_struct('r', CAST(NULL AS DOUBLE), 'h', CAST(NULL AS DOUBLE), 'pairs', concat(s.pairs, array(named_struct('one', x.metres, 'two', s.h))))
    WHEN x.label = 'rechtswert' THEN named_struct('r', x.metres, 'h', s.h, 'pairs', s.pairs)
    WHEN s.r IS NOT NULL THEN named_struct('r', CAST(NULL AS DOUBLE), 'h', CAST(NULL AS DOUBLE), 'pairs', concat(s.pairs, array(named_struct('one', s.r, 'two', x.metres))))
    ELSE named_struct('r', s.r, 'h', x.metres, 'pairs', s.pairs) END, s -> s.pairs)"""


def _labelled_values(block: Column) -> Column:
    labels, numbers = (F.regexp_extract_all(block, F.lit(LABELLED), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(labels.alias("label"), numbers.alias("number")), lambda x: F.struct(F.lower(x["label"]).alias("label"), pages.metres(x["number"]).alias("metres")))


def _first_pair(pairs: str, east: tuple[int, int]) -> str:
    """The first pair with an easting and a northing, each the first of its two values in range, as a struct of both."""
    within = lambda lo, hi: f"CASE WHEN p.one BETWEEN {lo} AND {hi} THEN p.one WHEN p.two BETWEEN {lo} AND {hi} THEN p.two END"
    told = f"transform({pairs}, p -> named_struct('east', {within(*east)}, 'north', {within(*NORTH)}))"
    return f"get(filter({told}, q -> q.east IS NOT NULL AND q.north IS NOT NULL), 0)"


def coordinate_pairs(book: DataFrame, text_col: str) -> DataFrame:
    """M9, its text part: adds method, place (UTM_BLOCK, GK_BLOCK or HEADING), east and north in metres; null where a page has none.

    Labelled values are folded in order: one of each label makes a pair, a label that repeats before that replaces its value.
    A UTM block is asked first, then one of Gauss-Krueger, then under any heading of coordinates all pairs of the page.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    texts = {"_utm": F.regexp_extract(t, UTM_BLOCK, 1), "_gk": F.regexp_extract(t, GK_BLOCK, 1), "_page": F.when(F.rlike(t, F.lit(GIS_HEADING)), t)}
    df = book.withColumns({n: F.coalesce(_labelled_values(x), F.array().cast("array<struct<label:string,metres:double>>")) for n, x in texts.items()})
    df = df.withColumns({n: F.expr(_FOLD.format(values=n)) for n in texts})
    tries = [("_utm", UTM_EAST, "UTM", "UTM_BLOCK"), ("_gk", GK_EAST, "GK", "GK_BLOCK"), ("_page", UTM_EAST, "UTM", "HEADING"), ("_page", GK_EAST, "GK", "HEADING")]
    methods = {"UTM": "UTM_ETRS89_TO_WGS84", "GK": "GAUSS_KRUEGER_DHDN_TO_WGS84"}
    found = [F.expr(f"named_struct('method', '{methods[m]}', 'place', '{place}', 'pair', {_first_pair(n, east)})") for n, east, m, place in tries]
    best = F.get(F.filter(F.array(*found), lambda x: x["pair"].isNotNull()), F.lit(0))
    return df.withColumn("_best", best).select(*book.columns, F.col("_best.method").alias("method"), F.col("_best.place").alias("place"), F.col("_best.pair.east").alias("east"), F.col("_best.pair.north").alias("north"))


def located(pairs: DataFrame) -> DataFrame:
    """M9: adds latitude and longitude of what ``coordinate_pairs`` found."""
    utm = F.col("method") == "UTM_ETRS89_TO_WGS84"
    df = geo.utm(pairs, F.when(utm, F.col("east")), F.col("north"), F.lit(32)).withColumnsRenamed({"latitude": "_lat", "longitude": "_lon"})
    df = geo.gauss_krueger(df, F.when(~utm, F.col("east")), F.col("north"))
    by = lambda one, two: F.when(utm, F.col(one)).when(F.col("method").isNotNull(), F.col(two))
    return df.select(*pairs.columns, geo.clamped(by("_lat", "latitude"), 90).alias("latitude"), geo.clamped(by("_lon", "longitude"), 180).alias("longitude"))
