"""Queries over what is extracted from documents: identities, changes, routed sections, text segments, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from girderlake.functions import pages
from girderlake.operators import bridges, identities, sections
from girderlake.plans.oracles import ORACLES, VIEWS
from girderlake.plans.queries import query
from girderlake.sources.relations import with_relations

SQL: dict[str, str] = {}


def sql(text: str):
    """The SQL of the query below."""

    def keep(made):
        SQL[made.__name__] = text
        return made

    return keep


#: NFKC of the letters that the relations hold.
_CANON = r"lower(trim(regexp_replace(translate({x}, 'ＡＮ', 'AN'), '\s+', ' ', 'g')))"


def _canon(x: str) -> str:
    return _CANON.format(x=x)


def _digest(json: str) -> str:
    return f"left(sha256({json}), 32)"


def _keyed(kinds: str, part: str, above: str, more: str = "") -> str:
    """One level: base keys from the parents' and siblings' collisions."""
    return f"""SELECT document_id, kind, source_key, CASE WHEN n > 1 THEN base || ':' || {_canon("source_key")} ELSE base END AS identity_key FROM (
      SELECT *, CASE WHEN base IS NOT NULL THEN row_number() OVER (PARTITION BY document_id, kind, base ORDER BY position, source_key) END AS n FROM (
        SELECT r.document_id, r.kind, r.source_key, r.position, a.identity_key || {part} AS base FROM own r {more} LEFT JOIN {above} WHERE r.kind IN ({kinds})))"""


_NAMED = f"coalesce(nullif({_canon('r.source_key')}, ''), proof)"


@sql(
    f"""SELECT * FROM (WITH proofs AS (SELECT document_id, kind, source_key, 'evidence:' || {_digest("'[' || string_agg('{\"pageNumber\":' || page || ',\"sourceExcerpt\":' || to_json(said) || '}', ',' ORDER BY page, said) || ']'")} AS proof
      FROM (SELECT *, coalesce({_canon("excerpt")}, '') AS said FROM {{extracted_evidence}}) GROUP BY ALL),
    own AS (SELECT o.*, coalesce(proof, 'unidentified') AS proof FROM (SELECT *, row_number() OVER (PARTITION BY document_id, kind, source_key ORDER BY position) AS place FROM {{extracted}}) o
      LEFT JOIN proofs p ON p.document_id = o.document_id AND p.kind = o.kind AND p.source_key = o.source_key WHERE place = 1),
    l0 AS (SELECT document_id, kind, source_key, 'bridge:' || {_canon("coalesce(external_number, proof)")} AS identity_key FROM own WHERE kind = 'BRIDGE'),
    l1 AS ({_keyed("'PARTIAL_STRUCTURE', 'TRAFFIC_OBSERVATION'", "CASE r.kind WHEN 'PARTIAL_STRUCTURE' THEN ':partial:' || " + _canon("coalesce(external_number, r.source_key)") + " ELSE ':traffic:' || year || ':' || coalesce(CAST(day AS VARCHAR), 'year') END", "l0 a ON a.document_id = r.document_id")}),
    l2 AS ({_keyed("'COMPONENT', 'INSPECTION', 'HISTORICAL_WORK'", "CASE r.kind WHEN 'COMPONENT' THEN ':component:' || " + _digest(f"to_json({_NAMED})") + " WHEN 'HISTORICAL_WORK' THEN ':historical-work:' || " + _digest(f"to_json({_NAMED})") + " ELSE ':inspection:' || coalesce(CAST(day AS VARCHAR), r.source_key) || ':' || coalesce(type, 'OTHER') END",
      "(SELECT * FROM l0 UNION ALL SELECT * FROM l1 WHERE kind = 'PARTIAL_STRUCTURE') a ON a.document_id = r.document_id AND a.source_key = CASE WHEN r.kind = 'HISTORICAL_WORK' THEN coalesce(r.parent_key, '$bridge') ELSE r.parent_key END")}),
    l3 AS ({_keyed("'FINDING'", "':finding:' || " + _digest(f"to_json(coalesce('source:' || {_canon('source_identifier')}, proof))"), "l2 a ON a.document_id = r.document_id AND a.kind = 'INSPECTION' AND a.source_key = r.parent_key")}),
    linked AS (SELECT k.document_id, k.source_key, bool_or(f.identity_key IS NULL) AS broken, list_sort(list(f.identity_key) FILTER (WHERE f.identity_key IS NOT NULL)) AS found FROM {{extracted_links}} k LEFT JOIN l3 f ON f.document_id = k.document_id AND f.source_key = k.finding_key GROUP BY ALL),
    l4 AS ({_keyed("'RECOMMENDATION'", "CASE WHEN NOT coalesce(broken, false) THEN ':recommendation:' || " + _digest("'{\"linkedFindings\":' || coalesce(CAST(to_json(found) AS VARCHAR), '[]') || ',\"sourceDescriptor\":' || to_json(" + _canon("r.source_key") + ") || '}'") + " END", "l1 a ON a.document_id = r.document_id AND a.kind = 'PARTIAL_STRUCTURE' AND a.source_key = r.parent_key", "LEFT JOIN linked k ON k.document_id = r.document_id AND k.source_key = r.source_key")})
    SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4)"""
)
@query
def identity_tree(rel):
    """Keys of all records of all documents, down the tree of kinds."""
    tasks = rel.tasks("lineitem", "orders")
    rel = rel.dealing(tasks, "structure_id", "findings")  # a document's are its structure's: distinct ones are found where they lie
    return identities.identity_plan(rel.extracted, rel.extracted_evidence, rel.extracted_links, tasks)


VIEWS["q_changes"] = """SELECT coalesce(b.document_id, d.document_id) AS document_id, coalesce(b.kind, d.kind) AS kind, coalesce(b.identity_key, d.identity_key) AS identity_key, entity_id,
    CASE WHEN b.document_id IS NULL THEN 'INSERT' WHEN d.document_id IS NULL THEN 'STALE' WHEN b.fingerprint = d.fingerprint THEN 'UNCHANGED' ELSE 'UPDATE' END AS action
  FROM {bindings} b FULL JOIN {desired} d ON d.document_id = b.document_id AND d.kind = b.kind AND d.identity_key = b.identity_key"""
VIEWS["q_guards"] = """SELECT document_id, guard, count(*) AS n FROM (
    SELECT document_id, 'REVIEWED_EVIDENCE' AS guard FROM {document_reviews} WHERE review_state = 'CONFIRMED' AND document_id IN (SELECT document_id FROM {bindings})
    UNION ALL SELECT b.document_id, CASE WHEN e.entity_id IS NULL THEN 'MISSING_ENTITY' ELSE 'CHANGED_ENTITY' END FROM {bindings} b LEFT JOIN {entities} e ON e.kind = b.kind AND e.entity_id = b.entity_id WHERE e.entity_id IS NULL OR e.fingerprint IS DISTINCT FROM b.fingerprint
    UNION ALL SELECT document_id, 'STALE_STRUCTURE' FROM {q_changes} WHERE action = 'STALE' AND kind = 'BRIDGE'
    UNION ALL SELECT document_id, 'PLANNED_USE' FROM {q_changes} WHERE action = 'STALE' AND kind = 'RECOMMENDATION' AND entity_id IN (SELECT concat('r', recommendation_id) FROM {interventions})
    UNION ALL SELECT document_id, 'SHARED_PARTIAL' FROM {q_changes} c WHERE action = 'STALE' AND kind = 'PARTIAL_STRUCTURE' AND EXISTS (SELECT 1 FROM {document_uses} u WHERE u.entity_id = c.entity_id AND u.document_id <> c.document_id)) GROUP BY ALL"""
_PLACES = ", ".join(f"'{g}'" for g in identities.GUARDS)
_STEPS = ", ".join(f"'{k}'" for k in identities.DELETE_ORDER)
VIEWS["q_outcomes"] = f"""SELECT document_id, kind, identity_key, entity_id, action, guard, CASE WHEN action = 'DELETE' THEN list_position([{_STEPS}], kind) END AS step FROM (
    SELECT c.document_id, kind, identity_key, entity_id, CASE WHEN guard IS NOT NULL THEN CASE action WHEN 'INSERT' THEN 'BLOCKED' ELSE 'KEPT' END WHEN action = 'STALE' THEN 'DELETE' ELSE action END AS action, guard
    FROM {{q_changes}} c LEFT JOIN (SELECT document_id, [{_PLACES}][min(list_position([{_PLACES}], guard))] AS guard FROM {{q_guards}} GROUP BY 1) g ON g.document_id = c.document_id)"""


class _Again:
    """What queries of re-extraction share: entities stored once by document, and all that is made of them beside them."""

    def __init__(self, rel):
        self.tasks = rel.tasks("lineitem", "orders")
        self.rel = rel = rel.by_structure(self.tasks).keeping("entities", tasks=self.tasks, key="document_id")
        self.bindings, self.desired = rel.bindings_at_home, rel.desired_at_home
        self.current = rel.entities.select(F.col("document_id").alias("home"), "kind", "entity_id", "fingerprint")
        self.spread = identities.spread_entities(self.bindings, self.current, "home", self.tasks)

    def stale(self, *kinds: str):
        """Stale records, of some kinds only."""
        of = (lambda df: df.where(F.col("kind").isin(*kinds))) if kinds else (lambda df: df)
        return identities.stale_changes(of(self.bindings), of(self.desired), "home")

    def guards(self):
        planned = self.rel.interventions.select(F.concat(F.lit("r"), F.col("recommendation_id").cast("string")).alias("recommendation_id"))
        return identities.reextraction_guards(self.bindings, self.stale(*identities.GUARDED), self.current, self.rel.document_reviews, planned, self.rel.document_uses, "home", self.spread)

    def outcomes(self, changes):
        return identities.guarded_changes(changes, self.guards(), "home", self.bindings, self.tasks)


@sql("SELECT * FROM {q_guards}")
@query
def extraction_guards(rel):
    """What keeps documents from being extracted anew."""
    return _Again(rel).guards()


@sql("SELECT * FROM {q_outcomes}")
@query
def extraction_outcomes(rel):
    """What a new extraction does to every record, all or nothing for each document."""
    again = _Again(rel)
    return again.outcomes(identities.reextraction_changes(again.bindings, again.desired, "home")).drop("home")


@sql("SELECT kind, entity_id, fingerprint FROM {entities} e WHERE NOT EXISTS (SELECT 1 FROM {q_outcomes} o WHERE o.action = 'DELETE' AND o.kind = e.kind AND o.entity_id = e.entity_id)")
@query
def surviving_entities(rel):
    """Records that are left after the deletes."""
    again = _Again(rel)
    return identities.survivors(again.current, again.outcomes(again.stale()), "home", again.spread).select("kind", "entity_id", "fingerprint")


@sql("SELECT u.document_id, CASE WHEN NOT EXISTS (SELECT 1 FROM {q_outcomes} o WHERE o.action = 'DELETE' AND o.kind = 'PARTIAL_STRUCTURE' AND o.document_id = u.document_id AND o.entity_id = u.entity_id) THEN u.entity_id END AS entity_id FROM {document_uses} u")
@query
def released_documents(rel):
    """Documents, without the parts that their own extraction deletes."""
    again = _Again(rel)
    return identities.released_documents(again.rel.document_uses, again.outcomes(again.stale(identities.PARTIAL)))


def _records(path: str, one: bool = False) -> str:
    """SQL of the records of the sections that hold a list: section_id, document_id, place, rec."""
    held = f"[json_extract(j, '{path}')]" if one else f"json_extract(j, '{path}[*]')"
    return f"""(SELECT section_id, document_id, place, l[place + 1] AS rec FROM (SELECT *, unnest(range(len(l))) AS place FROM (SELECT id AS section_id, document_id, {held} AS l
      FROM (SELECT id, document_id, try_cast(payload AS JSON) AS j FROM {{{{sections}}}} WHERE category = '{{category}}'))) WHERE coalesce(json_type(l[place + 1]), 'NULL') <> 'NULL')"""


def _value(name: str) -> str:
    return f"json_extract_string(rec, '$.{name}.value')"


def _plain(name: str) -> str:
    """A German number as the sections write it: points between thousands, a comma before decimals."""
    v = _value(name)
    return f"try_cast(CASE WHEN contains({v}, ',') THEN replace(replace({v}, '.', ''), ',', '.') WHEN regexp_full_match({v}, '\\d\\d?\\d?(\\.\\d\\d\\d)+') THEN replace({v}, '.', '') ELSE {v} END AS DOUBLE)"


def _whole(name: str) -> str:
    return f"CAST({_plain(name)} AS BIGINT)"


_DAY = "coalesce(CAST(try_strptime({v}, '%d.%m.%Y') AS DATE), CAST(try_strptime({v}, '%Y-%m-%d') AS DATE))"


def _day(name: str) -> str:
    return _DAY.format(v=_value(name))


def _small(name: str) -> str:
    return f"CASE WHEN try_cast({_value(name)} AS DOUBLE) BETWEEN 0 AND 4 THEN try_cast({_value(name)} AS BIGINT) END"


#: Of each kind: its fields in SQL, and what makes a record valid besides a source key.
_SECTION_SQL = {
    "bridges": ({"structure_number": f"trim({_value('structure_number')})", "name": _value("name"), "country": "'DE'", "latitude": f"CASE WHEN abs({_plain('latitude')}) <= 90 THEN {_plain('latitude')} END", "longitude": _plain("longitude")}, "true"),
    "partials": ({"part_number": _value("part_number"), "construction_year": _whole("construction_year"), "length_m": _plain("length_m"), "span_count": _whole("span_count")}, "coalesce(construction_year BETWEEN 1700 AND 2200, true)"),
    "components": ({"type": _value("type"), "material": f"regexp_replace({_value('material')}, '\\s+', ' ', 'g')", "install_year": _whole("install_year")}, "coalesce(install_year BETWEEN 1700 AND 2200, true)"),
    "inspections": ({"type": f"CASE {_value('type')} WHEN 'Hauptprüfung' THEN 'MAIN' END", "inspected_on": _day("inspected_on"), "score": _plain("score"), "cycle_months": _whole("cycle_months")}, "coalesce(score BETWEEN 1 AND 4, true) AND coalesce(cycle_months > 0, true)"),
    "findings": ({"number": _value("number"), "description": _value("description"), "quantity": f"CASE WHEN unit IS NOT NULL THEN {_plain('quantity')} END", "quantity_unit": "unit", "stability": _small("stability"), "safety": _small("safety"), "durability": "CAST(NULL AS BIGINT)", "status": f"CASE {_value('status')} WHEN 'behoben' THEN 'RESOLVED' ELSE 'OPEN' END"}, "true"),
    "recommendations": ({"work_type": _value("work_type"), "urgency": "'KURZFRISTIG'", "cost": _plain("cost"), "currency": f"CASE WHEN {_plain('cost')} IS NOT NULL THEN coalesce(upper({_value('currency')}), 'EUR') END", "target_year": _whole("target_year"), "status": "'SCHEDULED'"}, "coalesce(target_year BETWEEN 1700 AND 2200, true)"),
    "works": ({"title": _value("title"), "started_on": _day("started_on"), "ended_on": _day("ended_on"), "amount": _plain("amount")}, "coalesce(ended_on >= started_on, true)"),
    "observations": ({"observation_year": _whole("observation_year"), "observed_on": _day("observed_on"), "daily_traffic": _whole("daily_traffic"), "truck_share": _plain("truck_share"), "heavy_daily": f"CAST(floor({_plain('daily_traffic')} * {_plain('truck_share')} / 100 + 0.5) AS BIGINT)"},
        "observation_year IS NOT NULL AND coalesce(year(observed_on) = observation_year, true) AND coalesce(truck_share <= 100, true)"),
}
_UNIT = f"CASE WHEN {_plain('quantity')} IS NOT NULL THEN CASE {_value('quantity_unit')} WHEN 'Stück' THEN 'Stk' ELSE CASE {_value('description')} WHEN 'Riss 3 mm' THEN 'mm' WHEN '12 lfd m Fuge' THEN 'm' END END END AS unit"


def _judged_sql(kind: str) -> str:
    route, (fields, valid) = sections.ROUTES[kind], _SECTION_SQL[kind]
    rows = _records(route.path, route.one).format(category=route.category)
    rows = rows if kind != "findings" else f"(SELECT *, {_UNIT} FROM {rows})"
    key = "'$bridge'" if route.one else "nullif(json_extract_string(rec, '$.sourceKey'), '')"
    return f"(SELECT *, source_key IS NOT NULL AND {valid} AS valid FROM (SELECT document_id, section_id, place, {key} AS source_key, {', '.join(f'{v} AS {n}' for n, v in fields.items())} FROM {rows}))"


def _section_query(kind: str):
    def made(rel):
        return sections.kept(sections.routed(sections.section_records(rel.sections), kind)).drop("place")

    made.__name__, made.__doc__ = f"section_{kind}", f"E5, U5: {kind} of all documents' sections, invalid ones left out."
    order = f"SELECT *, row_number() OVER (PARTITION BY document_id, source_key ORDER BY section_id, place) AS n FROM {_judged_sql(kind)} WHERE valid"
    return sql(f"SELECT document_id, section_id, source_key, {', '.join(_SECTION_SQL[kind][0])} FROM ({order}) WHERE n = 1")(query(made))


for _kind in sections.ROUTES:
    _section_query(_kind)

_ALL_JUDGED = " UNION ALL ".join(f"SELECT '{route.category}' AS category, count(*) AS n_records, count(*) FILTER (WHERE valid) AS n_valid FROM {_judged_sql(kind)}" for kind, route in sections.ROUTES.items())


@sql(f"SELECT s.category, n_sections, coalesce(n_records, 0) AS n_records, coalesce(n_valid, 0) AS n_valid FROM (SELECT category, count(*) AS n_sections FROM {{sections}} GROUP BY 1) s LEFT JOIN ({_ALL_JUDGED}) j ON j.category = s.category")
@query
def section_counts(rel):
    """E5: records of each kind of section, and how many are valid."""
    return sections.routing_counts(rel.sections, sections.section_records(rel.sections))


@sql(
    r"""SELECT document_id, source_key, type, inspected_on, cycle_months, score, number FROM (SELECT *, row_number() OVER (PARTITION BY document_id, source_key ORDER BY number, id, place) AS n FROM (
      SELECT document_id, number, id, place, concat('inspection:', coalesce(CAST(day AS VARCHAR), m[2]), ':', type) AS source_key, type, day AS inspected_on, try_cast(m[3] AS BIGINT) AS cycle_months, try_cast(replace(m[4], ',', '.') AS DOUBLE) AS score FROM (
        SELECT *, CASE WHEN lower(m[1]) LIKE 'haupt%' THEN 'MAIN' WHEN lower(m[1]) LIKE 'einf%' THEN 'SIMPLE' ELSE 'SPECIAL' END AS type, CAST(try_strptime(m[2], '%d.%m.%Y') AS DATE) AS day FROM (
          SELECT document_id, number, id, place, [regexp_extract(hit, p, 1), regexp_extract(hit, p, 2), regexp_extract(hit, p, 3), regexp_extract(hit, p, 4)] AS m FROM (
            SELECT document_id, number, id, p, unnest(range(len(hits))) AS place, unnest(hits) AS hit FROM (SELECT *, regexp_extract_all(text, p) AS hits FROM (SELECT *, '(?i)(?:H\d+\s+)?(?:\d+\.\s+)?(Hauptprüfung(?:\s+vor der Abnahme)?|Einfache Prüfung|Sonderprüfung)\s+(\d{1,2}\.\d{1,2}\.\d{4})(?:\s+(\d+)\s+Monate)?(?:\s+(\d+,\d+))?' AS p FROM {measure_pages}))))))) WHERE n = 1"""
)
@query
def page_inspections(rel):
    """Inspections that pages list, the first of each day and type of a document."""
    return sections.page_inspections(rel.measure_pages, "document_id", "number", "id", "text")


_MEASURE_BLOCKS = r"""SELECT document_id, number, id, place, ids[place] AS measure, bodies[place + 1] AS body FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS place FROM (
    SELECT document_id, number, id, regexp_extract_all(text, '(?i)ma[sß]nahmenempfehlung\s*\x7B\s*(\d+)\s*\x7D', 1) AS ids, string_split_regex(text, '(?i)ma[sß]nahmenempfehlung\s*\x7B\s*\d+\s*\x7D') AS bodies FROM {measure_pages}))"""


def _amount(label: str) -> str:
    hit = rf"regexp_extract(body, '(?i){label}[:\s]*(--|\d{{1,3}}(?:\.\d{{3}})+(?:,\d+)?|\d+(?:[.,]\d+)?)', 1)"
    return rf"try_cast(CASE WHEN contains({hit}, ',') OR regexp_full_match({hit}, '\d+\.\d\d\d') THEN replace(replace({hit}, '.', ''), ',', '.') ELSE {hit} END AS DOUBLE)"


@sql(
    rf"""SELECT document_id, concat('recommendation:', measure) AS source_key, work_type, CASE lower(urgency) WHEN 'sofort' THEN 'SOFORT' WHEN 'langfristig' THEN 'LANGFRISTIG' END AS urgency, quantity,
      CASE WHEN quantity IS NOT NULL THEN CASE WHEN work_type LIKE '%m²%' THEN 'm2' WHEN work_type LIKE '%lfd m%' THEN 'm' ELSE 'Stk' END END AS unit, cost, CASE WHEN cost IS NOT NULL THEN 'EUR' END AS currency, array_to_string(found, ',') AS findings, number
    FROM (SELECT *, nullif(trim(regexp_replace(regexp_extract(body, '(?i)Art der Leistung\s+([^
]+)', 1), '\s+', ' ', 'g')), '') AS work_type, regexp_extract(body, '(?i)Dringlichkeit\s+(Sofort|Kurzfristig|Mittelfristig|Langfristig)', 1) AS urgency,
      {_amount("Menge")} AS quantity, {_amount("Gesch[äa]tzte Kosten")} AS cost, CASE WHEN contains(body, 'Zugeordnete') THEN ['28', '77'] ELSE [regexp_extract(body, '\[(\d+)\]', 1)] END AS found
      FROM (SELECT *, row_number() OVER (PARTITION BY document_id, measure ORDER BY number, id, place) AS n FROM ({_MEASURE_BLOCKS})) WHERE n = 1)"""
)
@query
def page_measures(rel):
    """Recommended measures that pages describe, the first of each number of a document."""
    return sections.page_measures(rel.measure_pages, "document_id", "number", "id", "text").withColumn("findings", F.array_join("findings", ","))


_FOUND_PAIRS = r"""list_reduce(list_prepend({{r: CAST(NULL AS DOUBLE), h: CAST(NULL AS DOUBLE), pairs: CAST([] AS STRUCT(one DOUBLE, two DOUBLE)[])}},
    list_transform(regexp_extract_all({t}, '(?i)(?:rechtswert|hochwert)\s*:?\s*(?:[0-9]{{1,3}}(?:\.[0-9]{{3}})+,[0-9]+|[0-9]+(?:[.,][0-9]+)?)'), lambda v: {{r: CASE WHEN lower(v) LIKE 'r%' THEN {m} END, h: CASE WHEN lower(v) LIKE 'h%' THEN {m} END, pairs: CAST([] AS STRUCT(one DOUBLE, two DOUBLE)[])}})),
    lambda s, x: CASE WHEN coalesce(x.r, s.r) IS NOT NULL AND coalesce(x.h, s.h) IS NOT NULL THEN {{r: CAST(NULL AS DOUBLE), h: CAST(NULL AS DOUBLE), pairs: list_append(s.pairs, {{one: coalesce(x.r, s.r), two: coalesce(x.h, s.h)}})}} ELSE {{r: coalesce(x.r, s.r), h: coalesce(x.h, s.h), pairs: s.pairs}} END).pairs"""
_METRES = r"CAST(CASE WHEN contains(v, ',') AND regexp_matches(v, '\.') THEN replace(replace(regexp_extract(v, '[0-9.,]+$'), '.', ''), ',', '.') ELSE replace(regexp_extract(v, '[0-9.,]+$'), ',', '.') END AS DOUBLE)"


def _pair_sql(pairs: str, low: int, high: int) -> str:
    inside = lambda a, b: f"CASE WHEN p.one BETWEEN {a} AND {b} THEN p.one WHEN p.two BETWEEN {a} AND {b} THEN p.two END"
    return f"list_filter(list_transform({pairs}, lambda p: {{east: {inside(low, high)}, north: {inside(5200000, 6200000)}}}), lambda q: q.east IS NOT NULL AND q.north IS NOT NULL)[1]"


_GIS = rf"""SELECT id, CASE WHEN best IS NOT NULL THEN CASE WHEN nr IN (1, 3) THEN 'UTM_ETRS89_TO_WGS84' ELSE 'GAUSS_KRUEGER_DHDN_TO_WGS84' END END AS method, CASE WHEN best IS NOT NULL THEN ['UTM_BLOCK', 'GK_BLOCK', 'HEADING', 'HEADING'][nr] END AS place, best.east AS east, best.north AS north
    FROM (SELECT id, CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN c IS NOT NULL THEN 3 ELSE 4 END AS nr, coalesce(a, b, c, d) AS best FROM (
      SELECT id, {_pair_sql("u", 250000, 850000)} AS a, {_pair_sql("g", 2400000, 5600000)} AS b, {_pair_sql("w", 250000, 850000)} AS c, {_pair_sql("w", 2400000, 5600000)} AS d
      FROM (SELECT id, {_FOUND_PAIRS.format(t="ut", m=_METRES)} AS u, {_FOUND_PAIRS.format(t="gt", m=_METRES)} AS g, {_FOUND_PAIRS.format(t="pt", m=_METRES)} AS w FROM (
        SELECT id, regexp_extract(t, '(?is)utm[- ]koordinaten(.{{0,500}}?)(?:gau[sß][- ]kr[uü]ger|gesamtl[aä]nge|5\.\d|\z)', 1) AS ut, regexp_extract(t, '(?is)gau[sß][- ]kr[uü]ger[- ]koordinaten(.{{0,500}}?)(?:utm[- ]koordinaten|gesamtl[aä]nge|5\.\d|\z)', 1) AS gt,
          CASE WHEN regexp_matches(t, '(?i)gis[- ]koordinaten|utm[- ]koordinaten|gau[sß][- ]kr[uü]ger') THEN t ELSE '' END AS pt FROM (SELECT id, coalesce(text, '') AS t FROM {{gis_pages}})))))"""


@sql(_GIS)
@query
def coordinate_pairs(rel):
    """M9: the pair of metres that each page gives, and where it stands; blocks before headings, swapped labels by range."""
    return sections.coordinate_pairs(rel.gis_pages, "text").drop("text")


#: Bytes of ``part`` whose pages one task takes: some 50,000 pages.
PAGE_BYTES = 1 << 19

#: A document's pages as one text; the rules for a name read its lines, the others its words.
_BOOK_TEXTS = """SELECT document_id, string_agg(coalesce(text, ''), chr(10) ORDER BY number) AS raw FROM {identity_pages} GROUP BY 1"""
_TOLD = rf"""SELECT document_id, coalesce(nullif(regexp_extract(flat, '(?i)bauwerks(?:nummer|-?nr\.?)\D{{0,20}}(\d{{5,8}})', 1), ''), nullif(regexp_extract(flat, '(?i)nummer\s+stra(?:ss|ß)e\s+ibwnr\s+(\d{{5,8}})', 1), ''),
      nullif(regexp_extract(raw, '(?i)(?:^|\n)\s*nummer\s*(?:\n[^\n]*){{0,3}}?\n\s*(\d{{5,8}})\b', 1), '')) AS structure_number,
    CASE WHEN label > 0 THEN list_filter(rows[label + 1:label + 4], lambda x: length(x) >= 4 AND NOT regexp_matches(x, '(?i)nächst|ort|verwaltung|titelblatt|bemerkung|autobahn|version|seite|akten|overath|vilkerath') AND NOT regexp_matches(x, '^\d'))[1] END AS name,
    nullif(regexp_extract(flat, '\b([ABLK]\s?\d{{1,4}})\b', 1), '') AS road
    FROM (SELECT *, coalesce(list_position(list_transform(rows, lambda x: regexp_matches(x, '(?i)^bauwerksname\b')), true), 0) AS label FROM (
      SELECT document_id, raw, trim(regexp_replace(translate(raw, 'Ａ', 'A'), '\s+', ' ', 'g')) AS flat, list_transform(regexp_split_to_array(raw, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS rows FROM ({_BOOK_TEXTS})))"""


@sql(_TOLD)
@query
def told_identities(rel):
    """what each document's text tells of its structure: number, name, road; its SQL reads the document as one text."""
    return bridges.told_identity(rel.identity_pages, "document_id", "number", "text", rel.tasks("part", share=PAGE_BYTES))


@sql(
    rf"""SELECT * FROM (WITH told AS ({_TOLD}), pair AS (SELECT document_id, min(number) AS place_page FROM ({_GIS.replace("{gis_pages}", "{identity_pages}")}) JOIN {{identity_pages}} USING (id) WHERE method IS NOT NULL GROUP BY 1),
    model AS (SELECT document_id, count(*) AS n, {", ".join(f"arg_min({f}, place) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in ("structure_number", "name", "road", "latitude", "longitude"))} FROM {{bridge_records}} GROUP BY 1)
    SELECT b.document_id, coalesce(m.structure_number, t.structure_number, concat('DOC-', coalesce(left(replace(uid, '-', ''), 12), 'unknown'))) AS structure_number, CASE WHEN m.structure_number IS NOT NULL THEN 'MODEL' WHEN t.structure_number IS NOT NULL THEN 'TEXT' ELSE 'DOCUMENT' END AS structure_number_from,
      coalesce(m.name, t.name, stem) AS name, CASE WHEN m.name IS NOT NULL THEN 'MODEL' WHEN t.name IS NOT NULL THEN 'TEXT' WHEN stem IS NOT NULL THEN 'FILENAME' END AS name_from, coalesce(m.road, t.road) AS road, CASE WHEN m.road IS NOT NULL THEN 'MODEL' WHEN t.road IS NOT NULL THEN 'TEXT' END AS road_from,
      CASE WHEN m.latitude IS NOT NULL THEN 'MODEL' WHEN place_page IS NOT NULL THEN 'PAGE' END AS latitude_from, CASE WHEN m.longitude IS NOT NULL THEN 'MODEL' WHEN place_page IS NOT NULL THEN 'PAGE' END AS longitude_from, place_page, coalesce(n, 0) AS n_merged
    FROM (SELECT *, nullif(trim(regexp_replace(filename, '(?i)\.pdf$', '')), '') AS stem FROM {{bridge_books}}) b LEFT JOIN model m USING (document_id) LEFT JOIN told t USING (document_id) LEFT JOIN pair p USING (document_id))"""
)
@query
def completed_bridges(rel):
    """One bridge of every book and where each of its fields comes from."""
    identity = bridges.told_identity(rel.identity_pages, "document_id", "number", "text", rel.tasks("part", share=PAGE_BYTES))
    places = bridges.told_place(rel.identity_pages, "document_id", "number", "text")
    return bridges.completed(rel.bridge_books, rel.bridge_records, identity, places, "document_id", "place").drop("latitude", "longitude")


def _added(have: str, test: str, category: str) -> str:
    """A list of categories, and one more where the test holds."""
    at = f"list_position({have}, 'DRAWINGS_IMAGES_OTHER')"
    room = f"CASE WHEN len({have}) >= 4 AND {at} IS NOT NULL AND {at} > 0 THEN list_concat({have}[1:{at} - 1], {have}[{at} + 1:]) ELSE {have} END"
    return f"CASE WHEN NOT ({test}) OR list_contains({have}, '{category}') THEN {have} WHEN len({room}) < 4 THEN list_append({room}, '{category}') ELSE {room} END"


@sql(
    f"""SELECT id, array_to_string(list_transform(x, lambda v, i: v || '=' || CASE WHEN i <= n AND list_contains(given, v) THEN '0.5' ELSE '0.95' END), ',') AS categories FROM (
      SELECT *, {_added("b", r"regexp_matches(text, '(?:Hauptprüfung|Einfache Prüfung|Sonderprüfung) +[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}')", "INSPECTIONS")} AS x FROM (
      SELECT *, {_added("a", "contains(text, 'Dringlichkeit')", "RECOMMENDATIONS")} AS b FROM (SELECT *, {_added("given", "contains(text, '[3] S = 1')", "FINDINGS_DAMAGE")} AS a FROM (SELECT *, [c0, c1, c2, c3, c4][1:n] AS given FROM {{classified_pages}}))))"""
)
@query
def page_categories(rel):
    """Categories of each page after its text was asked, with their confidence; some pages have five before."""
    one = lambda c: F.struct(F.col(c).alias("category"), F.lit(0.5).alias("confidence"))
    given = F.slice(F.array(*[one(f"c{i}") for i in range(5)]), F.lit(1), F.col("n").cast("int"))
    told = pages.with_told_categories(given, F.col("text"))
    return rel.classified_pages.select("id", F.array_join(F.transform(told, lambda x: F.concat(x["category"], F.lit("="), x["confidence"].cast("string"))), ",").alias("categories"))


ORACLES.update({name: with_relations(text, VIEWS) for name, text in SQL.items()})
