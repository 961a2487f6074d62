"""Sections to records, text to segments, labelled values to pairs: cases written out."""

import json

import pytest
from pyspark.sql import functions as F

from girderlake.operators import sections


def v(x):
    return {"value": x}


def test_an_invalid_record_goes_and_its_section_stays(spark):
    inspections = [
        {"sourceKey": "a", "type": v("Hauptprüfung"), "inspected_on": v("1.2.2003"), "score": v("2,5"), "cycle_months": v("36")},
        {"sourceKey": "b", "score": v(4.5)},
        {"sourceKey": "", "score": v(2)},
        {"sourceKey": "c", "score": v("unlesbar"), "cycle_months": v(None)},
        7,
        None,
        {"sourceKey": "a", "type": v("Sonderprüfung")},
    ]
    rows = [(1, 5, "INSPECTIONS", json.dumps({"inspections": inspections})), (2, 5, "INSPECTIONS", "{broken"), (3, 5, "INSPECTIONS", json.dumps({"inspections": "text"})), (4, 5, "INSPECTIONS", None), (5, 5, "OTHER", json.dumps({"inspections": inspections}))]
    frame = spark.createDataFrame(rows, "id long, document_id long, category string, payload string")
    records = sections.section_records(frame)
    judged = sections.routed(records, "inspections")
    assert sorted((r.place, r.source_key, r.valid) for r in judged.collect()) == [(0, "a", True), (1, "b", False), (2, None, False), (3, "c", True), (4, None, False), (6, "a", True)]
    kept = {r.source_key: (r.type, str(r.inspected_on), r.score, r.cycle_months) for r in sections.kept(judged).collect()}
    assert kept == {"a": ("MAIN", "2003-02-01", 2.5, 36), "c": (None, "None", None, None)}
    counts = {r.category: tuple(r)[1:] for r in sections.routing_counts(frame, records).collect()}
    assert counts["INSPECTIONS"] == (4, 6, 3) and counts["OTHER"] == (1, 0, 0)


def test_pairs_and_defaults_of_records(spark):
    findings = [
        {"sourceKey": "f1", "description": v("Riss 5 mm breit"), "quantity": v("3"), "stability": v(4), "status": v(None)},
        {"sourceKey": "f2", "description": v("Fleck"), "quantity": v("3"), "quantity_unit": v(None), "stability": v("7")},
        {"sourceKey": "f3", "quantity_unit": v("m²"), "status": v("noch offen")},
    ]
    observations = [{"sourceKey": "t", "observation_year": v("2001"), "daily_traffic": v("1.001"), "truck_share": v("12,5")}, {"sourceKey": "u", "observation_year": v("2001"), "observed_on": v("2002-01-01")}, {"sourceKey": "w", "daily_traffic": v(5)}]
    rows = [(1, 1, "FINDINGS_DAMAGE", json.dumps({"findings": findings})), (2, 1, "TRAFFIC_NETWORK", json.dumps({"trafficObservations": observations})), (3, 1, "IDENTITY_OVERVIEW", json.dumps({"bridge": {"latitude": v(91), "longitude": v("-7,5")}})), (4, 1, "IDENTITY_OVERVIEW", json.dumps({"bridge": None}))]
    records = sections.section_records(spark.createDataFrame(rows, "id long, document_id long, category string, payload string"))
    got = {r.source_key: (r.quantity, r.quantity_unit, r.stability, r.status) for r in sections.routed(records, "findings").collect()}
    assert got == {"f1": (3.0, "mm", 4, "OPEN"), "f2": (None, None, None, "OPEN"), "f3": (None, None, None, "OPEN")}
    got = {r.source_key: (r.heavy_daily, r.valid) for r in sections.routed(records, "observations").collect()}
    assert got == {"t": (125, True), "u": (None, False), "w": (None, False)}
    assert [(r.source_key, r.latitude, r.longitude, r.valid) for r in sections.routed(records, "bridges").collect()] == [("$bridge", None, -7.5, True)]


BOOK = "id long, document_id long, number long, text string"


def test_measures_from_pages(spark):
    one = """Maßnahmenempfehlung { 12 }
Art der Leistung  Fahrbahnübergang erneuern
Menge: 30 lfd m  Geschätzte Kosten: 20.000 EURO
Dringlichkeit Kurzfristig Zugeordnete Schäden: [28] [77] [28] Art der Leistung [9]
Masnahmenempfehlung{7} Menge: 0 Geschätzte Kosten -- [3]"""
    rows = [(1, 1, 2, "Maßnahmenempfehlung {12} Menge 99"), (2, 1, 1, one), (3, 1, 3, None), (4, 1, 4, "Massnahmenempfehlung {5}"), (5, 2, 1, "")]
    got = {r.source_key: (r.work_type, r.urgency, r.quantity, r.unit, r.cost, r.currency, r.findings, r.number) for r in sections.page_measures(spark.createDataFrame(rows, BOOK), "document_id", "number", "id", "text").collect()}
    assert got == {
        "recommendation:12": ("Fahrbahnübergang erneuern", "KURZFRISTIG", 30.0, "m", 20000.0, "EUR", ["28", "77"], 1),
        "recommendation:7": (None, None, 0.0, "Stk", None, None, ["3"], 1),
    }


def test_inspections_from_pages(spark):
    rows = [(1, 1, 1, "H3 2. Hauptprüfung 5.6.2010 36 Monate 2,3 Sonderprüfung 31.2.2011"), (2, 1, 2, "hauptprüfung vor der Abnahme 05.06.2010 72 Monate 1,0 einfache Prüfung  1.1.2012"), (3, 1, 3, None)]
    got = {r.source_key: (r.type, r.cycle_months, r.score, r.number) for r in sections.page_inspections(spark.createDataFrame(rows, BOOK), "document_id", "number", "id", "text").collect()}
    assert got["inspection:2010-06-05:MAIN"] == ("MAIN", 36, 2.3, 1)
    assert got["inspection:31.2.2011:SPECIAL"] == ("SPECIAL", None, None, 1)
    assert set(got) == {"inspection:2010-06-05:MAIN", "inspection:31.2.2011:SPECIAL", "inspection:2012-01-01:SIMPLE"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("UTM-Koordinaten Rechtswert: 382394,03 Hochwert: 5646659,71", ("UTM_ETRS89_TO_WGS84", "UTM_BLOCK", 382394.03, 5646659.71)),
        ("UTM-Koordinaten Rechtswert 5646659,71 Hochwert 382394,03", ("UTM_ETRS89_TO_WGS84", "UTM_BLOCK", 382394.03, 5646659.71)),
        ("Gauß-Krüger-Koordinaten Hochwert 5650321 Rechtswert 2578123", ("GAUSS_KRUEGER_DHDN_TO_WGS84", "GK_BLOCK", 2578123.0, 5650321.0)),
        ("Gauß-Krüger-Koordinaten Rechtswert 2578123 Hochwert 5650321 UTM-Koordinaten Rechtswert 400000 Hochwert 5600000", ("UTM_ETRS89_TO_WGS84", "UTM_BLOCK", 400000.0, 5600000.0)),
        ("UTM-Koordinaten Rechtswert 1 Rechtswert 400000 Hochwert 5600000 Hochwert 2", ("UTM_ETRS89_TO_WGS84", "UTM_BLOCK", 400000.0, 5600000.0)),
        ("UTM-Koordinaten Rechtswert 1 Hochwert 2 Rechtswert 400000 Hochwert 5600000", ("UTM_ETRS89_TO_WGS84", "UTM_BLOCK", 400000.0, 5600000.0)),
        ("GIS-Koordinaten Hochwert 5.600.000,5 und Rechtswert 400.000,5", ("UTM_ETRS89_TO_WGS84", "HEADING", 400000.5, 5600000.5)),
        ("UTM-Koordinaten Gesamtlänge Rechtswert 3400000 Hochwert 5600000", ("GAUSS_KRUEGER_DHDN_TO_WGS84", "HEADING", 3400000.0, 5600000.0)),
        ("Rechtswert 400000 Hochwert 5600000", (None, None, None, None)),
        ("UTM-Koordinaten Rechtswert 400000", (None, None, None, None)),
        (None, (None, None, None, None)),
    ],
)
def test_coordinate_pairs(spark, text, want):
    row = sections.located(sections.coordinate_pairs(spark.createDataFrame([(1, text)], "id long, text string"), "text")).first()
    assert (row.method, row.place, row.east, row.north) == want
    assert (row.latitude is None) == (want[0] is None)
    if row.east == 382394.03:
        assert 50.9 < row.latitude < 51.1 and 7.1 < row.longitude < 7.5
