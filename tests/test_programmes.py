"""Histories, chunks, plans, memberships and document contexts: cases written out."""

import datetime

import pytest

from girderlake.operators import lifecycle, maintenance, records, search
from girderlake.plans.queries import QUERIES

DAY = datetime.date


def test_history_is_in_order_with_titles(spark):
    inspections = spark.createDataFrame([(1, 7, DAY(2001, 5, 1), "MAIN", 20), (2, 7, None, None, 21), (3, 7, DAY(2001, 5, 1), "ODD", None)], "id long, structure_id long, inspected_on date, type string, tenths long")
    works = spark.createDataFrame([(4, 7, DAY(2001, 5, 1), None, None, None), (5, 7, DAY(2003, 1, 1), None, "Umbau", "Alter")], "id long, structure_id long, started_on date, ended_on date, title string, reason string")
    traffic = spark.createDataFrame([(6, 7, 2001, DAY(2001, 5, 1), 9), (7, 6, 1999, None, None)], "id long, structure_id long, observation_year long, observed_on date, daily_traffic long")
    rows = records.told_history(inspections, works, traffic).collect()
    assert [r.id for r in rows] == [7, 5, 1, 3, 4, 6, 2]
    assert [r.title for r in rows] == ["Traffic observation 1999", "Umbau", "Main inspection", None, "Historical work", "Traffic observation 2001", "Inspection"]
    assert records.told_history(inspections.limit(0), works.limit(0), traffic.limit(0)).collect() == []


def test_query_of_history_is_sorted(spark):
    rows = QUERIES["structure_history"](spark, "/root/testdata/sf0.001").collect()
    turn = {"INSPECTION": 0, "HISTORICAL_WORK": 1, "TRAFFIC_OBSERVATION": 2}
    keys = [(r.structure_id, -(r.happened_on.toordinal() if r.happened_on else 0), turn[r.kind], r.id) for r in rows]
    assert keys == sorted(keys)


def test_packed_chunks_go_over_gaps(spark):
    rows = spark.createDataFrame([("a", x) for x in (1, 2, 9, 9, 30, 31, None)] + [("b", 5), (None, 1)], "g string, n long")
    got = {(r.g, r.first, r.last, r.n) for r in records.packed_chunks(rows, "g", "n", 2).collect()}
    assert got == {("a", 1, 2, 2), ("a", 9, 30, 2), ("a", 31, 31, 1), ("b", 5, 5, 1), (None, 1, 1, 1)}
    assert records.packed_chunks(rows.limit(0), "g", "n", 2).collect() == []


def test_envelopes_of_a_new_plan(spark):
    plans = spark.createDataFrame([(1, 2020, 2, 5, "EUR"), (2, 2021, 1, 5, None), (3, 2021, 1, None, "EUR")], "scenario_id long, start_year long, n_years long, amount int, currency string")
    assert sorted(map(tuple, lifecycle.seed_envelopes(plans).collect())) == [(1, 2020, 5, "EUR"), (1, 2021, 5, "EUR"), (2, 2021, None, None), (3, 2021, None, None)]


def test_plans_by_their_last_change(spark):
    plans = spark.createDataFrame([(1,), (2,), (3,), (4,)], "scenario_id long")
    changes = spark.createDataFrame([(2, 5), (2, 9), (3, 9), (4, None)], "scenario_id long, changed_on int")
    assert [(r.scenario_id, r.updated_on) for r in lifecycle.newest_scenarios(plans, changes).collect()] == [(2, 9), (3, 9), (1, None), (4, None)]


def test_membership_is_by_intervention_and_year(spark):
    items = spark.createDataFrame([(1, 2020, 0), (2, 2020, 1), (3, None, 1)], "id long, planned_year long, included int")
    members = spark.createDataFrame([(1, 2020), (1, 2020), (2, 2021), (3, None), (9, 2020)], "intervention_id long, planning_year long")
    assert sorted((r.id, r.included) for r in maintenance.with_membership(items, members).collect()) == [(1, True), (2, False), (3, False)]


def test_planning_requests_are_checked():
    assert maintenance.PlanningRequest() == maintenance.PlanningRequest("unplanned", 1, 25)
    for bad in (dict(view="all"), dict(page=0), dict(page_size=0), dict(page_size=101)):
        with pytest.raises(ValueError):
            maintenance.PlanningRequest(**bad)
    for limit in (0, 11):
        with pytest.raises(ValueError):
            search.ranked(None, "name", limit)


def test_context_needs_every_page_of_the_newest_allowed_run(spark):
    runs = [(1, 1, 1, "EXTRACTED", 2), (2, 1, 2, "FAILED", 2), (3, 2, 1, "EXTRACTED", 2), (4, 2, 2, "EXTRACTION_PENDING", 3), (5, 3, 1, "EXTRACTED", None), (6, 4, 1, "FAILED", 1), (7, 5, 1, "EXTRACTED", 0), (8, 1, 1, "EXTRACTED", 2)]
    frame = spark.createDataFrame(runs, "id long, document_id long, created_at int, status string, page_count int")
    pages = spark.createDataFrame([(1, 2), (1, 1), (2, 1), (2, 2), (3, 1), (4, 1)], "document_id long, number int")
    got = lifecycle.extraction_contexts(frame, pages, ("EXTRACTION_PENDING", "EXTRACTED")).collect()
    assert [(r.document_id, r.run_id, r.n_pages, r.numbers) for r in got] == [(1, 8, 2, [1, 2])]
    listed = lifecycle.document_list(spark.createDataFrame([(1,), (6,)], "document_id long"), frame, pages).collect()
    assert sorted((r.document_id, r.run_id, r.run_status, r.numbers) for r in listed) == [(1, 2, "FAILED", [1, 2]), (6, None, None, None)]
