"""The greedy fill of plans against the loop that defines it: streamed, by prefix sums, and by both."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from girderlake.operators import maintenance
from girderlake.sources.cuts import cut

ITEM = "scenario_id long, id long, priority long, work_type string, planned_year long, assigned_year long, source string, estimate decimal(16,2)"


def plans(seed, n_plans=9, n_items=45):
    """Plans of one to four years, with gaps in envelopes, missing and zero estimates, overrides in and out of the horizon."""
    r = random.Random(seed)
    scenarios, envelopes, items = [], [], []
    for s in range(n_plans):
        start, n = 2020 + s % 3, 1 + s % 4
        scenarios.append((s, start, n))
        for y in range(start - 1, start + n + 1):
            if r.random() < 0.85:
                envelopes.append((s, y, None if r.random() < 0.1 else Decimal(r.randrange(0, 60_000)) / 100))
        for i in range(0 if s == 5 else n_items):
            source = r.choice([None, None, None, "USER_OVERRIDE", "AUTO_FILL"])
            wish = r.choice([None, r.randrange(2018, 2027)])
            cost = None if r.random() < 0.1 else Decimal(r.choice([0, 1, 5000, r.randrange(0, 20_000)])) / 100
            items.append((s, i, r.randrange(3), r.choice("abc"), r.choice([None, r.randrange(2018, 2027)]), wish, source, cost))
    return scenarios, envelopes, items


def by_loop(scenarios, envelopes, items):
    out = set()
    for s, start, n in scenarios:
        years = range(start, start + n)
        room = {y: b for q, y, b in envelopes if q == s and y in years and b is not None}
        mine = [(not (source == "USER_OVERRIDE" and wish in years), -p, w, i, wish if wish in years else planned if planned in years else start, cost) for q, i, p, w, planned, wish, source, cost in items if q == s]
        for free, _, _, i, first, cost in sorted(mine, key=lambda x: x[:4]):
            year = first if not free else None if cost is None else next((y for y in years if y >= first and y in room and room[y] >= cost), None)
            if cost is not None and year in room:
                room[year] -= cost
            out.add((s, i, year, "AUTO_FILL" if free else "USER_OVERRIDE"))
    return out


@pytest.mark.parametrize("most", [10**6, 7, 0])
def test_equals_the_loop(spark, most):
    scenarios, envelopes, items = plans(most)
    frames = [spark.createDataFrame(scenarios, "scenario_id long, start_year long, n_years long"), spark.createDataFrame(items, ITEM), spark.createDataFrame(envelopes, "scenario_id long, year long, budget decimal(16,2)")]
    got = [tuple(r) for r in maintenance.auto_fill(*frames, most=most).collect()]
    assert len(got) == len(items) and set(got) == by_loop(scenarios, envelopes, items)
    assert {y is None for _, _, y, s in got if s == "AUTO_FILL"} == {True, False}


def test_no_items_and_no_plans(spark):
    none = spark.createDataFrame([], "scenario_id long, start_year long, n_years long")
    some = spark.createDataFrame([(1, 2020, 2)], none.schema)
    items, envelopes = spark.createDataFrame([], ITEM), spark.createDataFrame([], "scenario_id long, year long, budget decimal(16,2)")
    assert not maintenance.auto_fill(some, items, envelopes, most=0).collect()
    assert not maintenance.auto_fill(none, items, envelopes).collect()


def test_ties_of_one_order(spark):
    """Many items of one priority and work type: only ids tell them apart, and slots cut the order among them."""
    scenarios = spark.createDataFrame([(1, 2020, 2)], "scenario_id long, start_year long, n_years long")
    items = spark.range(300).select(F.lit(1).cast("long").alias("scenario_id"), "id", F.lit(1).cast("long").alias("priority"), F.lit("x").alias("work_type"), F.lit(None).cast("long").alias("planned_year"), F.lit(None).cast("long").alias("assigned_year"), F.lit(None).cast("string").alias("source"), F.lit(1).cast("decimal(16,2)").alias("estimate"))
    envelopes = spark.createDataFrame([(1, 2020, Decimal(100)), (1, 2021, Decimal(50))], "scenario_id long, year long, budget decimal(16,2)")
    rows = {r.id: r.assigned_year for r in maintenance.auto_fill(scenarios, items, envelopes, most=10).collect()}
    assert rows == {i: 2020 if i < 100 else 2021 if i < 150 else None for i in range(300)}


def test_stored_rows_know_nothing_of_the_plan_that_made_them(spark):
    rows = spark.range(5).selectExpr("id AS a", "CASE WHEN id % 2 = 0 THEN 'x' ELSE 'y' END AS b").where("a > 1 AND b = 'x'")
    kept = cut(rows.select("a", "b"))
    assert kept._jdf.queryExecution().optimizedPlan().constraints().isEmpty() and kept.count() == 2
