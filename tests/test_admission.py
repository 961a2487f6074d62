"""Rows judged before they are stored: cases written out, and what the stored folder gives back."""

import datetime
from decimal import Decimal

import duckdb
import pytest

from girderlake.plans.queries import ORACLES
from girderlake.sources import admission, schemas

NOW = datetime.datetime(2020, 1, 1)
SHAPE = "id string, structure_id string, partial_structure_id string, type string, condition_score string, cycle_months string, created_at timestamp, updated_at timestamp, received int, broken string, given string, copies int"


def incoming(spark, rows):
    """(id, part, score, cycle, received) as inspections of structure s1; columns that clash with the operator's own ride along."""
    full = [(i, "s1", part, "MAIN", score, cycle, None if received == 99 else NOW, NOW, received, "mine", "mine", 7) for i, part, score, cycle, received in rows]
    return spark.createDataFrame(full, SHAPE)


@pytest.fixture
def parts(spark):
    return {"partial_structures": spark.createDataFrame([("p1", "s1"), ("p2", "s2"), ("p1", "s1"), (None, None)], "id string, structure_id string")}


def reasons(rows):
    return sorted((r.given.split('"id":"')[1][:1] if '"id"' in r.given else "-", sorted(r.broken), r.n) for r in admission.rejected(rows).where("given IS NOT NULL").collect())


def test_each_rule_and_the_first_of_a_key(spark, parts):
    rows = incoming(spark, [("a", "p1", "2.5", "12", 1), ("a", "p1", "3.0", "12", 2), ("b", "p2", "2.0", "12", 3), ("c", "p1", "4.5", "0", 4), ("d", "p1", "viel", None, 5), (None, "p1", None, None, 6), ("e", None, None, None, 7), ("f", "p1", None, None, 99)])
    done = admission.judged(rows, "inspections", ["received"], parts).cache()
    kept = {r.id: r for r in admission.admitted(done, "inspections").collect()}
    assert set(kept) == {"a"} and kept["a"].condition_score == Decimal("2.5") and kept["a"].cycle_months == 12
    assert admission.admitted(done, "inspections").schema.simpleString() == schemas.schema("inspections").simpleString()
    assert reasons(done) == [("-", ["null_id"], 1), ("a", ["unique_id"], 1), ("b", ["no_partial_structures"], 1), ("c", ["condition_score_range", "positive_cycle_months"], 1), ("d", ["type_condition_score"], 1), ("e", ["null_partial_structure_id"], 1), ("f", ["null_created_at"], 1)]


def test_a_broken_row_leaves_its_key_to_a_later_one(spark, parts):
    rows = incoming(spark, [("a", "p1", "9.0", None, 1), ("a", "p1", "2.0", None, 2)])
    done = admission.judged(rows, "inspections", ["received"], parts)
    assert [str(r.condition_score) for r in admission.admitted(done, "inspections").collect()] == ["2.0"]


def test_repeated_rows_ties_and_rows_already_there(spark, parts):
    rows = incoming(spark, [("a", "p1", "2.0", None, 1)] * 3 + [("b", "p1", "2.0", None, 4), ("b", "p1", "3.0", None, 4), ("z", "p1", None, None, 5)])
    there = spark.createDataFrame([("z",), (None,)], "id string")
    done = admission.judged(rows, "inspections", ["received"], parts, stored=there).cache()
    assert sorted(r.id for r in admission.admitted(done, "inspections").collect()) == ["a", "b"]
    out = admission.rejected(done).select("broken", "n").collect()
    assert sorted((r.broken, r.n) for r in out) == [(["repeated_row"], 2), (["stored_id"], 1), (["unique_id"], 1)]


def test_empty_tables_and_absent_columns(spark, parts):
    none = incoming(spark, []).drop("cycle_months")
    done = admission.judged(none, "inspections", ["received"], parts)
    assert admission.admitted(done, "inspections").collect() == [] == admission.rejected(done).collect()
    some = incoming(spark, [("a", "p1", None, None, 1)]).drop("updated_at", "cycle_months")
    done = admission.judged(some, "inspections", ["received"], {"partial_structures": parts["partial_structures"].limit(0)})
    assert [sorted(r.broken) for r in admission.rejected(done).collect()] == [["no_partial_structures", "null_updated_at"]]


def test_pairs_of_recommendations(spark):
    shape = "id string, structure_id string, partial_structure_id string, quantity string, unit string, source_estimated_cost string, source_estimated_cost_currency string, target_year int, description string, created_at timestamp, updated_at timestamp"
    cases = [("a", "2", "m", "7.5", "EUR", 2000, "x"), ("b", "2", None, None, None, None, None), ("c", None, "m", None, None, None, None), ("d", None, None, "7", "eur", None, None), ("e", None, None, None, "EUR", 1500, None), ("f", "-1", "m", "-2", "EUR", None, " ")]
    rows = spark.createDataFrame([(i, "s1", "p1", q, u, c, y, t, d, NOW, NOW) for i, q, u, c, y, t, d in cases], shape)
    parents = {"partial_structures": spark.createDataFrame([("p1", "s1")], "id string, structure_id string")}
    done = admission.judged(rows, "recommendations", ["id"], parents)
    assert reasons(done) == [("b", ["quantity_unit_pair"], 1), ("c", ["quantity_unit_pair"], 1), ("d", ["estimated_cost_pair"], 1), ("e", ["estimated_cost_pair", "year_ranges"], 1), ("f", ["description_not_blank", "estimated_cost_pair", "quantity_unit_pair"], 1)]


def test_stored_in_one_folder_and_read_apart(spark, parts, tmp_path):
    rows = incoming(spark, [("a", "p1", "2.5", "12", 1), ("a", "p1", "2.5", "12", 1), ("b", "p9", "x", None, 2)])
    done = admission.judged(rows, "inspections", ["received"], parts)
    folder = str(tmp_path / "inspections")
    admission.store(done, folder, "inspections")
    back = admission.read_admitted(spark, folder, "inspections")
    assert [r.id for r in back.collect()] == ["a"] and "PartitionFilters: [isnotnull(admitted" in back._jdf.queryExecution().executedPlan().toString()
    assert sorted((sorted(r.broken), r.n) for r in admission.read_rejected(spark, folder, "inspections").collect()) == [(["no_partial_structures", "type_condition_score"], 1), (["repeated_row"], 1)]
    with pytest.raises(Exception, match="already exists"):
        admission.store(done, folder, "inspections")


def test_every_rule_occurs_in_the_data():
    duck = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "nation"):
        duck.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    seen = {(r, rule) for r, rule in duck.sql(f"SELECT relation, rule FROM ({ORACLES['admission_counts']})").fetchall()}
    rules = {"type_dimension_length", "type_stability_rating", "null_id", "null_created_at", "no_partial_structures", "no_inspections", "no_components", "unique_id", "unique_inspection_id_source_identifier", "repeated_row", *admission.RULES["findings"].checks}
    assert {x for r, x in seen if r == "findings"} == rules
    assert {x for r, x in seen if r == "traffic_observations"} >= {"type_observation_year", "type_observed_on", "null_source", "null_structure_id", "no_structures", "unique_id", *admission.RULES["traffic_observations"].checks}
    assert duck.sql(f"SELECT count(*) FROM ({ORACLES['admitted_findings']})").fetchall()[0][0] > 1000


def test_rows_are_dealt_once_for_parents_and_once_for_each_key(spark, parts):
    rows = incoming(spark, [("a", "p1", "2.0", None, 1), ("a", "p1", "2.0", None, 2), (None, None, None, None, 3)])
    done = admission.judged(rows, "inspections", ["received"], parts)
    assert done._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2
    assert sorted((sorted(r.broken), r.n) for r in admission.rejected(done).collect()) == [(["null_id", "null_partial_structure_id"], 1), (["unique_id"], 1)]


def test_rows_that_lie_by_structure_are_judged_there(spark, parts):
    rows = incoming(spark, [("a", "p1", "2.5", "12", 1), ("a", "p1", "2.5", "12", 1), ("a", "p1", "3.0", "12", 2), ("b", "p2", "2.0", "12", 3), ("c", "p1", "4.5", "0", 4), ("e", None, None, None, 7), ("f", "p1", None, None, 99)])
    near = lambda df: df.selectExpr("*", "crc32(structure_id) AS home").repartition(5, "home")
    there = {k: near(df) for k, df in parts.items()}
    done = admission.judged(near(rows), "inspections", ["received"], there, within="home", tasks=5)
    same = admission.judged(rows, "inspections", ["received"], parts)
    assert reasons(done) == reasons(same) and admission.rejected(done).count() == admission.rejected(same).count() == 6
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(home") == 2 and plan.count("Exchange ") == 3
    some = admission.judged(near(rows), "inspections", ["received"], there, within="home", tasks=5, whole=True)
    assert sorted(map(tuple, admission.admitted(some, "inspections").collect())) == sorted(map(tuple, admission.admitted(same, "inspections").collect()))
