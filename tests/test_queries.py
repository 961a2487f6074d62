"""Every query of the asset relations against DuckDB, on the smallest tables."""

import duckdb
import pytest

from girderlake.plans.oracles import VIEWS
from girderlake.plans.queries import ORACLES, QUERIES
from girderlake.sources.relations import with_relations

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


def connected(folder):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return connection


@pytest.fixture(scope="module")
def duck():
    return connected(SF)


@pytest.fixture(scope="module")
def larger():
    """Of the tables that the queries are compared on besides."""
    return connected("/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == columns
        places = [want.columns.index(c) for c in columns]
        assert got == sorted(tuple(str(r[i]) for i in places) for r in want.fetchall())


def test_no_cross_join_and_pruned_scans(spark):
    for name in ("portfolio_attention", "maintenance_priority", "interval_first_match", "data_health"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
        assert "c_acctbal" not in plan and "l_tax" not in plan and "props" not in plan


def test_range_filter_reaches_the_scan(spark):
    plan = QUERIES["portfolio_page"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_rare_branches_occur(duck):
    """The data hold what the flood and urgency rules tell apart, or equal rows would show nothing."""
    count = lambda name, where: duck.sql(f"SELECT count(*) FROM ({ORACLES[name]}) WHERE {where}").fetchall()[0][0]
    assert count("portfolio_attention", "reasons LIKE '%FLOOD_EXPOSURE%'") and count("portfolio_attention", "reasons NOT LIKE '%FLOOD_EXPOSURE%'")
    assert count("maintenance_priority", "reasons LIKE '%POST_FLOOD_INSPECTION%'")
    for rank in (1, 2, 3, 4):
        assert count("headline_recommendation", f"urgency_rank = {rank}")
    assert count("scour_regex_semijoin", "true") and count("interval_antijoin", "true")
    for band in ("BELOW_TRIGGER", "MODERATE", "HIGH", "EXTREME"):
        assert count("flood_history", f"band = '{band}'")
    for kind in ("check", "scour", "repair"):
        assert count("flood_history", f"{kind}_on IS NOT NULL") and count("flood_history", f"{kind}_on IS NULL")
    for outcome in ("NOT_FOUND", "CREATED", "NOT_BUDGETED", "DELETED", "NOT_IN_TENDER"):
        assert count("package_commands", f"outcome = '{outcome}'"), outcome


def test_flood_rules_differ(larger):
    """Planning and the assessment go by the band of a peak, the portfolio by its level against the mark: the data tell them apart."""
    rows = lambda text: set(larger.sql(with_relations(text, VIEWS)).fetchall())
    by_mark, by_band = rows("SELECT structure_id FROM {q_unmatched}"), rows("SELECT structure_id FROM {q_open_flood}")
    assert by_mark - by_band and by_band - by_mark
    kinds = larger.sql(f"SELECT DISTINCT band, watch, trigger_exceeded, action IS NOT NULL FROM ({ORACLES['flood_exposure']})").fetchall()
    assert {("MODERATE", True, True, True), ("MODERATE", True, False, True), ("BELOW_TRIGGER", False, False, False)} <= set(kinds)
    reasons = {r for (text,) in larger.sql(f"SELECT reasons FROM ({ORACLES['flood_exposure']})").fetchall() for r in text.split(",")}
    assert reasons == {"NEAREST_GAUGE", "WATERCOURSE", "SCOUR_HISTORY", "FOUNDATION_TYPE", "TRIGGER_EXCEEDED", "UNMATCHED_FLOOD_EVENT"}

