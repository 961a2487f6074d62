"""Known values of the rules, and cases that the relations don't hold."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from girderlake.functions import dates, geo, money, pages, policies, text
from girderlake.operators import lifecycle, maintenance, portfolio, records, search


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("amount", "source", "as_of", "want"),
    [("18000.00", 2023, 2025, ("19118.77", False)), ("1.00", 2026, 2027, (None, None)), ("100.00", 1998, 2031, ("220.15", True)), ("0.01", 2015, 2016, ("0.01", False)), ("5.00", 2025, 2025, (None, None))],
)
def test_price_index(spark, amount, source, as_of, want):
    made, beyond = money.restated(F.lit(Decimal(amount)).cast("decimal(16,2)"), F.lit(source), F.lit(as_of))
    got = spark.range(1).select(made.alias("a"), beyond.alias("b")).first()
    assert (got["a"] and str(got["a"]), got["b"]) == want


@pytest.mark.parametrize(
    ("on", "months", "as_of", "want"),
    [("2025-08-14", 12, "2026-08-15", "OVERDUE"), ("2025-08-15", 12, "2026-08-15", "DUE_SOON"), ("2023-05-23", 72, "2026-08-15", "CURRENT"), ("2025-01-31", 1, "2025-03-01", "OVERDUE"), (None, 12, "2025-03-01", "UNKNOWN")],
)
def test_due_status(spark, on, months, as_of, want):
    due = dates.due_on(F.lit(on).cast("date"), F.lit(months))
    assert one(spark, dates.due_status(due, F.lit(as_of).cast("date"))) == want


def test_completed_years_counts_birthdays(spark):
    assert one(spark, dates.completed_years(F.lit("2024-02-29").cast("date"), F.lit("2025-02-28").cast("date"))) == 0
    assert one(spark, dates.completed_years(F.lit("2030-01-01").cast("date"), F.lit("2025-02-28").cast("date"))) == 0


@pytest.mark.parametrize(
    ("km", "alternatives", "daily", "heavy", "road", "points", "band"),
    [(40, 3, 3200, 200, "OTHER", 0, "LOW"), (370, 0, 54000, 8100, "AUTOBAHN", 12, "HIGH"), (95, 2, 44291, 4562, "OTHER", 4, "MEDIUM"), (410, 0, 38225, 5504, "OTHER", 8, "HIGH")],
)
def test_network_points(spark, km, alternatives, daily, heavy, road, points, band):
    score = policies.network_points(F.lit(daily), F.lit(heavy), F.lit(km), F.lit(alternatives), F.lit(road))
    assert one(spark, score) == points
    assert one(spark, policies.network_band(score)) == band


def test_heavy_vehicles_by_share(spark):
    assert one(spark, policies.heavy_vehicles(F.lit(None).cast("long"), F.lit(38225), F.lit(Decimal("14.40")))) == 5504


@pytest.mark.parametrize(("level", "want"), [(1069, "EXTREME"), (891, "HIGH"), (765, "MODERATE"), (66, "BELOW_TRIGGER")])
def test_flood_band(spark, level, want):
    assert one(spark, policies.flood_band(F.lit(level), F.lit(700), F.lit(830), F.lit(1069))) == want
    assert one(spark, policies.flood_band(F.lit(level), *[F.lit(None).cast("int")] * 3)) == "BELOW_TRIGGER"


@pytest.mark.parametrize(
    ("given", "want"),
    [("1.234,50", "1234.50"), ("1,234.50", "1234.50"), ("1.234", "1234"), ("1.50", "1.50"), ("20.000 EURO", "20000"), ("12,5 m²", "12.5"), ("ca. 7", None), ("-3", None), ("", None), (None, None), ("1,2,3", None)],
)
def test_decimals(spark, given, want):
    assert one(spark, text.decimal_text(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize(("given", "want"), [("1.5.2001", dt.date(2001, 5, 1)), ("31.02.2001", None), ("2020-02-29", dt.date(2020, 2, 29)), ("2019-02-29", None), ("Mai", None), (None, None)])
def test_dates(spark, given, want):
    assert one(spark, text.date(F.lit(given).cast("string"))) == want


def test_folding_and_words(spark):
    assert one(spark, text.contains_any(F.lit("UNTERSPÜLT"), ["unterspul"])) is True
    assert one(spark, text.contains_any(F.lit(None).cast("string"), ["x"])) is False
    assert one(spark, text.rating(F.lit(""))) == 0
    assert one(spark, text.unit_in(F.lit("3 m² Fuge"))) == "m2"


def test_search_text_is_literal_and_checked(spark):
    rows = spark.createDataFrame([(1, "A%1", "r"), (2, "A21", "r")], "id long, ext_no string, road string")
    found = search.matches(rows, "a%", ["ext_no", "road"], ["ext_no"], ["ext_no"]).collect()
    assert [(r["id"], r["match_rank"]) for r in found] == [(1, 1)]
    for bad in ("a", " " * 5, "x" * 101):
        with pytest.raises(ValueError):
            search.checked_text(bad)


def test_portfolio_query_is_checked():
    for bad in ({"page": 0}, {"page_size": 101}, {"sort": "x"}, {"built_from": 2000, "built_to": 1990}):
        with pytest.raises(ValueError):
            portfolio.PortfolioQuery(**bad)


def fill(spark, items, budgets, preserve=True):
    scenarios = spark.createDataFrame([(1, 2026, 2)], "scenario_id long, start_year long, n_years long")
    candidates = spark.createDataFrame([(1, *x) for x in items], "scenario_id long, id long, priority int, work_type string, planned_year long, assigned_year long, source string, estimate decimal(16,2)")
    envelopes = spark.createDataFrame([(1, y, b) for y, b in budgets], "scenario_id long, year long, budget decimal(16,2)")
    return {r["id"]: (r["assigned_year"], r["source"]) for r in maintenance.auto_fill(scenarios, candidates, envelopes, preserve).collect()}


def test_auto_fill(spark):
    D = Decimal
    both = [(2026, D(100)), (2027, D(100))]
    items = [(1, 4, "a", 2026, None, None, D(70)), (2, 3, "a", 2026, None, None, D(40)), (3, 2, "a", 2026, None, None, D(20))]
    assert {k: v[0] for k, v in fill(spark, items, both).items()} == {1: 2026, 2: 2027, 3: 2026}
    locked = [(1, 1, "a", 2026, 2026, "USER_OVERRIDE", D(60)), (2, 4, "a", 2026, None, None, D(50))]
    assert fill(spark, locked, both) == {1: (2026, "USER_OVERRIDE"), 2: (2027, "AUTO_FILL")}
    assert fill(spark, locked, both, preserve=False)[2] == (2026, "AUTO_FILL")
    assert fill(spark, items[:1], []) == {1: (None, "AUTO_FILL")}
    assert fill(spark, [(1, 4, "a", 2026, None, None, None)], both) == {1: (None, "AUTO_FILL")}
    # an override without a year isn't locked
    assert fill(spark, [(1, 4, "a", 2027, None, "USER_OVERRIDE", D(5))], both) == {1: (2027, "AUTO_FILL")}


def test_budget(spark):
    D = Decimal
    schema = "year long, id long, priority int, band string, extra_vehicle_tenths_km long, work_type string, included long, estimate decimal(16,2), budget decimal(16,2)"
    rows = [(1, 1, 1, None, None, "a", 1, D("0.10"), D("1.00")), (1, 2, 1, None, None, "b", 1, D("0.20"), D("1.00")), (1, 3, 1, None, None, "c", 1, None, D("1.00")), (2, 4, 1, None, None, "a", 1, D(50), D(100)), (2, 5, 3, None, None, "a", 1, D(70), D(100)), (3, 6, 3, None, None, "a", 1, D(70), None)]
    got = {r["year"]: r for r in maintenance.budget_summary(spark.createDataFrame(rows, schema), ["year"]).collect()}
    assert (got[1]["selected"], got[1]["remaining"], got[1]["n_funded"], got[1]["n_missing"], got[1]["budget_status"]) == (D("0.30"), D("0.70"), 2, 1, "WITHIN_BUDGET")
    assert (got[2]["over"], got[2]["n_funded"], got[2]["budget_status"]) == (D("20.00"), 1, "OVER_BUDGET")
    assert (got[3]["remaining"], got[3]["n_funded"], got[3]["budget_status"]) == (None, 0, "NOT_SET")


def test_finding_rows_first_wins(spark):
    pages = spark.createDataFrame([(1, "[9] S=0, V=0, D=1 x [9] S=4, V=4, D=4 [10] S=1, V=2, D=3"), (2, None), (3, "none")], "id long, t string")
    rows = sorted(tuple(r) for r in records.finding_rows(pages, "id", "t").collect())
    assert rows == [(1, 9, 0, 0, 1), (1, 10, 1, 2, 3)]


def test_fill_and_reconcile(spark):
    model = spark.createDataFrame([(1, "a", None), (2, None, None)], "k long, x string, y string")
    inferred = spark.createDataFrame([(1, "b", "c"), (3, "d", None)], "k long, x string, y string")
    assert sorted(tuple(r) for r in records.fill(model, inferred, ["k"], ["x", "y"]).collect()) == [(1, "a", "c"), (2, None, None), (3, "d", None)]
    old = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "k long, fingerprint string")
    new = spark.createDataFrame([(2, "q"), (3, "s"), (4, "t")], "k long, fingerprint string")
    assert {r["k"]: r["action"] for r in records.reconcile(old, new, ["k"]).collect()} == {1: "STALE", 2: "UNCHANGED", 3: "UPDATE", 4: "INSERT"}


def test_effective_year(spark):
    rows = spark.createDataFrame([(1, 2026, 2030, True), (2, None, 2026, True), (3, None, 2027, False), (4, 2040, 2027, True), (5, None, 2040, False)], "id long, a long, p long, has boolean").withColumns({"s": F.lit(2026), "n": F.lit(5)})
    got = {r["id"]: r["y"] for r in rows.select("id", maintenance.effective_year("a", "p", "has", "s", "n").alias("y")).collect()}
    assert got == {1: 2026, 2: None, 3: 2027, 4: 2027, 5: None}


def test_coordinates(spark):
    text_ = "5.2 UTM-Koordinaten\nHochwert: 5.646.659,71 Rechtswert: 382.394,03"
    rows = spark.createDataFrame([(1, text_), (2, "GIS-Koordinaten Rechtswert 2.578.123,50 Hochwert 5.650.321,25"), (3, None), (4, "Rechtswert 1 Hochwert 2")], "id long, t string")
    got = {r["id"]: r for r in pages.coordinates(rows, "t").collect()}
    assert 50.9 < got[1]["latitude"] < 51.1 and 7.1 < got[1]["longitude"] < 7.5
    assert 50.9 < got[2]["latitude"] < 51.1 and 7.0 < got[2]["longitude"] < 7.3
    assert got[3]["latitude"] is None and got[4]["method"] is None


def test_utm_agrees_with_the_forward_map(spark):
    import math

    # a point on the central meridian: northing is the scaled meridian arc
    a, f = geo.WGS84
    radius, _, _ = geo.series(f)
    rows = spark.createDataFrame([(500000.0, 0.9996 * a * radius * math.pi / 4)], "e double, n double")
    r = geo.utm(rows, F.col("e"), F.col("n"), F.lit(32)).first()
    assert r["longitude"] == pytest.approx(9.0, abs=1e-12)
    assert 45.1 < r["latitude"] < 45.2


def test_run_states(spark):
    log = spark.createDataFrame([(1, 1, 1, "PENDING"), (2, 1, 2, "CLASSIFYING"), (3, 1, 3, "PERSISTING"), (4, 2, 1, "EXTRACTING")], "id long, document_id long, attempt long, status string")
    assert sorted((r["id"], r["before"]) for r in lifecycle.bad_transitions(log).collect()) == [(3, "CLASSIFYING"), (4, None)]


def test_filenames_and_urls(spark):
    assert one(spark, pages.safe_filename(F.lit("C:\\x\\Brücke 7?.PDF"))) == "Brucke-7.pdf"
    assert one(spark, pages.safe_filename(F.lit("..."))) == "bauwerksbuch.pdf"
    assert one(spark, pages.page_url(F.lit("ftp://x"), F.lit(1))) is None
    assert one(spark, pages.page_url(F.lit("https://x.org/a#b"), F.lit(4))) == "https://x.org/a#page=4"


def test_funded_prefix_over_slots_is_one_running_sum(spark):
    """Against one sum in order: slots of one row and many, nulls in keys and order, ties, and a key without budget."""
    rows = []
    for i in range(300):
        year = (None, 2000, 2001)[i % 3]
        detour = None if i % 11 == 0 else (i * 7919) % 900_000
        rows.append((i, year, i % 5, ("HIGH", "MEDIUM", "LOW", None)[i % 4], detour, "ab"[i % 2], Decimal(i * 37 % 101) if i % 13 else None, i % 7 and 1, Decimal(900) if year != 2001 else None))
    items = spark.createDataFrame(rows, "id long, planned_year long, priority int, band string, extra_vehicle_tenths_km long, work_type string, estimate decimal(16,2), included int, budget decimal(16,2)")
    got = {r["id"]: (r["running"], r["funded"]) for r in maintenance.funded_prefix(items, ["planned_year"]).collect()}
    want, sums = {}, {}
    rank = {"HIGH": 3, "MEDIUM": 2, "LOW": 1, None: 0}
    for i, year, priority, band, detour, work, cost, included, budget in sorted(rows, key=lambda r: (-r[2], -rank[r[3]], -(r[4] or 0), r[5], r[0])):
        if included == 1 and cost is not None:
            sums[year] = sums.get(year, 0) + cost
            want[i] = (sums[year], budget is not None and sums[year] <= budget)
    assert got == want and any(f for _, f in want.values()) and not all(f for _, f in want.values())
