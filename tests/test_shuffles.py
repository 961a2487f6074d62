"""How often the plans of joins over findings shuffle, when no side is small enough to be broadcast."""

import re

import pytest

from girderlake.plans.queries import QUERIES
from girderlake.sources.relations import Relations


@pytest.mark.parametrize(("name", "most"), [("finding_context", 8), ("evidence_chain", 11)])
def test_findings_are_not_shuffled_for_every_join(spark, name, most):
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most
    finally:
        spark.conf.unset(key)


def test_identities_come_down_within_documents(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        plan = QUERIES["identity_tree"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(key)
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert dealt and not [d for d in dealt if re.search("source_key|parent_key|finding_key|base|identity", d)]


@pytest.mark.parametrize("name", ["recommendation_links", "search_findings", "evidence_facts", "told_identities", "completed_bridges"])
def test_large_joins_are_dealt_by_size(spark, name):
    """Spark doesn't merge tasks of a dealing by number, so none grows with the tables."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        assert "REPARTITION_BY_NUM" in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", ["finding_health", "data_health", "document_overview", "overview_counts"])
def test_health_stays_where_it_was_dealt(spark, name):
    """Findings go by inspection and what is counted by structure by structure: nothing is dealt by a finding's id, nor parts for their DISTINCT."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(key)
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert "REPARTITION_BY_NUM" in plan and dealt
    assert not [d for d in dealt if re.search(r", \w+#", d)]  # each by one column
    assert plan.count("l_returnflag") and len(re.findall(r"Exchange hashpartitioning\(l_orderkey", plan)) == 2  # all findings once, and those that cite other evidence


@pytest.mark.parametrize("name", ["finding_health", "data_health", "document_overview", "overview_counts"])
def test_health_stays_where_it_was_dealt_beside_broadcasts(spark, name):
    """Where orders are small enough to be broadcast, findings that come dealt by inspection aren't dealt again by id."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert "REPARTITION_BY_NUM" in plan and not [d for d in dealt if re.search(r"(?:^|, )id#", d)]


def test_overview_takes_runs_as_dealt_for_health(spark):
    """Runs and processing lie by document, as indicators read them: ranking them deals nothing anew."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        plan = QUERIES["overview_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(key)
    assert "Exchange hashpartitioning(document_id" not in plan


def _shuffled_rows(spark):
    """By stage run so far, the rows that it wrote to shuffles."""
    context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    context.listenerBus().waitUntilEmpty(30_000)
    no_quantiles = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Double.TYPE, 0)
    listed = context.statusStore().stageList(None, False, False, no_quantiles, None)
    return {s.stageId(): s.shuffleWriteRecords() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(listed)}


def test_overview_moves_findings_once(spark):
    """Counted as it runs: all findings are shuffled once, besides them those that cite other evidence and what is made from orders."""
    findings, orders = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").count() for name in ("lineitem", "orders"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        before = _shuffled_rows(spark)
        assert len(QUERIES["document_overview"](spark, "/root/testdata/sf0.001").collect()) == 9
        moved = sum(rows for stage, rows in _shuffled_rows(spark).items() if stage not in before)
    finally:
        spark.conf.unset(key)
    assert findings < moved < 2 * findings + 10 * orders


@pytest.mark.parametrize("name", ["admitted_findings", "rejected_findings", "admission_counts"])
@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_incoming_findings_are_dealt_before_they_are_made(spark, name, threshold):
    """Lines travel to their structure as numbers; distinct rows, copies and parents are found there, and only unique keys deal rows again."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, threshold)
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(key)
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert [d.split("#")[0] for d in dealt].count("o_custkey") == 4
    assert not [d for d in dealt if d.count("#") > 3 or "partial_structure_id" in d]


@pytest.mark.parametrize("name", ["extraction_guards", "extraction_outcomes", "surviving_entities", "released_documents"])
def test_records_of_a_document_meet_where_they_are_stored(spark, name):
    """Bound and desired records travel for no comparison: of all entities only hashes are dealt, to find those under several documents."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(key)
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert "_told" in str(dealt) and "identity_key" not in str(dealt) and "Bucketed: true" in plan


def test_survivors_are_not_dealt_for_the_deletes(spark):
    """Counted as it runs: of the records that are left none travels besides hashes; an anti join put below another had dealt them all."""
    made = Relations(spark, "/root/testdata/sf0.001").entities.count()
    lines, orders = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").count() for name in ("lineitem", "orders"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        before = _shuffled_rows(spark)
        QUERIES["surviving_entities"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        moved = sum(rows for stage, rows in _shuffled_rows(spark).items() if stage not in before)
    finally:
        spark.conf.unset(key)
    assert made < moved < made + 2 * lines + 8 * orders
