"""What has to hold at scale: plans without costly operators, and keys that hold very many rows."""

import re

import pytest
from pyspark.sql import functions as F

from fleetops.operators import health, lines, settings, versions
from fleetops.plans.queries import QUERIES
from tests.helpers import final_plan, plan, sorted_rows, table


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_no_python_no_limit(name, spark, testdata):
    text = plan(QUERIES[name](spark, testdata))
    costly = ["CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"]
    limits = ["LocalLimit", "GlobalLimit", "CollectLimit", "TakeOrderedAndProject"]
    assert not [operator for operator in costly + limits if operator in text]
    assert "SinglePartition" not in text or name == "find_references_summary"


@pytest.mark.parametrize(
    "name",
    [
        "fleet_tuning",
        "tuned_params_long",
        "preflight_report",
        "parse_run_logs",
        "judge_checks",
        "activity_scan",
        "find_references",
        "rewrite_lines_endings",
        "rewrite_lines_delete",
        "rewrite_lines_first",
        "rewrite_lines_after",
        "rewrite_lines_last",
        "parse_conf",
    ],
)
def test_row_by_row_jobs_do_not_shuffle(name, spark, testdata):
    assert "Exchange" not in plan(QUERIES[name](spark, testdata))


def test_scans_read_only_what_is_used(spark, testdata):
    text = plan(QUERIES["fleet_tuning"](spark, testdata))
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in text
    text = plan(QUERIES["backup_inventory_latest"](spark, testdata))
    assert "o_totalprice" not in text and "o_orderpriority" not in text


HOT = 6000


def hot_lines(spark):
    """File 0 holds two thirds of all lines."""
    hot = spark.range(1, HOT + 1).selectExpr("0L AS file_id", "id AS line_no")
    cold = spark.range(HOT // 2).selectExpr("1 + id % 500 AS file_id", "1 + id div 500 AS line_no")
    text = "CASE line_no % 5 WHEN 0 THEN '#a = 1' WHEN 1 THEN '  b = 2' WHEN 2 THEN 'hit' ELSE 'text' END AS line"
    return hot.unionByName(cold).selectExpr("file_id", "line_no", text)


def largest_key(df, *keys):
    return df.groupBy(*keys).count().agg(F.max("count")).collect()[0][0]


def test_joins_of_lines_never_gather_a_file(spark, monkeypatch):
    """Every join key of a line job holds at most a block of lines, whatever the file."""
    seen = []
    import pyspark.sql.classic.dataframe as classic

    original = classic.DataFrame.join

    def spy(self, other, on=None, how=None):
        if "block" in self.columns:
            seen.append(largest_key(self, *[c for c in ("file_id", "name", "block") if c in self.columns]))
        return original(self, other, on, how)

    monkeypatch.setattr(classic.DataFrame, "join", spy)
    df = hot_lines(spark)
    settings.upsert_params(df, [("a", "9"), ("b", "8"), ("c", "7")], block_lines=100).count()
    lines.context_after(df, "hit", 9).count()
    lines.last_lines(df, 150, block_lines=100).count()
    assert len(seen) == 3
    assert max(seen) <= 100


def test_hot_file_results(spark):
    df = hot_lines(spark)
    for n in (5, 150):
        got = lines.last_lines(df, n, block_lines=100).filter("file_id = 0")
        assert [r[1] for r in sorted_rows(got)] == list(range(HOT - n + 1, HOT + 1))
    out = settings.upsert_params(df, [("a", "9"), ("b", "8")], block_lines=100)
    counts = {r.line: r["count"] for r in out.filter("file_id = 0").groupBy("line").count().collect()}
    assert counts["a = 9"] == HOT // 5
    assert counts["b = 8"] == HOT // 5
    assert out.filter("file_id = 0").count() == HOT


def test_a_busy_key_leaves_the_map_side_as_one_row(spark):
    checks = spark.range(20000).selectExpr(
        "id % 1 AS host_id", "'default_url' AS check_kind", "CAST(200 + id % 1 AS STRING) AS http_code"
    )
    df = health.health_report(checks)
    assert sorted_rows(df) == [(0, True, 0, 0)]
    text = plan(df)
    before_shuffle = text[text.index("Exchange") :]
    assert re.search(r"HashAggregate\(keys=\[[^\]]*\], functions=\[partial_count", before_shuffle)
    assert "SortAggregate" not in text


def popular_targets(spark):
    """A third of all hosts want the same version of one package, another third names no package."""
    targets = spark.range(0, 30000, 1, 8).selectExpr(
        "id AS host_id",
        "CASE id % 3 WHEN 0 THEN 'p' WHEN 1 THEN concat('q', id % 997) END AS package",
        "'8.1-1' AS installed_version",
        "if(id % 3 = 2, NULL, if(id % 2 = 0, 'latest', '9')) AS target_version",
        "'no' AS force_upgrade",
    )
    offers = spark.range(2000).selectExpr(
        "if(id % 2 = 0, 'p', concat('q', id % 997)) AS package",
        "id AS listing_rank",
        "concat(8 + id % 2, '.', id % 7, '-1') AS version",
    )
    return targets, offers


UNEVEN = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
}


@pytest.fixture
def no_broadcast(spark):
    """Joins as on large tables: none by broadcast, large partitions split."""
    before = {k: spark.conf.get(k, None) for k in UNEVEN}
    for k, v in UNEVEN.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_without_broadcast(name, spark, testdata, no_broadcast):
    text = plan(QUERIES[name](spark, testdata))
    assert "SortAggregate" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "BroadcastExchange" not in text


@pytest.mark.parametrize("name", ["installed_version", "installed_version_marked", "backed_up_version", "candidate_version"])
def test_first_hits_take_one_scan_and_one_exchange(name, spark, testdata, no_broadcast):
    text = plan(QUERIES[name](spark, testdata))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert re.search(r"WindowGroupLimit .*Partial", text)


def test_popular_targets_are_split(spark, no_broadcast):
    targets, offers = popular_targets(spark)
    df = versions.resolve_versions(targets, offers)
    assert "skew=true" in final_plan(df)
    assert df.count() == 30000
    ranks = {}
    for package, rank, version in sorted(tuple(r) for r in offers.collect()):
        ranks.setdefault(package, []).append((rank, version))
    for host, package, installed, new, _ in sorted_rows(df)[::37]:
        target = None if host % 3 == 2 else "" if host % 2 == 0 else "9"
        hits = [v for _, v in sorted(ranks.get(package, [])) if target is not None and v.startswith(target)]
        assert new == (hits[0] if hits else None)


def test_upserts_compute_file_facts_once(spark, testdata, no_broadcast):
    for name in ("upsert_params", "apply_tuning"):
        text = final_plan(QUERIES[name](spark, testdata))
        assert text.count("functions=[partial_max(line_no") <= 1


def test_building_an_upsert_starts_no_job(spark, testdata):
    group = "building"
    spark.sparkContext.setJobGroup(group, group)
    try:
        for name in ("upsert_params", "apply_tuning"):
            QUERIES[name](spark, testdata)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_aqe_splits_uneven_keys_of_plain_joins(spark, no_broadcast):
    """Joins on keys that are unique by nature rely on AQE should they ever be uneven."""
    desired = spark.range(0, 30000, 1, 8).selectExpr(
        "if(id % 3 = 0, 0, id) AS host_id", "'work_mem' AS name", "concat(id, 'MB') AS value"
    )
    reported = spark.range(2000).selectExpr("id AS host_id", "'work_mem' AS name", "concat(id, 'MB') AS value")
    df = settings.settings_lookup(reported, desired)
    assert "skew=true" in final_plan(df)
    assert df.filter("host_id = 0").select("actual").distinct().count() == 1
    assert df.count() == 30000


def test_candidates_are_never_paired_with_targets(spark):
    """The join meets one row per package and prefix, however many offers share them."""
    offers = spark.range(5000).selectExpr("'p' AS package", "id AS listing_rank", "concat('9.', id % 3, '-1') AS version")
    first = versions.first_version_by_prefix(offers)
    assert first.count() == first.select("package", "prefix").distinct().count() == 12


def test_entry(spark):
    import __spark_entry__ as entry_module

    df = entry_module.entry(spark)
    assert df.count() == 150
    assert table(spark, "a INT", (1,)).count() == 1
