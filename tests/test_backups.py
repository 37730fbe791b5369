from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fleetops.operators.backups import backup_expired, backup_latest, backup_sizes, manifest, prune_plan
from fleetops.operators.fingerprints import fingerprints
from fleetops.sources import storage
from tests.helpers import plan, sorted_rows, table

NOW = datetime(2024, 3, 1)
SCHEMA = "host_id BIGINT, backup_id BIGINT, mtime TIMESTAMP_NTZ, component STRING, bytes BIGINT"


def backups(spark):
    return table(
        spark,
        SCHEMA,
        (1, 1, datetime(2024, 1, 30, 0, 0, 0), "etc", 10),
        (1, 1, datetime(2024, 1, 30, 0, 0, 0), "web", 5),
        (1, 2, datetime(2024, 1, 30, 1, 0, 0), "etc", 20480),
        (1, 3, datetime(2024, 1, 30, 1, 0, 0), "etc", 1),
    )


def test_expired_after_31_full_days(spark):
    got = sorted_rows(backup_expired(backups(spark), NOW))
    assert got == [(1, 1, datetime(2024, 1, 30))]


def test_latest_and_sizes(spark):
    at = datetime(2024, 1, 30, 1)
    assert sorted_rows(backup_latest(backups(spark))) == [(1, at, 3)]
    got = [tuple(r) for r in backup_sizes(backups(spark)).collect()]
    assert got == [
        (1, 3, at, 1, "1 bytes"),
        (1, 2, at, 20480, "20 kB"),
        (1, 1, datetime(2024, 1, 30), 15, "15 bytes"),
    ]


def test_manifest(spark):
    hosts = table(spark, "host_id BIGINT, keep_web BOOLEAN", (1, True), (2, False), (3, None))
    parts = table(spark, "host_id BIGINT, component STRING, files BIGINT", (1, "etc", 2), (2, "web", 3), (9, "etc", 1))
    assert sorted_rows(manifest(hosts, parts, ["etc", "web"], {"web": "keep_web"})) == [
        (1, "etc", "present", 2),
        (1, "web", "missing", 0),
        (2, "etc", "missing", 0),
        (2, "web", "switched_off", 0),
        (3, "etc", "missing", 0),
        (3, "web", "switched_off", 0),
    ]


def test_snapshot_and_restore(spark, tmp_path):
    base, target = str(tmp_path / "base"), str(tmp_path / "target")
    at, later = datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 6)
    old = table(spark, "a BIGINT", (1,), (2,))
    storage.overwrite(old, target)
    path = storage.snapshot(spark.read.parquet(target), base, at)
    assert path.endswith("snapshot_ts=20240102_030405")
    storage.append(table(spark, "a BIGINT", (3,)), target)
    storage.snapshot(spark.read.parquet(target), base, later)
    assert spark.read.parquet(target).count() == 3

    storage.restore(spark, base, at, target)
    assert sorted_rows(spark.read.parquet(target)) == [(1,), (2,)]

    both = storage.read_snapshots(spark, base)
    assert sorted_rows(both.groupBy("snapshot_ts").count()) == [("20240102_030405", 2), ("20240102_030406", 3)]
    assert "snapshot_ts" in plan(both.filter("snapshot_ts = '20240102_030405'")).split("PartitionFilters")[1][:80]

    with pytest.raises(AnalysisException):
        storage.snapshot(old, base, at)
    with pytest.raises(AnalysisException):
        storage.restore(spark, base, datetime(2000, 1, 1), target)
    assert spark.read.parquet(target).count() == 2


def test_partitioned_snapshot(spark, tmp_path):
    base, at = str(tmp_path), datetime(2024, 1, 2)
    storage.snapshot(table(spark, "a BIGINT, part STRING", (1, "x"), (2, "y")), base, at, ["part"])
    df = storage.read_snapshot(spark, base, at)
    assert sorted_rows(df.filter("part = 'x'"), "a") == [(1,)]


def test_old_parts_do_not_expire_a_backup(spark):
    rows = [(1, 1, datetime(2020, 1, 1), "etc", 1), (1, 1, datetime(2024, 2, 29), "web", 1)]
    assert sorted_rows(backup_expired(table(spark, SCHEMA, *rows), NOW)) == []


@pytest.mark.parametrize("partition_by", [[], ["v"], ["v", "d"]])
def test_restore_keeps_types_values_and_layout(spark, tmp_path, partition_by):
    base, target, at = str(tmp_path / "backups"), str(tmp_path / "target"), datetime(2024, 1, 2)
    rows = [(1, "9.10", "2024-01-02", 1), (2, "9.1", "x", None), (3, "007", None, 2), (4, None, "2024-1-2", 3)]
    df = table(spark, "a BIGINT, v STRING, d STRING, n INT", *rows)
    storage.snapshot(df, base, at, partition_by)
    storage.overwrite(table(spark, "other INT", (1,)), target)
    storage.restore(spark, base, at, target)
    back = storage.read_table(spark, target)
    assert back.dtypes == df.dtypes
    assert sorted_rows(back) == sorted_rows(df)
    assert storage.table_layout(spark, target)[1] == partition_by
    assert bool(list((tmp_path / "target").glob("v=007"))) == bool(partition_by)


def test_an_empty_partition_value_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="an empty text"):
        storage.snapshot(table(spark, "a BIGINT, v STRING", (1, "")), str(tmp_path), datetime(2024, 1, 2), ["v"])


def test_compressed_export(spark, tmp_path):
    out = str(tmp_path / "export")
    storage.export_lines(table(spark, "line STRING", ("a",), ("b",)), out)
    assert list((tmp_path / "export").glob("*.gz"))
    assert sorted_rows(storage.import_lines(spark, out)) == [("a",), ("b",)]


def failing(df):
    return df.withColumn("a", F.when(F.col("a") > 1, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("a")))


def test_a_failed_replacement_leaves_the_old_table(spark, tmp_path):
    target = str(tmp_path / "target")
    storage.overwrite(table(spark, "a BIGINT", (1,), (2,)), target)
    with pytest.raises(Exception, match="lost"):
        storage.overwrite(failing(spark.read.parquet(target)), target)
    assert sorted_rows(storage.read_table(spark, target)) == [(1,), (2,)]
    # The next one starts afresh, and may read the table that it replaces.
    storage.overwrite(storage.read_table(spark, target).filter("a = 2"), target)
    assert sorted_rows(storage.read_table(spark, target)) == [(2,)]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["target"]


@pytest.mark.parametrize("renames", [1, 2])
def test_a_switch_that_broke_off_is_mended(spark, tmp_path, monkeypatch, renames):
    target = str(tmp_path / "target")
    storage.overwrite(table(spark, "a BIGINT", (1,)), target)
    done = []
    rename = storage._rename

    def broken(*args):
        if len(done) == renames:
            raise KeyboardInterrupt
        done.append(args)
        rename(*args)
        if len(done) == renames:
            raise KeyboardInterrupt

    monkeypatch.setattr(storage, "_rename", broken)
    with pytest.raises(KeyboardInterrupt):
        storage.overwrite(table(spark, "a BIGINT", (2,)), target)
    monkeypatch.setattr(storage, "_rename", rename)
    assert sorted_rows(storage.read_table(spark, target)) == [(2,)]
    assert storage.recover(spark, target) == "whole"
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["target"]


def test_a_switch_to_half_a_table_is_undone(spark, tmp_path):
    target = tmp_path / "target"
    storage.overwrite(table(spark, "a BIGINT", (1,)), str(target))
    target.rename(tmp_path / "_target.old")
    table(spark, "a BIGINT", (2,)).write.parquet(str(tmp_path / "_target.staged"))
    assert storage.recover(spark, str(target)) == "undone"
    assert sorted_rows(storage.read_table(spark, str(target))) == [(1,)]
    assert storage.recover(spark, str(tmp_path / "never")) == "absent"


def test_copies_are_proved(spark, tmp_path):
    base, target, at = str(tmp_path / "base"), str(tmp_path / "target"), datetime(2024, 1, 2)
    rows = [(i, "x" if i % 3 else None, f"p{i % 4}") for i in range(40)] + [(1, "x", "p1")]
    df = table(spark, "a BIGINT, b STRING, p STRING", *rows)
    storage.snapshot(df, base, at, ["p"])
    assert sorted_rows(storage.restore(spark, base, at, target)) == []
    whole = storage.read_snapshot(spark, base, at)
    storage.overwrite(whole.withColumn("b", F.expr("IF(a = 2, '', b)")), target, ["p"])
    assert sorted_rows(storage.verify_copy(spark, base, at, target)) == [("p2", "changed", 10, 10)]
    storage.overwrite(whole.unionByName(whole.filter("a = 5")).filter("p <> 'p3'"), target, ["p"])
    assert sorted_rows(storage.verify_copy(spark, base, at, target)) == [("p1", "changed", 11, 12), ("p3", "missing", 10, 0)]


def test_fingerprints_tell_rows_apart(spark):
    schema = "a STRING, b STRING, n STRUCT<x: INT, y: STRING>, z ARRAY<INT>, raw BINARY"
    rows = [("1", "", (1, None), [1, None], b"\x00"), ("1", None, (1, None), [1, None], b"\x00"), ("", "1", (1, "y"), [], None)]
    sums = {tuple(fingerprints(table(spark, schema, r)).first()) for r in rows}
    assert len(sums) == 3
    twice = table(spark, schema, rows[0], rows[0], rows[1])
    mixed = table(spark, schema, rows[1], rows[0], rows[0]).select("raw", "z", "n", "b", "a")
    assert fingerprints(twice).collect() == fingerprints(mixed).collect()
    assert fingerprints(twice.limit(0)).collect() == [] and fingerprints(twice.limit(0), ["a"]).collect() == []


def test_prune(spark, tmp_path):
    base, times = str(tmp_path), [datetime(2024, 1, d) for d in (1, 2, 3, 4)]
    for ts in times:
        storage.snapshot(table(spark, "a BIGINT", (ts.day,)), base, ts)
    for wrong in ([times[3]], [times[0], times[1]]):
        with pytest.raises(ValueError, match="newest or in use"):
            storage.prune(spark, base, wrong, in_use=[times[1]])
    assert storage.read_snapshots(spark, base).count() == 4
    plan_ = [times[0], times[2]]
    assert storage.prune(spark, base, plan_, in_use=[times[1]]) == storage.prune(spark, base, plan_, in_use=[times[1]])
    assert sorted_rows(storage.read_snapshots(spark, base), "a") == [(2,), (4,)]


def test_prune_plan(spark):
    times = [datetime(2023, 1, 1), datetime(2023, 2, 1), datetime(2023, 3, 1), datetime(2023, 4, 1)]
    rows = [(1, i, t, "etc", 1) for i, t in enumerate(times)] + [(2, 9, times[0], "etc", 1), (3, 5, datetime(2024, 2, 29), "etc", 1)]
    used = table(spark, "host_id BIGINT, backup_id BIGINT", (1, 1), (1, 1), (7, 7))
    got = [(r.host_id, r.backup_id, r.action) for r in prune_plan(table(spark, SCHEMA, *rows), used, NOW).collect()]
    assert sorted(got) == [(1, 0, "delete"), (1, 1, "keep_in_use"), (1, 2, "delete"), (1, 3, "keep_newest"), (2, 9, "keep_newest")]
