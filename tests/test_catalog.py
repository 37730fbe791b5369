from datetime import datetime

from pyspark.sql import functions as F

from fleetops.functions.text import (
    basename,
    dirname,
    field,
    or_default,
    pretty_size,
    says_yes,
    stamp_of,
    stamped_name,
)
from fleetops.operators.catalog import (
    activity_scan,
    database_exists,
    database_exists_exact,
    database_size_report,
    table_size_report,
)
from tests.helpers import sorted_rows, table


def test_pretty_size(spark):
    cases = [
        (0, "0 bytes"),
        (10239, "10239 bytes"),
        (10240, "10 kB"),
        (10751, "10 kB"),
        (10752, "11 kB"),
        (16000, "16 kB"),
        (10485247, "10239 kB"),
        (10485248, "10 MB"),
        (10485759, "10 MB"),
        (10485760, "10 MB"),
        (10 * 1024**3, "10 GB"),
        (10 * 1024**4, "10 TB"),
        (2**60 + 1, "1024 PB"),
        (-16000, "-16 kB"),
        (None, None),
    ]
    df = table(spark, "n INT, b BIGINT", *[(i, b) for i, (b, _) in enumerate(cases)])
    assert sorted_rows(df.select("n", pretty_size(F.col("b")))) == [(i, t) for i, (_, t) in enumerate(cases)]


def test_table_sizes_are_ordered_by_bytes_not_by_text(spark):
    tables = table(
        spark,
        "schemaname STRING, datname STRING, tablename STRING, bytes BIGINT",
        ("public", "d", "small", 9000),
        ("public", "d", "big", 20480),
        ("public", "d", "also_big", 20480),
        ("audit", "d", "hidden", 99999999),
    )
    got = [tuple(r) for r in table_size_report(tables).collect()]
    assert got == [("also_big", "20 kB"), ("big", "20 kB"), ("small", "9000 bytes")]
    assert sorted_rows(database_size_report(tables)) == [("d", "95 MB")]


def test_activity(spark):
    df = table(spark, "a BIGINT, b STRING", (1, "x"))
    assert sorted_rows(activity_scan(df)) == [(1, "x")]


def test_database_exists(spark):
    listing = table(
        spark,
        "host_id BIGINT, line STRING",
        (1, " myappdb_old | myappdb | UTF8"),
        (2, " myappdb-x | o | UTF8"),
        (3, " myappdb | o"),
    )
    assert sorted_rows(database_exists(listing, ["myappdb"])) == [
        (1, "myappdb", False),
        (2, "myappdb", True),
        (3, "myappdb", True),
    ]
    dots = table(spark, "host_id BIGINT, line STRING", (1, " axb |"), (2, " a.b |"))
    assert sorted_rows(database_exists(dots, ["a.b"])) == [(1, "a.b", False), (2, "a.b", True)]
    wanted = table(spark, "host_id BIGINT, name STRING", (2, "myappdb"), (3, "myappdb"), (4, "myappdb"))
    assert sorted_rows(database_exists_exact(listing, wanted)) == [
        (2, "myappdb", False),
        (3, "myappdb", True),
        (4, "myappdb", False),
    ]


def test_paths_and_fields(spark):
    paths = ["/a/b/c.conf", "/a", "a", "/", "/a/b/", "a//b"]
    df = table(spark, "n INT, p STRING", *enumerate(paths))
    got = [r[1:] for r in sorted_rows(df.select("n", dirname(F.col("p")), basename(F.col("p"))))]
    assert got == [("/a/b", "c.conf"), ("/", "a"), (".", "a"), ("/", "/"), ("/a", "b"), ("a", "b")]
    line = table(spark, "l STRING", ("  one\ttwo  three ",))
    row = line.select(field(F.col("l"), 1), field(F.col("l"), 3), field(F.col("l"), 4)).collect()[0]
    assert tuple(row) == ("one", "three", None)
    empty = table(spark, "l STRING", ("",), (None,), ("x",))
    assert sorted_rows(empty.select(or_default(F.col("l"), "d"))) == [("d",), ("d",), ("x",)]


def test_stamped_names(spark):
    names = ["/b/x_20240131_102030", "x_20240131_102030/", "x_20241331_102030", "x_20240131", "x", None]
    df = table(spark, "n INT, p STRING", *enumerate(names))
    at = datetime(2024, 1, 31, 10, 20, 30)
    assert [r[1] for r in sorted_rows(df.select("n", stamp_of(F.col("p"))))] == [at, at, None, None, None, None]
    made = table(spark, "b STRING, t TIMESTAMP_NTZ", ("/b/x", at))
    assert sorted_rows(made.select(stamped_name(F.col("b"), F.col("t")))) == [("/b/x_20240131_102030",)]


def test_confirmation(spark):
    answers = table(spark, "n INT, a STRING", *enumerate(["yes", "YES", "y", "", None, "no"]))
    assert [r[1] for r in sorted_rows(answers.select("n", says_yes(F.col("a"))))] == [True, True] + [False] * 4
