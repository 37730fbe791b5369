import random

import pytest
from pyspark.sql import functions as F

from fleetops.operators import lines as L
from fleetops.sources import text
from tests.helpers import sorted_rows, table

SCHEMA = "file_id BIGINT, line_no BIGINT, line STRING"


def numbered(spark, files):
    return table(spark, SCHEMA, *[(f, i, t) for f, ts in files.items() for i, t in enumerate(ts, start=1)])


def test_references(spark):
    files = table(spark, "file STRING, text STRING", ("a", "x data\ny\ndata data"), ("b", "none"), ("c", None))
    assert sorted_rows(L.find_references(files, "data")) == [("a", 2)]
    assert sorted_rows(L.reference_summary(files, "data")) == [(1, None)]
    assert sorted_rows(L.reference_summary(files, "zzz")) == [(0, L.NO_REFERENCES)]
    assert sorted_rows(L.reference_summary(files, "da.a")) == [(0, L.NO_REFERENCES)]


def test_line_endings(spark):
    df = numbered(spark, {1: ["a\r", "b", "c\r\r", "\rd"]})
    assert [r[2] for r in sorted_rows(L.fix_line_endings(df))] == ["a", "b", "c\r", "\rd"]


def test_delete(spark):
    df = numbered(spark, {1: ["a x.local", "b", "xylocal"]})
    assert [r[2] for r in sorted_rows(L.delete_matching(df, r"x\.local"))] == ["b", "xylocal"]


def test_context_of_twenty(spark):
    df = numbered(spark, {1: ["-", "hit"] + ["-"] * 28})
    assert [r[1] for r in sorted_rows(L.context_after(df, "hit", 20))] == list(range(2, 23))


@pytest.mark.parametrize("after", [0, 1, 3, 7])
def test_context_against_brute_force(spark, after):
    rng = random.Random(after)
    files = {f: [rng.choice(["hit", "-", "-", "-", "-"]) for _ in range(rng.randrange(1, 60))] for f in range(40)}
    want = [
        (f, i + 1, t)
        for f, ts in files.items()
        for i, t in enumerate(ts)
        if "hit" in ts[max(0, i - after) : i + 1]
    ]
    assert sorted_rows(L.context_after(numbered(spark, files), "hit", after)) == want


@pytest.mark.parametrize("after", [0, 2, 5])
def test_whole_texts_give_what_line_tables_give(spark, after):
    rng = random.Random(after)
    texts = ["\n".join(rng.choice(["hit", "-", "-", "x"]) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    texts += ["", "\n", "hit", "hit\nhit\n", None]
    files = table(spark, "file_id BIGINT, text STRING", *enumerate(texts))
    rows = L.split_lines(files.filter("text IS NOT NULL"))
    assert sorted_rows(L.context_after_in_texts(files, "hit", after)) == sorted_rows(L.context_after(rows, "hit", after))
    for n in (1, 3, 100):
        assert sorted_rows(L.last_lines_of_texts(files, n)) == sorted_rows(L.last_lines(rows, n, block_lines=4))


@pytest.mark.parametrize("n", [1, 4, 100])
def test_first_and_last(spark, n):
    files = {f: [str(i) for i in range(f + 1)] for f in range(30)}
    df = numbered(spark, files)
    numbers = {f: list(enumerate(ts, start=1)) for f, ts in files.items()}
    first = [(f, i, t) for f, ts in numbers.items() for i, t in ts[:n]]
    last = [(f, i, t) for f, ts in numbers.items() for i, t in ts[-n:]]
    assert sorted_rows(L.first_lines(df, n)) == first
    assert sorted_rows(L.last_lines(df, n, block_lines=3)) == last


def test_numbers_over_splits_equal_those_of_whole_texts(spark, tmp_path):
    size = "spark.sql.files.maxPartitionBytes"
    big = "".join(f"line {i} {'x' * (i % 50)}\r\n" if i % 7 else "\n" for i in range(4000)) + "no break at the end"
    (tmp_path / "big.log").write_bytes(big.encode())
    (tmp_path / "small.log").write_bytes("one\ntwo é\n".encode())
    before = spark.conf.get(size)
    spark.conf.set(size, "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        split = text.read_numbered_lines(spark, str(tmp_path), "*.log")
        got = sorted_rows(split)
        tasks = split.filter("file_id LIKE '%big%'").select(F.spark_partition_id().alias("p")).distinct().count()
        splits = spark.read.text(str(tmp_path / "big.log")).select("_metadata.file_block_start").distinct().count()
    finally:
        spark.conf.set(size, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted_rows(text.read_lines(spark, str(tmp_path), "*.log"))
    assert splits > 10 and tasks > 1


def test_split_numbers_of_files_without_a_name(spark):
    rows = [(None, 0, 5, "a"), (None, 0, 6, "b"), (None, 9, 100, "c"), (1, 0, 0, "d")]
    given = table(spark, "file_id BIGINT, split BIGINT, at BIGINT, line STRING", *rows)
    assert sorted_rows(L.number_splits(given)) == [(None, 1, "a"), (None, 2, "b"), (None, 3, "c"), (1, 1, "d")]
