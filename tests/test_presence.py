from fleetops.operators.presence import insert_if_absent, listed_modules, missing_items, required_modules
from tests.helpers import sorted_rows, table

LINES = "file_id BIGINT, line_no BIGINT, line STRING"


def test_insert_if_absent(spark):
    lines = table(
        spark,
        LINES,
        (1, 1, "127.0.0.1 localhost a.local"),
        (2, 1, "# 127.0.0.1 b.local"),
        (2, 2, "10.0.0.1 b.local"),
        (3, 1, "127.0.0.1\tc.local.lan"),
        (4, 1, " 127.0.0.1 d.local"),
        (5, 1, "127x0.0.1 e.local"),
    )
    names = table(
        spark,
        "file_id BIGINT, domain STRING",
        (1, "a.local"),
        (2, "b.local"),
        (3, "c.local"),
        (4, "d.local"),
        (5, "e.local"),
        (6, "f.local"),
    )
    once = insert_if_absent(lines, names, block_lines=1)
    added = sorted_rows(once.exceptAll(lines))
    assert added == [
        (2, 3, "127.0.0.1    b.local"),
        (4, 2, "127.0.0.1    d.local"),
        (5, 2, "127.0.0.1    e.local"),
        (6, 1, "127.0.0.1    f.local"),
    ]
    assert sorted_rows(insert_if_absent(once, names)) == sorted_rows(once)


def test_missing_modules(spark):
    hosts = table(spark, "host_id BIGINT, ssl BOOLEAN", (1, True), (2, False), (3, None))
    loaded = table(
        spark, "host_id BIGINT, item STRING", (1, "ssl"), (1, "ssl"), (1, "headers"), (2, "rewrite"), (2, "headers")
    )
    assert sorted_rows(missing_items(required_modules(hosts), loaded)) == [
        (1, "rewrite"),
        (1, "socache_shmcb"),
        (3, "headers"),
        (3, "rewrite"),
    ]


def test_module_listing(spark):
    lines = table(
        spark, "host_id BIGINT, line STRING", (1, "Loaded Modules:"), (1, " ssl_module (shared)"), (2, "socache_shmcb_module")
    )
    assert sorted_rows(listed_modules(lines)) == [(1, "ssl"), (2, "socache_shmcb")]


def test_several_names_for_one_file(spark):
    lines = table(spark, LINES, (1, 1, "127.0.0.1 b.local"), (1, 2, "x"))
    names = table(spark, "file_id BIGINT, domain STRING", (1, "c.local"), (1, "a.local"), (1, "b.local"), (1, "c.local"))
    once = insert_if_absent(lines, names)
    added = sorted_rows(once.exceptAll(lines))
    assert added == [(1, 3, "127.0.0.1    a.local"), (1, 4, "127.0.0.1    c.local")]
    assert sorted_rows(insert_if_absent(once, names)) == sorted_rows(once)
