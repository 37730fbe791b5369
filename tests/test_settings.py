import random
import re

import pytest

from fleetops.operators.settings import APPEND_COMMENT, config_folders, settings_lookup, show_settings, upsert_params
from tests.helpers import sorted_rows, table

LINES = "file_id BIGINT, line_no BIGINT, line STRING"


def upserted(spark, texts, desired, **options):
    df = table(spark, LINES, *[(1, i, t) for i, t in enumerate(texts, start=1)])
    rows = sorted_rows(upsert_params(df, desired, **options))
    assert [r[1] for r in rows] == list(range(1, len(rows) + 1))
    return [r[2] for r in rows]


def test_active_lines_are_replaced_and_comments_kept(spark):
    got = upserted(spark, ["  work_mem = 1  # note", "#work_mem = 2", "work_mem=3"], [("work_mem", "9")])
    assert got == ["work_mem = 9", "#work_mem = 2", "work_mem = 9"]


def test_all_commented_lines_become_active(spark):
    got = upserted(spark, ["#work_mem = 1", "x", " #  work_mem = 2"], [("work_mem", "9")])
    assert got == ["work_mem = 9", "x", "work_mem = 9"]


def test_absent_appends_three_lines_in_order(spark):
    got = upserted(spark, ["x = 1"], [("b", "2"), ("a", "'3'")])
    assert got == ["x = 1", "", APPEND_COMMENT, "b = 2", "", APPEND_COMMENT, "a = '3'"]


def test_longer_names_and_lines_without_equals_do_not_match(spark):
    got = upserted(spark, ["maintenance_work_mem = 1", "work_mem 5", "##work_mem = 1"], [("work_mem", "9")])
    assert got[:3] == ["maintenance_work_mem = 1", "work_mem 5", "##work_mem = 1"]
    assert got[3:] == ["", APPEND_COMMENT, "work_mem = 9"]


def test_odd_values_are_written_as_they_are(spark):
    got = upserted(spark, ["a = 1"], [("a", "'it\\'s $1 \\\\ {x}'")])
    assert got == ["a = 'it\\'s $1 \\\\ {x}'"]


def test_per_file_values_and_files_without_lines(spark):
    df = table(spark, LINES, (1, 1, "a = 1"), (2, 1, "#a = 1"), (3, 1, "a = 1"))
    desired = table(
        spark, "file_id BIGINT, ord BIGINT, name STRING, value STRING", (1, 1, "a", "x"), (2, 1, "a", "y"), (4, 1, "a", "z")
    )
    assert sorted_rows(upsert_params(df, desired, ["a"])) == [
        (1, 1, "a = x"),
        (2, 1, "a = y"),
        (3, 1, "a = 1"),
        (4, 1, ""),
        (4, 2, APPEND_COMMENT),
        (4, 3, "a = z"),
    ]


@pytest.mark.parametrize("names", [[], ["a", "a"], ["a b"]])
def test_bad_names_are_refused(spark, names):
    with pytest.raises(ValueError):
        upsert_params(table(spark, LINES, (1, 1, "x")), [(n, "1") for n in names])


def test_two_hundred_names(spark):
    texts = [f"n{i} = 1" if i % 3 == 0 else f"#n{i} = 1" if i % 3 == 1 else "x" for i in range(200)]
    desired = [(f"n{i}", str(i)) for i in range(200)]
    assert upserted(spark, texts, desired) == edited(texts, desired)


def test_lines_without_a_file_are_kept(spark):
    df = table(spark, LINES, (None, 1, "a = 1"), (None, 2, "x"), (1, 1, "#a = 1"))
    got = sorted_rows(upsert_params(df, [("a", "9")]))
    assert got == [(None, 1, "a = 9"), (None, 2, "x"), (1, 1, "a = 9")]


def edited(texts, desired):
    """The rule, one setting after another on a list of lines."""
    texts = list(texts)
    for name, value in desired:
        active = re.compile(rf"\s*{name}\s*=")
        hidden = re.compile(rf"\s*#\s*{name}\s*=")
        for kind in (active, hidden):
            if any(kind.match(t) for t in texts):
                texts = [f"{name} = {value}" if kind.match(t) else t for t in texts]
                break
        else:
            texts += ["", APPEND_COMMENT, f"{name} = {value}"]
    return texts


def test_many_files_against_the_rule_with_small_blocks(spark):
    rng = random.Random(7)
    names = ["a", "b", "c_d", "d"]
    desired = [("c_d", "1"), ("a", "2"), ("b", "3")]
    files = {
        f: [
            rng.choice(["", "#", " # ", "  ", "##"]) + rng.choice(names) + rng.choice([" = ", "=", " "]) + "0"
            for _ in range(rng.choice([1, 2, 3, 40]))
        ]
        for f in range(60)
    }
    df = table(spark, LINES, *[(f, i, t) for f, ts in files.items() for i, t in enumerate(ts, start=1)])
    got = sorted_rows(upsert_params(df, desired, block_lines=3))
    want = [(f, i, t) for f, ts in files.items() for i, t in enumerate(edited(ts, desired), start=1)]
    assert got == want


def test_lookup(spark):
    settings = table(spark, "host_id BIGINT, name STRING, value STRING", (1, "a", " 1GB "), (1, "b", "2"), (2, "a", "x"))
    desired = table(spark, "host_id BIGINT, name STRING, value STRING", (1, "a", "'1GB'"), (1, "b", "3"), (3, "a", "1"))
    assert sorted_rows(settings_lookup(settings, desired)) == [
        (1, "a", "1GB", "1GB", True),
        (1, "b", "2", "3", False),
        (3, "a", None, "1", False),
    ]
    assert sorted_rows(settings_lookup(settings, desired, ["b"]), "host_id", "name") == [(1, "b")]
    assert sorted_rows(show_settings(settings, ["a"])) == [(1, "a", "1GB"), (2, "a", "x")]
    assert show_settings(settings).count() == 3


def test_config_folders(spark):
    settings = table(
        spark, "host_id BIGINT, name STRING, value STRING", (1, "config_file", " /etc/x/main/s.conf"), (1, "port", "1")
    )
    assert sorted_rows(config_folders(settings)) == [(1, "/etc/x/main")]
