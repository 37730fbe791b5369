import gzip
import random
import re

import pytest

from fleetops.operators.settings import upsert_params
from fleetops.sources import ordered, storage
from fleetops.sources.text import read_lines
from tests.helpers import plan, sorted_rows, table

LINES = "file_id STRING, line_no BIGINT, line STRING"
ODD = [("a b%/ü", 1, ""), ("a b%/ü", 2, "x\r"), ("a b%/ü", 3, " \t"), (None, 1, "null's"), ("", 1, "empty's"), ("007", 1, "é\x00"), ("7", 1, "")]


def shuffled(spark, rows):
    mixed = list(rows)
    random.Random(1).shuffle(mixed)
    return table(spark, LINES, *mixed).repartition(5)


def large(n):
    """One file with nearly all lines, among small ones."""
    return [("big", i, f"line {i}") for i in range(1, n + 1)] + [(f"s{i % 40}", i // 40 + 1, f"s {i}") for i in range(400)]


def test_round_trip_keeps_files_numbers_and_lines(spark, tmp_path):
    path, rows = str(tmp_path / "out"), ODD + large(20_000)
    index = ordered.export_ordered(shuffled(spark, rows), path, members=6)
    assert sorted_rows(ordered.import_ordered(spark, path)) == sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))
    of_big = sorted((r.member, r.lines, r.first_line) for r in index.filter("file_id = 'big'").collect())
    assert len(of_big) >= 4 and max(n for _, n, _ in of_big) < 8_000
    assert [first for _, _, first in of_big] == [1 + sum(n for _, n, _ in of_big[:i]) for i in range(len(of_big))]
    assert sorted_rows(ordered.damaged_members(spark, path)) == []


def test_members_joined_by_number_are_one_compressed_file(spark, tmp_path):
    path = str(tmp_path / "out")
    index = ordered.export_ordered(shuffled(spark, large(5_000)), path, members=4)
    key = index.filter("file_id = 'big'").first().file_key
    parts = sorted((tmp_path / "out" / ordered.MEMBERS / f"file_key={key}").glob("part-*.gz"))
    assert len(parts) > 1
    whole = gzip.decompress(b"".join(p.read_bytes() for p in parts)).decode()
    assert whole == "".join(f"line {i}\n" for i in range(1, 5_001))


def test_some_files_are_read_alone(spark, tmp_path):
    path = str(tmp_path / "out")
    ordered.export_ordered(shuffled(spark, ODD + large(100)), path, members=3)
    some = ordered.import_ordered(spark, path, ["s3", None, "absent"])
    assert sorted_rows(some) == [(None, 1, "null's")] + [("s3", i, f"s {(i - 1) * 40 + 3}") for i in range(1, 11)]
    scans = [p for p in plan(ordered.import_ordered(spark, path, ["s3"])).splitlines() if "FileScan text" in p]
    assert len(scans) == 2 and all(re.search(r"PartitionFilters: \[[^\]]*file_key#\d+L", p) for p in scans), scans


def test_a_member_that_lost_lines_is_found(spark, tmp_path):
    path = str(tmp_path / "out")
    index = ordered.export_ordered(shuffled(spark, large(3_000)), path, members=4)
    row = index.filter("file_id = 'big'").orderBy("member").first()
    part = next((tmp_path / "out" / ordered.MEMBERS / f"file_key={row.file_key}").glob(f"part-{row.member:05d}-*.gz"))
    text = gzip.decompress(part.read_bytes()).splitlines(keepends=True)
    part.write_bytes(gzip.compress(b"".join(text[:-2])))
    (part.parent / f".{part.name}.crc").unlink()
    assert sorted_rows(ordered.damaged_members(spark, path)) == [("big", row.member, row.lines, row.lines - 2)]


def test_empty_tables_null_lines_and_line_breaks(spark, tmp_path):
    empty = shuffled(spark, ODD).limit(0)
    assert ordered.export_ordered(empty, str(tmp_path / "a")).count() == 0
    assert ordered.import_ordered(spark, str(tmp_path / "a")).count() == 0
    ties = table(spark, LINES, ("f", 3, None), ("f", 3, "b"), ("f", 9, "c"), ("f", None, "first"))
    ordered.export_ordered(ties, str(tmp_path / "b"))
    assert sorted_rows(ordered.import_ordered(spark, str(tmp_path / "b"))) == [("f", 1, "first"), ("f", 2, ""), ("f", 3, "b"), ("f", 4, "c")]
    with pytest.raises(Exception, match="a line break within line 1"):
        ordered.export_ordered(table(spark, LINES, ("f", 1, "a\nb")), str(tmp_path / "c"))
    ordered.write_files(empty, str(tmp_path / "d"))
    assert [p.name for p in (tmp_path / "d").iterdir() if not p.name.startswith((".", "_"))] == []


def files_of(folder):
    shown = (p for p in folder.rglob("*") if p.is_file() and not p.name.startswith((".", "_")))
    return {str(p.relative_to(folder)): p.read_bytes() for p in shown}


def test_settings_are_written_back_as_files(spark, tmp_path):
    """Files in, parameters set, files out: the bytes are those of the rule applied to each file's text."""
    source, target = tmp_path / "in", tmp_path / "out dir"
    source.mkdir()
    texts = {"a.conf": "x = 1\nwork_mem = 1\n#work_mem = 2\n", "b.conf": "#work_mem = 1\n\n", "big.conf": "x = 2\n" * 5_000 + "work_mem = 3\n" + "y = 1\n" * 5_000}
    for name, text in texts.items():
        (source / name).write_text(text)
    lines = read_lines(spark, str(source)).selectExpr("element_at(split(file_id, '/'), -1) AS file_id", "line_no", "line")
    ordered.write_files(upsert_params(lines, [("work_mem", "9")], block_lines=100), str(target), members=4)
    want = {name: text.replace("work_mem = 3", "work_mem = 9").replace("\nwork_mem = 1", "\nwork_mem = 9") for name, text in texts.items()}
    want["b.conf"] = "work_mem = 9\n\n"
    assert files_of(target) == {name: text.encode() for name, text in want.items()}


def test_files_replace_files_or_leave_them(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "etc")
    ordered.write_files(shuffled(spark, [("d/a", 1, "1"), ("b c%20", 1, "2"), ("b c%20", 2, "3")]), target)
    assert files_of(tmp_path / "etc") == {"d/a": b"1\n", "b c%20": b"2\n3\n"}
    for wrong in [[(None, 1, "")], [("", 1, "")], [("/a", 1, "")], [("a/../b", 1, "")], [("a//b", 1, "")], [("a/", 1, "")]]:
        with pytest.raises(ValueError, match="not names of files"):
            ordered.write_files(shuffled(spark, wrong), target)
    with pytest.raises(Exception, match="(?i)director"):
        ordered.write_files(shuffled(spark, [("a", 1, ""), ("a/b", 1, "")]), target)
    rename, calls = storage._rename, []

    def broken(session, a, b):
        calls.append(a)
        if len(calls) == 2:
            raise KeyboardInterrupt
        rename(session, a, b)

    monkeypatch.setattr(storage, "_rename", broken)
    with pytest.raises(KeyboardInterrupt):
        ordered.write_files(shuffled(spark, [("new", 1, "n")]), target)
    monkeypatch.setattr(storage, "_rename", rename)
    assert storage.recover(spark, target) == "finished"
    assert files_of(tmp_path / "etc") == {"new": b"n\n"}
    ordered.write_files(shuffled(spark, [("newer", 1, "n")]), target)
    assert files_of(tmp_path / "etc") == {"newer": b"n\n"}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["etc"]
