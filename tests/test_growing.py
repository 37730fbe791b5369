"""Logs that grow while they are followed: every line once, whatever happens to the files."""

import pytest

from fleetops.operators.logs import parse_log_lines
from fleetops.sources.text import read_log_lines
from fleetops.streaming import growing
from fleetops.streaming.follow import follow_logs
from tests.helpers import sorted_rows

COLUMNS = ["ts", "level", "msg", "bad"]


def line(i):
    return f"2024-01-31 10:20:{i % 60:02d} - [INFO] message {i}\n"


class Followed:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        (folder / "logs").mkdir()
        self.logs, self.out, self.progress = folder / "logs", str(folder / "out"), str(folder / "progress")

    def run(self):
        query = follow_logs(self.spark, str(self.logs), self.out, self.progress, once=True, growing=True)
        assert query.awaitTermination(120)
        return [r[0] for r in sorted_rows(self.spark.read.parquet(self.out), "msg")]

    def write(self, name, text, mode="a"):
        with open(self.logs / name, mode, newline="") as file:
            file.write(text)


@pytest.fixture
def followed(spark, tmp_path):
    return Followed(spark, tmp_path)


def test_lines_of_a_growing_file_come_once_and_equal_the_batch(spark, followed):
    followed.write("a.log", line(1) + line(2) + "2024-01-31 10:20:03 - [INF")
    followed.write("b.log", "no line break yet")
    followed.write("c.txt", line(9))
    assert followed.run() == ["message 1", "message 2"]
    followed.write("a.log", "O] message 3\r\n" + line(4) + "é half")
    followed.write("d.log", line(5))
    assert followed.run() == ["message 1", "message 2", "message 3", "message 4", "message 5"]
    assert len(followed.run()) == 5
    followed.write("a.log", " and half\n")
    followed.write("b.log", "\n")
    followed.run()
    batch = parse_log_lines(read_log_lines(spark, str(followed.logs / "*.log")), ["file"])
    assert sorted_rows(spark.read.parquet(followed.out), *COLUMNS) == sorted_rows(batch, *COLUMNS)


def test_rotation_truncation_and_replacement(followed):
    followed.write("a.log", line(1) + line(2))
    followed.write("t.log", line(10) + line(11))
    followed.run()
    # Written to, rotated away and begun anew: what was left under the old name is read on.
    followed.write("a.log", line(3))
    (followed.logs / "a.log").rename(followed.logs / "a.log.1")
    followed.write("a.log", line(4))
    followed.write("t.log", line(12), "w")
    followed.write("old.log.7", line(99))
    assert followed.run() == [f"message {i}" for i in (1, 10, 11, 12, 2, 3, 4)]
    followed.write("a.log.1", line(5))
    followed.write("a.log", line(6))
    assert followed.run() == [f"message {i}" for i in (1, 10, 11, 12, 2, 3, 4, 5, 6)]


def test_progress_of_another_kind_is_refused(spark, followed):
    followed.write("a.log", line(1))
    followed.run()
    with pytest.raises(ValueError, match="already followed"):
        follow_logs(spark, str(followed.logs), followed.out, followed.progress, once=True)


@pytest.mark.parametrize("part_bytes", [1, 7, 64, 10_000])
def test_ranges_give_each_line_to_one_task(tmp_path, monkeypatch, part_bytes):
    monkeypatch.setattr(growing, "STEP", 13)
    texts = [b"", b"x", b"", b"a longer line than a step of reading", "é€".encode(), b"\r", b"end"]
    (tmp_path / "a.log").write_bytes(b"\n".join(texts) + b"\nopen")
    reader = growing.Reader([str(tmp_path)], "*.log", part_bytes)
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    got = [r for p in parts for b in reader.read(p) for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
    want, at = [], 0
    for t in texts:
        want.append((at, t.removesuffix(b"\r").decode()))
        at += len(t) + 1
    assert got == want
    assert len(parts) == -(-at // part_bytes)
    assert reader.partitions(end, end) == []


def test_a_file_rotated_after_it_was_looked_at_is_found(tmp_path):
    (tmp_path / "a.log").write_text(line(1) + line(2))
    reader = growing.Reader([str(tmp_path)], "*.log", 1000)
    parts = reader.partitions({}, reader.latestOffset())
    (tmp_path / "a.log").rename(tmp_path / "a.log.1")
    (tmp_path / "a.log").write_text("else\n")
    assert [b.num_rows for b in reader.read(parts[0])] == [2]
    (tmp_path / "a.log.1").unlink()
    with pytest.raises(OSError, match="replaced"):
        list(reader.read(parts[0]))


def test_no_files_and_no_folder(tmp_path):
    reader = growing.Reader([str(tmp_path / "absent")], "*.log", 10)
    assert reader.partitions({}, reader.latestOffset()) == []
