from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetops.operators.logs import parse_log_lines, parse_run_logs, run_outcomes, segment_runs
from fleetops.sources.text import ingest_conf, read_lines, read_log_lines
from fleetops.streaming.follow import follow_logs, progress_folder
from tests.helpers import plan, sorted_rows, table

SCHEMA = "run_id BIGINT, seq BIGINT, line STRING"
AT = datetime(2024, 1, 31, 10, 20, 30)


def parsed(spark, line):
    row = parse_run_logs(table(spark, SCHEMA, (1, 1, line))).collect()[0]
    return row.ts, row.level, row.msg, row.bad


def test_layouts(spark):
    assert parsed(spark, "2024-01-31 10:20:30 - [WARNING] a ] b - c") == (AT, "WARNING", "a ] b - c", False)
    assert parsed(spark, "[INFO] 2024-01-31 10:20:30 - [x] y") == (AT, "INFO", "[x] y", False)


def test_colours_are_removed(spark):
    line = "\x1b[0;34m[SUCCESS]\x1b[0m 2024-01-31 10:20:30 - done"
    assert parsed(spark, line) == (AT, "SUCCESS", "done", False)


@pytest.mark.parametrize(
    "line",
    [
        "free text",
        "",
        "2024-01-31 10:20:30 - [DEBUG] x",
        "2024-13-31 10:20:30 - [INFO] x",
        " 2024-01-31 10:20:30 - [INFO] x",
        "2024-01-31 10:20:30 [INFO] x",
    ],
)
def test_bad_lines_are_kept_whole(spark, line):
    assert parsed(spark, line) == (None, None, line, True)


def outcome(spark, *messages):
    lines = [(1, i, m if m.startswith("!") else f"2024-01-31 10:20:30 - [INFO] {m}") for i, m in enumerate(messages)]
    row = run_outcomes(parse_run_logs(table(spark, SCHEMA, *lines))).collect()[0]
    return row.outcome, row.exit_code


def test_outcomes(spark):
    success = "Apache domain configuration completed successfully!"
    failed = "Script failed with exit code: 3"
    assert outcome(spark, "x") == ("unknown", None)
    assert outcome(spark, "x", success) == ("success", None)
    assert outcome(spark, "Already running the latest version (9.1-1)", success) == ("no-op", None)
    assert outcome(spark, "Upgrade cancelled by user", "Already running version 9") == ("cancelled", None)
    assert outcome(spark, failed, "Installation cancelled by user") == ("failed", 3)
    assert outcome(spark, failed, "Script failed with exit code: 5") == ("failed", 5)
    assert outcome(spark, "An error occurred during installation") == ("failed", 1)
    assert outcome(spark, failed, "Rollback completed successfully") == ("rolled_back", 3)
    assert outcome(spark, "!Script failed with exit code: 3", "Rollback completion pending") == ("unknown", None)
    assert outcome(spark, "Backup completed successfully") == ("unknown", None)


def write_logs(folder):
    folder.mkdir(exist_ok=True)
    coloured = "\x1b[0;31m[ERROR]\x1b[0m 2024-01-31 10:20:30 - two\n"
    (folder / "a.log").write_text("2024-01-31 10:20:30 - [INFO] one\r\nnoise\n" + coloured)
    (folder / "b.log").write_text("[INFO] 2024-01-31 10:20:30 - three\n")
    (folder / "c.txt").write_text("[INFO] 2024-01-31 10:20:30 - not a log\n")


def test_following_equals_batch_and_takes_files_once(spark, tmp_path):
    logs, out, progress = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "progress")
    write_logs(logs)
    follow_logs(spark, str(logs), out, progress, once=True).awaitTermination(120)
    batch = parse_log_lines(read_log_lines(spark, str(logs / "*.log")), ["file"])
    columns = ["file", "ts", "level", "msg", "bad"]
    first = sorted_rows(spark.read.parquet(out), *columns)
    assert first == sorted_rows(batch, *columns)
    assert len(first) == 4

    (logs / "d.log").write_text("[SUCCESS] 2024-01-31 10:20:30 - later\n")
    follow_logs(spark, str(logs), out, progress, once=True).awaitTermination(120)
    again = sorted_rows(spark.read.parquet(out), *columns)
    assert len(again) == 5
    assert again == sorted_rows(parse_log_lines(read_log_lines(spark, str(logs / "*.log")), ["file"]), *columns)


def test_outcomes_of_log_files(spark, tmp_path):
    failed = "2024-01-31 10:20:30 - [ERROR] Script failed with exit code: 2\n"
    (tmp_path / "a.log").write_text(failed + "2024-01-31 10:20:31 - [WARNING] Rollback completed. System restored\n")
    (tmp_path / "b.log").write_text("nothing to see\n")
    parsed = parse_log_lines(read_log_lines(spark, str(tmp_path)), ["file"])
    runs = parsed.withColumnRenamed("file", "run_id").withColumn("seq", F.col("ts"))
    got = [(f.rsplit("/", 1)[-1], o, c) for f, o, c in sorted_rows(run_outcomes(runs))]
    assert got == [("a.log", "rolled_back", 2), ("b.log", "unknown", None)]


class Session:
    """As much of a session as is asked for its configuration."""

    def __init__(self, **conf):
        self.conf = conf


def test_progress_goes_to_the_shared_folder():
    named = Session(**{"spark.checkpoint.dir": "hdfs://shared/checkpoints/"})
    one, other = progress_folder(named, "s3://b/out/a/b"), progress_folder(named, "s3://b/out/a_b/")
    assert one.startswith("hdfs://shared/checkpoints/follow_logs/") and other.startswith("hdfs://shared/checkpoints/follow_logs/")
    assert one != other
    assert other == progress_folder(named, "s3://b/out/a_b")
    with pytest.raises(ValueError):
        progress_folder(Session(), "out")


def test_tables_with_like_names_both_get_all_rows(spark, tmp_path):
    logs, shared = tmp_path / "logs", Session(**{"spark.checkpoint.dir": str(tmp_path / "shared")})
    write_logs(logs)
    for out in (str(tmp_path / "a" / "b"), str(tmp_path / "a_b")):
        follow_logs(spark, str(logs), out, progress_folder(shared, out), once=True).awaitTermination(120)
        assert spark.read.parquet(out).count() == 4


def test_several_folders_are_one_stream(spark, tmp_path):
    one, two, out, progress = tmp_path / "one", tmp_path / "two", str(tmp_path / "out"), str(tmp_path / "progress")
    write_logs(one)
    two.mkdir()
    (two / "e.log").write_text("[INFO] 2024-01-31 10:20:30 - elsewhere\n")
    sources = [str(two), str(one)]
    follow_logs(spark, sources, out, progress, once=True, files_per_batch=1).awaitTermination(120)
    assert spark.read.parquet(out).count() == 5
    (two / "f.log").write_text("[INFO] 2024-01-31 10:20:30 - more\n")
    follow_logs(spark, sources[::-1], out, progress, once=True).awaitTermination(120)
    assert spark.read.parquet(out).count() == 6
    with pytest.raises(ValueError, match="already followed"):
        follow_logs(spark, str(one), out, progress, once=True)
    with pytest.raises(ValueError, match="already followed"):
        follow_logs(spark, sources, out, str(tmp_path / "other"), once=True)


def test_file_readers(spark, tmp_path):
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "open.log").write_bytes(b"one\r\ntwo")
    (tmp_path / "closed.log").write_bytes(b"one\n\n")
    (tmp_path / "bad.log").write_bytes(b"caf\xe9 \xff\n")
    (tmp_path / "deep").mkdir()
    for i in range(30):
        (tmp_path / "deep" / f"{i}.log").write_text(f"K={i}\n")
    name = lambda f: f.rsplit("/", 1)[-1]
    got = [(name(f), n, t) for f, n, t in sorted_rows(read_lines(spark, str(tmp_path), "*.log")) if "deep" not in f]
    assert [r for r in got if r[0] == "open.log"] == [("open.log", 1, "one"), ("open.log", 2, "two")]
    assert [r for r in got if r[0] == "closed.log"] == [("closed.log", 1, "one"), ("closed.log", 2, "")]
    assert [r[1] for r in got if r[0] == "bad.log"] == [1]
    conf = ingest_conf(spark, str(tmp_path / "deep"), "*.log")
    assert sorted(int(r["value"]) for r in conf.collect()) == list(range(30))
    assert read_log_lines(spark, str(tmp_path / "deep")).count() == 30


def appended(*messages):
    return [f"2024-01-31 10:20:30 - [INFO] {m}" for m in messages]


def test_runs_within_one_log(spark):
    begin = ["Starting installation script...", "Temporary log file: /tmp/x"]
    texts = appended("left over", *begin, "work", "Script failed with exit code: 4", *begin, "Installation completed successfully!")
    texts += ["\x1b[0;34m[INFO]\x1b[0m 2024-01-31 10:20:30 - Starting Apache domain configuration...", "Temporary log file: noise"]
    given = table(spark, "file_id STRING, line_no BIGINT, line STRING", *[("a", i + 1, t) for i, t in enumerate(texts)], (None, 1, None))
    for block in (1, 2, 3, 65536):
        found = segment_runs(given, block_lines=block)
        got = {(f, n): (r, s) for f, r, s, _, n, _ in sorted_rows(found)}
        assert [got[("a", i)][0] for i in range(1, 11)] == [0, 1, 1, 1, 1, 2, 2, 2, 3, 3]
        assert [got[("a", i)][1] for i in range(1, 11)] == [None, 2, 2, 2, 2, 6, 6, 6, 9, 9]
        assert got[(None, 1)] == (0, None)
        ended = run_outcomes(parse_run_logs(found.withColumnRenamed("line_no", "seq")))
        assert sorted_rows(ended) == [("#0", "unknown", None), ("a#0", "unknown", None), ("a#1", "failed", 4), ("a#2", "success", None), ("a#3", "unknown", None)]


def test_a_log_with_a_third_of_all_lines_is_spread(spark):
    rows = spark.range(9000).selectExpr(
        "IF(id % 3 = 0, 'hot', 'f' || id % 30) AS file_id",
        "id AS line_no",
        "IF(id % 500 = 3, '2024-01-31 10:20:30 - [INFO] Temporary log file: x', 'text') AS line",
    )
    found = segment_runs(rows, block_lines=100)
    starts = [i - 1 for i in range(9000) if i % 500 == 3 and i % 3 == 0]
    for row in found.filter("file_id = 'hot'").collect():
        assert row.run_no == sum(s <= row.line_no for s in starts)
    text = plan(found)
    # The window over lines is dealt by file and block; only the one over blocks by file alone.
    assert text.count("hashpartitioning(file_id") >= 2 and "SinglePartition" not in text


def test_empty_log_has_no_runs(spark):
    given = table(spark, "file_id STRING, line_no BIGINT, line STRING", ("a", 1, "x")).limit(0)
    assert sorted_rows(segment_runs(given)) == []
