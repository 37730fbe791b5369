"""Run logs: parsing lines, and how each run ended."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetops.functions.blocks import BLOCK_LINES, block_of
from fleetops.functions.text import strip_ansi

# Levels, and the two layouts of a line.
#   2024-01-31 10:20:30 - [LEVEL] message
#   [LEVEL] 2024-01-31 10:20:30 - message
LEVELS = ["INFO", "SUCCESS", "WARNING", "ERROR"]
TIME_PATTERN = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
LINE_PATTERN = rf"^(?:{TIME_PATTERN} - \[(?:{'|'.join(LEVELS)})\]|\[(?:{'|'.join(LEVELS)})\] {TIME_PATTERN} -) "
TIME_LENGTH = 19

# How a run can end, from weakest to strongest evidence.
OUTCOMES = ["unknown", "success", "no-op", "cancelled", "failed", "rolled_back"]

# Messages that mark an outcome, by how they begin or end.
OUTCOME_MARKERS = {
    "rolled_back": [("startswith", "Rollback completed")],
    "failed": [
        ("startswith", "Script failed with exit code: "),
        ("startswith", "An error occurred during installation"),
    ],
    "cancelled": [
        ("startswith", "Installation cancelled by user"),
        ("startswith", "Upgrade cancelled by user"),
    ],
    "no-op": [
        ("startswith", "Already running version "),
        ("startswith", "Already running the latest version "),
    ],
    "success": [
        ("endswith", "Installation completed successfully!"),
        ("endswith", "upgrade completed successfully!"),
        ("endswith", "configuration completed successfully!"),
    ],
}
EXIT_CODE_PREFIX = "Script failed with exit code: "

# Fixed value: the exit code of a failure whose message does not state one.
PLAIN_FAILURE_CODE = 1


# Messages that a run begins with, and how many lines before them the run's first line stands.
RUN_STARTS = {
    "Temporary log file: ": 1,
    "Starting Apache domain configuration...": 0,
}


def segment_runs(lines: DataFrame, starts: Mapping[str, int] = RUN_STARTS, block_lines: int = BLOCK_LINES) -> DataFrame:
    """[file_id, run_no, run_start, run_id, line_no, line]: the runs that were appended to each log, from its lines.

    Runs are numbered from 1 by the lines that begin them; lines before the first are run 0, whose ``run_start`` is null.
    ``run_id`` names file and run. Starts are counted per block of lines, the counts are carried over a file's blocks, of
    which there are few, and only within a block lines are walked in order; a log with a third of all lines is spread over
    as many tasks as it has blocks. Lines of one number are of the same run.
    """
    numbered = lines.select("file_id", F.col("line_no").cast("bigint").alias("line_no"), "line")
    clean = strip_ansi(F.col("line"))
    back = F.lit(None).cast("bigint")
    for text, before in starts.items():
        back = F.when(clean.rlike(f"{LINE_PATTERN}{re.escape(text)}"), F.lit(before).cast("bigint")).otherwise(back)
    begun = (
        numbered.select("file_id", (F.col("line_no") - back).alias("line_no"))
        .filter(F.col("line_no").isNotNull())
        .distinct()
        .withColumn("block", block_of(F.col("line_no"), block_lines))
    )
    rows = numbered.withColumn("block", block_of(F.col("line_no"), block_lines))
    held = rows.select("file_id", "block").withColumn("_n", F.lit(0)).withColumn("_last", F.lit(None).cast("bigint"))
    per_block = held.unionByName(begun.select("file_id", "block", F.lit(1).alias("_n"), F.col("line_no").alias("_last")))
    per_block = per_block.groupBy("file_id", "block").agg(F.sum("_n").alias("_n"), F.max("_last").alias("_last"))
    before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        F.col("file_id").alias("_file"),
        F.col("block").alias("_block"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_runs"),
        F.max("_last").over(before).alias("_start"),
    )
    mark = begun.select("file_id", "line_no", F.lit(None).cast("string").alias("line"), "block", F.lit(1).alias("_begins"))
    walked = rows.withColumn("_begins", F.lit(0)).unionByName(mark)
    # Range frames take all lines of a number together, so a start counts for its own line.
    inside = Window.partitionBy("file_id", "block").orderBy("line_no").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    walked = walked.withColumn("_here", F.sum("_begins").over(inside)).withColumn(
        "_since", F.max(F.when(F.col("_begins") == 1, F.col("line_no"))).over(inside)
    )
    met = walked.filter("_begins = 0").join(carried, F.col("file_id").eqNullSafe(F.col("_file")) & (F.col("block") == F.col("_block")))
    run_no = (F.col("_runs") + F.col("_here")).cast("bigint")
    return met.select(
        "file_id",
        run_no.alias("run_no"),
        F.coalesce("_since", "_start").alias("run_start"),
        F.concat(F.coalesce(F.col("file_id").cast("string"), F.lit("")), F.lit("#"), run_no.cast("string")).alias("run_id"),
        "line_no",
        "line",
    )


def parse_log_lines(lines: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` plus [ts, level, msg, bad], from the text column ``line``.

    Lines of neither layout, or with an impossible time, are kept whole as ``msg`` and
    flagged ``bad``. Both layouts put the message behind equally many characters, so one
    pattern match per line is enough. Stateless: the same on batches and streams.
    """
    clean = lines.select(*keep, strip_ansi(F.col("line")).alias("_line"))
    level = F.substring_index(F.substring_index(F.col("_line"), "]", 1), "[", -1)
    matched = clean.withColumn("_ok", F.coalesce(F.col("_line").rlike(LINE_PATTERN), F.lit(False)))
    cut = matched.withColumn("_level", F.when(F.col("_ok"), level)).withColumn(
        "ts",
        F.when(
            F.col("_ok"),
            F.when(
                F.col("_line").startswith("["),
                F.substring(F.col("_line"), F.length("_level") + 4, F.lit(TIME_LENGTH)),
            ).otherwise(F.substring(F.col("_line"), 1, TIME_LENGTH)),
        ).try_cast("timestamp_ntz"),
    )
    bad = F.col("ts").isNull()
    message = F.expr(f"substring(_line, length(_level) + {TIME_LENGTH + 7})")
    return cut.select(
        *keep,
        "ts",
        F.when(~bad, F.col("_level")).alias("level"),
        F.when(bad, F.col("_line")).otherwise(message).alias("msg"),
        bad.alias("bad"),
    )


def parse_run_logs(lines: DataFrame) -> DataFrame:
    """[run_id, seq, ts, level, msg, bad] from [run_id, seq, line]."""
    return parse_log_lines(lines, ["run_id", "seq"])


def _rank() -> str:
    """Position in OUTCOMES of what ``msg`` marks, as SQL; 0 when it marks nothing."""
    cases = [
        f"WHEN {test}(msg, '{text}') THEN {i}"
        for i, outcome in enumerate(OUTCOMES)
        for test, text in OUTCOME_MARKERS.get(outcome, [])
    ]
    return f"CASE {' '.join(cases)} ELSE 0 END"


def run_outcomes(parsed: DataFrame) -> DataFrame:
    """[run_id, outcome, exit_code]: the strongest outcome any message of the run marks.

    ``exit_code`` is that of the last failure logged, also when a rollback followed; null
    when none was logged. Lines that could not be parsed mark nothing. The aggregates are
    plain numbers, so the map side merges a long run into one row.
    """
    failed = f"rank = {OUTCOMES.index('failed')}"
    code = f"try_cast(substring_index(msg, '{EXIT_CODE_PREFIX}', -1) AS INT)"
    marked = parsed.selectExpr("run_id", "seq", "msg", f"if(bad, 0, {_rank()}) AS rank").selectExpr(
        "run_id",
        "rank",
        f"if({failed}, coalesce({code}, {PLAIN_FAILURE_CODE}), NULL) AS code",
        f"if({failed}, seq, NULL) AS code_seq",
    )
    ended = marked.groupBy("run_id").agg(F.max("rank").alias("rank"), F.max_by("code", "code_seq").alias("exit_code"))
    names = ", ".join(f"'{o}'" for o in OUTCOMES)
    return ended.selectExpr("run_id", f"element_at(array({names}), rank + 1) AS outcome", "exit_code")
