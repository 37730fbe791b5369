"""Settings in configuration files and on running servers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetops.functions.blocks import BLOCK_LINES, block_of, over_blocks
from fleetops.functions.text import dirname

# Fixed value: the comment written above an appended setting.
APPEND_COMMENT = "# Added by install script for performance tuning"

# Fixed value: the setting that names the server's own configuration file.
CONFIG_FILE = "config_file"

# Names in one BIGINT of a file's bit sets; more names take more of them.
BITS = 62

# How a setting is named, and its line, active or behind one comment sign; group 1 is the name.
SETTING_NAME = r"[A-Za-z_][A-Za-z0-9_.]*"
SETTING_LINE = r"^\s*#?\s*([^\s=#]+)\s*="


def upsert_params(
    lines: DataFrame,
    desired: DataFrame | Sequence[tuple[str, str]],
    names: Sequence[str] | None = None,
    block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """Set ``name = value`` in each file: [file_id, line_no, line].

    Where a file has active lines for the name, all of them are replaced; else all its
    commented lines are; else three lines are appended, in the order given.

    ``desired`` is either a list of (name, value) for all files, or a table
    [file_id, ord, name, value] with at most one row per file and name; for a table,
    ``names`` lists the names that occur in it. Lines without a file are a file of their own.

    Lines without a wanted name never shuffle. The others meet their setting on
    (file, name, block of lines), so that no file, however long, lands in one task; what
    a file holds is found by one aggregation into bit sets, two numbers for 62 names.
    """
    fleet_wide = not isinstance(desired, DataFrame)
    names = [n for n, _ in desired] if fleet_wide else list(names or [])
    if not names or len(set(names)) != len(names):
        raise ValueError("different setting names are needed, at least one")
    if not all(re.fullmatch(SETTING_NAME, n) for n in names):
        raise ValueError("a setting name is made of letters, digits, dots and underscores")

    parsed = lines.select(
        "file_id",
        F.col("line_no").cast("bigint").alias("line_no"),
        "line",
        F.coalesce(F.regexp_extract("line", SETTING_LINE, 1), F.lit("")).alias("name"),
        F.col("line").rlike(r"^\s*#").alias("commented"),
    )
    wanted = F.col("name").isin(*names)
    # One bit per name makes a set of names a few numbers, which aggregate without objects.
    groups = [names[i : i + BITS] for i in range(0, len(names), BITS)]
    bits = [
        "CASE name " + " ".join(f"WHEN '{n}' THEN {1 << i}L" for i, n in enumerate(group)) + " ELSE 0L END"
        for group in groups
    ]
    files = parsed.groupBy("file_id").agg(
        F.max("line_no").alias("last"),
        *[F.expr(f"bit_or(if(commented, 0L, {bit}))").alias(f"active_{g}") for g, bit in enumerate(bits)],
        *[F.expr(f"bit_or(if(commented, {bit}, 0L))").alias(f"hidden_{g}") for g, bit in enumerate(bits)],
    )

    def holds(kind: str) -> str:
        return " OR ".join(f"{kind}_{g} & {bit} <> 0" for g, bit in enumerate(bits))

    if fleet_wide:
        name_at = "CASE ord " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"
        todo = files.select("*", F.posexplode(F.lit([f"{n} = {v}" for n, v in desired])).alias("ord", "new_line"))
        todo = todo.withColumn("name", F.expr(name_at))
    else:
        wanted_rows = desired.select("file_id", "ord", "name", F.concat_ws(" = ", "name", "value").alias("new_line"))
        held = files.withColumnRenamed("file_id", "held_file")
        todo = wanted_rows.join(held, F.col("file_id").eqNullSafe(F.col("held_file")), "left")
    todo = todo.selectExpr(
        "file_id",
        "ord",
        "name",
        "new_line",
        "coalesce(last, 0L) AS last",
        f"CASE WHEN {holds('active')} THEN 'active' WHEN {holds('hidden')} THEN 'commented' ELSE 'absent' END AS found",
    )

    # Joined null-safe: no filter on the file reaches one use of the facts, and all uses share them.
    changes = over_blocks(todo.filter(F.col("found") != "absent"), F.lit(1), F.col("last"), block_lines).select(
        F.col("file_id").alias("in_file"), F.col("name").alias("of"), F.col("block").alias("in_block"), "new_line", "found"
    )
    touched = (
        parsed.filter(wanted)
        .withColumn("block", block_of(F.col("line_no"), block_lines))
        .join(
            changes,
            F.col("file_id").eqNullSafe(F.col("in_file"))
            & (F.col("name") == F.col("of"))
            & (F.col("block") == F.col("in_block")),
            "left",
        )
    )
    replace = (F.col("found") == "active") & ~F.col("commented") | (F.col("found") == "commented")
    rewritten = touched.select(
        "file_id", "line_no", F.when(replace, F.col("new_line")).otherwise(F.col("line")).alias("line")
    )
    untouched = parsed.filter(~wanted).select("file_id", "line_no", "line")

    # At most one row per name is left per file, so this window is bounded.
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("ord"))
    added = (
        todo.filter(F.col("found") == "absent")
        .withColumn("start", F.col("last") + (nth - 1) * 3)
        .select("file_id", "start", F.posexplode(F.array(F.lit(""), F.lit(APPEND_COMMENT), F.col("new_line"))))
        .select("file_id", (F.col("start") + F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))
    )
    return untouched.unionByName(rewritten).unionByName(added)


def settings_lookup(settings: DataFrame, desired: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """[host_id, name, actual, desired, matches] for every desired setting, or those named.

    ``settings`` and ``desired`` are [host_id, name, value]; quotes around a desired value
    are not part of it. A setting the host does not report has a null ``actual``.
    """
    wanted = desired.select("host_id", "name", F.regexp_replace("value", "^'|'$", "").alias("desired"))
    if names is not None:
        wanted = wanted.filter(F.col("name").isin(*names))
    actual = settings.select("host_id", "name", F.trim("value").alias("actual"))
    return wanted.join(actual, ["host_id", "name"], "left").select(
        "host_id",
        "name",
        "actual",
        "desired",
        F.coalesce(F.col("actual") == F.col("desired"), F.lit(False)).alias("matches"),
    )


def show_settings(settings: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """All settings of every host, or only the named ones."""
    shown = settings.select("host_id", "name", F.trim("value").alias("value"))
    return shown if names is None else shown.filter(F.col("name").isin(*names))


def config_folders(settings: DataFrame) -> DataFrame:
    """[host_id, folder]: where each host's server reads its configuration file."""
    files = settings.filter(F.col("name") == CONFIG_FILE)
    return files.select("host_id", dirname(F.trim("value")).alias("folder"))
