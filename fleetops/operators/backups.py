"""What backups exist, and what each of them holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetops.functions.text import basename, pretty_size, stamp_of

# Fixed value: backups of this whole-day age or less are kept.
KEEP_DAYS = 30


def backup_sizes(backups: DataFrame) -> DataFrame:
    """[host_id, backup_id, mtime, bytes, size] per backup, newest first."""
    return (
        backups.groupBy("host_id", "backup_id")
        .agg(F.max("mtime").alias("mtime"), F.sum("bytes").alias("bytes"))
        .withColumn("size", pretty_size(F.col("bytes")))
        .orderBy(F.desc("mtime"), F.desc("backup_id"))
    )


def backup_latest(backups: DataFrame) -> DataFrame:
    """[host_id, mtime, backup_id]: the newest backup of each host, the higher id on a tie."""
    # Both steps aggregate numbers only, and so hash; the first leaves no tie to the second.
    by_time = backups.groupBy("host_id", "mtime").agg(F.max("backup_id").alias("backup_id"))
    return by_time.groupBy("host_id").agg(
        F.max("mtime").alias("mtime"), F.max_by("backup_id", "mtime").alias("backup_id")
    )


def backup_stamps(names: DataFrame) -> DataFrame:
    """[backup_id, folder, taken]: folder name and time of backups known by their path only."""
    return names.select("backup_id", basename(F.col("name")).alias("folder"), stamp_of(F.col("name")).alias("taken"))


def backup_expired(backups: DataFrame, now: datetime, keep_days: int = KEEP_DAYS) -> DataFrame:
    """[host_id, backup_id, mtime] of backups whose age in whole days is above ``keep_days``.

    That is the same as a time at least ``keep_days + 1`` days before ``now``, a local time
    without zone. A backup is as old as its newest part, so old parts alone never expire it.
    """
    limit = (now - timedelta(days=keep_days + 1)).strftime("%Y-%m-%d %H:%M:%S.%f")
    newest = backups.groupBy("host_id", "backup_id").agg(F.max("mtime").alias("mtime"))
    return newest.filter(F.col("mtime") <= F.lit(limit).cast("timestamp_ntz"))


def prune_plan(backups: DataFrame, in_use: DataFrame, now: datetime, keep_days: int = KEEP_DAYS) -> DataFrame:
    """[host_id, backup_id, mtime, action]: what is to become of every expired backup.

    ``delete``, but ``keep_newest`` for a host's newest backup, however old, and ``keep_in_use`` for those that ``in_use``
    [host_id, backup_id] names. The plan is a table of its own: deleting by it again deletes the same.
    """
    expired = backup_expired(backups, now, keep_days)
    newest = backup_latest(backups).select("host_id", "backup_id", F.lit(True).alias("_newest"))
    used = in_use.select("host_id", "backup_id").distinct().withColumn("_used", F.lit(True))
    planned = expired.join(newest, ["host_id", "backup_id"], "left").join(used, ["host_id", "backup_id"], "left")
    action = F.when(F.col("_newest"), "keep_newest").when(F.col("_used"), "keep_in_use").otherwise("delete")
    return planned.select("host_id", "backup_id", "mtime", action.alias("action"))


def manifest(
    hosts: DataFrame, parts: DataFrame, components: Sequence[str], switches: Mapping[str, str] | None = None
) -> DataFrame:
    """[host_id, component, state, files]: each part is present, missing or switched_off.

    ``hosts`` has one row per host with the boolean switch columns that ``switches`` names
    by component; a part without a switch is always wanted. ``parts`` is
    [host_id, component, files]. Both sides of the join have one row per host.
    """
    switches = dict(switches or {})
    held = parts.groupBy("host_id").agg(
        *[F.sum(F.when(F.col("component") == c, F.col("files"))).alias(f"files_{i}") for i, c in enumerate(components)]
    )
    wanted = hosts.select(
        "host_id",
        *[
            (F.coalesce(F.col(switches[c]), F.lit(False)) if c in switches else F.lit(True)).alias(f"on_{i}")
            for i, c in enumerate(components)
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("component"),
                F.when(~F.col(f"on_{i}"), "switched_off")
                .when(F.coalesce(F.col(f"files_{i}"), F.lit(0)) > 0, "present")
                .otherwise("missing")
                .alias("state"),
                F.when(F.col(f"on_{i}"), F.coalesce(F.col(f"files_{i}"), F.lit(0)))
                .otherwise(F.lit(0))
                .cast("bigint")
                .alias("files"),
            )
            for i, c in enumerate(components)
        ]
    )
    return wanted.join(held, "host_id", "left").select("host_id", F.inline(rows))
