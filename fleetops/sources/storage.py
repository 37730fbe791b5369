"""Tables with their schema beside them, timestamped snapshots, and compressed export and import."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from fleetops.operators.fingerprints import differing, fingerprints

# Fixed value: how a snapshot's time is written in its name.
SNAPSHOT_FORMAT = "%Y%m%d_%H%M%S"

# Readers of the table pass over folders that begin with an underscore.
SCHEMA_FOLDER = "_table_schema"
FINGERPRINT_FOLDER = "_table_fingerprints"
# Says of what is beside a table or a folder of files that it is whole.
WHOLE = "_whole"


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Write ``df`` as Parquet together with its schema and layout, so that it can be read back as it was.

    Partition values are folder names, which carry no type and cannot tell an empty text from
    null; an empty text in a partition column is an error.
    """
    texts = [f.name for f in df.schema.fields if f.name in partition_by and isinstance(f.dataType, StringType)]
    checked = df.withColumns({c: _not_empty(c) for c in texts}) if texts else df
    checked.write.mode(mode).partitionBy(*partition_by).parquet(path)
    note = [("schema", df.schema.json()), *[("partition", c) for c in partition_by]]
    described = df.sparkSession.createDataFrame([(f"{kind}\t{text}",) for kind, text in note], "value string")
    described.coalesce(1).write.mode("overwrite").text(f"{path}/{SCHEMA_FOLDER}")


def _not_empty(column: str) -> Column:
    message = F.lit(f"an empty text in the partition column {column}")
    return F.when(F.col(column) == "", F.raise_error(message).cast("string")).otherwise(F.col(column))


def table_layout(spark: SparkSession, path: str) -> tuple[StructType, list[str]]:
    """Schema and partition columns that ``write_table`` noted."""
    notes = [r["value"].split("\t", 1) for r in spark.read.text(f"{path}/{SCHEMA_FOLDER}").collect()]
    schema = next(StructType.fromJson(json.loads(text)) for kind, text in notes if kind == "schema")
    return schema, [text for kind, text in notes if kind == "partition"]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_table`` with its columns in order and their types, partition columns included."""
    if not path_exists(spark, path):
        recover(spark, path)
    schema, _ = table_layout(spark, path)
    return spark.read.schema(schema).parquet(path).select(*[F.col(f"`{c}`") for c in schema.names])


def path_exists(spark: SparkSession, path: str) -> bool:
    system, place = file_system(spark, path)
    return system.exists(place)


def snapshot_name(ts: datetime) -> str:
    return ts.strftime(SNAPSHOT_FORMAT)


def snapshot_path(base: str, ts: datetime) -> str:
    return f"{base}/snapshot_ts={snapshot_name(ts)}"


def snapshot(df: DataFrame, base: str, ts: datetime, partition_by: Sequence[str] = ()) -> str:
    """Write a copy of ``df`` named by its time and return the path; an existing one is an error."""
    path = snapshot_path(base, ts)
    write_table(df, path, partition_by)
    # Of the rows as given, not of what was written: what was lost in writing is to be found.
    fingerprints(df, partition_by).write.parquet(f"{path}/{FINGERPRINT_FOLDER}")
    return path


def read_snapshot(spark: SparkSession, base: str, ts: datetime) -> DataFrame:
    return read_table(spark, snapshot_path(base, ts))


def read_snapshots(spark: SparkSession, base: str) -> DataFrame:
    """All snapshots with their ``snapshot_ts`` as text; a filter on it prunes folders.

    Columns that snapshots are partitioned by are read as the folders' names suggest; for their
    true types read one snapshot.
    """
    return (
        spark.read.option("basePath", base)
        .parquet(f"{base}/snapshot_ts=*")
        .withColumn("snapshot_ts", F.col("snapshot_ts").cast("string"))
    )


def restore(spark: SparkSession, base: str, ts: datetime, target: str, verify: bool = True) -> DataFrame | None:
    """Replace what is at ``target`` by the snapshot, in the snapshot's types and layout.

    The snapshot is resolved and written beside the target before anything is replaced, so a missing one or a job that
    fails midway changes nothing. With ``verify`` the partitions that differ from the snapshot's fingerprints are
    returned; none should.
    """
    copy = read_snapshot(spark, base, ts)
    _, partition_by = table_layout(spark, snapshot_path(base, ts))
    overwrite(copy, target, partition_by)
    return verify_copy(spark, base, ts, target) if verify else None


def verify_copy(spark: SparkSession, base: str, ts: datetime, target: str) -> DataFrame:
    """[partition columns..., state, rows_original, rows_copy] where ``target`` differs from the snapshot's fingerprints."""
    path = snapshot_path(base, ts)
    _, partition_by = table_layout(spark, path)
    noted = spark.read.parquet(f"{path}/{FINGERPRINT_FOLDER}")
    return differing(noted, fingerprints(read_table(spark, target), partition_by), partition_by)


def prune(spark: SparkSession, base: str, expired: Sequence[datetime], in_use: Sequence[datetime] = ()) -> list[str]:
    """Delete expired snapshots under ``base`` and return their names; a second call deletes what a first one left.

    The newest snapshot and those in use are refused before anything is deleted.
    """
    system, root = file_system(spark, base)
    present = sorted(f.getPath().getName().split("=", 1)[1] for f in system.globStatus(hadoop(spark, f"{base}/snapshot_ts=*")) or [])
    chosen = sorted({snapshot_name(ts) for ts in expired})
    kept = {snapshot_name(ts) for ts in in_use} | set(present[-1:])
    if refused := [name for name in chosen if name in kept]:
        raise ValueError(f"newest or in use, not deleted: {refused}")
    for name in chosen:
        # The schema goes first: a snapshot without one is not read, so half a deletion is never taken for a copy.
        for part in (f"snapshot_ts={name}/{SCHEMA_FOLDER}", f"snapshot_ts={name}"):
            system.delete(hadoop(spark, f"{base}/{part}"), True)
    return chosen


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table, also the one that ``df`` is read from.

    The new table is written whole beside the old one, then the two change places by renames. Until that, a failure leaves
    the old table; one between the two renames is mended by ``recover``, which ``overwrite`` begins with, and
    ``read_table`` where it finds no table. Meant for file systems with atomic renames. One writer at a time.
    """
    spark = df.sparkSession
    recover(spark, path)
    staged = staged_beside(path)
    write_table(df, staged, partition_by, "overwrite")
    switch(spark, path)


def staged_beside(path: str) -> str:
    """Where what is to replace ``path`` is made ready."""
    return _beside(path)[0]


def switch(spark: SparkSession, path: str) -> None:
    """Put what is whole beside ``path`` in its place, by two renames."""
    staged, old = _beside(path)
    system, target = file_system(spark, path)
    system.create(hadoop(spark, f"{staged}/{WHOLE}"), True).close()
    if system.exists(target):
        _rename(spark, path, old)
    _rename(spark, staged, path)
    system.delete(hadoop(spark, old), True)


def recover(spark: SparkSession, path: str) -> str:
    """Finish or undo a replacement that was broken off, and say which: ``whole``, ``finished``, ``undone`` or ``absent``."""
    staged, old = _beside(path)
    system, target = file_system(spark, path)
    exists = lambda p: system.exists(hadoop(spark, p))
    if system.exists(target):
        state = "whole"
    elif exists(old):
        # The old table stepped aside only once the new one was whole.
        complete = exists(f"{staged}/{WHOLE}")
        _rename(spark, staged if complete else old, path)
        state = "finished" if complete else "undone"
    else:
        return "absent"
    for left in (old, staged):
        if exists(left):
            system.delete(hadoop(spark, left), True)
    return state


def _beside(path: str) -> tuple[str, str]:
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/_{name}.staged", f"{folder}/_{name}.old"


def hadoop(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    place = hadoop(spark, path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _rename(spark: SparkSession, source: str, target: str) -> None:
    system, place = file_system(spark, source)
    if not system.rename(place, hadoop(spark, target)):
        raise OSError(f"could not rename {source} to {target}")


def export_lines(df: DataFrame, path: str, column: str = "line", compression: str = "gzip") -> None:
    """Write one text column as compressed text; reading it back needs no option. Lines in order: ``ordered.export_ordered``."""
    df.select(F.col(column).alias("value")).write.mode("error").option("compression", compression).text(path)


def import_lines(spark: SparkSession, path: str, column: str = "line") -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias(column))
