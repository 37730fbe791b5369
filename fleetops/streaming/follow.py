"""Following run logs as they arrive."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetops.operators.logs import parse_log_lines
from fleetops.streaming.growing import stream_growing_lines

# Files taken at once, from each folder; the rest waits for the next batch.
FILES_PER_BATCH = 1000

# Beside the table's files, where readers do not look: what is followed into it, and how far.
FOLLOWED = "_followed"


def stream_logs(
    spark: SparkSession, folder: str | Sequence[str], glob: str = "*.log", files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    """A stream of [file, ts, level, msg, bad] of one or more folders, parsed exactly as in batch.

    The file source takes each file once, when it appears, so growing logs are to be
    shipped in closed segments. Stateless: no watermark and nothing to keep.
    """
    texts = [
        spark.readStream.option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .text(one)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
        for one in folders(folder)
    ]
    return parse_log_lines(reduce(DataFrame.unionAll, texts), ["file"])


def stream_growing_logs(spark: SparkSession, folder: str | Sequence[str], glob: str = "*.log") -> DataFrame:
    """As ``stream_logs``, of files that are still written to: each line once, when it is whole."""
    return parse_log_lines(stream_growing_lines(spark, folders(folder), glob), ["file"])


def folders(folder: str | Sequence[str]) -> list[str]:
    return [folder] if isinstance(folder, str) else sorted(folder)


def progress_folder(spark: SparkSession, out: str) -> str:
    """Where the stream into ``out`` keeps its progress, under ``spark.checkpoint.dir``.

    One folder per table, named by a digest of its whole path, so that two streams never
    share their progress.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("give a checkpoint folder, or set spark.checkpoint.dir")
    return f"{shared.rstrip('/')}/follow_logs/{sha256(out.rstrip('/').encode()).hexdigest()}"


def claim(spark: SparkSession, out: str, sources: list[str], checkpoint: str, growing: bool = False) -> None:
    """Note what is followed into a table; raise if it was something else, or with other progress.

    A second stream with progress of its own would number its batches anew, and the table's
    sink skips numbers that it has seen: its rows would be lost.
    """
    note = [f"source {s.rstrip('/')}" for s in sources] + [f"progress {checkpoint.rstrip('/')}"]
    note += ["growing"] if growing else []
    path = f"{out.rstrip('/')}/{FOLLOWED}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        known = sorted(r["value"] for r in spark.read.text(path).collect())
        if known != sorted(note):
            raise ValueError(f"the table {out} is already followed into: {known}; give all its folders to one stream")
        return
    spark.createDataFrame([(n,) for n in note], "value string").coalesce(1).write.text(path)


def follow_logs(
    spark: SparkSession,
    folder: str | Sequence[str],
    out: str,
    checkpoint: str | None = None,
    once: bool = False,
    every: str = "10 seconds",
    glob: str = "*.log",
    files_per_batch: int = FILES_PER_BATCH,
    growing: bool = False,
) -> StreamingQuery:
    """Append the parsed logs of one or more folders to the Parquet table ``out``, exactly once per file.

    With ``growing`` files are read on as they grow, exactly once per line; a half-written last line waits.

    Progress is kept under ``checkpoint``; by default in the shared folder the cluster
    names in ``spark.checkpoint.dir``. A table takes one stream: following another folder
    or with other progress into it raises. With ``once`` the query stops when all present
    files are taken.
    """
    checkpoint = checkpoint or progress_folder(spark, out)
    claim(spark, out, folders(folder), checkpoint, growing)
    logs = stream_growing_logs(spark, folder, glob) if growing else stream_logs(spark, folder, glob, files_per_batch)
    writer = (
        logs.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", out)
    )
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return writer.trigger(**trigger).start()
