"""What the operators need of a session: partitions, shared storage, Arrow tasks, and a cache in each worker process."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHECKPOINTS = "spark.checkpoint.dir"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 1000  # rows of whole texts in an Arrow batch: it is held several times, by the executor and by its worker


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: the one knob that sizes what a task holds."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, or that the context was given.

    Where neither is set, a session whose tasks all run in the driver's process has one of its own; on a cluster, whose
    executors could not read that, this raises.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINTS, None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"set {CHECKPOINTS} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder; Spark removes them as it is set to."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, so that Spark knows its size when it plans joins."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ROWS rows at most from now on, in this session; a smaller number that it has stays."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= ROWS:
        spark.conf.set(BATCH_ROWS, str(ROWS))


def give_back() -> None:
    """Memory that this process has freed goes back to the machine, where its C library can do that."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def in_arrow(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str
) -> DataFrame:
    """``mapInArrow`` whose tasks give back what they held: workers live on, and share the memory of their executor."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def free_name(taken: Iterable[str], name: str) -> str:
    """The name, led by underscores until no other column has it, whatever its case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def carried(docs: DataFrame, used: Sequence[str]) -> DataFrame:
    """The columns that a step uses and all others as one, ``own``, so that no name of the step can meet one of theirs."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*rest, *([] if rest else [F.lit(0).alias("none")])).alias("own"))


def unpacked(rows: DataFrame, columns: Sequence[str], used: Sequence[str]) -> DataFrame:
    """Rows of a ``carried`` table with the given columns again."""
    return rows.select(*[F.col(c) if c in used else F.col(f"own.`{c}`").alias(c) for c in columns])


def process_cache() -> dict:
    """A dictionary that lives as long as the worker process; tasks get their functions anew, this stays."""
    name = "_llm_process_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__
