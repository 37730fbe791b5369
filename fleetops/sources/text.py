"""Text files: configurations, logs, listings and anything else made of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetops.functions.text import strip_cr
from fleetops.operators.conf import parse_conf
from fleetops.operators.lines import number_splits, split_lines


def read_texts(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """[file, text], one row per file, for the many small files whose line order matters."""
    reader = spark.read
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """[file_id, line_no, line] with line numbers, carriage returns removed."""
    texts = read_texts(spark, path, glob).withColumnRenamed("file", "file_id")
    # The line break that ends a text opens no further line.
    whole = texts.withColumn("text", F.regexp_replace("text", r"\n\z", ""))
    return split_lines(whole).withColumn("line", strip_cr(F.col("line")))


def read_numbered_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """[file_id, line_no, line] as ``read_lines``, from files of any size, each read in as many splits as Spark makes.

    A task reads a split from its start, so the rows' ids grow with the lines; counts of lines per split, found by a first
    scan, say what the numbers of each split begin with. The files must not change in between. A file without any line
    has no rows.
    """
    reader = spark.read.option("lineSep", "\n")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
        strip_cr(F.col("value")).alias("line"),
    )
    return number_splits(lines)


def read_log_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """[file, line] from logs of any size: splittable, so no line numbers."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def ingest_conf(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """[file, line_no, key, value, value_len] of the configuration files under a path."""
    return parse_conf(read_texts(spark, path, glob))
