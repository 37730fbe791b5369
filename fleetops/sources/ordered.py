"""Lines written out in order: compressed members with an index of their lines, and files in place of files."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetops.operators.lines import number_splits
from fleetops.sources.storage import file_system, hadoop, recover, staged_beside, switch

MEMBERS = "members"
INDEX = "_index"
# Bytes that are copied at a time when members are joined.
CHUNK = 1 << 23


def export_ordered(lines: DataFrame, path: str, compression: str = "gzip", members: int | None = None) -> DataFrame:
    """Write [file_id, line_no, line] as numbered compressed members of lines, and return their index.

    Lines are dealt by ranges of (file, line number) over ``members`` tasks (the session's shuffle partitions where not
    given), so a file of any size is spread over as many members as it needs, and no task holds more than its range. A
    file's members are in a folder of its own and follow each other by number: joined by number they are one valid
    compressed file. The index, [file_id, file_key, member, lines, first_line], is counted from what was written and
    kept beside it. It is written last: an export that broke off has none and is not read.

    Lines are numbered from 1 on in the order of ``line_no``; equal numbers are ordered by text. A null line is an empty
    one, a file may be named null, and a line that holds a line break is an error.
    """
    spark = lines.sparkSession
    keyed = _keyed(lines)
    _write_members(keyed, f"{path}/{MEMBERS}", compression, members)
    written = _members(spark, path).groupBy("file_key", "member").agg(F.count("*").alias("lines"))
    before = Window.partitionBy("file_key").orderBy("member").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("lines").over(before), F.lit(0)) + 1
    index = written.withColumn("first_line", first.cast("bigint")).join(_names(keyed), "file_key")
    index.select("file_id", "file_key", "member", "lines", "first_line").write.mode("error").parquet(f"{path}/{INDEX}")
    return export_index(spark, path)


def export_index(spark: SparkSession, path: str) -> DataFrame:
    """[file_id, file_key, member, lines, first_line] of an export."""
    schema = "file_id string, file_key bigint, member int, lines bigint, first_line bigint"
    return spark.read.schema(schema).parquet(f"{path}/{INDEX}")


def import_ordered(spark: SparkSession, path: str, files: Sequence[str | None] | None = None) -> DataFrame:
    """[file_id, line_no, line] of an export, or of some of its files, whose members alone are then read.

    Members are read in parallel; a line's number is its place in its member after the lines of the members before.
    """
    chosen = F.lit(True)
    if files is not None:
        keys = spark.createDataFrame([(f,) for f in files], "file_id string").select(F.xxhash64("file_id")).collect()
        chosen = F.col("file_key").isin([k[0] for k in keys])
    index, found = export_index(spark, path).filter(chosen), _members(spark, path, chosen)
    numbered = number_splits(found.select(F.col("file_key").alias("file_id"), F.col("member").alias("split"), "at", "line"))
    names = index.select("file_key", F.col("file_id").alias("name")).distinct()
    return numbered.join(names, F.col("file_id") == F.col("file_key")).select(F.col("name").alias("file_id"), "line_no", "line")


def damaged_members(spark: SparkSession, path: str) -> DataFrame:
    """[file_id, member, lines, found]: members of an export that do not hold as many lines as its index says."""
    found = _members(spark, path).groupBy("file_key", "member").agg(F.count("*").alias("found"))
    held = export_index(spark, path).join(found, ["file_key", "member"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return held.filter(F.col("found") != F.col("lines")).select("file_id", "member", "lines", "found")


def write_files(lines: DataFrame, folder: str, members: int | None = None) -> None:
    """Write [file_id, line_no, line] as the files ``folder/<file_id>``, which take the place of all that was there.

    Members are written by ranges as in ``export_ordered``, then each file's are copied one after the other into one
    file, a few megabytes at a time; all files change places with the old folder at once, as tables do in
    ``storage.overwrite``. A failure leaves the old files, one between the two renames is mended by ``storage.recover``,
    which the next call begins with. One writer at a time.

    Every line ends with a line feed; carriage returns stay. File ids are paths within the folder: one that is null, empty,
    absolute, or has empty parts, ``.`` or ``..``, is refused, as is a file whose name is another's folder.
    """
    spark = lines.sparkSession
    recover(spark, folder)
    staged = staged_beside(folder)
    parts = f"{staged}.parts"
    system, _ = file_system(spark, staged)
    for left in (staged, parts):
        system.delete(hadoop(spark, left), True)
    keyed = _keyed(lines)
    names = _names(keyed).withColumn("bad", F.coalesce(F.concat(F.lit("/"), "file_id", F.lit("/")).rlike("//|/[.]{1,2}/"), F.lit(True)))
    names.write.parquet(f"{parts}/{INDEX}")
    names = spark.read.schema(names.schema).parquet(f"{parts}/{INDEX}")
    if refused := [r[0] for r in names.filter("bad").select("file_id").limit(3).collect()]:
        raise ValueError(f"not names of files within a folder: {refused}")
    _write_members(keyed, f"{parts}/{MEMBERS}", "none", members)
    system.mkdirs(hadoop(spark, staged))
    done = _join_members(spark, parts, staged, names) if _any_member(spark, parts) else 0
    if done != names.count():
        raise OSError(f"{done} files were written to {staged}, which are not all")
    switch(spark, folder)
    system.delete(hadoop(spark, parts), True)


def _join_members(spark: SparkSession, parts: str, target: str, names: DataFrame) -> int:
    """Write each file's members one after the other to ``target``; how many files that gave."""
    listed = spark.read.schema("path string, modificationTime timestamp, length bigint, content binary, file_key bigint")
    found = listed.format("binaryFile").load(f"{parts}/{MEMBERS}").select("file_key", F.element_at(F.split("path", "/"), -1).alias("member"))
    # One row per file, of the names of its members: at most one for each task that wrote.
    by_file = found.groupBy("file_key").agg(F.sort_array(F.collect_list("member")).alias("members"))
    joined = by_file.join(names, "file_key").select("file_id", F.col("file_key").cast("string"), "members")
    system, _ = file_system(spark, parts)
    place = lambda p: system.makeQualified(hadoop(spark, p)).toUri().toString()
    return joined.mapInArrow(_joiner(place(parts), place(target)), "file_id string").count()


def _keyed(lines: DataFrame) -> DataFrame:
    """[file_id, file_key, line_no, value]: files are told apart in folder names by a number, which any name has."""
    name = F.col("file_id").cast("string")
    broken = F.raise_error(F.concat(F.lit("a line break within line "), F.col("line_no").cast("string"))).cast("string")
    value = F.when(F.contains("line", F.lit("\n")), broken).otherwise(F.coalesce("line", F.lit("")))
    return lines.select(name.alias("file_id"), F.xxhash64(name).alias("file_key"), "line_no", value.alias("value"))


def _names(keyed: DataFrame) -> DataFrame:
    """[file_key, file_id], one row per file; two names of one number are an error."""
    some = keyed.select("file_key", "file_id").distinct().groupBy("file_key").agg(F.count("*").alias("n"), F.first("file_id").alias("file_id"))
    error = F.raise_error(F.lit("two files have the same number; write them apart")).cast("string")
    return some.select("file_key", F.when(F.col("n") > 1, error).otherwise(F.col("file_id")).alias("file_id"))


def _write_members(keyed: DataFrame, path: str, compression: str, members: int | None) -> None:
    order = ["file_key", "line_no"]
    count = members or int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(count, *order).sortWithinPartitions(*order, "value")
    ranged.select("file_key", "value").write.mode("error").partitionBy("file_key").option("compression", compression).text(path, lineSep="\n")


def _any_member(spark: SparkSession, path: str) -> bool:
    """Spark finds the column of the folders' names only where there is a folder."""
    system, _ = file_system(spark, path)
    return len(system.globStatus(hadoop(spark, f"{path}/{MEMBERS}/file_key=*")) or []) > 0


def _members(spark: SparkSession, path: str, chosen: Column | None = None) -> DataFrame:
    """[file_key, member, at, line]: lines of all members; a compressed member is read by one task, from its start."""
    if not _any_member(spark, path):
        return spark.createDataFrame([], "file_key bigint, member int, at bigint, line string")
    lines = spark.read.schema("value string, file_key bigint").option("lineSep", "\n").text(f"{path}/{MEMBERS}")
    # Filtered before rows are given ids, past which no filter is moved to the scan.
    lines = lines if chosen is None else lines.filter(chosen)
    member = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int")
    return lines.select("file_key", member.alias("member"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def _joiner(parts: str, target: str):
    folder, chunk = MEMBERS, CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def opened(uri: str):
            # Hadoop writes local paths with one slash.
            return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)

        (system, source), (_, goal) = opened(parts), opened(target)
        system.create_dir(posixpath.join(source, "attempts"), recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                # Attempts of one task write apart from each other and from the files that will stay.
                attempt = posixpath.join(source, "attempts", uuid.uuid4().hex)
                with system.open_output_stream(attempt) as out:
                    for member in row["members"]:
                        with system.open_input_stream(posixpath.join(source, folder, f"file_key={row['file_key']}", member), compression=None) as part:
                            while some := part.read(chunk):
                                out.write(some)
                path = posixpath.join(goal, row["file_id"])
                system.create_dir(posixpath.dirname(path), recursive=True)
                system.move(attempt, path)
            yield batch.select(["file_id"])

    return run
