"""A streaming source of text files that grow: every line once, by byte offsets kept for each file.

An offset says for each file how far it was read, always behind a line break, so a half-written last line is held back,
and a checksum of the file's first bytes. A file whose first bytes are others, or that has become shorter, has been
replaced or truncated and is read from its start. One that was renamed by rotation, to its name with a suffix, is known
by its first bytes and read on from where it was left.

Files are listed and looked at by the driver, a few small reads for each file that changed size; lines are read by tasks,
each a range of bytes. Files are opened through Arrow's file systems, so folders may be local, HDFS or an object store.
"""

from __future__ import annotations

import posixpath
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Executors get the source with the task, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD = 1024  # first bytes that tell a file from another
PART_BYTES = 16 << 20  # bytes that a task reads
STEP = 1 << 16  # bytes read at a time when looking for a line break
ROWS = 10_000
SCHEMA = "file string, offset bigint, line string"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def head_of(system: fs.FileSystem, path: str, size: int) -> int:
    with system.open_input_file(path) as file:
        return zlib.crc32(file.read_at(size, 0)) if size else 0


def last_break(system: fs.FileSystem, path: str, size: int) -> int:
    """The place behind the last line break among the first ``size`` bytes; 0 if there is none."""
    with system.open_input_file(path) as file:
        high = size
        while high > 0:
            low = max(0, high - STEP)
            found = file.read_at(high - low, low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            high = low
    return 0


def same_file(system: fs.FileSystem, path: str, size: int, known: dict) -> bool:
    """Whether a file of that size begins as the one that was known by ``known`` did, and is no shorter."""
    return size >= known["end"] and head_of(system, path, known["head"]) == known["crc"]


def rotated_from(path: str, name: str) -> bool:
    """Whether ``path`` is ``name`` with a suffix, as rotation leaves it."""
    return path.startswith(f"{name}.")


@dataclass
class Range(InputPartition):
    folder: str
    path: str
    start: int
    end: int
    begins_line: bool
    head: int
    crc: int


class Reader(DataSourceStreamReader):
    def __init__(self, folders: list[str], glob: str, part_bytes: int):
        self.folders, self.glob, self.part_bytes = folders, glob, part_bytes
        self.looked_at: dict[str, tuple] = {}  # path -> (size, time, entry): files that stay as they are are not opened again

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """For each folder and file: where its last whole line ends, how many first bytes were looked at, their checksum."""
        now: dict[str, dict] = {}
        for folder in self.folders:
            system, root = opened(folder)
            files = now.setdefault(folder, {})
            for info in system.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True)):
                # Rotated names are looked at as well: they may hold lines that were not read under the old name.
                stems = [info.base_name[:i] for i, c in enumerate(info.base_name) if c == "."]
                if info.type != fs.FileType.File or not any(fnmatch(n, self.glob) for n in [info.base_name, *stems]):
                    continue
                state = (info.size, str(info.mtime))
                known = self.looked_at.get(info.path)
                if known is None or known[0] != state:
                    end = last_break(system, info.path, info.size)
                    size = min(HEAD, end)
                    known = (state, {"end": end, "head": size, "crc": head_of(system, info.path, size)})
                    self.looked_at[info.path] = known
                files[info.path] = known[1]
        return now

    def partitions(self, start: dict, end: dict) -> list[Range]:
        ranges = []
        for folder, files in end.items():
            system, _ = opened(folder)
            before = start.get(folder, {})
            for path, entry in sorted(files.items()):
                begin = self.begin(system, path, entry, before)
                if begin is None:
                    continue
                for low in range(begin, entry["end"], self.part_bytes):
                    high = min(low + self.part_bytes, entry["end"])
                    ranges.append(Range(folder, path, low, high, low == begin, entry["head"], entry["crc"]))
        return ranges

    def begin(self, system: fs.FileSystem, path: str, entry: dict, before: dict) -> int | None:
        """Where to read on in a file; None for files that are none of this stream's."""

        def continues(known: dict) -> bool:
            if entry["end"] < known["end"] or known["head"] > entry["end"]:
                return False
            if known["head"] == entry["head"]:
                return known["crc"] == entry["crc"]
            place = path if system.get_file_info(path).type == fs.FileType.File else self.moved(system, path, entry)
            return place is not None and head_of(system, place, known["head"]) == known["crc"]

        if path in before and continues(before[path]):
            return before[path]["end"]
        for name, known in sorted(before.items()):
            if rotated_from(path, name) and known["end"] and continues(known):
                return known["end"]
        # A suffixed name is a file of its own only if the pattern says so.
        return 0 if fnmatch(posixpath.basename(path), self.glob) else None

    @staticmethod
    def moved(system: fs.FileSystem, path: str, entry: dict) -> str | None:
        """The name that a file has been rotated to since it was looked at."""
        for info in system.get_file_info(fs.FileSelector(posixpath.dirname(path), allow_not_found=True)):
            if rotated_from(info.path, path) and info.type == fs.FileType.File and same_file(system, info.path, info.size, entry):
                return info.path
        return None

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = opened(partition.folder)
        entry = {"end": partition.end, "head": partition.head, "crc": partition.crc}
        path = partition.path
        info = system.get_file_info(path)
        if info.type != fs.FileType.File or not same_file(system, path, info.size, entry):
            path = self.moved(system, path, entry)
            if path is None:
                raise OSError(f"{partition.path} was replaced before it was read")
        rows: list[tuple[int, str]] = []
        for offset, line in lines_of(system, path, partition):
            rows.append((offset, line.removesuffix(b"\r").decode("utf-8", "replace")))
            if len(rows) == ROWS:
                yield batch_of(partition.path, rows)
                rows = []
        if rows:
            yield batch_of(partition.path, rows)

    def commit(self, end: dict) -> None:
        """Offsets are kept by Spark."""


def lines_of(system: fs.FileSystem, path: str, part: Range) -> Iterator[tuple[int, bytes]]:
    """The lines that begin within a range, with where they begin; the last one is read beyond its end."""
    with system.open_input_file(path) as file:
        at = part.start
        held = b""
        if not part.begins_line:
            # The line that runs into the range belongs to the one before, which looks one byte back for that.
            at -= 1
        begin, skipping = at, not part.begins_line
        while begin < part.end:
            piece = file.read_at(STEP, at)
            if not piece:
                return
            at += len(piece)
            held += piece
            *whole, held = held.split(b"\n")
            for line in whole:
                if begin >= part.end:
                    return
                if not skipping:
                    yield begin, line
                skipping = False
                begin += len(line) + 1


def batch_of(path: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    offsets, texts = zip(*rows)
    columns = [pa.array([path] * len(rows), pa.string()), pa.array(offsets, pa.int64()), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["file", "offset", "line"])


class GrowingFiles(DataSource):
    """Format ``growing_files``: options ``folders`` (one to a line), ``glob`` and ``part_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        options = self.options
        return Reader(options["folders"].split("\n"), options.get("glob", "*.log"), int(options.get("part_bytes", PART_BYTES)))


def stream_growing_lines(spark: SparkSession, folders: list[str], glob: str = "*.log", part_bytes: int = PART_BYTES) -> DataFrame:
    """A stream of [file, offset, line]: each whole line of the folders' files once, ``offset`` being its first byte's place."""
    spark.dataSource.register(GrowingFiles)
    reader = spark.readStream.format(GrowingFiles.name()).option("folders", "\n".join(f.rstrip("/") for f in folders))
    return reader.option("glob", glob).option("part_bytes", part_bytes).load()
