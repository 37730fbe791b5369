"""Best-fit packing of token sequences by their length histogram.

Only counts by length reach the driver, at most one per length up to the capacity. The plan is made over these counts:
from long to short, the pieces of a length go to the fullest sequences that still have room, many alike at once. A
plan entry says "pieces of this length with ranks a to b go to sequences s onwards, at this offset". Documents take
their places by rank within their length: ranks are counted by chunks, so no length gathers in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetops.llm.runtime import checkpointed, in_arrow, partitions
from fleetops.llm.tokens import TEXTS, default_path, encoder, slices

CAPACITY = 4096
END_ID = 1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Entries (length, first rank, number of pieces, first sequence, offset) for counts by length.

    Best-fit decreasing: a piece goes to the sequence with the least room that holds it, so one sequence takes as many
    pieces of a length as it can before the next gets any. Sequences with equal room are interchangeable, and runs of
    them are filled at once; the number of entries depends on the lengths that occur and the capacity, not on the
    number of pieces.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
    rooms: list[int] = []
    entries = []
    next_sequence = 0

    def add(room: int, first: int, n: int) -> None:
        if room:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, first, n = capacity, next_sequence, -(-left // (capacity // length))
                next_sequence += n
            else:
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
            each = room // length
            full = min(n, left // each)
            more = min(left - full * each, each) if full < n else 0
            for k in range(each if full else 0):
                entries.append((length, rank, full, first, capacity - room + k * length))
                rank += full
            for k in range(more):
                entries.append((length, rank, 1, first + full, capacity - room + k * length))
                rank += 1
            left -= full * each + more
            used = full + (more > 0)
            if full:
                add(room - each * length, first, full)
            if more:
                add(room - more * length, first + full, 1)
            if used < n:
                add(room, first + used, n - used)
    return entries


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """Documents (doc_id, text) as pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32[, ids].

    A null text is empty and has the end id alone. Only documents longer than the capacity are cut. ``ids`` are
    little-endian unsigned 32-bit numbers. Other columns are not read.
    """
    path = tokenizer or default_path()
    types = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]
    types += [("ids_crc32", pa.int64())] + [("ids", pa.binary())] * keep_ids
    schema = pa.schema(types)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], dtype=np.uint32)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for low, high in slices([len(t) for t in texts], TEXTS):
                rows = []
                for doc_id, found in zip(doc_ids[low:high], encode(texts[low:high])):
                    ids = np.concatenate([found, end])
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        raw = part.astype("<u4").tobytes()
                        rows.append((doc_id, piece, start, len(part), zlib.crc32(raw), raw)[: len(types)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    text = F.coalesce("text", F.lit("")).alias("text")
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return in_arrow(docs.select(F.col("doc_id").cast("long"), text), cut, fields)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. ``cut`` is read several times: give it from storage.

    Rows that agree in all columns are separate pieces. An empty table gives an empty one.
    """
    spark = cut.sparkSession
    chunks = 4 * partitions(spark)
    entries = plan({r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)
    table = np.array(sorted(entries), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)

    chunked = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    order = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        chunked.groupBy("length", "chunk")
        .agg(F.count("*").alias("n"))
        .select("length", "chunk", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("shift"))
    )
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        chunked.withColumn("inside", F.row_number().over(within) - 1)
        .join(shifts, ["length", "chunk"])
        .withColumn("rank", F.col("inside") + F.col("shift"))
        .select(*cut.columns, "rank")
    )

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        lengths, firsts = np.unique(entries[:, 0], return_index=True)
        # Entries of a length follow each other by rank; a big step between lengths makes one sorted key.
        step = int(entries[:, 1:3].sum(axis=1).max(initial=0)) + 1
        keys = np.searchsorted(lengths, entries[:, 0]) * step + entries[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, np.searchsorted(lengths, length) * step + rank, side="right") - 1
            sequence = entries[at, 3] + rank - entries[at, 1]
            columns = [batch.column(n) for n in batch.schema.names if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(entries[at, 4])], names=[*names, "sequence_id", "offset"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return in_arrow(ranked, take, f"{fields}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed ids of each sequence, from placed pieces that kept their ids; a sequence is at most one capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b""), lambda joined, x: F.concat(joined, x.getField("ids"))).alias("ids")
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``docs`` with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(checkpointed(pieces(docs, capacity, tokenizer, end_id)), capacity)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
