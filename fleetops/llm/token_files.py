"""Token ids in files of patched frame-of-reference blocks.

Ids of documents in ascending order of document id are cut into blocks of 128. A block stores its minimum, the
differences to it at the width that 90 % of them need, and a list of exceptions: places and upper bits of the others.
Block starts and document ends are indexed, so a reader finds a document's ids without unpacking what is before.

File layout, little-endian:

    8 bytes   b"PFORIDS1"
    3 x u64   number of ids, documents, blocks
    u8        per document: 1 if its id is null
    i64       per document: its id (0 if null)
    u64       per document: end of its ids, counted from the file's first id
    u64       per block, and one more: start of the block, counted from the first block's
    blocks    u32 minimum, u8 width, u8 number of exceptions, width x 4 words u32,
              then u8 places and u32 upper bits of the exceptions

Value i of a block is in lane i % 4 at place i // 4; each lane packs its 32 values into ``width`` words. The last block
is filled up with its last id.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetops.llm.runtime import partitions, shared_folder, stored
from fleetops.llm.tokens import TEXTS, default_path, encoder, slices

MAGIC = b"PFORIDS1"
BLOCK, LANES = 128, 4
PLACES = BLOCK // LANES
PERCENTILE = 90
FILE_IDS = 2_000_000  # a file is closed at the document that reaches this many ids
END_ID = 2


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 numbers below 2**width as rows of width * 4 words."""
    lanes = values.reshape(len(values), PLACES, LANES)
    out = np.zeros((len(values), width, LANES), dtype=np.uint32)
    for i in range(PLACES):
        word, shift = divmod(i * width, 32)
        out[:, word] |= lanes[:, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= lanes[:, i] >> np.uint32(32 - shift)
    return out.reshape(len(values), width * LANES)


def unpacked(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``packed``."""
    lanes = words.reshape(len(words), width, LANES)
    out = np.zeros((len(words), PLACES, LANES), dtype=np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(PLACES if width else 0):
        word, shift = divmod(i * width, 32)
        value = lanes[:, word] >> np.uint32(shift)
        if shift + width > 32:
            value = value | lanes[:, word + 1] << np.uint32(32 - shift)
        out[:, i] = value & mask
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Starts of the blocks (one more than blocks) and their bytes."""
    count = -(-len(ids) // BLOCK)
    if not count:
        return np.zeros(1, dtype=np.uint64), b""
    rows = np.concatenate([ids, np.full(count * BLOCK - len(ids), ids[-1], dtype=np.uint32)]).reshape(count, BLOCK)
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    nth = BLOCK * PERCENTILE // 100
    usual = np.partition(rest, nth, axis=1)[:, nth].astype(np.float64)
    widths = np.ceil(np.log2(usual + 1)).astype(np.int64)
    above = (rest.astype(np.uint64) >> widths[:, None].astype(np.uint64)).astype(np.uint32)
    row, place = np.nonzero(above)
    exceptions = np.bincount(row, minlength=count)
    sizes = 6 + widths * LANES * 4 + exceptions * 5
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.zeros(starts[-1], dtype=np.uint8)
    heads = np.zeros((count, 6), dtype=np.uint8)
    heads[:, :4] = least.astype("<u4").view(np.uint8).reshape(count, 4)
    heads[:, 4], heads[:, 5] = widths, exceptions
    out[(starts[:-1, None] + np.arange(6)).ravel()] = heads.ravel()
    for width in np.unique(widths):
        if width:
            chosen = np.nonzero(widths == width)[0]
            low = rest[chosen] & np.uint32((1 << int(width)) - 1)
            data = packed(low, int(width)).astype("<u4").view(np.uint8).reshape(len(chosen), -1)
            out[(starts[chosen, None] + 6 + np.arange(data.shape[1])).ravel()] = data.ravel()
    nth_of_row = np.arange(len(row)) - np.concatenate([[0], np.cumsum(exceptions)])[row]
    lists = starts[row] + 6 + widths[row] * LANES * 4
    out[lists + nth_of_row] = place
    at = lists + exceptions[row] + 4 * nth_of_row
    out[(at[:, None] + np.arange(4)).ravel()] = above[row, place].astype("<u4").view(np.uint8)
    return starts.astype(np.uint64), out.tobytes()


def decode_blocks(starts: np.ndarray, data: np.ndarray, first: int, last: int) -> np.ndarray:
    """The ids of blocks first to last - 1."""
    at = starts[first:last].astype(np.int64)
    if not len(at):
        return np.zeros(0, dtype=np.uint32)
    heads = data[at[:, None] + np.arange(6)]
    least = np.ascontiguousarray(heads[:, :4]).view("<u4").ravel().astype(np.uint32)
    widths, exceptions = heads[:, 4].astype(np.int64), heads[:, 5].astype(np.int64)
    rows = np.zeros((len(at), BLOCK), dtype=np.uint32)
    for width in np.unique(widths):
        if width:
            chosen = np.nonzero(widths == width)[0]
            raw = data[at[chosen, None] + 6 + np.arange(width * LANES * 4)]
            rows[chosen] = unpacked(np.ascontiguousarray(raw).view("<u4").astype(np.uint32), int(width))
    row = np.repeat(np.arange(len(at)), exceptions)
    nth_of_row = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    lists = at[row] + 6 + widths[row] * LANES * 4
    place = data[lists + nth_of_row]
    upper = data[(lists + exceptions[row] + 4 * nth_of_row)[:, None] + np.arange(4)]
    upper = np.ascontiguousarray(upper).view("<u4").ravel().astype(np.uint32)
    rows[row, place] |= upper << widths[row].astype(np.uint32)
    return (rows + least[:, None]).ravel()


def encode_file(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A file of documents, given in order."""
    ends = np.cumsum([len(x) for x in ids], dtype=np.uint64)
    everything = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)
    starts, blocks = encode_blocks(everything.astype(np.uint32))
    counts = np.array([len(everything), len(doc_ids), len(starts) - 1], dtype="<u8")
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    plain = np.array([d or 0 for d in doc_ids], dtype="<i8")
    parts = [MAGIC, counts, nulls, plain, ends.astype("<u8"), starts.astype("<u8"), blocks]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class TokenFile:
    """A file's documents; ``ids(i)`` unpacks only the blocks that hold document i."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a file of patched frame-of-reference blocks")
        _, docs, blocks = (int(x) for x in np.frombuffer(content, dtype="<u8", count=3, offset=8))
        at = 32
        nulls = np.frombuffer(content, dtype=np.uint8, count=docs, offset=at)
        plain = np.frombuffer(content, dtype="<i8", count=docs, offset=at + docs)
        self.doc_ids = [None if null else int(d) for null, d in zip(nulls, plain)]
        self.ends = np.frombuffer(content, dtype="<u8", count=docs, offset=at + 9 * docs).astype(np.int64)
        self.starts = np.frombuffer(content, dtype="<u8", count=blocks + 1, offset=at + 17 * docs)
        self.data = np.frombuffer(content, dtype=np.uint8, offset=at + 17 * docs + 8 * (blocks + 1))

    def ids(self, i: int) -> np.ndarray:
        start, end = (int(self.ends[i - 1]) if i else 0), int(self.ends[i])
        first = start // BLOCK
        blocks = decode_blocks(self.starts, self.data, first, -(-end // BLOCK))
        return blocks[start - first * BLOCK : end - first * BLOCK]

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, start in the file, ids) of all documents, unpacking about ``at_once`` ids at a time."""
        begins = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        sizes = (self.ends - begins).tolist()
        for low, high in slices(sizes, at_once):
            first = int(begins[low]) // BLOCK
            ids = decode_blocks(self.starts, self.data, first, -(-int(self.ends[high - 1]) // BLOCK))
            for i in range(low, high):
                start = int(begins[i])
                yield self.doc_ids[i], start, ids[start - first * BLOCK : int(self.ends[i]) - first * BLOCK]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) to ``folder`` and returns its list: file, n_docs, n_ids, start.

    A null text is empty and has the end id alone; a null document id comes first; rows with one id are ordered by
    text. An empty table writes no file. Tasks write files of their own through the folder's file system, under a
    temporary name first, so a repeated task only writes the same file again. ``start`` counts the ids of all files
    before. Other columns are not read.
    """
    spark = docs.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(place)  # readers find it even if no file follows
    # With its scheme and host, so that tasks write where Spark will read, whatever the default file system is.
    uri = store.makeQualified(place).toUri().toString()
    uri = f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri
    path = tokenizer or default_path()
    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(uri)
        system.create_dir(root, recursive=True)
        part, encode, serial = TaskContext.get().partitionId(), encoder(path), 0
        end = np.array([end_id], dtype=np.uint32)

        def close(keys, ids):
            name = f"ids-{part:06d}-{serial:06d}.pfor"
            attempt = posixpath.join(root, f".{name}.{uuid.uuid4().hex}")
            with system.open_output_stream(attempt) as out:
                out.write(encode_file(keys, ids))
            system.move(attempt, posixpath.join(root, name))
            return pa.RecordBatch.from_pydict(
                {"file": [name], "n_docs": [len(keys)], "n_ids": [sum(map(len, ids))]},
                schema=pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

        keys, ids, total = [], [], 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            names = batch.column(0).to_pylist()
            for low, high in slices([len(t) for t in texts], TEXTS):
                for name, found in zip(names[low:high], encode(texts[low:high])):
                    keys.append(name)
                    ids.append(np.concatenate([found, end]))
                    total += len(found) + 1
                    if total >= FILE_IDS:
                        yield close(keys, ids)
                        keys, ids, total, serial = [], [], 0, serial + 1
        if keys:
            yield close(keys, ids)

    files = stored(ordered.mapInArrow(write, "file string, n_docs long, n_ids long"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_token_files(spark, folder: str, files: DataFrame) -> DataFrame:
    """Documents read back from the files: doc_id, start, n_tokens, ids_crc32 (of little-endian 32-bit ids).

    A listed file that is not in the folder is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = [
                    (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for doc_id, start, ids in TokenFile(content.as_py()).documents()
                ]
                doc_ids, starts, sizes, sums = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name.as_py()] * len(rows), pa.string()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["file", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder)
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    if lost := [r["file"] for r in files.join(listed.select(name), "file", "left_anti").select("file").limit(3).collect()]:
        raise FileNotFoundError(f"listed, but not in {folder}: {lost}")
    found = listed.select(name, "content").mapInArrow(
        read, "file string, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    return found.join(files.select("file", F.col("start").alias("before")), "file").select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    files = write_token_files(docs, folder)
    return read_token_files(spark, folder, files)
