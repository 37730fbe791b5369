"""Removal of long repeated passages, found by difference-cover anchors.

A passage of ``window`` words that occurs twice shares, wherever its copies begin, an anchor at a position of the cover:
with D a difference cover modulo a period, two positions i and j can always be shifted by the same amount below the
period so that both fall on D. So only anchors, shorter runs of words at cover positions, are hashed and counted:

1. anchors of all documents are counted; those that occur once are dropped;
2. each anchor left is extended to the windows around it, and only these windows are hashed and counted;
3. words under windows that occur at least twice are removed.

Occurrences travel as columns of numbers, a row for each batch of a task and part of the hash space; what is found goes
back by batch. A batch that sees a hash twice sends it once, marked, so a passage with millions of copies costs its
part one entry per batch. Documents are named by
a 128-bit hash of id and text, so repeated rows and repeated ids need no special case; anchors and windows by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetops.llm.runtime import in_arrow, partitions
from fleetops.llm.tokens import slices
from fleetops.llm.words import window_hashes, word_hashes

WINDOW = 35
FLUSH = 400_000  # occurrences that a task gathers before it sends them off
TWICE = np.uint32(1 << 31)  # mark of an entry whose hash its task has seen more than once


@dataclass(frozen=True)
class Cover:
    """A difference cover: every number below ``period`` is a difference of two of ``places``, modulo the period."""

    period: int
    places: tuple[int, ...]

    def mask(self, n: int) -> np.ndarray:
        """Which of positions 0 to n - 1 are in the cover."""
        one = np.zeros(self.period, dtype=bool)
        one[list(self.places)] = True
        return np.tile(one, -(-n // self.period))[:n]

    def complete(self) -> bool:
        return {(a - b) % self.period for a in self.places for b in self.places} == set(range(self.period))


# Perfect difference sets.
COVERS = (Cover(21, (0, 1, 4, 14, 16)), Cover(13, (0, 1, 3, 9)), Cover(7, (0, 1, 3)), Cover(3, (0, 1)), Cover(1, (0,)))


def cover_for(window: int) -> Cover:
    """The widest cover that leaves anchors of more than a third of the window."""
    return next(c for c in COVERS if 3 * (window - c.period + 1) > window or c.period == 1)


# A row holds many entries as columns. ``numbers`` say which document of the batch an entry belongs to, ``places`` are
# the differences from entry to entry; both compress well. What a row is: entries to count, places known to repeat, or
# the names of the batch's documents.
COUNT, KNOWN, NAMED = 0, 1, 2
ENTRIES = "part int, batch long, kind int, hashes binary, numbers binary, places binary"
TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
COLUMNS = ["part", "batch", "kind", "hashes", "numbers", "places"]
FOUND = "batch long, kind int, numbers binary, places binary"


def differences(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as what each adds to the one before, modulo 2**32."""
    return np.diff(x.astype(np.uint32), prepend=np.uint32(0)).astype("<u4").tobytes()


def summed(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, dtype="<u4"), dtype=np.uint32)


class Gatherer:
    """Occurrences (hash, document, place) of one task, sent off in batches as rows of columns by part."""

    def __init__(self, parts: int):
        self.parts = parts
        self.clear()

    def clear(self) -> None:
        self.keys, self.hashes, self.numbers, self.places, self.held = [], [], [], [], 0

    def add(self, key: bytes, hashes: np.ndarray, places: np.ndarray) -> None:
        if len(hashes):
            self.hashes.append(hashes)
            self.numbers.append(np.full(len(hashes), len(self.keys), dtype=np.uint32))
            self.places.append(places.astype(np.uint32))
            self.keys.append(key)
            self.held += len(hashes)

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Entries to be counted, one for each different hash, and the occurrences already known to repeat."""
        if not self.held:
            return
        hashes, numbers, places = np.concatenate(self.hashes), np.concatenate(self.numbers), np.concatenate(self.places)
        names = b"".join(self.keys)
        self.clear()
        batch = int.from_bytes(blake2b(names, digest_size=8).digest(), "little", signed=True)
        _, first, group, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        twice = count[group] > 1
        rows = [(batch % self.parts, batch, NAMED, None, names, None)]
        if twice.any():
            rows.append((batch % self.parts, batch, KNOWN, None, numbers[twice].tobytes(), differences(places[twice])))
        first.sort()
        hashes, places = hashes[first], places[first]
        numbers = numbers[first] | np.where(twice[first], TWICE, np.uint32(0))
        part = ((hashes >> np.uint64(33)) % np.uint64(self.parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p in range(self.parts):
            some = order[cuts[p] : cuts[p + 1]]
            if len(some):
                rows.append((p, batch, COUNT, hashes[some].tobytes(), numbers[some].tobytes(), differences(places[some])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=COLUMNS)


def repeated(entries: DataFrame, parts: int) -> DataFrame:
    """Rows (key, found): for each document that has any, the places whose hash occurs more than once anywhere.

    A task first holds the entries of its part of the hash space, about 20 bytes each; what it finds goes back by batch,
    and a task then holds the places of some batches. The session's shuffle partitions are to be as many that this fits.
    """

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(batch, kind, numbers, places):
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            columns = [pa.array([x], t) for x, t in zip((batch, kind, numbers, places), types)]
            return pa.RecordBatch.from_arrays(columns, names=["batch", "kind", "numbers", "places"])

        batches, hashes, numbers, places = [], [], [], []
        for some in rows:
            for i in range(some.num_rows):
                _, batch, kind, column, number, place = (c[i].as_py() for c in some.columns)
                if kind == COUNT:
                    batches.append(batch)
                    hashes.append(np.frombuffer(column, dtype="<u8"))
                    numbers.append(np.frombuffer(number, dtype="<u4"))
                    places.append(place)
                else:
                    yield row(batch, kind, number, place)
        if not batches:
            return
        ends = np.cumsum([len(h) for h in hashes])
        _, group, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        del hashes
        marked = np.concatenate(numbers) & TWICE > 0
        times[group[marked]] = 2
        often = times[group] > 1
        for batch, number, place, end in zip(batches, numbers, places, ends.tolist()):
            here = often[end - len(number) : end]
            if here.any():
                yield row(batch, KNOWN, (number[here] & ~TWICE).tobytes(), differences(summed(place)[here]))

    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, bytes] = {}
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for some in rows:
            for i in range(some.num_rows):
                batch, kind, numbers, places = (c[i].as_py() for c in some.columns)
                if kind == NAMED:
                    names[batch] = numbers
                else:
                    held.setdefault(batch, []).append((numbers, places))
        for batch, columns in held.items():
            number = np.concatenate([np.frombuffer(n, dtype="<u4") for n, _ in columns])
            place = np.concatenate([summed(p) for _, p in columns])
            order = np.lexsort((place, number))
            number, place = number[order], place[order]
            used, starts = np.unique(number, return_index=True)
            ends = [*starts[1:].tolist(), len(number)]
            keys = [names[batch][16 * u : 16 * u + 16] for u in used.tolist()]
            found = [differences(place[a:b]) for a, b in zip(starts.tolist(), ends)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.binary())], names=["key", "found"])

    counted = in_arrow(entries.repartition(parts, "part"), count, FOUND)
    gathered = in_arrow(counted.repartition(parts, "batch"), gather, "key binary, found binary")
    # Rows that agree in id and text have one key; all of their places repeat, in each of them.
    return gathered.groupBy("key").agg(F.get(F.collect_set("found"), F.lit(0)).alias("found"))


def keyed(docs: DataFrame) -> DataFrame:
    """The rows as (key, text, row): the key names id and text, the row holds all columns but the text."""
    text = F.coalesce("text", F.lit(""))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\u0000"), text)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.unhex(F.md5(name.cast("binary"))).alias("key"), text.alias("text"), F.struct(*rest).alias("row"))


def found_places(found: bytes | None) -> np.ndarray:
    return np.unique(summed(found)).astype(np.int64) if found else np.zeros(0, dtype=np.int64)


def anchors(texts: DataFrame, parts: int, window: int, cover: Cover) -> DataFrame:
    """Anchors of all documents that hold a window."""
    size = window - cover.period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gatherer(parts)
        for batch in batches:
            keys, raw = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for low, high in slices([len(t) for t in raw]):
                split = [t.split() for t in raw[low:high]]
                long = [i for i, words in enumerate(split) if len(words) >= window]
                hashes = window_hashes(word_hashes([w for i in long for w in split[i]]), size)
                start = 0
                for i in long:
                    n = len(split[i])
                    at = np.nonzero(cover.mask(n - size + 1))[0]
                    gathered.add(keys[low + i], hashes[start + at], at)
                    start += n
                if gathered.held >= FLUSH:
                    yield from gathered.flush()
        yield from gathered.flush()

    return in_arrow(texts.select("key", "text"), run, ENTRIES)


def windows(joined: DataFrame, parts: int, window: int, cover: Cover) -> DataFrame:
    """The windows around the anchors found, of rows (key, text, row, found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gatherer(parts)
        for batch in batches:
            keys, raw, found = batch.column(0), batch.column(1).cast(pa.binary()), batch.column(3)
            some = [i for i in range(len(raw)) if found[i].is_valid]
            texts = [raw[i].as_py() for i in some]
            for low, high in slices([len(t) for t in texts]):
                split = [t.split() for t in texts[low:high]]
                hashes = window_hashes(word_hashes([w for words in split for w in words]), window)
                start = 0
                for i, words in zip(some[low:high], split):
                    n = len(words)
                    at = found_places(found[i].as_py())
                    change = np.zeros(n + 2, dtype=np.int64)
                    np.add.at(change, np.maximum(at - cover.period + 1, 0), 1)
                    np.add.at(change, at + 1, -1)
                    begin = np.nonzero(np.cumsum(change)[: max(n - window + 1, 0)] > 0)[0]
                    gathered.add(keys[i].as_py(), hashes[start + begin], begin)
                    start += n
                if gathered.held >= FLUSH:
                    yield from gathered.flush()
        yield from gathered.flush()

    return in_arrow(joined, run, ENTRIES)


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) with passages that repeat removed, and what was done.

    A word goes if it is under a run of ``window`` words whose sequence also starts anywhere else, the same document
    included, judged on the input; so all copies go. Added columns: n_words, n_removed, kept_sha256 (of the kept words
    joined by one space) and removed, the spans [first word, last word + 1). ``text`` is unchanged where nothing goes,
    else the kept words joined by one space; null texts become empty. Texts with fewer words than the window stay.
    Repeated rows are copies of each other. Columns named like the added ones are replaced.
    """
    added = ["n_words", "n_removed", "kept_sha256", "removed"]
    docs = docs.drop(*added)
    parts = partitions(docs.sparkSession)
    cover = cover_for(window)
    texts = keyed(docs)
    held = texts.repartition(parts, "key")

    def with_found(found: DataFrame) -> DataFrame:
        at = found.select(F.col("key").alias("at"), "found")
        return held.join(at, F.col("key") == F.col("at"), "left").select("key", "text", "row", "found")

    first = repeated(anchors(texts, parts, window, cover), parts)
    second = repeated(windows(with_found(first), parts, window, cover), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes, gone, sums, spans = [], [], [], [], []
            for raw, found in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
                words = raw.split()
                n = len(words)
                at = found_places(found)
                if not len(at):
                    out.append(raw)
                    sizes.append(n)
                    gone.append(0)
                    sums.append(sha256(b" ".join(words)).hexdigest())
                    spans.append([])
                    continue
                change = np.zeros(n + 1, dtype=np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                covered = np.cumsum(change)[:n] > 0
                kept = b" ".join([words[i] for i in np.nonzero(~covered)[0].tolist()])
                edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                out.append(kept)
                sizes.append(n)
                gone.append(int(covered.sum()))
                sums.append(sha256(kept).hexdigest())
                spans.append([{"first": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            columns = [batch.column(2), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())]
            names = ["row", "n_words", "n_removed", "kept_sha256"]
            columns.append(pa.array(spans, kind))
            names.append("removed")
            if with_text:
                columns.append(pa.array(out, pa.binary()).cast(pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = with_found(second)
    row = joined.schema["row"].dataType.simpleString()
    fields = f"row {row}, n_words long, n_removed long, kept_sha256 string, removed array<struct<first:int,end:int>>"
    done = in_arrow(joined, run, fields + ", text string" * with_text)
    columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if with_text or c != "text"]
    return done.select(*columns, *added)


def op6_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i+34], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35) q
), r AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM g) q WHERE n > 1
), c AS (
  SELECT DISTINCT doc_id, i + k AS j FROM r, range(0, 35) t(k)
), l AS (
  SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id
), p AS (
  SELECT w.doc_id, len(ws) AS n, coalesce(len(gone), 0) AS m, ws, gone FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), u AS (
  SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w
), k AS (
  SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.j) AS kept FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.j = u.j WHERE c.j IS NULL GROUP BY u.doc_id
)
SELECT p.doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM p LEFT JOIN k ON k.doc_id = p.doc_id
"""
