"""Similarity join of documents by the Jaccard similarity of their word n-grams.

Equal sets are one class. N-grams are ordered rare first, by a table of counts over all documents; two classes as
similar as asked must share an n-gram among the first few of each (prefix filter). Classes are brought together by
their prefix n-grams, cut into runs of comparable length (length filter), and these where places of the shared n-gram lie
so far apart that too little can be shared around it (positional filter). All classes of a run belong to its least one,
the pivot; runs with the same classes have the same pivot, so a class's text is sent to a few pivots and not to each
n-gram. There, pairs pass a filter on how their n-grams spread over hash ranges (suffix filter) and are verified by exact
overlap, each pair under one pivot only.

What leaves a task is a forest of links, never all pairs. A pivot with more text or more classes than one task should
hold is split into blocks, and its pairs into pairs of blocks; what is known of such pivots is joined to their classes by
salted keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from fleetops.llm.components import components
from fleetops.llm.runtime import carried, checkpointed, in_arrow, partitions, stored, unpacked
from fleetops.llm.tokens import slices
from fleetops.llm.words import BASE, mix64, powers, word_hashes

N = 3
PERCENT = 90
SLOTS = 1 << 22  # places of the table of counts: 16 MB, whatever the input
SLOT_BLOCKS = 64
BLOCK_GRAMS = 1_000_000  # n-grams of the classes that one block of a pivot holds
BLOCK_CLASSES = 10_000  # and how many classes, as verifying takes time by their pairs
SALTS = 32  # keys among which the classes of a pivot are dealt to learn of its blocks
RANGES = 64  # hash ranges of the suffix filter
FLUSH = 1_000_000  # prefix n-grams that a task gathers before it sends them off


def gram_sets(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text, A-Z taken as a-z. Fewer than n words are one sequence."""
    split = [t.lower().split() for t in texts]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    hashes = word_hashes([w for s in split for w in s])
    ends = np.cumsum(sizes)
    total = len(hashes)
    out = []
    if total >= n:
        up, down = powers(BASE, n)
        value = np.zeros(total - n + 1, dtype=np.uint64)
        for k in range(n):
            value += hashes[k : total - n + 1 + k] * up[k]
        value = mix64(value + np.uint64(n))
    for size, end in zip(sizes.tolist(), ends.tolist()):
        if size >= n:
            out.append(np.unique(value[end - size : end - n + 1]))
        elif size:
            short = np.uint64(size)
            for k in range(end - size, end):
                short = mix64(np.array([short * np.uint64(BASE) + hashes[k]], dtype=np.uint64))[0]
            out.append(np.array([short], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def digest(grams: np.ndarray) -> bytes:
    return blake2b(grams.astype("<u8").tobytes(), digest_size=16).digest()


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap with which sets of a and b n-grams are similar enough: 100 * o >= percent * (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def classes(docs: DataFrame, n: int = N) -> DataFrame:
    """Rows (doc_id, n_shingles, class, text_hash): documents with equal sets are in one class; without words it is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            sets = [g for low, high in slices([len(t) for t in texts]) for g in gram_sets(texts[low:high], n)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(g) for g in sets], pa.int64()),
                    pa.array([digest(g) if len(g) else None for g in sets], pa.binary()),
                    batch.column(2),
                ],
                names=["doc_id", "n_shingles", "class", "text_hash"],
            )

    hashed = texts_of(docs).withColumn("text_hash", F.xxhash64("text"))
    return in_arrow(hashed, run, "doc_id long, n_shingles long, class binary, text_hash long")


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def gram_counts(docs: DataFrame, n: int = N) -> np.ndarray:
    """How many documents have n-grams of each slot, over all documents; a table of fixed size, summed in Spark."""
    size = SLOTS // SLOT_BLOCKS

    def blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(SLOT_BLOCKS):
            part = counts[i * size : (i + 1) * size]
            raw = part.astype("<u2").tobytes() if part.max(initial=0) < 1 << 16 else part.astype("<u4").tobytes()
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "counts": pa.array([raw], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, dtype=np.uint32)
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for low, high in slices([len(t) for t in texts]):
                grams = np.concatenate(gram_sets(texts[low:high], n))
                np.add.at(counts, slot(grams), 1)
        if counts.any():
            yield from blocks(counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * size else "<u4")
                total = totals.setdefault(block, np.zeros(size, dtype=np.int64))
                total += part
        for block, total in totals.items():
            raw = np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([raw], pa.binary())})

    fields = "block int, counts binary"
    by_task = in_arrow(texts_of(docs).select("text"), run, fields)
    summed = in_arrow(by_task.repartition(SLOT_BLOCKS, "block"), add, fields)
    counts = np.zeros(SLOTS, dtype=np.uint32)
    for row in summed.collect():
        counts[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["counts"], dtype="<u4")
    return counts


def slot(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(SLOTS - 1)).astype(np.int64)


def prefix_entries(docs: DataFrame, counts, parts: int, n: int, percent: int) -> DataFrame:
    """Prefix n-grams of all classes, gathered in columns by the part that their hash belongs to.

    A row holds many: hashes, which class of the row's list each belongs to, and its place in that class's order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        seen: set[bytes] = set()
        names, lengths, grams, owners, places, held = [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            gram, owner, place = np.concatenate(grams), np.concatenate(owners), np.concatenate(places)
            part = (gram >> np.uint64(40)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            gram, owner, place = gram[order], owner[order], place[order]
            cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            rows = []
            for p in range(parts):
                low, high = cuts[p], cuts[p + 1]
                if low < high:
                    used, local = np.unique(owner[low:high], return_inverse=True)
                    keys = b"".join([names[u] for u in used.tolist()])
                    sizes = np.array([lengths[u] for u in used.tolist()], dtype="<u4")
                    columns = gram[low:high].astype("<u8"), local.astype("<u4"), place[low:high].astype("<u4")
                    rows.append((p, keys, sizes.tobytes(), *[c.tobytes() for c in columns]))
            types = [pa.int32()] + [pa.binary()] * 5
            labels = ["part", "keys", "sizes", "grams", "owners", "places"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=labels)

        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for low, high in slices([len(t) for t in texts]):
                for found in gram_sets(texts[low:high], n):
                    if not len(found):
                        continue
                    name = digest(found)
                    if name in seen:
                        continue
                    seen.add(name)
                    size = prefix_size(len(found), percent)
                    rarity = table[slot(found)]
                    first = np.lexsort((found, rarity))[:size]
                    grams.append(found[first])
                    owners.append(np.full(size, len(names), dtype=np.uint32))
                    places.append(np.arange(size, dtype=np.uint32))
                    names.append(name)
                    lengths.append(len(found))
                    held += size
                if held >= FLUSH:
                    yield flush()
                    seen.clear()
                    names, lengths, grams, owners, places, held = [], [], [], [], [], 0
        if held:
            yield flush()

    fields = "part int, keys binary, sizes binary, grams binary, owners binary, places binary"
    return in_arrow(texts_of(docs).select("text"), run, fields)


def pivots(entries: DataFrame, parts: int, percent: int) -> DataFrame:
    """Rows (pivot, member, size) of classes that meet in a run of a prefix n-gram, the pivot itself included.

    A part is held as columns of numbers; the session's shuffle partitions are to be as many that a part, about 20
    bytes per prefix n-gram, fits a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, grams, owners, places, base = [], [], [], [], [], 0
        for batch in batches:
            for _, key, size, gram, owner, place in zip(*(c.to_pylist() for c in batch.columns)):
                keys.append(np.frombuffer(key, dtype="V16"))
                sizes.append(np.frombuffer(size, dtype="<u4"))
                grams.append(np.frombuffer(gram, dtype="<u8"))
                owners.append(np.frombuffer(owner, dtype="<u4").astype(np.int64) + base)
                places.append(np.frombuffer(place, dtype="<u4"))
                base += len(keys[-1])
        if not keys:
            return
        key, size = np.concatenate(keys), np.concatenate(sizes).astype(np.int64)
        # The same class may come from several tasks: number classes by size, then name.
        name = np.frombuffer(key.tobytes(), dtype=">u8").reshape(-1, 2)
        order = np.lexsort((name[:, 1], name[:, 0], size))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (name[order[1:]] != name[order[:-1]]).any(axis=1)
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        kept = order[new]
        key, size = key[kept], size[kept]
        gram, owner, place = np.concatenate(grams), number[np.concatenate(owners)], np.concatenate(places).astype(np.int64)
        order = np.lexsort((owner, gram))
        gram, owner, place = gram[order], owner[order], place[order]
        fresh = np.ones(len(gram), dtype=bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
        gram, owner, place = gram[fresh], owner[fresh], place[fresh]
        length = size[owner]
        # A run ends where the next class is too long for the one before, so no similar pair spans two runs.
        head = np.ones(len(gram), dtype=bool)
        head[1:] = (gram[1:] != gram[:-1]) | (100 * length[:-1] < percent * length[1:])
        start, run_of = np.nonzero(head)[0], np.cumsum(head) - 1
        shortest, longest = length[start], length[np.append(start[1:], len(gram)) - 1]
        # In order of places, two classes share at most the longer one's n-grams less the distance of the places.
        reach = longest - needed(np.maximum(shortest, -(-percent * longest // 100)), longest, percent)
        order = np.lexsort((place, run_of))
        owner, place, length, run_of = owner[order], place[order], length[order], run_of[order]
        head = np.ones(len(gram), dtype=bool)
        head[1:] = (run_of[1:] != run_of[:-1]) | (place[1:] - place[:-1] > reach[run_of[1:]])
        run_of = np.cumsum(head) - 1
        count = np.bincount(run_of)
        # Of runs of two, the one pair is checked: what can still be shared before and behind this n-gram.
        first = np.nonzero((count[run_of] == 2) & head)[0]
        room = np.minimum(place[first], place[first + 1]) + np.minimum(
            length[first] - place[first], length[first + 1] - place[first + 1]
        )
        out_of_reach = np.zeros(len(count), dtype=bool)
        out_of_reach[run_of[first[room < needed(length[first], length[first + 1], percent)]]] = True
        live = (count[run_of] > 1) & ~out_of_reach[run_of]
        least = np.minimum.reduceat(owner, np.nonzero(head)[0])[run_of]
        pairs = np.unique(np.stack([least[live], owner[live]], axis=1), axis=0)
        for low in range(0, len(pairs), 20_000):
            some = pairs[low : low + 20_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key[p].tobytes() for p in some[:, 0]], pa.binary()),
                    pa.array([key[m].tobytes() for m in some[:, 1]], pa.binary()),
                    pa.array(size[some[:, 1]], pa.int64()),
                ],
                names=["pivot", "member", "size"],
            )

    met = in_arrow(entries.repartition(parts, "part"), run, "pivot binary, member binary, size long")
    return met.distinct()


def forest(sets: list[np.ndarray], sides: list[int], homes: list[set], here, percent: int, across: bool) -> list[tuple[int, int]]:
    """Links between members of a pivot that join all that are similar, by verifying what the filters leave.

    Members on equal sides are not compared if ``across``; a pair that shares several pivots (``homes``) is only
    compared under the least. Pairs already joined by other links are left out.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    length = np.array([len(sets[i]) for i in order], dtype=np.int64)
    joined = np.concatenate([sets[i] for i in order])
    _, token = np.unique(joined, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(length)])
    spread = np.zeros((len(order), RANGES), dtype=np.int32)
    np.add.at(spread, (np.repeat(np.arange(len(order)), length), (joined >> np.uint64(58)).astype(np.int64)), 1)
    side = np.array([sides[i] for i in order])
    root = np.arange(len(order))
    flags = np.zeros(int(token.max(initial=-1)) + 1, dtype=np.int64)
    links = []
    for i in range(1, len(order)):
        low = int(np.searchsorted(100 * length[:i], percent * length[i]))
        others = np.arange(low, i)
        others = others[root[others] != root[i]]
        if across:
            others = others[side[others] != side[i]]
        if not len(others):
            continue
        least = needed(length[others], length[i], percent)
        apart = np.abs(spread[others] - spread[i]).sum(axis=1)
        near = (length[others] + length[i] - apart) // 2 >= least
        others, least = others[near], least[near]
        if not len(others):
            continue
        flags[token[starts[i] : starts[i + 1]]] = 1
        for at in range(0, len(others), 256):
            some = others[at : at + 256]
            some_least = least[at : at + 256]
            open_ = root[some] != root[i]
            some, some_least = some[open_], some_least[open_]
            if not len(some):
                continue
            reach = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in some])
            ends = np.concatenate([[0], np.cumsum(length[some])[:-1]])
            overlap = np.add.reduceat(flags[token[reach]], ends)
            for j in some[overlap >= some_least].tolist():
                if root[j] != root[i] and min(homes[order[i]] & homes[order[j]]) == here:
                    links.append((order[i], order[j]))
                    root[root == root[j]] = root[i]
        flags[token[starts[i] : starts[i + 1]]] = 0
    return links


NO_ID = -(1 << 63)  # stands for a null id where rows are joined


def representatives(known: DataFrame) -> DataFrame:
    """Rows (class, rep, rep_hash): the least id of each class, and the hash of a text of it under that id."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    found = known.filter(F.col("class").isNotNull()).groupBy("class").agg(first)
    return found.select("class", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("rep_hash"))


def with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (member, rep, rep_hash and others), each with the text of one document of its class.

    Documents are found by id and text, as many different ones may share an id or have none. Copies under one id are
    dropped by the tasks that read them and once more after the join, which has them in one place.
    """

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            new = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(new, pa.bool_()))

    texts = texts_of(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("hash"), "text")
    found = in_arrow(texts, once, "id long, hash long, text string").join(
        wanted.withColumn("rep", F.coalesce("rep", F.lit(NO_ID))), (F.col("id") == F.col("rep")) & (F.col("hash") == F.col("rep_hash"))
    )
    nth = F.row_number().over(Window.partitionBy("id", "hash").orderBy("hash"))
    return found.withColumn("nth", nth).filter("nth = 1").drop("id", "hash", "rep", "rep_hash", "nth")


def links(docs: DataFrame, reps: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Verified links (a, b) between classes that share a pivot, with their texts fetched from one document each."""
    spark = docs.sparkSession
    # A class counts for its n-grams, or for its share of the classes of a block if that is more.
    size = F.greatest("size", F.lit(BLOCK_GRAMS // BLOCK_CLASSES))
    load = members.groupBy("pivot").agg(F.ceil(F.sum(size) / BLOCK_GRAMS).cast("int").alias("blocks")).filter("blocks > 1")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    large = stored(load.select(F.col("pivot").alias("p"), "blocks", salts.alias("s")))
    homes = members.groupBy("member").agg(F.sort_array(F.collect_set("pivot")).alias("homes"))
    block = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = (
        members.withColumn("salt", F.pmod(F.hash("member"), F.lit(SALTS)))
        .join(large, (F.col("pivot") == F.col("p")) & (F.col("salt") == F.col("s")), "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", block)
        .withColumn("other", other)
        .select(
            "member",
            F.struct(
                "pivot", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block"
            ).alias("task"),
        )
        .groupBy("member")
        .agg(F.collect_list("task").alias("tasks"))
    )
    wanted = (
        tasks.join(homes, "member")
        .join(reps.withColumnRenamed("class", "member"), "member")
        .select("member", "rep", "rep_hash", "tasks", "homes")
    )
    sent = (
        with_texts(docs, wanted)
        .select(F.explode("tasks").alias("task"), "member", "homes", "text")
        .select("task.pivot", "task.one", "task.two", "task.block", "member", "homes", "text")
    )
    dealt = sent.repartition(partitions(spark), "pivot", "one", "two").sortWithinPartitions("pivot", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []

        def verify():
            names = [r[0] for r in rows]
            sets = [g for low, high in slices([len(r[3]) for r in rows]) for g in gram_sets([r[3] for r in rows[low:high]], n)]
            # A text that only shares id and hash is not the class that was asked for.
            fit = [i for i, g in enumerate(sets) if len(g) and digest(g) == names[i]]
            fit = list({names[i]: i for i in fit}.values())
            pivot, one, two = current
            found = forest(
                [sets[i] for i in fit], [rows[i][2] for i in fit], [rows[i][1] for i in fit], pivot, percent, one != two
            )
            return [(names[fit[i]], names[fit[j]]) for i, j in found]

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], names=["a", "b"])

        for batch in batches:
            out = []
            for pivot, one, two, block, member, homes, text in zip(
                *(c.to_pylist() for c in batch.columns[:6]), batch.column(6).cast(pa.binary()).to_pylist()
            ):
                if (pivot, one, two) != current:
                    if len(rows) > 1:
                        out += verify()
                    current, rows = (pivot, one, two), []
                rows.append((member, set(homes), block, text))
            if out:
                yield batch_of(out)
        if len(rows) > 1 and (out := verify()):
            yield batch_of(out)

    return in_arrow(dealt, run, "a binary, b binary")


def join(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_shingles, component_id, class, root.

    Documents whose sets overlap in at least ``percent`` of their union are linked; a component is what links reach,
    named by its least document id. A null or empty text has no n-grams and is alone; a null id is no name, unless a
    component has no other, and then its name is null. Repeated rows have equal sets. ``root`` is the class that names
    a component whatever its ids, null without n-grams. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    known = checkpointed(classes(docs, n))
    reps = representatives(known)
    counts = spark.sparkContext.broadcast(gram_counts(docs, n))
    members = checkpointed(pivots(prefix_entries(docs, counts, parts, n, percent), parts, percent))
    found = components(links(docs, reps, members, n, percent))
    rooted = reps.join(found.withColumnRenamed("node", "class"), "class", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "class"))
    rooted = checkpointed(rooted.select(F.col("class").alias("c"), "root", "rep"))
    names = rooted.groupBy("root").agg(F.min("rep").alias("component")).withColumnRenamed("root", "r")
    named = rooted.join(names, F.col("root") == F.col("r")).select("c", "root", "component")
    return known.join(named, F.col("class") == F.col("c"), "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        "class",
        "root",
    )


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others), of each component the one with the least id only.

    Rows without n-grams all stay. Of rows that agree in id and n-grams one stays. Read ``docs`` from storage: it is
    scanned several times.
    """
    own = carried(docs, ["doc_id", "text"])
    schema = StructType([*own.schema.fields, StructField("class", BinaryType()), StructField("hash", BinaryType())])

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            sets = [g for low, high in slices([len(t) for t in texts]) for g in gram_sets(texts[low:high], n)]
            names = pa.array([digest(g) if len(g) else None for g in sets], pa.binary())
            hashes = pa.array([blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, names, hashes], names=schema.names)

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")).alias("first")
    found = join(docs, n, percent).filter(F.col("class").isNotNull()).groupBy("root").agg(first)
    kept = found.select(F.col("first.class").alias("kept"), F.coalesce("first.doc_id", F.lit(NO_ID)).alias("kept_id"))
    tagged = in_arrow(own, tag, schema).withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    joined = tagged.join(kept, (F.col("class") == F.col("kept")) & (F.col("id") == F.col("kept_id")), "left")
    nth = F.row_number().over(Window.partitionBy("class", "id").orderBy("hash"))
    chosen = F.col("class").isNull() | (F.col("kept").isNotNull() & (F.col("nth") == 1))
    return unpacked(joined.withColumn("nth", nth).filter(chosen), docs.columns, ["doc_id", "text"])


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return join(docs).select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.c, nb.c HAVING 100 * count(*) >= 90 * (na.c + nb.c - count(*))
), r AS (
  SELECT doc_id, doc_id AS reach FROM documents
  UNION
  SELECT r.doc_id, l.y FROM r JOIN l ON r.reach = l.x
)
SELECT d.doc_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
