"""Exact top-k search by inner product over a bit-sliced index.

The index of a block of rows holds one bitmap for each bit of each quantised component. A query's scores are not
computed row by row: for every set bit of a query component the component's bitmaps are added, with full adders on
whole bitmaps, to bitmaps of the score's bits. The top rows are then read off from the most significant score bitmap
downward; rows that are equal to the last place stay as one boundary bitmap, of which the smallest ids are taken.

Every row is indexed, in blocks of a bounded number of components, whatever the dimension. Queries come in blocks of
their own, of about the bytes of an index block; a block of queries meets each block of rows once, and only its best k
rows per query and block go on to the final ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetops.llm.runtime import checkpointed, partitions

SCALE = 64
K = 20
EVERY = 20  # rows whose id is divisible by this are queries
BLOCK_NUMBERS = 1 << 22  # components in a block of rows
QUERY_NUMBERS = 1 << 19  # components in a block of queries
TASK_QUERIES = 256  # a block of queries is not split below this to keep all tasks busy


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null for null vectors and those with null or non-finite components."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    odd = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~odd, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros, which add nothing to an inner product."""
    lists = vectors.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def bitmap(bits: np.ndarray) -> np.ndarray:
    """Booleans as a bitmap of 64-bit words."""
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, dtype=np.uint8)]).view("<u8").astype(np.uint64)


def members(words: np.ndarray, n: int) -> np.ndarray:
    return np.nonzero(np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little")[:n])[0]


class Index:
    """Bit slices of a block of rows, ordered by id. Rows have names of their own, as an id may be that of several."""

    def __init__(self, ids: np.ndarray, names: np.ndarray, low: np.ndarray, slices: list[np.ndarray]):
        self.ids, self.names, self.low, self.slices = ids, names, low, slices
        self.everyone = bitmap(np.ones(len(ids), dtype=bool))

    @classmethod
    def of(cls, ids: np.ndarray, rows: np.ndarray, names: np.ndarray | None = None) -> Index:
        names = ids if names is None else names
        order = np.lexsort((names, ids))
        ids, names, rows = ids[order], names[order], rows[order]
        low = rows.min(axis=0)
        above = rows - low
        slices = []
        for d in range(rows.shape[1]):
            bits = int(above[:, d].max()).bit_length()
            slices.append(np.array([bitmap((above[:, d] >> b) & 1 > 0) for b in range(bits)], dtype=np.uint64))
        return cls(ids, names, low, slices)

    def dumped(self) -> tuple[bytes, bytes, bytes, bytes, bytes]:
        bits = np.array([len(s) for s in self.slices], dtype="<i4")
        data = b"".join(s.astype("<u8").tobytes() for s in self.slices)
        return *(x.astype("<i8").tobytes() for x in (self.ids, self.names, self.low)), bits.tobytes(), data

    @classmethod
    def loaded(cls, *dumped: bytes) -> Index:
        ids, names, low = (np.frombuffer(x, dtype="<i8") for x in dumped[:3])
        bits, data = dumped[3:]
        words = -(-len(ids) // 64)
        flat = np.frombuffer(data, dtype="<u8").reshape(-1, words)
        ends = np.cumsum(np.frombuffer(bits, dtype="<i4"))
        return cls(ids, names, low, np.split(flat, ends[:-1]) if len(ends) else [])

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of the bits of all rows' scores, least significant first, and what to add to each score.

        A negative query component adds the complement of its slices, so that all terms are positive.
        """
        columns: list[list[np.ndarray]] = []
        base = 0
        for d, x in enumerate(query.tolist()[: len(self.slices)]):
            slices = self.slices[d]
            base += x * int(self.low[d])
            if x < 0:
                base += x * ((1 << len(slices)) - 1)
            weight = abs(x)
            for j in range(weight.bit_length()):
                if weight >> j & 1:
                    while len(columns) < j + len(slices):
                        columns.append([])
                    for b, part in enumerate(slices):
                        columns[j + b].append(~part if x < 0 else part)
        sums = []
        s = 0
        while s < len(columns):
            terms = columns[s]
            carries = []
            while len(terms) > 2:
                rest = []
                for i in range(0, len(terms) - 2, 3):
                    a, b, c = terms[i : i + 3]
                    half = a ^ b
                    rest.append(half ^ c)
                    carries.append((a & b) | (half & c))
                terms = rest + terms[len(terms) - len(terms) % 3 :]
            if len(terms) == 2:
                carries.append(terms[0] & terms[1])
                terms = [terms[0] ^ terms[1]]
            if carries:
                if s + 1 == len(columns):
                    columns.append([])
                columns[s + 1] += carries
            sums.append(terms[0] if terms else np.zeros_like(self.everyone))
            s += 1
        return sums, base

    def top(self, query: np.ndarray, k: int, own: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows but the one named ``own``; of equal scores the smaller ids."""
        sums, base = self.scores(query)
        rest = self.everyone
        for i in np.nonzero(self.names == own)[0].tolist():
            rest = rest.copy()
            rest[i // 64] &= ~(np.uint64(1) << np.uint64(i % 64))
        sure = np.zeros_like(rest)
        for part in reversed(sums):
            higher = sure | (rest & part)
            n = int(np.bitwise_count(higher).sum())
            if n >= k:
                rest = rest & part
            else:
                sure, rest = higher, rest & ~part
        chosen = members(sure, len(self.ids)).tolist()
        # What is left in ``rest`` has one and the same score: rows of the last place.
        chosen += members(rest, len(self.ids))[: k - len(chosen)].tolist()
        word, bit = np.array(chosen, dtype=np.int64) // 64, np.array(chosen, dtype=np.int64) % 64
        total = [base] * len(chosen)
        for s, part in enumerate(sums):
            has = (part[word] >> bit.astype(np.uint64)) & np.uint64(1)
            total = [t + (int(h) << s) for t, h in zip(total, has)]
        return [(int(self.ids[i]), t) for i, t in zip(chosen, total)]


def named(rows: DataFrame) -> DataFrame:
    """(row, vec_id, vector): where rows have no names, their ids are taken for names, which must then differ."""
    row = F.col("row") if "row" in rows.columns else F.col("vec_id").alias("row")
    return rows.select(row, "vec_id", "vector")


def shape(rows: DataFrame) -> tuple[int, int]:
    """How many rows, and components of the longest vector, at least 1."""
    count, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    return count, max(1, width or 1)


def build(vectors: DataFrame, block_rows: int | None = None) -> DataFrame:
    """The index of rows (vec_id, vector, and row if ids repeat): one row per block.

    Blocks have about ``block_rows`` rows, where not given as many as have ``BLOCK_NUMBERS`` components.
    """
    count, width = shape(vectors)
    blocks = max(1, -(-count // (block_rows or max(1, BLOCK_NUMBERS // width))))

    def run(table: pa.Table) -> pa.Table:
        ids, names = (table.column(c).to_numpy() for c in ("vec_id", "row"))
        index = Index.of(ids, matrix(table.column("vector")), names)
        columns = [[table.column("block")[0].as_py()], *([x] for x in index.dumped())]
        types = [pa.int32()] + [pa.binary()] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["block", *DUMPED])

    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    fields = "block int, " + ", ".join(f"{c} binary" for c in DUMPED)
    return named(vectors).withColumn("block", block).groupBy("block").applyInArrow(run, fields)


DUMPED = ["ids", "names", "low", "bits", "data"]


def search(index: DataFrame, queries: DataFrame, k: int = K, block_queries: int | None = None) -> DataFrame:
    """The k best rows for every query (vec_id, vector, and row if ids repeat): query_id, rank, vec_id, score.

    The query's own row is left out. Fewer rows than k give all of them, an empty index none. Blocks of queries have
    ``block_queries`` rows, where not given as many as have ``QUERY_NUMBERS`` components or as give each task one.
    """
    spark = index.sparkSession
    count, width = shape(queries)
    groups = max(-(-count * width // QUERY_NUMBERS), min(partitions(spark), -(-count // TASK_QUERIES)), 1)
    if block_queries is not None:
        groups = max(1, -(-count // block_queries))
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")

    def bundle(table: pa.Table) -> pa.Table:
        plain = [table.column("row").to_numpy(), table.column("vec_id").to_numpy(), matrix(table.column("vector"))]
        columns = [[table.column("group")[0].as_py()], *([x.astype("<i8").tobytes()] for x in plain)]
        types = [pa.int32()] + [pa.binary()] * 3
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["group", "own", "query_ids", "queries"])

    bundled = (
        named(queries)
        .withColumn("group", group)
        .groupBy("group")
        .applyInArrow(bundle, "group int, own binary, query_ids binary, queries binary")
    )
    met = index.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = bundled.join(met, F.col("group") == F.col("at")).select("own", "query_ids", "queries", *DUMPED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, ids, vectors, *dumped = (c[i].as_py() for c in batch.columns)
                block = Index.loaded(*dumped)
                own, ids = (np.frombuffer(x, dtype="<i8").tolist() for x in (own, ids))
                rows = np.frombuffer(vectors, dtype="<i8").reshape(len(own), -1)
                for low in range(0, len(own), TASK_QUERIES):
                    some = range(low, min(len(own), low + TASK_QUERIES))
                    found = [(own[j], ids[j], v, s) for j in some for v, s in block.top(rows[j], k, own[j])]
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, pa.int64()) for c in zip(*found)], names=["own", "query_id", "vec_id", "score"]
                        )

    best = pairs.mapInArrow(run, "own long, query_id long, vec_id long, score long")
    order = Window.partitionBy("own").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_k(rows: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, embedding) searched for the k best others of each row whose id is divisible by ``every``.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Rows that agree in
    id and vector are one row. Rows that share an id with different vectors are rows of their own: each is a query with
    its own k ranks, and they find each other. Vectors of fewer components count as filled with zeros. Scaled components
    are to stay below 2**26 or so, that scores fit 63 bits. Other columns are not read.
    """
    vectors = rows.select(F.col("vec_id").cast("long"), quantised(F.col("embedding"), scale).alias("vector"))
    vectors = vectors.filter("vec_id IS NOT NULL AND vector IS NOT NULL").distinct()
    # Named before they are kept, so that a lost task's rows have their names again.
    vectors = checkpointed(vectors.withColumn("row", F.monotonically_increasing_id()))
    return search(build(vectors), vectors.filter(F.col("vec_id") % every == 0), k)


def op8_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT vec_id, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS i FROM v
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.y * b.y) AS BIGINT) AS score
  FROM c a JOIN c b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id, b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) q WHERE rank <= 20
"""
