"""Merkle manifest of a dataset, with a witness for every row, by incremental witnesses.

Rows become leaves; leaves of one language, in ascending order, are appended to a tree. A task appends aligned blocks of
BLOCK leaves as a stream: it keeps the open subtrees, the largest first, and for each leaf the part of its witness that
its subtree completes. When two subtrees of one height meet they become one, and the witnesses of either side grow by the
other's digest; a subtree that stays without a sibling at a level is hashed alone. What a block ends with is its root, and
the roots of a tree's blocks are appended again, as leaves of the next round, until every tree has one node. The trees'
roots, ordered by language, are appended to one tree more in the same way. A row's witness is what its rounds have given,
joined: its own, that of its block, of its block's block, and so on.

Positions come from a sort by ranges and the counts of its parts, so a language with a third of all rows is spread over
tasks as any other; every join key is one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetops.llm.runtime import checkpointed, partitions, stored

BLOCK = 256  # leaves that are appended to one another before their root goes on; a power of two
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_EVERY = 7
LEFT, RIGHT, NONE = "L", "R", "-"  # where a level's sibling stands
HEX = 64  # characters of a digest


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row: each field as ``-`` if null, else as its length in bytes, ``:`` and its value."""
    written = []
    for value in fields.values():
        text = value.cast("string")
        written.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*written).cast("binary"), 256)


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``pos`` (from 0) and ``n`` within their ``tree``, by the columns of ``order``.

    The rows are sorted by ranges and kept; what is counted is one number for each part and tree.
    """
    spark = rows.sparkSession
    keys = ["tree", *order]
    ranged = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    # The second half of the number counts rows within the part.
    kept = checkpointed(
        ranged.withColumn("__id", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__id", 33).cast("int"))
        .withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1))
    )
    counts = kept.groupBy("tree", "__part").agg(F.count("*").alias("__here"), F.min("__at").alias("__first"))
    inside = Window.partitionBy("tree")
    before = inside.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "tree",
        "__part",
        "__first",
        F.coalesce(F.sum("__here").over(before), F.lit(0)).alias("__before"),
        F.sum("__here").over(inside).alias("n"),
    )
    pos = (F.col("__before") + F.col("__at") - F.col("__first")).cast("long").alias("pos")
    return kept.join(stored(counts), ["tree", "__part"]).select(*rows.columns, pos, F.col("n").cast("long").alias("n"))


class Appender:
    """Open subtrees of a block and what their leaves' witnesses hold so far."""

    def __init__(self):
        self.open: list[tuple[int, str, int]] = []  # height, digest, first leaf
        self.sides: list[list[str]] = []
        self.siblings: list[list[str]] = []

    def grow(self, first: int, last: int, side: str, sibling: str) -> None:
        for i in range(first, last):
            self.sides[i].append(side)
            self.siblings[i].append(sibling)

    def meet(self) -> None:
        """The last two open subtrees, of one height, become one; each side's witnesses grow by the other's digest."""
        height, right, middle = self.open.pop()
        _, left, first = self.open.pop()
        self.grow(first, middle, RIGHT, right)
        self.grow(middle, len(self.sides), LEFT, left)
        self.open.append((height + 1, digest(left, right), first))

    def append(self, node: str) -> None:
        self.open.append((0, node, len(self.sides)))
        self.sides.append([])
        self.siblings.append([])
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self.meet()

    def close(self, height: int) -> str:
        """The block's root, nodes without a sibling being hashed alone up to ``height``."""
        while len(self.open) > 1 or self.open[0][0] < height:
            if len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
                self.meet()
                continue
            low, alone, first = self.open[-1]
            self.grow(first, len(self.sides), NONE, " " * HEX)
            self.open[-1] = (low + 1, digest(alone), first)
        return self.open[0][1]


def appended(nodes: DataFrame, block: int) -> DataFrame:
    """One round: the rows (tree, pos, n, node and others) with block, witness and, on a block's first row, its root."""
    full = block.bit_length() - 1
    names = [c for c in nodes.columns if c != "block"]
    at_tree, at_pos, at_n, at_node = (names.index(c) for c in ("tree", "pos", "n", "node"))
    added = StructType.fromDDL("sides string, siblings string, root string")
    result = StructType([*nodes.select(*names).schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pieces = None, []

        def finish() -> pa.RecordBatch:
            rows = pa.Table.from_batches(pieces).combine_chunks()
            appender = Appender()
            for node in rows.column(at_node).to_pylist():
                appender.append(node)
            n = rows.column(at_n)[0].as_py()
            root = appender.close(full if n > block else (n - 1).bit_length())
            columns = [
                *(c.chunk(0) for c in rows.columns),
                pa.array(["".join(s) for s in appender.sides], pa.string()),
                pa.array(["".join(s) for s in appender.siblings], pa.string()),
                pa.array([root] + [None] * (rows.num_rows - 1), pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=result.names)

        for batch in batches:
            start = 0
            keys = list(zip(batch.column(at_tree).to_pylist(), (p // block for p in batch.column(at_pos).to_pylist())))
            for i, key in enumerate(keys):
                if key != current:
                    if start < i:
                        pieces.append(batch.slice(start, i - start))
                    if pieces:
                        yield finish()
                    current, pieces, start = key, [], i
            if start < len(keys):
                pieces.append(batch.slice(start))
        if pieces:
            yield finish()

    dealt = nodes.select(*names, block_of(block)).repartition(partitions(nodes.sparkSession), "tree", "block")
    made = dealt.sortWithinPartitions("tree", "pos").select(*names).mapInArrow(run, result)
    return made.withColumn("block", block_of(block))


def block_of(block: int) -> Column:
    return F.expr(f"pos div {block}").alias("block")


def grown(nodes: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The rows (tree, pos, n, node and others) with their whole witness, and the roots (tree, root) of their trees."""
    most = nodes.agg(F.max("n").alias("most")).first()["most"] or 0
    rounds = []
    while True:
        rounds.append(checkpointed(appended(nodes, block)))
        roots = rounds[-1].filter(F.col("root").isNotNull())
        if most <= block:
            break
        above = F.expr(f"(n + {block - 1}) div {block}").alias("n")
        nodes = roots.select("tree", F.col("block").alias("pos"), above, F.col("root").alias("node"))
        most = -(-most // block)
    witnessed = rounds.pop()
    while rounds:
        above = stored(witnessed.select(*[F.col(c).alias(f"__{c}") for c in ("tree", "pos", "sides", "siblings")]))
        met = rounds.pop().join(above, (F.col("tree") == F.col("__tree")) & (F.col("block") == F.col("__pos")))
        longer = {c: F.concat(c, f"__{c}") for c in ("sides", "siblings")}
        witnessed = met.withColumns(longer).drop("__tree", "__pos", "__sides", "__siblings")
    return witnessed, roots.select("tree", "root")


def sibling(level: Column) -> Column:
    return F.rtrim(F.substring(F.col("siblings"), level * HEX + 1, F.lit(HEX)))


def folded(node: Column) -> Column:
    """The root that a leaf's digest and the witness (sides, siblings) lead to."""

    def up(so_far: Column, level: Column) -> Column:
        on_left = F.substring(F.col("sides"), level + 1, F.lit(1)) == LEFT
        both = F.when(on_left, F.concat(sibling(level), so_far)).otherwise(F.concat(so_far, sibling(level)))
        return F.sha2(both.cast("binary"), 256)

    levels = F.filter(F.sequence(F.lit(0), F.length("sides")), lambda level: level < F.length("sides"))
    return F.aggregate(levels, node, up)


def proof() -> Column:
    """One digest of all siblings of the witness, from the leaf's level up."""
    return F.sha2(F.replace(F.col("siblings"), F.lit(" "), F.lit("")).cast("binary"), 256)


def manifest(docs: DataFrame, tampered: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, the witness (sides, siblings) and ``tampered``.

    The witness has a letter of ``sides`` and 64 characters of ``siblings`` for each level from the leaf to the root: L
    or R, where the sibling stands, and its digest, or - and spaces where there is none. ``tampered`` is the leaf of the
    row with that expression for n_chars, null without one.

    Nulls in any field are values of their own. Rows without a language are a tree of their own, the first; rows without
    an id come first within theirs. Equal ids are ordered by leaf, so repeated rows give one result in either order.
    Empty and very long texts are leaves as any other. An empty table gives no rows. Columns other than the five fields
    are not read, so their names cannot clash.
    """
    fields = {c: F.col(c) for c in FIELDS}
    changed = leaf({**fields, "n_chars": tampered}) if tampered is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null before all languages
    leaves = stored(docs.select(tree.alias("tree"), "doc_id", leaf(fields).alias("node"), changed.alias("tampered")))
    witnessed, subroots = grown(checkpointed(positions(leaves, ["doc_id", "node"])), block)
    tops = checkpointed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("node")))
    upper, root = grown(checkpointed(positions(tops, ["of"])), block)
    upper = upper.drop("root").join(root, "tree").select(
        "of", F.col("node").alias("subroot"), "root", F.col("sides").alias("__sides"), F.col("siblings").alias("__siblings")
    )
    return witnessed.drop("root").join(stored(upper), F.col("tree") == F.col("of")).select(
        "doc_id",
        F.col("node").alias("leaf"),
        "subroot",
        "root",
        F.concat("sides", "__sides").alias("sides"),
        F.concat("siblings", "__siblings").alias("siblings"),
        "tampered",
    )


def verified(docs: DataFrame, tampered: Column, block: int = BLOCK) -> DataFrame:
    """Every row's digests, and whether its leaf, with n_chars as ``tampered`` has it, still leads to the root."""
    found = manifest(docs, tampered, block).withColumn("folded_root", folded(F.col("tampered")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof().alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def tampered_n_chars(every: int = TAMPERED_EVERY) -> Column:
    """n_chars, one more where ``every`` divides the checksum of the id; a null stays null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return F.when(F.coalesce(chosen, F.lit(False)), F.col("n_chars") + 1).otherwise(F.col("n_chars"))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    return verified(spark.read.parquet(f"{sf_dir}/documents.parquet"), tampered_n_chars())


OP11_SQL = """
WITH RECURSIVE bits AS (
  SELECT doc_id, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(ch) AS BIGINT) FOR ch IN string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) FOR i IN range(8)]),
      lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) k
), d AS (
  SELECT coalesce('=' || lang, '') AS tree, documents.doc_id,
    coalesce(strlen(CAST(documents.doc_id AS VARCHAR)) || ':' || documents.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, n_chars,
    n_chars + CASE WHEN xor(crc, CAST(4294967295 AS BIGINT)) % 7 = 0 THEN 1 ELSE 0 END AS changed
  FROM documents LEFT JOIN bits ON bits.doc_id = documents.doc_id
), l AS (
  SELECT tree, doc_id, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(coalesce(changed, n_chars) AS VARCHAR)) || ':' || coalesce(changed, n_chars), '-') || tail) AS given
  FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l
), t AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM t WHERE len(nodes) > 1
), s AS (
  SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM t WHERE len(nodes) = 1
), u AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM s
  UNION ALL
  SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM u WHERE len(nodes) > 1
), steps AS (
  SELECT p.tree, p.pos, t.level, (p.pos >> t.level) % 2 = 1 AS on_left, coalesce(t.nodes[xor(p.pos >> t.level, 1) + 1], '') AS sibling
  FROM p JOIN t ON t.tree = p.tree AND len(t.nodes) > 1
  UNION ALL
  SELECT p.tree, p.pos, 1000 + u.level, (s.pos >> u.level) % 2 = 1, coalesce(u.nodes[xor(s.pos >> u.level, 1) + 1], '')
  FROM p JOIN s ON s.tree = p.tree JOIN u ON len(u.nodes) > 1
), w AS (
  SELECT tree, pos, list(on_left ORDER BY level) AS on_left, list(sibling ORDER BY level) AS siblings FROM steps GROUP BY tree, pos
), f AS (
  SELECT p.tree, p.pos, 0 AS done, p.given AS node, w.on_left, w.siblings FROM p LEFT JOIN w ON w.tree = p.tree AND w.pos = p.pos
  UNION ALL
  SELECT tree, pos, done + 1, sha256(CASE WHEN on_left[done + 1] THEN siblings[done + 1] || node ELSE node || siblings[done + 1] END), on_left, siblings
  FROM f WHERE done < len(siblings)
)
SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(coalesce(array_to_string(f.siblings, ''), '')) AS proof_sha256,
  f.node AS folded_root, f.node = r.root AS verified
FROM p JOIN s ON s.tree = p.tree JOIN f ON f.tree = p.tree AND f.pos = p.pos AND f.done = coalesce(len(f.siblings), 0)
  JOIN (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1) r ON true
"""
