"""Systematic sampling of documents to target weights of their sources.

Every document of a source is expected ``target / size`` times. Documents stand in order of size and id; the
expected copies are summed along that order, one random offset per source is added, and a document is emitted
once for each integer that its sum crosses. As the order follows the sizes, what a source gives differs from its
target by less than its largest document.

Ranks come from a range partitioning by (source, size, id): counts per part are summed, not rows, so a source with
a third of all rows is spread like any other. Rows that agree in all three may stand in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetops.llm.runtime import checkpointed, partitions
from fleetops.llm.words import n_words

WEIGHTS = (1, 2, 3)
CAP = 3.0
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """Targets by source, from rows (source, size): weights go round by code point, a null source last.

    ``share`` of all sizes is dealt out by weight. No target exceeds ``cap`` times its source's size; what is cut goes
    to the others by weight, until none is above. That end state is found at once: sources fill up in order of
    cap / weight. One row per source is windowed, never one per document. An empty table gives no row; where all
    sizes are 0, so are the targets.
    """
    everyone = Window.partitionBy()
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    limits = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", weight)
        .withColumn("most", F.lit(cap) * F.col("source_size"))
        .withColumn("fill", F.col("most") / F.col("weight"))
        .withColumn("all", F.lit(share) * F.sum("source_size").over(everyone))
    )
    before = F.coalesce(F.sum("most").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    full = limits.withColumn("full", F.col("fill") <= (F.col("all") - before) / rest)
    spare = F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everyone), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everyone)
    return full.withColumn("rate", spare / open_weight).select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("most")).otherwise(F.col("rate") * F.col("weight")).alias("target"),
    )


def offset(source: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the source alone, in steps of 2**-24."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.concat(F.lit("="), source), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 6), 16, 10).cast("double") / F.lit(float(1 << 24))


def copy_plan(
    docs: DataFrame,
    size: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.0,
    cap: float = CAP,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies.

    ``size`` defaults to the words of the text, 0 for a null text. A null source is a source of its own, null ids
    come first within a size, repeated rows are separate documents; a document of size 0 may be emitted but adds
    nothing. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        (n_words(F.col(text_col)) if size is None else size.cast("long")).alias("size"),
    )
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("id").asc_nulls_first()]
    dealt = checkpointed(
        sized.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id())
    )
    targets = source_targets(dealt, weights, share, cap)
    parts = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        dealt.groupBy("source", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("shift", F.coalesce(F.sum("n").over(parts), F.lit(0)))
        .select(F.col("source").alias("s"), F.col("part").alias("p"), "shift")
    )
    targets = targets.select(F.col("source").alias("t"), "source_size", "target")
    within = Window.partitionBy("source", "part").orderBy("size", F.col("id").asc_nulls_first())
    known = shifts.join(targets, F.col("s").eqNullSafe(F.col("t")))
    ranked = dealt.withColumn("rank", F.row_number().over(within)).join(
        known, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = lambda k: F.floor(offset(F.col("source"), seed) + F.col("rate") * k)
    position = F.col("shift") + F.col("rank")
    copies = (at(position) - at(position - 1)).cast("long")
    return ranked.withColumn("rate", rate).select("id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken, with all their columns.

    Takes the options of ``copy_plan``. Documents that agree in id, source and size share their copies evenly.
    """
    # The user's columns travel as one, so no name of a step can meet one of theirs.
    plan = (
        copy_plan(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
        .groupBy("id", "source", "size")
        .agg(F.sum("copies").alias("copies"), F.count("*").alias("alike"))
        .select(F.col("id").alias("of_id"), F.col("source").alias("of_source"), F.col("size").alias("of_size"), "copies", "alike")
    )
    size = options.get("size")
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"),
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        (n_words(F.col(text_col)) if size is None else size.cast("long")).alias("size"),
        F.xxhash64(F.col(text_col)).alias("hash"),
    )
    key = Window.partitionBy("of_id", "of_source", "of_size").orderBy("hash")
    joined = sized.join(
        plan.filter(F.col("copies") > 0),
        F.col("id").eqNullSafe(F.col("of_id"))
        & F.col("source").eqNullSafe(F.col("of_source"))
        & (F.col("size") == F.col("of_size")),
    )
    share = lambda k: F.floor(k * F.col("copies") / F.col("alike"))
    taken = F.when(F.col("alike") == 1, F.col("copies")).otherwise(share(F.col("nth")) - share(F.col("nth") - 1))
    return (
        joined.withColumn("nth", F.row_number().over(key))
        .select("own", F.explode(F.array_repeat(F.lit(1), taken.cast("int"))))
        .select("own.*")
    )


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return copy_plan(docs).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), p AS (
  SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight,
    3.0::DOUBLE * source_size AS most, CAST(sum(source_size) OVER () AS DOUBLE) AS everything FROM s
), o AS (
  SELECT *, most / weight AS fill FROM p
), f AS (
  SELECT *, fill <= (everything - coalesce(sum(most) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full FROM o
), r AS (
  SELECT *, (everything - coalesce(sum(most) FILTER (WHERE is_full) OVER (), 0.0)) / sum(weight) FILTER (WHERE NOT is_full) OVER () AS rate FROM f
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN most ELSE rate * weight END AS target FROM r
), k AS (
  SELECT doc_id, size, source_size, target,
    row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS rank,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS per_doc,
    CAST(('0x' || substr(md5('mix-1|' || coalesce('=' || d.source, '')), 1, 6)) AS BIGINT) / 16777216.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST((floor(u + per_doc * rank) - floor(u + per_doc * (rank - 1))) * size AS BIGINT) AS taken FROM k
"""
