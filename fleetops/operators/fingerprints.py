"""Fingerprints of tables: proof that a copy holds the same rows, whatever their order, and where it does not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Each row's digest gives two numbers of so many hexadecimal digits, which are added up.
DIGITS = 15


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """A digest of a row's columns in the order of ``columns``: each as its length and text, or ``-`` if null."""
    written = []
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        plain = F.hex(f"`{c}`") if kind == "binary" else F.col(f"`{c}`")
        # Nested columns are written as JSON, with null fields kept.
        nested = kind.startswith(("array", "map", "struct", "variant"))
        text = F.to_json(plain, {"ignoreNullFields": "false"}) if nested else plain.cast("string")
        written.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(F.lit(""), *written).cast("binary"), 256)


def fingerprints(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """[by..., row_count, sum_one, sum_two] per partition: how many rows, and two sums over the rows' digests.

    Sums do not depend on order, and a row that is there twice counts twice. Each task adds its rows up before the
    shuffle, so a partition of any size costs it one row. Without ``by`` the whole table is one partition. An empty
    table has no partitions. Columns take part by name, so their order does not matter.
    """
    columns = sorted(df.columns)
    half = lambda nth: F.conv(F.substring("_digest", 1 + nth * DIGITS, DIGITS), 16, 10).cast("decimal(38,0)")
    keys = [F.col(f"`{c}`").alias(c) for c in by]
    digested = df.select(*keys, row_digest(df, columns).alias("_digest"))
    summed = digested.groupBy(*[f"`{c}`" for c in by]).agg(
        F.count("*").alias("row_count"), F.sum(half(0)).alias("sum_one"), F.sum(half(1)).alias("sum_two")
    )
    return summed.filter("row_count > 0").select(
        *[f"`{c}`" for c in by], "row_count", F.col("sum_one").cast("string"), F.col("sum_two").cast("string")
    )


def differing(original: DataFrame, copy: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """[by..., state, rows_original, rows_copy] of the partitions whose fingerprints differ: changed, missing or extra.

    Both sides have one row per partition; null is a partition of its own.
    """
    one = original.select(F.struct(*[f"`{c}`" for c in by], F.lit(0).alias("_")).alias("k"), F.struct("row_count", "sum_one", "sum_two").alias("a"))
    two = copy.select(F.struct(*[f"`{c}`" for c in by], F.lit(0).alias("_")).alias("k2"), F.struct("row_count", "sum_one", "sum_two").alias("b"))
    joined = one.join(two, F.col("k").eqNullSafe(F.col("k2")), "full")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    key = F.coalesce("k", "k2")
    rows = lambda side: F.coalesce(F.col(f"{side}.row_count"), F.lit(0)).cast("bigint")
    return joined.filter(~F.col("a").eqNullSafe(F.col("b"))).select(
        *[key.getField(c).alias(c) for c in by], state.alias("state"), rows("a").alias("rows_original"), rows("b").alias("rows_copy")
    )
