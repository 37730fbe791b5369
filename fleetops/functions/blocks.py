"""Blocks of lines: a bounded grouping key for files of any length.

A file may hold a large share of all lines, so nothing here groups, sorts or joins
lines by file alone. Line ``n`` belongs to block ``(n - 1) div size``; a (file, block)
pair never holds more than ``size`` lines. What is known once per file is copied to the
file's blocks, of which there are only ``lines / size``, and joined on (file, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetops.functions.text import idiv

BLOCK_LINES = 65536


def block_of(line_no: Column, size: int = BLOCK_LINES) -> Column:
    return idiv(line_no.cast("bigint") - 1, size)


def over_blocks(df: DataFrame, first: Column, last: Column, size: int = BLOCK_LINES) -> DataFrame:
    """Copy each row to every block that the lines ``first`` to ``last`` fall into."""
    blocks = F.sequence(block_of(first, size), block_of(last, size))
    return df.filter(last >= first).withColumn("block", F.explode(blocks))
