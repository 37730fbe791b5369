"""Searching and editing tables of text lines [file_id, line_no, line]."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetops.functions.blocks import BLOCK_LINES, block_of, over_blocks
from fleetops.functions.text import strip_cr

# Fixed value: said when no file refers to the text sought.
NO_REFERENCES = "No files referencing the text were found"


def split_lines(texts: DataFrame) -> DataFrame:
    """[file_id, line_no, line] from whole texts [file_id, text]; no shuffle."""
    return texts.select("file_id", F.posexplode(F.split("text", "\n"))).select(
        "file_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), F.col("col").alias("line")
    )


def number_splits(lines: DataFrame) -> DataFrame:
    """[file_id, line_no, line] from lines [file_id, split, at, line] of files that were read in many splits.

    ``split`` orders a file's splits and ``at`` its lines within one, without gaps from any number on. Lines are counted per
    split, the counts of the splits before are added up, and that sum, one row per split, is joined back: no task sees
    more than a split's lines or a file's list of splits.
    """
    counts = lines.groupBy("file_id", "split").agg(F.count("*").alias("_n"), F.min("at").alias("_first"))
    before = Window.partitionBy("file_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("file_id").alias("_file"), F.col("split").alias("_split"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # A file may be named null; splits never are.
    same = F.col("file_id").eqNullSafe(F.col("_file")) & (F.col("split") == F.col("_split"))
    number = (F.col("_before") + F.col("at") - F.col("_first") + 1).cast("bigint")
    return lines.join(bases, same).select("file_id", number.alias("line_no"), "line")


def find_references(files: DataFrame, needle: str) -> DataFrame:
    """[file, hits]: files whose text holds the fixed string, and on how many lines.

    ``files`` is [file, text]. Texts stay whole rows: nothing is exploded or shuffled.
    """
    hits = F.size(F.filter(F.split("text", "\n"), lambda line: line.contains(needle)))
    return files.filter(F.col("text").contains(needle)).select("file", hits.cast("bigint").alias("hits"))


def reference_summary(files: DataFrame, needle: str) -> DataFrame:
    """[files, warning]: how many files hold the string; a warning when none does."""
    found = F.count_if(F.col("text").contains(needle))
    return files.agg(found.alias("files")).select(
        "files", F.when(F.col("files") == 0, F.lit(NO_REFERENCES)).alias("warning")
    )


def fix_line_endings(lines: DataFrame) -> DataFrame:
    """Drops the carriage return at the end of each line."""
    return lines.select("file_id", "line_no", strip_cr(F.col("line")).alias("line"))


def delete_matching(lines: DataFrame, pattern: str) -> DataFrame:
    """Keeps the lines that the pattern does not match."""
    kept = ~F.coalesce(F.col("line").rlike(pattern), F.lit(False))
    return lines.filter(kept).select("file_id", "line_no", "line")


def context_after(lines: DataFrame, pattern: str, after: int) -> DataFrame:
    """Each matching line together with the ``after`` lines that follow it.

    With blocks of ``after + 1`` lines, a line is kept if the first match in its block
    stands at or before it, or if the last match in the block before reaches it. So two
    numbers per block are all there is to join; no window runs over a file, a matching
    line is never copied ``after`` times, and no key has more than ``after + 1`` lines.
    """
    size = after + 1
    numbered = lines.select("file_id", F.col("line_no").cast("bigint").alias("line_no"), "line")
    hits = numbered.filter(F.col("line").rlike(pattern)).select(
        "file_id", "line_no", block_of(F.col("line_no"), size).alias("block")
    )
    reach = (
        hits.select(
            "file_id",
            F.inline(
                F.array(
                    F.struct(
                        F.col("block"),
                        F.col("line_no").alias("from_line"),
                        F.lit(None).cast("bigint").alias("to_line"),
                    ),
                    F.struct(
                        (F.col("block") + 1).alias("block"),
                        F.lit(None).cast("bigint").alias("from_line"),
                        (F.col("line_no") + after).alias("to_line"),
                    ),
                )
            ),
        )
        .groupBy("file_id", "block")
        .agg(F.min("from_line").alias("from_line"), F.max("to_line").alias("to_line"))
    )
    return (
        numbered.withColumn("block", block_of(F.col("line_no"), size))
        .join(reach, ["file_id", "block"])
        .filter((F.col("line_no") >= F.col("from_line")) | (F.col("line_no") <= F.col("to_line")))
        .select("file_id", "line_no", "line")
    )


def context_after_in_texts(texts: DataFrame, pattern: str, after: int) -> DataFrame:
    """As ``context_after``, from whole texts [file_id, text], found inside the row without a shuffle.

    Each match keeps the lines up to the next match, ``after`` of them at most behind it.
    """
    split = texts.select("file_id", F.split("text", "\n").alias("lines"))
    hits = F.filter(F.transform("lines", lambda line, at: F.when(line.rlike(pattern), at)), lambda at: at.isNotNull())
    end = lambda at, i: F.least(
        at + after, F.coalesce(F.get("hits", i + 1) - 1, F.size("lines") - 1), F.size("lines") - 1
    )
    kept = F.flatten(F.transform("hits", lambda at, i: F.sequence(at, end(at, i))))
    rows = F.transform(
        kept, lambda at: F.struct((at + 1).cast("bigint").alias("line_no"), F.get("lines", at).alias("line"))
    )
    return split.select("file_id", "lines", hits.alias("hits")).select("file_id", F.inline(rows))


def last_lines_of_texts(texts: DataFrame, n: int) -> DataFrame:
    """As ``last_lines``, from whole texts [file_id, text], inside the row."""
    split = texts.select("file_id", F.split("text", "\n").alias("lines"))
    before = F.greatest(F.size("lines") - n, F.lit(0))
    rows = F.transform(
        F.slice("lines", before + 1, F.lit(n)),
        lambda line, i: F.struct((before + i + 1).cast("bigint").alias("line_no"), line.alias("line")),
    )
    return split.select("file_id", F.inline(rows))


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of each file; line numbers count from 1, so this is a filter."""
    return lines.filter(F.col("line_no") <= n).select(
        "file_id", F.col("line_no").cast("bigint").alias("line_no"), "line"
    )


def last_lines(lines: DataFrame, n: int, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The last ``n`` lines of each file.

    The longest line number per file comes from one aggregation, and the blocks holding
    the last lines are joined back.
    """
    numbered = lines.select("file_id", F.col("line_no").cast("bigint").alias("line_no"), "line")
    ends = numbered.groupBy("file_id").agg(F.max("line_no").alias("last"))
    start = F.greatest(F.col("last") - n + 1, F.lit(1))
    tails = over_blocks(ends.withColumn("start", start), F.col("start"), F.col("last"), block_lines)
    return (
        numbered.withColumn("block", block_of(F.col("line_no"), block_lines))
        .join(tails.select("file_id", "block", "start"), ["file_id", "block"])
        .filter(F.col("line_no") >= F.col("start"))
        .select("file_id", "line_no", "line")
    )
