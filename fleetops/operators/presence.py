"""Adding and listing what is absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetops.functions.blocks import BLOCK_LINES, block_of, over_blocks

# A loopback line, and the line added for a name that has none.
LOOPBACK_LINE = r"^127\.0\.0\.1\s"
LOOPBACK_NEW = "127.0.0.1    "

# Web server modules needed always, and those needed for SSL on top.
MODULES = ["headers", "rewrite"]
SSL_MODULES = ["ssl", "socache_shmcb"]

# Fixed value: a line of the server's module listing; group 1 is the module.
MODULE_LINE = r"^\s*(\w+)_module\b"


def insert_if_absent(lines: DataFrame, wanted: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Append a loopback line for each wanted name that no loopback line holds.

    ``lines`` is [file_id, line_no, line], ``wanted`` [file_id, domain] with any number of
    names per file; they are added in order of the name. Running it on its own result
    changes nothing. Only loopback lines meet the wanted names, on (file, block of lines);
    copies of a line or name are merged before.
    """
    numbered = lines.select("file_id", F.col("line_no").cast("bigint").alias("line_no"), "line")
    lengths = numbered.groupBy("file_id").agg(F.max("line_no").alias("last"))
    todo = wanted.select("file_id", "domain").distinct().join(lengths, "file_id", "left").select(
        "file_id", "domain", F.coalesce("last", F.lit(0)).alias("last")
    )
    rest = F.expr("substring(line, 11)")
    loopback = (
        numbered.filter(F.col("line").rlike(LOOPBACK_LINE))
        .select("file_id", block_of(F.col("line_no"), block_lines).alias("block"), rest.alias("rest"))
        .distinct()
    )
    spread = over_blocks(todo, F.lit(1), F.col("last"), block_lines).select("file_id", "block", "domain")
    present = (
        loopback.join(spread, ["file_id", "block"])
        .filter(F.col("rest").contains(F.col("domain")))
        .select("file_id", "domain")
        .distinct()
    )
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("domain"))
    absent = todo.join(present, ["file_id", "domain"], "left_anti").withColumn("nth", nth)
    added = absent.select(
        "file_id",
        (F.col("last") + F.col("nth")).alias("line_no"),
        F.concat(F.lit(LOOPBACK_NEW), F.col("domain")).alias("line"),
    )
    return numbered.unionByName(added)


def required_modules(hosts: DataFrame) -> DataFrame:
    """[host_id, item]: two modules per host, four where ``ssl`` is true."""
    plain = F.array(*[F.lit(m) for m in MODULES])
    full = F.array(*[F.lit(m) for m in MODULES + SSL_MODULES])
    items = F.when(F.coalesce("ssl", F.lit(False)), full).otherwise(plain)
    return hosts.select("host_id", F.explode(items).alias("item"))


def listed_modules(lines: DataFrame) -> DataFrame:
    """[host_id, item] from a web server's module listing [host_id, line], as `` ssl_module (shared)``."""
    name = F.regexp_extract("line", MODULE_LINE, 1)
    return lines.select("host_id", name.alias("item")).filter(F.col("item") != "")


def missing_items(required: DataFrame, loaded: DataFrame) -> DataFrame:
    """[host_id, item]: what is required on a host and not loaded there.

    The loaded side is made distinct first: copies merge before the shuffle, and the join
    reuses that shuffle's partitioning.
    """
    have = loaded.select("host_id", "item").distinct()
    return required.select("host_id", "item").join(have, ["host_id", "item"], "left_anti")
