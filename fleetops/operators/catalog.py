"""Databases, tables and sessions of the fleet's servers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetops.functions.text import pretty_size, whole_word

# The schema reported on, and the separator of a database listing.
PUBLIC_SCHEMA = "public"
LISTING_SEPARATOR = "|"


def table_size_report(tables: DataFrame, schema: str = PUBLIC_SCHEMA) -> DataFrame:
    """[tablename, size] of one schema's tables, largest first, names breaking ties."""
    return (
        tables.filter(F.col("schemaname") == schema)
        .select("tablename", "bytes")
        .orderBy(F.desc("bytes"), "tablename")
        .select("tablename", pretty_size(F.col("bytes")).alias("size"))
    )


def database_size_report(tables: DataFrame) -> DataFrame:
    """[datname, size]: all tables of a database, in every schema, added up."""
    return (
        tables.groupBy("datname")
        .agg(F.sum("bytes").alias("bytes"))
        .select("datname", pretty_size(F.col("bytes")).alias("size"))
    )


def activity_scan(activity: DataFrame) -> DataFrame:
    """Every row and column, as they are."""
    return activity.select("*")


def list_databases(listing: DataFrame) -> DataFrame:
    """[host_id, name]: the different names in the first field of a host's listing."""
    first = F.trim(F.split_part(F.col("line"), F.lit(LISTING_SEPARATOR), F.lit(1)))
    return listing.select("host_id", first.alias("name")).filter(F.col("name") != "").distinct()


def database_exists(listing: DataFrame, names: Sequence[str]) -> DataFrame:
    """[host_id, name, exists]: is the name a whole word in the first field of a listing line?

    Word characters are letters, digits and ``_``, so ``app`` is found in ``app-x`` but
    not in ``app_old``. ``names`` are literals: one boolean each is aggregated per host.
    """
    first = F.split_part(F.col("line"), F.lit(LISTING_SEPARATOR), F.lit(1))
    found = [F.bool_or(whole_word(F.col("first"), n)).alias(f"found_{i}") for i, n in enumerate(names)]
    per_host = listing.select("host_id", first.alias("first")).groupBy("host_id").agg(*found)
    rows = F.array(
        *[F.struct(F.lit(n).alias("name"), F.col(f"found_{i}").alias("exists")) for i, n in enumerate(names)]
    )
    return per_host.select("host_id", F.inline(rows))


def database_exists_exact(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """[host_id, name, exists] for a table of wanted [host_id, name]: the whole name must be equal."""
    names = list_databases(listing).withColumn("_found", F.lit(True))
    return (
        wanted.select("host_id", "name")
        .join(names, ["host_id", "name"], "left")
        .select("host_id", "name", F.col("_found").isNotNull().alias("exists"))
    )
