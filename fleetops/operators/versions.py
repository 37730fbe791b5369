"""Package versions: what is installed, what is offered, and what a change would be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetops.functions.text import field, is_blank

# The target that means the newest offer, the listing mark of an installed
# package, the label of the old version in a backup's state file, and that of the offer in
# a package's policy listing.
LATEST = "latest"
INSTALLED_MARK = "ii"
OLD_VERSION_LABEL = "Old Version:"
CANDIDATE_LABEL = "Candidate"

UNRANKED = (1 << 63) - 1


def first_version_by_prefix(candidates: DataFrame) -> DataFrame:
    """[package, prefix, new_version]: the first listed version for every prefix.

    The empty prefix stands for the newest offer, the first version listed at all.
    Matching targets to candidates pair by pair would be quadratic within a package, so
    each version is expanded to its own prefixes instead, after copies of it have been
    merged: the work is linear in the number of different versions. Ranks are numbers, and
    so hash; the version of a rank is joined to it afterwards. Of versions with one rank,
    the first by name counts. Versions without a rank come after all others.
    """
    rank = F.coalesce(F.min("listing_rank"), F.lit(UNRANKED))
    versions = candidates.groupBy("package", "version").agg(rank.alias("rank"))
    ends = F.sequence(F.lit(0), F.length("version"))
    prefixes = F.transform(ends, lambda n: F.substring(F.col("version"), F.lit(1), n))
    first = (
        versions.select("package", "rank", F.explode(prefixes).alias("prefix"))
        .groupBy("package", "prefix")
        .agg(F.min("rank").alias("rank"))
    )
    return (
        first.join(versions, ["package", "rank"])
        .filter(F.col("version").startswith(F.col("prefix")))
        .groupBy("package", "prefix")
        .agg(F.array_min(F.collect_set("version")).alias("new_version"))
    )


def resolve_versions(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """[host_id, package, installed_version, new_version, status] for every target.

    ``targets`` is [host_id, package, installed_version, target_version, force_upgrade],
    ``candidates`` [package, listing_rank, version]. The target is a literal prefix with
    no boundary; a blank or null one finds nothing. Status is available, up_to_date,
    not_found or undetermined.

    The offers hold one row per package and prefix, and targets meet them in one
    equi-join. A target that very many hosts share makes one large partition of the
    targets, which AQE splits, as only the targets' side is large. The join has a key of
    its own: on the columns that the offers are grouped by, it would take over their
    partitioning, and AQE could not split.
    """
    offers = first_version_by_prefix(candidates)
    latest = F.col("target_version") == LATEST
    target = F.when(~is_blank(F.col("target_version")), F.col("target_version"))
    wanted = targets.withColumn("prefix", F.when(latest, F.lit("")).otherwise(target))
    same = F.col("new_version") == F.col("installed_version")
    forced = F.coalesce(F.col("force_upgrade") == "yes", F.lit(False))
    key = F.concat("package", F.lit("\n"), "prefix").alias("offer")
    by_key = offers.select(key, "new_version")
    return wanted.withColumn("offer", key).join(by_key, "offer", "left").select(
        "host_id",
        "package",
        "installed_version",
        "new_version",
        F.when(F.col("new_version").isNull() & latest, "undetermined")
        .when(F.col("new_version").isNull(), "not_found")
        .when(same & ~forced, "up_to_date")
        .otherwise("available")
        .alias("status"),
    )


def version_change(resolved: DataFrame) -> DataFrame:
    """[host_id, change]: major, minor or up_to_date; a target without a version keeps its status.

    Versions are only compared for equality, so going back to an older one counts as well.
    """

    def major(column: str):
        return F.split_part(F.col(column), F.lit("."), F.lit(1))

    return resolved.select(
        "host_id",
        F.when(F.col("status") != "available", F.col("status"))
        .when(major("installed_version") != major("new_version"), "major")
        .otherwise("minor")
        .alias("change"),
    )


def installed_version(
    listing: DataFrame, package: str, marked_only: bool = False, key: str = "host_group"
) -> DataFrame:
    """[host, version]: third field of the first line that contains the package name.

    The name may be part of a longer one. With ``marked_only`` the line must also begin
    with the mark of an installed package. Hosts without such a line have a null version.
    """
    hit = F.col("line").contains(package)
    if marked_only:
        hit = hit & F.col("line").startswith(INSTALLED_MARK)
    return _field_of_first(listing, hit, 3, key)


def backed_up_version(state_lines: DataFrame, key: str = "backup_id") -> DataFrame:
    """[backup, version]: the old version that a backup's state file names, else null."""
    return _field_of_first(state_lines, F.col("line").startswith(OLD_VERSION_LABEL), 3, key)


def candidate_version(policy_lines: DataFrame, key: str = "host_id") -> DataFrame:
    """[host, version]: what the package manager would install, from its policy listing."""
    return _field_of_first(policy_lines, F.col("line").contains(CANDIDATE_LABEL), 2, key)


def _field_of_first(lines: DataFrame, hit: Column, n: int, key: str) -> DataFrame:
    """[key, version] for every key, in one pass.

    Only the field of the hits goes on, and each task keeps one row per key before the
    shuffle: its first hit, or any row where it has none.
    """
    found = lines.select(key, F.when(hit, F.col("line_no")).alias("at"), F.when(hit, field(F.col("line"), n)).alias("version"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.col("at").asc_nulls_last()))
    return found.withColumn("nth", nth).filter(F.col("nth") == 1).select(key, "version")
