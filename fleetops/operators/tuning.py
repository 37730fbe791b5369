"""Recommended server settings for every host of the fleet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# RAM in MB below which a host is in the tier; from the last one on it is "high".
TIER_LIMITS_MB = {"low": 2048, "medium": 8192}

# Settings by tier. For "high" the two cache sizes follow the host's RAM.
# For "custom" these are the defaults under the host's own overrides.
TIER_SETTINGS = {
    "low": {
        "shared_buffers": "256MB",
        "effective_cache_size": "1GB",
        "maintenance_work_mem": "64MB",
        "work_mem": "4MB",
        "max_connections": "100",
        "max_wal_size": "1GB",
        "min_wal_size": "80MB",
    },
    "medium": {
        "shared_buffers": "1GB",
        "effective_cache_size": "3GB",
        "maintenance_work_mem": "256MB",
        "work_mem": "16MB",
        "max_connections": "200",
        "max_wal_size": "2GB",
        "min_wal_size": "1GB",
    },
    "high": {
        "maintenance_work_mem": "512MB",
        "work_mem": "32MB",
        "max_connections": "300",
        "max_wal_size": "4GB",
        "min_wal_size": "2GB",
    },
    "custom": {
        "shared_buffers": "256MB",
        "effective_cache_size": "1GB",
        "maintenance_work_mem": "64MB",
        "work_mem": "4MB",
        "max_connections": "100",
        "max_wal_size": "1GB",
        "min_wal_size": "80MB",
    },
}

# What "high" takes from the host's RAM instead.
HIGH_FROM_RAM = {
    "shared_buffers": "concat(ram_mb div 4, 'MB')",
    "effective_cache_size": "concat(ram_mb * 3 div 4, 'MB')",
}

# Settings that do not depend on the tier.
COMMON_SETTINGS = {
    "checkpoint_completion_target": "0.9",
    "wal_buffers": "16MB",
    "default_statistics_target": "100",
}

# Settings by disk type.
DISK_SETTINGS = {
    "random_page_cost": {"SSD": "1.1", "HDD": "4.0"},
    "effective_io_concurrency": {"SSD": "200", "HDD": "2"},
}

# The order in which settings are written, and whether the value is quoted.
WRITTEN_SETTINGS = [
    ("shared_buffers", True),
    ("effective_cache_size", True),
    ("maintenance_work_mem", True),
    ("work_mem", True),
    ("max_connections", False),
    ("max_wal_size", True),
    ("min_wal_size", True),
    ("checkpoint_completion_target", False),
    ("wal_buffers", True),
    ("default_statistics_target", False),
    ("random_page_cost", False),
    ("effective_io_concurrency", False),
]

SETTING_NAMES = [name for name, _ in WRITTEN_SETTINGS]


def host_resources(hosts: DataFrame) -> DataFrame:
    """[host_id, ram_mb, ram_gb, cpu_cores, disk_type]; a missing rotational flag means HDD."""
    return hosts.selectExpr(
        "host_id",
        "mem_total_kb div 1024 AS ram_mb",
        "mem_total_kb div 1024 div 1024 AS ram_gb",
        "cpu_cores",
        "CASE WHEN rotational = 0 THEN 'SSD' ELSE 'HDD' END AS disk_type",
    )


def fleet_tuning(hosts: DataFrame) -> DataFrame:
    """One row per host: the tier, the disk type, twelve settings and a status.

    ``hosts`` has host_id, mem_total_kb, rotational, profile and any of the override
    columns ``custom_<setting>``. A host whose profile is not known keeps its row with
    null settings. A single projection: no shuffle, and only the named columns are read.
    """
    low, medium = TIER_LIMITS_MB["low"], TIER_LIMITS_MB["medium"]
    tiers = ", ".join(f"'{t}'" for t in TIER_SETTINGS)
    facts = (
        hosts.withColumn("ram_mb", F.expr("mem_total_kb div 1024"))
        .withColumn("asked", F.expr("coalesce(nullif(profile, ''), 'auto')"))
        .withColumn(
            "tier",
            F.expr(
                f"CASE WHEN asked <> 'auto' THEN asked WHEN ram_mb < {low} THEN 'low'"
                f" WHEN ram_mb < {medium} THEN 'medium' WHEN ram_mb >= {medium} THEN 'high' END"
            ),
        )
        .withColumn("disk_type", F.expr("CASE WHEN rotational = 0 THEN 'SSD' ELSE 'HDD' END"))
        .withColumn(
            "status",
            F.expr(
                "CASE WHEN tier IS NULL OR (tier = 'high' AND ram_mb IS NULL) THEN 'unknown_ram'"
                f" WHEN tier IN ({tiers}) THEN 'ok' ELSE 'unknown_profile' END"
            ),
        )
    )
    settings = [
        f"CASE WHEN status = 'ok' THEN {_setting(name, hosts.columns)} END AS {name}" for name in SETTING_NAMES
    ]
    return facts.selectExpr("host_id", "tier", "disk_type", *settings, "status")


def _setting(name: str, columns: list[str]) -> str:
    """The value of a setting as SQL over tier, disk_type, ram_mb and the host's overrides."""

    def or_own(default: str) -> str:
        own = f"custom_{name}"
        return f"coalesce(nullif({own}, ''), {default})" if own in columns else default

    if name in COMMON_SETTINGS:
        return or_own(f"'{COMMON_SETTINGS[name]}'")
    if name in DISK_SETTINGS:
        by_disk = DISK_SETTINGS[name]
        return or_own(f"CASE disk_type WHEN 'SSD' THEN '{by_disk['SSD']}' ELSE '{by_disk['HDD']}' END")
    values = {tier: f"'{settings[name]}'" for tier, settings in TIER_SETTINGS.items() if name in settings}
    values["custom"] = or_own(values["custom"])
    if name in HIGH_FROM_RAM:
        values["high"] = HIGH_FROM_RAM[name]
    return "CASE tier " + " ".join(f"WHEN '{tier}' THEN {value}" for tier, value in values.items()) + " END"


def tuned_params_long(tuning: DataFrame) -> DataFrame:
    """[host_id, ord, name, value]: twelve rows per host, values as they are written.

    Hosts without a usable profile have no settings and therefore no rows.
    """
    rows = ", ".join(
        f"struct({i}L AS ord, '{name}' AS name, {_quote(name) if quoted else name} AS value)"
        for i, (name, quoted) in enumerate(WRITTEN_SETTINGS, start=1)
    )
    return tuning.filter("status = 'ok'").selectExpr("host_id", f"inline(array({rows}))")


def _quote(name: str) -> str:
    return f"concat('\\'', {name}, '\\'')"
