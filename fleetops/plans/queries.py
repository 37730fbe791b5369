"""The registered queries: every job over its whole derived input."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetops.operators import backups, catalog, conf, fingerprints, health, lines, logs, preflight, presence, settings, tuning
from fleetops.operators import versions
from fleetops.plans import views
from fleetops.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the queries below; the checking SQL uses the same.
DESIRED = [("work_mem", "'16MB'"), ("shared_buffers", "'1GB'"), ("max_connections", "200")]
DATABASES = ["myappdb", "postgres", "reports"]
PACKAGE = "pgadmin4-web"
NEEDLE = "data"
PATTERN = "[Tt]he "
AFTER = 3
LINES = 5
NOW = datetime(2001, 1, 1)
COMPONENTS = ["etc", "data", "web"]
SWITCHES = {"data": "keep_data", "web": "keep_web"}


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return tuning.tuned_params_long(tuning.fleet_tuning(views.hosts(spark, sf)))


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return versions.resolve_versions(views.pkg_targets(spark, sf), views.pkg_candidates(spark, sf))


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return logs.parse_run_logs(views.log_lines(spark, sf))


def _crlf(spark: SparkSession, sf: str) -> DataFrame:
    end = F.when(F.col("line_no") % 3 == 0, F.lit("\r")).otherwise(F.lit(""))
    return views.doc_lines(spark, sf).withColumn("line", F.concat("line", end))


def _wanted_databases(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in DATABASES])
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("host_id"), F.explode(names).alias("name"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return views.documents(spark, sf).withColumnRenamed("file", "file_id")


def apply_tuning(spark: SparkSession, sf: str) -> DataFrame:
    """Every host's recommended settings written into that host's configuration lines."""
    desired = _long(spark, sf).withColumnRenamed("host_id", "file_id")
    return settings.upsert_params(views.conf_lines(spark, sf), desired, tuning.SETTING_NAMES)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return logs.segment_runs(views.appended_lines(spark, sf))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return views.backups(spark, sf).withColumn("part", F.col("host_id") % 20)


def appended_run_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """How each run ended that was appended to a log."""
    return logs.run_outcomes(logs.parse_run_logs(_runs(spark, sf).withColumnRenamed("line_no", "seq")))


def differing_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Where a copy of a table is not the table."""
    one, two = (fingerprints.fingerprints(t, ["part"]) for t in (_parts(spark, sf), views.copied_backups(spark, sf)))
    return fingerprints.differing(one, two, ["part"])


QUERIES: dict[str, Query] = {
    "fleet_tuning": lambda s, d: tuning.fleet_tuning(views.hosts(s, d)),
    "host_resources": lambda s, d: tuning.host_resources(views.hosts(s, d)),
    "tuned_params_long": _long,
    "upsert_params": lambda s, d: settings.upsert_params(views.conf_lines(s, d), DESIRED),
    "apply_tuning": apply_tuning,
    "settings_lookup": lambda s, d: settings.settings_lookup(views.settings(s, d), _long(s, d)),
    "show_settings": lambda s, d: settings.show_settings(views.settings(s, d), ["shared_buffers", "max_connections"]),
    "config_folders": lambda s, d: settings.config_folders(views.config_files(s, d)),
    "parse_conf": lambda s, d: conf.parse_conf(views.conf_texts(s, d)),
    "validate_conf": lambda s, d: conf.validate_conf(views.conf_values(s, d), files=views.conf_files(s, d)),
    "first_failures": lambda s, d: conf.first_failures(
        conf.validate_conf(views.conf_values(s, d), ["install"], files=views.conf_files(s, d))
    ),
    "insert_if_absent": lambda s, d: presence.insert_if_absent(views.host_lines(s, d), views.wanted_domains(s, d)),
    "listed_modules": lambda s, d: presence.listed_modules(views.module_lines(s, d)),
    "missing_items": lambda s, d: presence.missing_items(
        presence.required_modules(views.ssl_hosts(s, d)), views.loaded_modules(s, d)
    ),
    "preflight_report": lambda s, d: preflight.preflight_report(views.host_facts(s, d)),
    "preflight_verdict": lambda s, d: preflight.preflight_verdict(preflight.preflight_report(views.host_facts(s, d))),
    "resolve_versions": _resolved,
    "version_change": lambda s, d: versions.version_change(_resolved(s, d)),
    "installed_version": lambda s, d: versions.installed_version(views.pkg_listing(s, d), PACKAGE),
    "installed_version_marked": lambda s, d: versions.installed_version(
        views.pkg_listing(s, d), PACKAGE, marked_only=True
    ),
    "backed_up_version": lambda s, d: versions.backed_up_version(views.state_lines(s, d)),
    "candidate_version": lambda s, d: versions.candidate_version(views.policy_lines(s, d)),
    "judge_checks": lambda s, d: health.judge_checks(views.health_checks(s, d)),
    "health_report": lambda s, d: health.health_report(views.health_checks(s, d)),
    "parse_run_logs": _parsed,
    "run_outcomes": lambda s, d: logs.run_outcomes(_parsed(s, d)),
    "table_size_report": lambda s, d: catalog.table_size_report(views.table_sizes(s, d)),
    "database_size_report": lambda s, d: catalog.database_size_report(views.table_sizes(s, d)),
    "activity_scan": lambda s, d: catalog.activity_scan(table(s, d, "events")),
    "list_databases": lambda s, d: catalog.list_databases(views.db_listing(s, d)),
    "database_exists": lambda s, d: catalog.database_exists(views.db_listing(s, d), DATABASES),
    "database_exists_exact": lambda s, d: catalog.database_exists_exact(
        views.db_listing(s, d), _wanted_databases(s, d)
    ),
    "manifest": lambda s, d: backups.manifest(
        views.snapshot_hosts(s, d), views.snapshot_parts(s, d), COMPONENTS, SWITCHES
    ),
    "backup_inventory_sizes": lambda s, d: backups.backup_sizes(views.backups(s, d)),
    "backup_inventory_latest": lambda s, d: backups.backup_latest(views.backups(s, d)),
    "backup_inventory_expired": lambda s, d: backups.backup_expired(views.backups(s, d), NOW),
    "backup_inventory_stamps": lambda s, d: backups.backup_stamps(views.backup_names(s, d)),
    "find_references": lambda s, d: lines.find_references(views.documents(s, d), NEEDLE),
    "find_references_summary": lambda s, d: lines.reference_summary(views.documents(s, d), NEEDLE),
    "rewrite_lines_endings": lambda s, d: lines.fix_line_endings(_crlf(s, d)),
    "rewrite_lines_delete": lambda s, d: lines.delete_matching(views.doc_lines(s, d), PATTERN),
    "rewrite_lines_after": lambda s, d: lines.context_after_in_texts(_texts(s, d), PATTERN, AFTER),
    "rewrite_lines_first": lambda s, d: lines.first_lines(views.doc_lines(s, d), LINES),
    "segment_runs": lambda s, d: _runs(s, d).drop("line"),
    "appended_run_outcomes": appended_run_outcomes,
    "number_splits": lambda s, d: lines.number_splits(views.split_lines_of_files(s, d)),
    "table_fingerprints": lambda s, d: fingerprints.fingerprints(_parts(s, d), ["part"]),
    "differing_parts": differing_parts,
    "prune_plan": lambda s, d: backups.prune_plan(views.backups(s, d), views.backups_in_use(s, d), NOW),
    "rewrite_lines_last": lambda s, d: lines.last_lines_of_texts(_texts(s, d), LINES),
}
