"""Judging connectivity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Per kind of check, the accepted answers (HTTP codes, or states of what is
# checked on the host), those accepted on the fallback path, and what a failure counts as.
CHECK_KINDS = {
    "install_url": (["200", "302"], [], "warning"),
    "default_url": (["200", "302"], [], "error"),
    "custom_domain": (["200", "301", "302"], [], "warning"),
    "custom_https": (["200", "301", "302"], ["200", "302"], "warning"),
    "after_rollback": (["200", "302"], [], "error"),
    "domain_http": (["200", "301", "302"], [], "warning"),
    "domain_https": (["200", "302"], [], "error"),
    "web_server_running": (["active"], [], "error"),
    "web_config_present": (["present"], [], "error"),
    "database_running": (["active"], [], "error"),
    "database_connection": (["ok"], [], "error"),
    "custom_database": (["present"], [], "warning"),
    "storage_writable": (["writable"], [], "warning"),
    "data_file": (["present"], [], "warning"),
    "web_server_after_rollback": (["active"], [], "error"),
}


def judge_checks(checks: DataFrame) -> DataFrame:
    """Adds ``passed`` and ``severity`` (error, warning or null) to each check.

    ``checks`` has check_kind, http_code (for checks of services, files and databases the
    state found) and optionally fallback_code. A check of an unknown kind can be neither
    passed nor failed and gets nulls.
    """

    def accepted(column: str, codes: list[str]) -> str:
        return f"coalesce({column} IN ({', '.join(f'{c!r}' for c in codes)}), false)"

    tests, levels = [], []
    for kind, (codes, fallback_codes, level) in CHECK_KINDS.items():
        test = accepted("http_code", codes)
        if fallback_codes and "fallback_code" in checks.columns:
            test += " OR " + accepted("fallback_code", fallback_codes)
        tests.append(f"WHEN '{kind}' THEN {test}")
        levels.append(f"WHEN '{kind}' THEN '{level}'")
    judged = checks.withColumn("passed", F.expr(f"CASE check_kind {' '.join(tests)} END"))
    return judged.withColumn("severity", F.expr(f"CASE WHEN NOT passed THEN CASE check_kind {' '.join(levels)} END END"))


def health_report(checks: DataFrame) -> DataFrame:
    """[host_id, ok, errors, warnings]: ok means no failure of level error.

    Only counts are kept per host, so the map side reduces even a very busy host to one row.
    """
    errors = F.count_if(F.col("severity") == "error")
    return (
        judge_checks(checks)
        .groupBy("host_id")
        .agg(
            (errors == 0).alias("ok"),
            errors.alias("errors"),
            F.count_if(F.col("severity") == "warning").alias("warnings"),
        )
    )
