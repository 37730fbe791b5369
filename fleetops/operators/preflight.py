"""Checks made on a host before a run starts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The system the runs are made for.
OS_ID = "ubuntu"
OS_VERSION = "24.04"

SCRIPTS = ("install", "upgrade", "domain")


def _failed_unless(test: str) -> str:
    return f"if({test}, 'pass', 'fail')"


def _warned_if(test: str) -> str:
    return f"if({test}, 'warn', 'pass')"


def _checks(script: str) -> dict[str, str]:
    """The checks of a script as SQL over the host facts; an unknown fact counts as false."""
    common = {
        "os": f"if(os_id = '{OS_ID}', 'pass', '{'fail' if script == 'install' else 'warn'}')",
        "os_version": f"if(os_version = '{OS_VERSION}', 'pass', 'warn')",
    }
    if script == "install":
        # A running service and an installed client are one finding.
        return common | {
            "existing_database": _warned_if("db_running OR client_present"),
            "existing_web_ui": _warned_if("ui_installed"),
        }
    if script == "upgrade":
        return common | {
            "web_ui_package": _failed_unless("ui_installed"),
            "web_server_running": _failed_unless("web_running"),
        }
    if script == "domain":
        return common | {
            "web_server_present": _failed_unless("web_present"),
            "web_server_running": _failed_unless("web_running"),
            "web_ui_reachable": _failed_unless("ui_reachable"),
        }
    raise ValueError(f"unknown script: {script}")


def preflight_report(
    facts: DataFrame, scripts: str | Sequence[str] = SCRIPTS, skip: Sequence[str] = ()
) -> DataFrame:
    """[host_id, script, check, level] with level pass, warn or fail.

    Every check is reported, also after a failing one. ``skip`` leaves out the checks of
    the scripts it names. One pass over the facts: no join and no shuffle.
    """
    chosen = [scripts] if isinstance(scripts, str) else list(scripts)
    rows = [
        f"struct('{s}' AS script, '{name}' AS check, {level} AS level)"
        for s in chosen
        for name, level in _checks(s).items()
        if s not in skip
    ]
    if not rows:
        nothing = "array(struct('' AS script, '' AS check, '' AS level))"
        return facts.selectExpr("host_id", f"inline({nothing})").filter(F.lit(False))
    return facts.selectExpr("host_id", f"inline(array({', '.join(rows)}))")


def preflight_verdict(report: DataFrame) -> DataFrame:
    """[host_id, script, can_run, must_confirm]: no check fails; one at least warns."""
    return report.groupBy("host_id", "script").agg(
        (~F.bool_or(F.col("level") == "fail")).alias("can_run"),
        F.bool_or(F.col("level") == "warn").alias("must_confirm"),
    )
