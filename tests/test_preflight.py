import pytest

from fleetops.operators.preflight import preflight_report, preflight_verdict
from tests.helpers import sorted_rows, table

SCHEMA = (
    "host_id BIGINT, os_id STRING, os_version STRING, db_running BOOLEAN, client_present BOOLEAN,"
    " ui_installed BOOLEAN, web_present BOOLEAN, web_running BOOLEAN, ui_reachable BOOLEAN"
)


def levels(spark, script, *facts):
    report = preflight_report(table(spark, SCHEMA, (1, *facts)), script)
    return {r.check: r.level for r in report.collect()}


def test_unknown_system(spark):
    facts = (None, None, None, None, None, None, None, None)
    assert levels(spark, "install", *facts) == {
        "os": "fail",
        "os_version": "warn",
        "existing_database": "pass",
        "existing_web_ui": "pass",
    }
    assert levels(spark, "upgrade", *facts) == {
        "os": "warn",
        "os_version": "warn",
        "web_ui_package": "fail",
        "web_server_running": "fail",
    }


def test_all_well(spark):
    facts = ("ubuntu", "24.04", False, False, True, True, True, True)
    assert set(levels(spark, "domain", *facts).values()) == {"pass"}
    assert set(levels(spark, "upgrade", *facts).values()) == {"pass"}


def test_service_and_client_are_one_finding(spark):
    assert levels(spark, "install", "ubuntu", "24.04", True, None, False, True, True, True)["existing_database"] == "warn"
    assert levels(spark, "install", "ubuntu", "24.04", None, True, False, True, True, True)["existing_database"] == "warn"


def test_verdict_and_skip(spark):
    facts = table(spark, SCHEMA, (1, "debian", "24.04", False, False, True, True, True, True))
    assert sorted_rows(preflight_verdict(preflight_report(facts))) == [
        (1, "domain", True, True),
        (1, "install", False, True),
        (1, "upgrade", True, True),
    ]
    skipped = preflight_report(facts, skip=["upgrade"])
    assert {r.script for r in skipped.collect()} == {"install", "domain"}
    assert preflight_report(facts, "upgrade", skip=["upgrade"]).collect() == []
    with pytest.raises(ValueError):
        preflight_report(facts, "other")
