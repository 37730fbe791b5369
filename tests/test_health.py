from fleetops.operators.health import health_report, judge_checks
from tests.helpers import sorted_rows, table

SCHEMA = "host_id BIGINT, check_kind STRING, http_code STRING, fallback_code STRING"


def test_judgement(spark):
    rows = [
        ("default_url", "301", None, False, "error"),
        ("custom_domain", "301", None, True, None),
        ("custom_https", "000", "200", True, None),
        ("custom_https", "000", "301", False, "warning"),
        ("custom_https", None, None, False, "warning"),
        ("domain_https", "302", None, True, None),
        ("domain_https", "503", "200", False, "error"),
        ("something", "200", None, None, None),
    ]
    df = judge_checks(table(spark, SCHEMA, *[(i, k, c, f) for i, (k, c, f, _, _) in enumerate(rows)]))
    assert sorted_rows(df, "host_id", "passed", "severity") == [(i, r[3], r[4]) for i, r in enumerate(rows)]


def test_report(spark):
    checks = table(
        spark,
        "host_id BIGINT, check_kind STRING, http_code STRING",
        (1, "install_url", "500"),
        (1, "default_url", "200"),
        (2, "after_rollback", "000"),
        (2, "after_rollback", "200"),
    )
    assert sorted_rows(health_report(checks)) == [(1, True, 0, 1), (2, False, 1, 0)]


def test_states_of_services_and_files(spark):
    rows = [
        ("web_server_running", "active", True, None),
        ("web_server_running", "absent", False, "error"),
        ("database_connection", "ok", True, None),
        ("database_running", None, False, "error"),
        ("custom_database", "absent", False, "warning"),
        ("storage_writable", "writable", True, None),
        ("data_file", "absent", False, "warning"),
        ("web_config_present", "absent", False, "error"),
        ("web_server_after_rollback", "200", False, "error"),
    ]
    df = judge_checks(table(spark, SCHEMA, *[(i, k, c, None) for i, (k, c, _, _) in enumerate(rows)]))
    assert sorted_rows(df, "host_id", "passed", "severity") == [(i, r[2], r[3]) for i, r in enumerate(rows)]
