from fleetops.operators.conf import MASK, RULES, first_failures, parse_conf, validate_conf
from fleetops.sources.text import ingest_conf, read_lines
from tests.helpers import sorted_rows, table


def parsed(spark, text):
    rows = sorted_rows(parse_conf(table(spark, "file STRING, text STRING", ("f", text))))
    return {key: (line_no, value, length) for _, line_no, key, value, length in rows}


def test_last_assignment_wins_without_carriage_return(spark):
    assert parsed(spark, 'A="1"\r\nA="2"\r\n') == {"A": (2, "2", 1)}


def test_comments_and_blanks_are_skipped(spark):
    assert parsed(spark, '# A="3"\n\nB=10\n  #C=1') == {"B": (3, "10", 2)}


def test_secrets_are_masked_but_measured(spark):
    assert parsed(spark, 'X_PASSWORD="secret12"') == {"X_PASSWORD": (1, MASK, 8)}


def test_forms_of_values(spark):
    text = "A='it # stays'\nB=\"say \\\"hi\\\"\" # note\nC=\nexport D=x#y\nE = 1\nF=\"\"\n"
    got = {k: v[1] for k, v in parsed(spark, text).items()}
    assert got == {"A": "it # stays", "B": 'say "hi"', "C": "", "D": "x#y", "F": ""}


def test_ingest_reads_files(spark, tmp_path):
    (tmp_path / "one.conf").write_bytes(b'KEY="a"\r\nMY_PASSWORD="12345"\r\n')
    (tmp_path / "two.conf").write_bytes(b"KEY=b\nKEY=c\n")
    rows = [(f.rsplit("/", 1)[-1], *rest) for f, *rest in sorted_rows(ingest_conf(spark, str(tmp_path), "*.conf"))]
    assert rows == [
        ("one.conf", 1, "KEY", "a", 1),
        ("one.conf", 2, "MY_PASSWORD", MASK, 5),
        ("two.conf", 2, "KEY", "c", 1),
    ]


def test_read_lines_numbers_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\n\r\nthree\r\n")
    assert sorted_rows(read_lines(spark, str(tmp_path)), "line_no", "line") == [(1, "one"), (2, ""), (3, "three")]


def verdict(spark, rule_id, *rows):
    conf = table(spark, "file_id BIGINT, key STRING, value STRING", (1, "UNRELATED", "x"), *[(1, *r) for r in rows])
    report = validate_conf(conf).filter(f"rule_id = '{rule_id}'")
    return report.collect()[0].ok


def test_lengths(spark):
    assert not verdict(spark, "install_db_password_length", ("POSTGRES_PASSWORD", "1234567"))
    assert verdict(spark, "install_db_password_length", ("POSTGRES_PASSWORD", "12345678"))
    assert not verdict(spark, "install_db_password_length")


def test_flags(spark):
    assert verdict(spark, "upgrade_dry_run_flag", ("DRY_RUN", "no"))
    assert not verdict(spark, "upgrade_dry_run_flag", ("DRY_RUN", "YES"))
    assert not verdict(spark, "upgrade_dry_run_flag")


def test_timeout(spark):
    rule = "upgrade_verify_timeout_number"
    assert verdict(spark, rule, ("VERIFY_TIMEOUT", "0"))
    assert not verdict(spark, rule, ("VERIFY_TIMEOUT", "-1"))
    assert verdict(spark, rule, ("VERIFY_TIMEOUT", ""))
    assert verdict(spark, rule)


def test_ssl_details_only_matter_with_ssl(spark):
    rule = "domain_ssl_state_set"
    assert verdict(spark, rule, ("ENABLE_SSL", "no"))
    assert not verdict(spark, rule, ("ENABLE_SSL", "yes"))
    assert verdict(spark, rule, ("ENABLE_SSL", "yes"), ("SSL_STATE", "x"))


def test_null_values_count_as_empty(spark):
    assert not verdict(spark, "install_ui_email_set", ("PGADMIN_EMAIL", None))


def test_masked_secrets_validate_by_length(spark):
    texts = table(spark, "file STRING, text STRING", ("f", "POSTGRES_PASSWORD=1234567\nPGADMIN_PASSWORD=123456\n"))
    report = validate_conf(parse_conf(texts), ["install"], key="file")
    got = {r.rule_id: r.ok for r in report.collect()}
    assert got == {
        "install_db_password_set": True,
        "install_db_password_length": False,
        "install_ui_email_set": False,
        "install_ui_password_set": True,
        "install_ui_password_length": True,
    }
    assert sorted_rows(first_failures(report, "file")) == [("f", 2, "install_db_password_length")]


def test_rule_ids_are_unique():
    assert len({r[0] for r in RULES}) == len(RULES)


def test_files_without_assignments_are_judged(spark):
    conf = table(spark, "file_id BIGINT, key STRING, value STRING", (1, "DOMAIN_NAME", "x"))
    files = table(spark, "file_id BIGINT", (1,), (2,))
    report = validate_conf(conf, ["domain"], files=files)
    assert sorted_rows(first_failures(report)) == [(1, 18, "domain_enable_ssl_set"), (2, 17, "domain_name_set")]
    assert report.filter("file_id = 2 AND rule_id = 'domain_ssl_city_set'").first()["ok"] is True


def test_last_assignment_of_many(spark):
    text = "\n".join(f"K{i % 7}={i}" for i in range(100)) + "\n# K1=x\n"
    got = sorted_rows(parse_conf(table(spark, "file STRING, text STRING", ("f", text), ("g", ""), ("h", None))))
    assert got == sorted(("f", i + 1, f"K{i % 7}", str(i), 2) for i in range(93, 100))
