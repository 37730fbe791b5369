"""Configuration files of the form ``KEY="VALUE"``: reading and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetops.functions.text import strip_cr

# Fixed value: keys containing this hold secrets; their values never leave ``parse_conf``.
SECRET_MARK = "PASSWORD"
MASK = "********"

# Fixed value: an assignment. Groups: key, "quoted", 'quoted' and bare value.
ASSIGNMENT = r"""^\s*(?:export\s+)?([A-Za-z_]\w*)=(?:"((?:[^"\\]|\\.)*)"|'([^']*)'|([^\s"']*))"""

# Fixed value: a number without sign.
DIGITS = "^[0-9]+$"

# The checks of each kind of configuration, in the order they are made.
# (rule_id, kind of configuration, check, key, argument)
RULES = [
    ("install_db_password_set", "install", "required", "POSTGRES_PASSWORD", None),
    ("install_db_password_length", "install", "min_length", "POSTGRES_PASSWORD", 8),
    ("install_ui_email_set", "install", "required", "PGADMIN_EMAIL", None),
    ("install_ui_password_set", "install", "required", "PGADMIN_PASSWORD", None),
    ("install_ui_password_length", "install", "min_length", "PGADMIN_PASSWORD", 6),
    ("upgrade_target_version_set", "upgrade", "required", "TARGET_VERSION", None),
    ("upgrade_backup_base_dir_set", "upgrade", "required", "BACKUP_BASE_DIR", None),
    ("upgrade_preserve_user_data_flag", "upgrade", "yes_no", "PRESERVE_USER_DATA", None),
    ("upgrade_auto_rollback_flag", "upgrade", "yes_no", "AUTO_ROLLBACK_ON_FAILURE", None),
    ("upgrade_dry_run_flag", "upgrade", "yes_no", "DRY_RUN", None),
    ("upgrade_backup_web_configs_flag", "upgrade", "yes_no", "BACKUP_APACHE_CONFIGS", None),
    ("upgrade_backup_ssl_certs_flag", "upgrade", "yes_no", "BACKUP_SSL_CERTS", None),
    ("upgrade_skip_preflight_flag", "upgrade", "yes_no", "SKIP_PREFLIGHT_CHECKS", None),
    ("upgrade_test_https_flag", "upgrade", "yes_no", "TEST_HTTPS", None),
    ("upgrade_force_flag", "upgrade", "yes_no", "FORCE_UPGRADE", None),
    ("upgrade_verify_timeout_number", "upgrade", "digits_if_set", "VERIFY_TIMEOUT", None),
    ("domain_name_set", "domain", "required", "DOMAIN_NAME", None),
    ("domain_enable_ssl_set", "domain", "required", "ENABLE_SSL", None),
    ("domain_enable_ssl_flag", "domain", "yes_no", "ENABLE_SSL", None),
    ("domain_ssl_country_set", "domain", "required_if_ssl", "SSL_COUNTRY", "ENABLE_SSL"),
    ("domain_ssl_state_set", "domain", "required_if_ssl", "SSL_STATE", "ENABLE_SSL"),
    ("domain_ssl_city_set", "domain", "required_if_ssl", "SSL_CITY", "ENABLE_SSL"),
    ("domain_ssl_org_set", "domain", "required_if_ssl", "SSL_ORG", "ENABLE_SSL"),
    ("domain_config_name_set", "domain", "required", "APACHE_CONFIG_NAME", None),
]


def parse_conf(files: DataFrame) -> DataFrame:
    """[file, line_no, key, value, value_len] from whole texts [file, text].

    Blank lines and comments are skipped, quotes and carriage returns removed, and the
    last assignment of a key wins. Values of secret keys are masked, their length kept.
    All lines of a file come from one row, and the last assignments are found inside it, by
    sorting the few assigned lines; nothing is shuffled.
    """

    def assignment(line: Column, at: Column) -> Column:
        groups = [F.regexp_extract(line, ASSIGNMENT, i) for i in range(1, 5)]
        # Inside double quotes a backslash only escapes these four characters.
        double = F.regexp_replace(groups[1], r'\\(["\\$`])', "$1")
        return F.struct(
            groups[0].alias("key"),
            (at + 1).cast("bigint").alias("line_no"),
            F.concat(double, groups[2], groups[3]).alias("value"),
        )

    lines = F.transform(F.split("text", "\n"), lambda line: strip_cr(line))
    numbered = F.transform(lines, lambda line, at: F.struct(line.alias("line"), at.alias("at")))
    kept = F.filter(numbered, lambda x: x["line"].rlike(ASSIGNMENT))
    in_order = F.array_sort(F.transform(kept, lambda x: assignment(x["line"], x["at"])))
    following = lambda i: F.get("in_order", i + 1)["key"]
    final = F.filter("in_order", lambda x, i: ~following(i).eqNullSafe(x["key"]))
    secret = F.col("key").contains(SECRET_MARK)
    return (
        files.select("file", in_order.alias("in_order"))
        .select("file", F.inline(final))
        .select(
            "file",
            "line_no",
            "key",
            F.when(secret, F.lit(MASK)).otherwise(F.col("value")).alias("value"),
            F.length("value").cast("bigint").alias("value_len"),
        )
    )


def validate_conf(
    conf: DataFrame, kinds: Sequence[str] | None = None, key: str = "file_id", files: DataFrame | None = None
) -> DataFrame:
    """[file, rule_ord, rule_id, key, ok]: every rule for every file.

    ``files`` lists all files, one row each; without it, files that assign nothing have no
    row anywhere and are not judged.

    ``conf`` is [file, key, value] with one row per file and key; ``value_len`` is used
    for the length rules where present, since secrets arrive masked. A key without a row
    counts as empty. All rules are reported; the lowest failing ``rule_ord`` is the one
    that a checker stopping at the first failure would name.

    One aggregation of booleans per file; the rules are literals, so nothing is joined.
    """
    chosen = [(i, r) for i, r in enumerate(RULES, start=1) if kinds is None or r[1] in kinds]
    sized = conf if "value_len" in conf.columns else conf.withColumn("value_len", F.length("value"))

    facts: dict[str, str] = {}

    def seen(key_name: str, label: str, test: str) -> str:
        """The name of a boolean per file: is there a row of this key that passes the test?"""
        column = f"{label}_{key_name}"
        facts[column] = f"bool_or(key = '{key_name}' AND coalesce({test}, false)) AS {column}"
        return column

    verdicts = []
    for rule_ord, (rule_id, _, check, name, arg) in chosen:
        if check == "required":
            ok = seen(name, "filled", "value_len > 0")
        elif check == "min_length":
            ok = seen(name, f"long{arg}", f"value_len >= {arg}")
        elif check == "yes_no":
            ok = seen(name, "flag", "value IN ('yes', 'no')")
        elif check == "digits_if_set":
            ok = "NOT " + seen(name, "bad_number", f"value_len > 0 AND NOT rlike(value, '{DIGITS}')")
        else:
            on = seen(arg, "on", "value = 'yes'")
            ok = f"(NOT {on} OR {seen(name, 'filled', 'value_len > 0')})"
        verdicts.append(f"struct({rule_ord}L AS rule_ord, '{rule_id}' AS rule_id, '{name}' AS key, {ok} AS ok)")

    # A null key makes a test null, not false.
    per_file = sized.groupBy(key).agg(*[F.expr(f) for f in facts.values()])
    if files is not None:
        per_file = files.select(key).join(per_file, key, "left")
    per_file = per_file.na.fill(False, subset=list(facts))
    return per_file.selectExpr(key, f"inline(array({', '.join(verdicts)}))")


def first_failures(report: DataFrame, key: str = "file_id") -> DataFrame:
    """[file, rule_ord, rule_id]: the rule each failing file fails first."""
    first = report.filter(~F.col("ok")).groupBy(key).agg(F.min("rule_ord").alias("rule_ord"))
    name = F.element_at(F.array(*[F.lit(r[0]) for r in RULES]), F.col("rule_ord").cast("int"))
    return first.select(key, "rule_ord", name.alias("rule_id"))
