"""Job inputs, derived from the given tables by projections only, but for one count.

The values are synthetic; the shapes are those the jobs work on. Small literal lists are
exploded inside the row, so no view needs a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetops.functions.text import stamped_name
from fleetops.operators.lines import split_lines
from fleetops.sources.tables import table

Folder = str


def _with_literals(df: DataFrame, column: str, values: list[str], ord_from: int = 0) -> DataFrame:
    """Each row once per literal, numbered in ``ord``."""
    rows = ", ".join(f"struct('{v}' AS {column}, {i} AS ord)" for i, v in enumerate(values, start=ord_from))
    return df.selectExpr("*", f"inline(array({rows}))")


def hosts(spark: SparkSession, sf: Folder) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS host_id",
        "CAST(524288 + (c_custkey * 293003) % 33554432 AS BIGINT) AS mem_total_kb",
        "CAST(c_nationkey + 1 AS INT) AS cpu_cores",
        "CASE c_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS rotational",
        "CASE c_custkey % 6 WHEN 0 THEN 'auto' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high'"
        " WHEN 4 THEN 'custom' ELSE 'turbo' END AS profile",
        "CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '2GB' END AS custom_shared_buffers",
        "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '1.1' END AS custom_random_page_cost",
    )


def host_facts(spark: SparkSession, sf: Folder) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS host_id",
        "CASE c_nationkey % 5 WHEN 0 THEN 'debian' WHEN 1 THEN NULL ELSE 'ubuntu' END AS os_id",
        "CASE WHEN c_custkey % 3 = 0 THEN '22.04' ELSE '24.04' END AS os_version",
        "c_custkey % 2 = 0 AS db_running",
        "c_custkey % 4 < 2 AS client_present",
        "c_custkey % 7 = 0 AS ui_installed",
        "c_custkey % 5 <> 0 AS web_present",
        "c_custkey % 10 > 2 AS web_running",
        "c_custkey % 11 <> 0 AS ui_reachable",
    )


def conf_lines(spark: SparkSession, sf: Folder) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS file_id",
        "CAST(l_linenumber AS BIGINT) AS line_no",
        "CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '#' WHEN 2 THEN '  # ' ELSE '  ' END"
        " || CASE l_partkey % 4 WHEN 0 THEN 'work_mem' WHEN 1 THEN 'max_connections' WHEN 2 THEN 'wal_buffers'"
        " ELSE 'maintenance_work_mem' END"
        " || ' = ' || CAST(CAST(l_quantity AS INT) AS STRING)"
        " || CASE WHEN l_returnflag = 'R' THEN '   # note' ELSE '' END AS line",
    )


def conf_files(spark: SparkSession, sf: Folder) -> DataFrame:
    """[file_id]: all configuration files, also those that assign nothing."""
    return table(spark, sf, "customer").selectExpr("c_custkey AS file_id")


def conf_values(spark: SparkSession, sf: Folder) -> DataFrame:
    keys = [
        "POSTGRES_PASSWORD",
        "PGADMIN_EMAIL",
        "PGADMIN_PASSWORD",
        "TARGET_VERSION",
        "DRY_RUN",
        "VERIFY_TIMEOUT",
        "ENABLE_SSL",
        "SSL_COUNTRY",
        "SSL_CITY",
    ]
    files = table(spark, sf, "customer").select("c_custkey")
    return (
        _with_literals(files, "key", keys)
        .filter(((F.col("c_custkey") + F.col("ord")) % 11 != 0) & (F.col("c_custkey") % 13 != 0))
        .selectExpr(
            "c_custkey AS file_id",
            "key",
            "CASE (c_custkey * 3 + ord * ord + ord) % 7 WHEN 0 THEN '' WHEN 1 THEN 'short' WHEN 2 THEN 'longenough1'"
            " WHEN 3 THEN 'yes' WHEN 4 THEN 'no' WHEN 5 THEN '10' ELSE 'abcdef' END AS value",
        )
    )


def conf_texts(spark: SparkSession, sf: Folder) -> DataFrame:
    """[file, text]: a small configuration file per customer, with Windows line ends on some."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("file"),
        F.expr(
            "'# settings of ' || c_name || chr(10)"
            " || 'TARGET_VERSION=\"' || CAST(c_nationkey AS STRING) || '\"'"
            " || CASE WHEN c_custkey % 3 = 0 THEN chr(13) ELSE '' END || chr(10) || chr(10)"
            " || '  DB_PASSWORD=\"' || c_mktsegment || '\" # keep' || chr(10)"
            " || CASE WHEN c_custkey % 2 = 0 THEN '#' ELSE '' END || 'VERIFY_TIMEOUT='"
            " || CAST(c_custkey % 60 AS STRING) || chr(10)"
            " || 'DRY_RUN=''no''' || chr(10) || 'not an assignment' || chr(10)"
            " || CASE WHEN c_custkey % 5 = 0 THEN 'TARGET_VERSION=\"latest\"' || chr(13) || chr(10) ELSE '' END"
        ).alias("text"),
    )


def settings(spark: SparkSession, sf: Folder) -> DataFrame:
    names = ["shared_buffers", "effective_cache_size", "max_connections"]
    files = table(spark, sf, "customer").select("c_custkey")
    return (
        _with_literals(files, "name", names)
        .filter((F.col("c_custkey") + F.col("ord")) % 13 != 0)
        .selectExpr(
            "c_custkey AS host_id",
            "name",
            "CASE ord WHEN 0 THEN CASE c_custkey % 2 WHEN 0 THEN '256MB' ELSE '1GB' END"
            " WHEN 1 THEN CASE c_custkey % 3 WHEN 0 THEN '1GB' ELSE '3GB' END"
            " ELSE CAST(100 * (1 + c_custkey % 3) AS STRING) END AS value",
        )
    )


def config_files(spark: SparkSession, sf: Folder) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS host_id",
        "if(c_custkey % 5 = 0, 'port', 'config_file') AS name",
        "' /etc/server/' || CAST(c_nationkey AS STRING) || '/main/server.conf' AS value",
    )


def host_lines(spark: SparkSession, sf: Folder) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS file_id",
        "CAST(1 AS BIGINT) AS line_no",
        "CASE s_suppkey % 4 WHEN 0 THEN '127.0.0.1    node' || CAST(s_suppkey AS STRING) || '.local'"
        " WHEN 1 THEN '# 127.0.0.1 node' || CAST(s_suppkey AS STRING) || '.local'"
        " WHEN 2 THEN '127.0.0.1 localhost node' || CAST(s_suppkey AS STRING) || '.local'"
        " ELSE '127.0.0.1 localhost' END AS line",
    )


def wanted_domains(spark: SparkSession, sf: Folder) -> DataFrame:
    """[file_id, domain]: one to three names for each file."""
    names = "slice(array('node', 'app', 'db'), 1, CAST(1 + s_suppkey % 3 AS INT))"
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS file_id",
        f"explode(transform({names}, n -> n || CAST(s_suppkey AS STRING) || '.local')) AS domain",
    )


def loaded_modules(spark: SparkSession, sf: Folder) -> DataFrame:
    hosts_ = table(spark, sf, "customer").select("c_custkey")
    modules = ["headers", "rewrite", "ssl", "socache_shmcb", "mime"]
    return (
        _with_literals(hosts_, "item", modules, ord_from=1)
        .filter((F.col("c_custkey") + F.col("ord") * F.col("ord")) % 3 != 0)
        .select(F.col("c_custkey").alias("host_id"), "item")
    )


def ssl_hosts(spark: SparkSession, sf: Folder) -> DataFrame:
    return table(spark, sf, "customer").selectExpr("c_custkey AS host_id", "c_custkey % 2 = 0 AS ssl")


def pkg_candidates(spark: SparkSession, sf: Folder) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("package"), F.col("p_partkey").alias("listing_rank"), _version().alias("version")
    )


def _version() -> Column:
    return F.expr(
        "CAST(8 + p_size % 3 AS STRING) || '.' || CAST(p_partkey % 25 AS STRING)"
        " || '-' || CAST(1 + p_partkey % 2 AS STRING)"
    )


def pkg_targets(spark: SparkSession, sf: Folder) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("host_id"),
        F.col("p_brand").alias("package"),
        _version().alias("installed_version"),
        F.expr(
            "CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'latest'"
            " WHEN p_partkey % 5 = 1 THEN '9' WHEN p_partkey % 5 = 2 THEN '9.1' WHEN p_partkey % 5 = 3 THEN '77'"
            " ELSE CAST(8 + p_size % 3 AS STRING) || '.' || CAST(p_partkey % 25 AS STRING) END"
        ).alias("target_version"),
        F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'yes' ELSE 'no' END").alias("force_upgrade"),
    )


def pkg_listing(spark: SparkSession, sf: Folder) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_brand AS host_group",
        "p_partkey AS line_no",
        "CASE p_partkey % 4 WHEN 0 THEN 'rc' ELSE 'ii' END || '  '"
        " || CASE p_size % 3 WHEN 0 THEN 'pgadmin4-web' WHEN 1 THEN 'postgresql' ELSE 'pgadmin4-web-extra' END"
        " || '   ' || CAST(8 + p_size % 3 AS STRING) || '.' || CAST(p_partkey % 25 AS STRING)"
        " || '-1   all   text' AS line",
    )


def policy_lines(spark: SparkSession, sf: Folder) -> DataFrame:
    """[host_id, line_no, line]: policy listings of a package, some without an offer."""
    parts = table(spark, sf, "part").select("p_partkey", "p_size")
    labels = ["Installed:", "Candidate:", "Version table:"]
    return (
        _with_literals(parts, "label", labels, ord_from=1)
        .filter((F.col("ord") != 2) | (F.col("p_partkey") % 9 != 0))
        .selectExpr(
            "p_partkey AS host_id",
            "CAST(ord AS BIGINT) AS line_no",
            "'  ' || label || if(ord = 3, '', ' ' || CAST(ord + p_size % 7 AS STRING) || '.1-1') AS line",
        )
    )


def module_lines(spark: SparkSession, sf: Folder) -> DataFrame:
    """[host_id, line]: the modules of ``loaded_modules`` as a server lists them."""
    header = table(spark, sf, "customer").selectExpr("c_custkey AS host_id", "'Loaded Modules:' AS line")
    listed = loaded_modules(spark, sf).selectExpr("host_id", "' ' || item || '_module (shared)' AS line")
    return header.unionByName(listed)


def state_lines(spark: SparkSession, sf: Folder) -> DataFrame:
    """[backup_id, line_no, line]: state files saved with backups, some without an old version."""
    states = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    texts = ["=== Upgrade Information ===", "Old Version:", "Target Version: latest"]
    return (
        _with_literals(states, "label", texts, ord_from=1)
        .filter((F.col("ord") != 2) | (F.col("o_orderkey") % 7 != 0))
        .selectExpr(
            "o_orderkey AS backup_id",
            "CAST(ord AS BIGINT) AS line_no",
            "CASE ord WHEN 2 THEN label || ' 9.' || CAST(o_custkey % 25 AS STRING) || '-1' ELSE label END AS line",
        )
    )


def health_checks(spark: SparkSession, sf: Folder) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id AS check_id",
        "user_id AS host_id",
        "ts",
        "CASE event_id % 15 WHEN 0 THEN 'install_url' WHEN 1 THEN 'default_url' WHEN 2 THEN 'custom_domain'"
        " WHEN 3 THEN 'custom_https' WHEN 4 THEN 'after_rollback' WHEN 5 THEN 'domain_http' WHEN 6 THEN 'domain_https'"
        " WHEN 7 THEN 'web_server_running' WHEN 8 THEN 'web_config_present' WHEN 9 THEN 'database_running'"
        " WHEN 10 THEN 'database_connection' WHEN 11 THEN 'custom_database' WHEN 12 THEN 'storage_writable'"
        " WHEN 13 THEN 'data_file' ELSE 'web_server_after_rollback' END AS check_kind",
        "CASE WHEN event_id % 15 < 7 THEN CASE event_type WHEN 'view' THEN '200' WHEN 'click' THEN '302'"
        " WHEN 'signup' THEN '301' WHEN 'purchase' THEN '000' ELSE '503' END"
        " WHEN event_type NOT IN ('view', 'click') THEN 'absent'"
        " WHEN event_id % 15 IN (7, 9, 14) THEN 'active' WHEN event_id % 15 IN (8, 11, 13) THEN 'present'"
        " WHEN event_id % 15 = 10 THEN 'ok' ELSE 'writable' END AS http_code",
        "CASE WHEN event_id % 15 = 3 THEN CASE event_id % 2 WHEN 0 THEN '200' ELSE '301' END END AS fallback_code",
    )


def log_lines(spark: SparkSession, sf: Folder) -> DataFrame:
    return (
        table(spark, sf, "events")
        .selectExpr(
            "event_id",
            "substr(CAST(ts AS STRING), 1, 19) AS at",
            "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' WHEN 'purchase' THEN 'SUCCESS'"
            " ELSE 'INFO' END AS lvl",
            "CASE WHEN event_type = 'error' AND event_id % 4 = 0"
            " THEN 'Script failed with exit code: ' || CAST(1 + event_id % 3 AS STRING)"
            " WHEN event_type = 'error' AND event_id % 4 = 1"
            " THEN 'Rollback completed. System restored to previous state.'"
            " WHEN event_type = 'purchase' AND event_id % 4 < 2 THEN 'Installation completed successfully!'"
            " WHEN event_type = 'click' AND event_id % 8 = 1 THEN 'Installation cancelled by user'"
            " WHEN event_type = 'signup' AND event_id % 8 = 2 THEN 'Already running version 9.1-1'"
            " ELSE event_type END AS msg",
        )
        .selectExpr(
            "event_id div 5 AS run_id",
            "event_id AS seq",
            "CASE WHEN event_id % 10 = 9 THEN 'free text ' || msg"
            " WHEN event_id % 2 = 0 THEN at || ' - [' || lvl || '] ' || msg"
            " ELSE '[' || lvl || '] ' || at || ' - ' || msg END AS line",
        )
    )


def table_sizes(spark: SparkSession, sf: Folder) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "CASE WHEN p_size % 3 = 0 THEN 'audit' ELSE 'public' END AS schemaname",
        "p_type AS datname",
        "replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING) AS tablename",
        "CAST((p_partkey % 997) * (p_partkey % 997) * (p_size + 1) * 512 AS BIGINT) AS bytes",
    )


def db_listing(spark: SparkSession, sf: Folder) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "CAST(p_partkey % 25 AS INT) AS host_id",
        "p_partkey AS line_no",
        "' ' || CASE WHEN p_partkey % 25 >= 20 AND p_partkey % 3 = 0 THEN 'template0'"
        " WHEN p_partkey % 3 = 0 THEN 'myappdb' WHEN p_partkey % 3 = 1 THEN 'myappdb_old' ELSE 'postgres' END"
        " || ' | owner' || CAST(p_size AS STRING) || ' | UTF8' AS line",
    )


def backups(spark: SparkSession, sf: Folder) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_custkey AS host_id",
        "o_orderkey AS backup_id",
        "o_orderdate AS mtime",
        "CASE o_orderstatus WHEN 'F' THEN 'etc' WHEN 'O' THEN 'data' ELSE 'web' END AS component",
        "CAST(floor(o_totalprice) AS BIGINT) AS bytes",
    )


def backup_names(spark: SparkSession, sf: Folder) -> DataFrame:
    """[backup_id, name]: the folder names of backups, some without a time."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("backup_id"),
        F.when(F.col("o_orderkey") % 6 != 0, stamped_name(F.lit("/var/backups/conf"), F.col("o_orderdate")))
        .otherwise(F.lit("/var/backups/conf_other"))
        .alias("name"),
    )


def snapshot_parts(spark: SparkSession, sf: Folder) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .selectExpr(
            "o_custkey AS host_id",
            "CASE WHEN o_orderkey % 3 <> 0 THEN 'logs' WHEN o_orderstatus = 'F' THEN 'etc'"
            " WHEN o_orderstatus = 'O' THEN 'data' ELSE 'web' END AS component",
        )
        .groupBy("host_id", "component")
        .agg(F.count("*").alias("files"))
    )


def snapshot_hosts(spark: SparkSession, sf: Folder) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS host_id", "c_custkey % 5 <> 0 AS keep_data", "c_custkey % 7 <> 0 AS keep_web"
    )


def appended_lines(spark: SparkSession, sf: Folder) -> DataFrame:
    """[file_id, line_no, line]: logs to which many runs were appended; one file holds a third of all lines."""
    return log_lines(spark, sf).selectExpr(
        "CASE WHEN seq % 3 = 0 THEN 0 ELSE 1 + seq % 50 END AS file_id",
        "seq AS line_no",
        "CASE WHEN seq % 97 = 5 THEN '2024-01-31 10:20:30 - [INFO] Temporary log file: /tmp/' || CAST(seq AS STRING)"
        " WHEN seq % 89 = 7 THEN '[INFO] 2024-01-31 10:20:30 - Starting Apache domain configuration...'"
        " ELSE line END AS line",
    )


def split_lines_of_files(spark: SparkSession, sf: Folder) -> DataFrame:
    """[file_id, split, at, line]: each file's splits are documents, their lines counted from a number of their own."""
    return doc_lines(spark, sf).selectExpr(
        "file_id % 40 AS file_id", "file_id AS split", "line_no + file_id * 1000 AS at", "line"
    )


def backups_in_use(spark: SparkSession, sf: Folder) -> DataFrame:
    return table(spark, sf, "orders").filter("o_orderkey % 9 = 0").selectExpr("o_custkey AS host_id", "o_orderkey AS backup_id")


def copied_backups(spark: SparkSession, sf: Folder) -> DataFrame:
    """The backups' table as a faulty copy: components of one row changed, doubled, lost or added."""
    good = backups(spark, sf).withColumn("part", F.col("host_id") % 20)
    doubled = good.filter("backup_id % 1000 = 1 AND part < 5")
    changed = good.withColumn("bytes", F.expr("IF(backup_id % 1000 = 2 AND part > 9, bytes + 1, bytes)"))
    extra = good.filter("part = 3").withColumn("part", F.lit(99).cast("bigint"))
    return changed.filter("part <> 7").unionByName(doubled).unionByName(extra)


def doc_lines(spark: SparkSession, sf: Folder) -> DataFrame:
    return split_lines(table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "text"))


def documents(spark: SparkSession, sf: Folder) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text")
