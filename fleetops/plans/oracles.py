"""Checking SQL for the registered queries, for DuckDB over the same tables.

Written from the rules of each job, independently of the DataFrame code. Every statement
stands alone: the derived inputs are common table expressions.
"""

from __future__ import annotations

VIEWS = {
    "hosts": """
SELECT c_custkey AS host_id,
  CAST(524288 + (c_custkey * 293003) % 33554432 AS BIGINT) AS mem_total_kb,
  CAST(c_nationkey + 1 AS INT) AS cpu_cores,
  CASE c_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS rotational,
  CASE c_custkey % 6 WHEN 0 THEN 'auto' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high'
    WHEN 4 THEN 'custom' ELSE 'turbo' END AS profile,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '2GB' END AS custom_shared_buffers,
  CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '1.1' END AS custom_random_page_cost
FROM customer""",
    "host_facts": """
SELECT c_custkey AS host_id,
  CASE c_nationkey % 5 WHEN 0 THEN 'debian' WHEN 1 THEN NULL ELSE 'ubuntu' END AS os_id,
  CASE WHEN c_custkey % 3 = 0 THEN '22.04' ELSE '24.04' END AS os_version,
  c_custkey % 2 = 0 AS db_running, c_custkey % 4 < 2 AS client_present, c_custkey % 7 = 0 AS ui_installed,
  c_custkey % 5 <> 0 AS web_present, c_custkey % 10 > 2 AS web_running, c_custkey % 11 <> 0 AS ui_reachable
FROM customer""",
    "conf_lines": """
SELECT l_orderkey AS file_id, CAST(l_linenumber AS BIGINT) AS line_no,
  CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '#' WHEN 2 THEN '  # ' ELSE '  ' END
   || CASE l_partkey % 4 WHEN 0 THEN 'work_mem' WHEN 1 THEN 'max_connections' WHEN 2 THEN 'wal_buffers'
      ELSE 'maintenance_work_mem' END
   || ' = ' || CAST(CAST(l_quantity AS INT) AS STRING)
   || CASE WHEN l_returnflag = 'R' THEN '   # note' ELSE '' END AS line
FROM lineitem""",
    "conf_values": """
SELECT c_custkey AS file_id, k.key AS key,
  CASE (c_custkey * 3 + k.ord * k.ord + k.ord) % 7 WHEN 0 THEN '' WHEN 1 THEN 'short' WHEN 2 THEN 'longenough1'
    WHEN 3 THEN 'yes' WHEN 4 THEN 'no' WHEN 5 THEN '10' ELSE 'abcdef' END AS value
FROM customer CROSS JOIN (VALUES ('POSTGRES_PASSWORD', 0), ('PGADMIN_EMAIL', 1), ('PGADMIN_PASSWORD', 2),
  ('TARGET_VERSION', 3), ('DRY_RUN', 4), ('VERIFY_TIMEOUT', 5), ('ENABLE_SSL', 6), ('SSL_COUNTRY', 7),
  ('SSL_CITY', 8)) AS k(key, ord)
WHERE (c_custkey + k.ord) % 11 <> 0 AND c_custkey % 13 <> 0""",
    "conf_texts": """
SELECT c_custkey AS file, '# settings of ' || c_name || chr(10)
  || 'TARGET_VERSION="' || CAST(c_nationkey AS VARCHAR) || '"'
  || CASE WHEN c_custkey % 3 = 0 THEN chr(13) ELSE '' END || chr(10) || chr(10)
  || '  DB_PASSWORD="' || c_mktsegment || '" # keep' || chr(10)
  || CASE WHEN c_custkey % 2 = 0 THEN '#' ELSE '' END || 'VERIFY_TIMEOUT=' || CAST(c_custkey % 60 AS VARCHAR)
  || chr(10) || 'DRY_RUN=''no''' || chr(10) || 'not an assignment' || chr(10)
  || CASE WHEN c_custkey % 5 = 0 THEN 'TARGET_VERSION="latest"' || chr(13) || chr(10) ELSE '' END AS text
FROM customer""",
    "settings": """
SELECT c_custkey AS host_id, k.name AS name,
  CASE k.ord WHEN 0 THEN CASE c_custkey % 2 WHEN 0 THEN '256MB' ELSE '1GB' END
    WHEN 1 THEN CASE c_custkey % 3 WHEN 0 THEN '1GB' ELSE '3GB' END
    ELSE CAST(100 * (1 + c_custkey % 3) AS STRING) END AS value
FROM customer CROSS JOIN (VALUES ('shared_buffers', 0), ('effective_cache_size', 1), ('max_connections', 2))
  AS k(name, ord)
WHERE (c_custkey + k.ord) % 13 <> 0""",
    "host_lines": """
SELECT s_suppkey AS file_id, CAST(1 AS BIGINT) AS line_no,
  CASE s_suppkey % 4 WHEN 0 THEN '127.0.0.1    node' || CAST(s_suppkey AS STRING) || '.local'
    WHEN 1 THEN '# 127.0.0.1 node' || CAST(s_suppkey AS STRING) || '.local'
    WHEN 2 THEN '127.0.0.1 localhost node' || CAST(s_suppkey AS STRING) || '.local'
    ELSE '127.0.0.1 localhost' END AS line
FROM supplier""",
    "loaded_modules": """
SELECT c_custkey AS host_id, m.module AS module
FROM customer CROSS JOIN (VALUES ('headers', 1), ('rewrite', 2), ('ssl', 3), ('socache_shmcb', 4), ('mime', 5))
  AS m(module, ord)
WHERE (c_custkey + m.ord * m.ord) % 3 <> 0""",
    "pkg_candidates": """
SELECT p_brand AS package, p_partkey AS listing_rank,
  CAST(8 + p_size % 3 AS STRING) || '.' || CAST(p_partkey % 25 AS STRING) || '-'
    || CAST(1 + p_partkey % 2 AS STRING) AS version
FROM part""",
    "pkg_targets": """
SELECT p_partkey AS host_id, p_brand AS package,
  CAST(8 + p_size % 3 AS STRING) || '.' || CAST(p_partkey % 25 AS STRING) || '-'
    || CAST(1 + p_partkey % 2 AS STRING) AS installed_version,
  CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'latest'
    WHEN p_partkey % 5 = 1 THEN '9' WHEN p_partkey % 5 = 2 THEN '9.1' WHEN p_partkey % 5 = 3 THEN '77'
    ELSE CAST(8 + p_size % 3 AS STRING) || '.' || CAST(p_partkey % 25 AS STRING) END AS target_version,
  CASE WHEN p_partkey % 3 = 0 THEN 'yes' ELSE 'no' END AS force_upgrade
FROM part""",
    "pkg_listing": """
SELECT p_brand AS host_group, p_partkey AS line_no,
  CASE p_partkey % 4 WHEN 0 THEN 'rc' ELSE 'ii' END || '  '
   || CASE p_size % 3 WHEN 0 THEN 'pgadmin4-web' WHEN 1 THEN 'postgresql' ELSE 'pgadmin4-web-extra' END
   || '   ' || CAST(8 + p_size % 3 AS STRING) || '.' || CAST(p_partkey % 25 AS STRING) || '-1   all   text' AS line
FROM part""",
    "state_lines": """
SELECT o_orderkey AS backup_id, k.ord AS line_no,
  CASE k.ord WHEN 1 THEN '=== Upgrade Information ==='
    WHEN 2 THEN 'Old Version: 9.' || CAST(o_custkey % 25 AS VARCHAR) || '-1'
    ELSE 'Target Version: latest' END AS line
FROM orders CROSS JOIN (VALUES (1), (2), (3)) AS k(ord) WHERE k.ord <> 2 OR o_orderkey % 7 <> 0""",
    "health_checks": """
SELECT event_id AS check_id, user_id AS host_id, ts,
  CASE event_id % 15 WHEN 0 THEN 'install_url' WHEN 1 THEN 'default_url' WHEN 2 THEN 'custom_domain'
    WHEN 3 THEN 'custom_https' WHEN 4 THEN 'after_rollback' WHEN 5 THEN 'domain_http' WHEN 6 THEN 'domain_https'
    WHEN 7 THEN 'web_server_running' WHEN 8 THEN 'web_config_present' WHEN 9 THEN 'database_running'
    WHEN 10 THEN 'database_connection' WHEN 11 THEN 'custom_database' WHEN 12 THEN 'storage_writable'
    WHEN 13 THEN 'data_file' ELSE 'web_server_after_rollback' END AS check_kind,
  CASE WHEN event_id % 15 < 7 THEN CASE event_type WHEN 'view' THEN '200' WHEN 'click' THEN '302'
      WHEN 'signup' THEN '301' WHEN 'purchase' THEN '000' ELSE '503' END
    WHEN event_type NOT IN ('view', 'click') THEN 'absent'
    WHEN event_id % 15 IN (7, 9, 14) THEN 'active' WHEN event_id % 15 IN (8, 11, 13) THEN 'present'
    WHEN event_id % 15 = 10 THEN 'ok' ELSE 'writable' END AS http_code,
  CASE WHEN event_id % 15 = 3 THEN CASE event_id % 2 WHEN 0 THEN '200' ELSE '301' END END AS fallback_code
FROM events""",
    "appended_lines": """
SELECT CASE WHEN seq % 3 = 0 THEN 0 ELSE 1 + seq % 50 END AS file_id, seq AS line_no,
  CASE WHEN seq % 97 = 5 THEN '2024-01-31 10:20:30 - [INFO] Temporary log file: /tmp/' || seq
    WHEN seq % 89 = 7 THEN '[INFO] 2024-01-31 10:20:30 - Starting Apache domain configuration...' ELSE line END AS line
FROM log_lines""",
    "backup_parts": "SELECT *, host_id % 20 AS part FROM backups",
    "copied_backups": """
SELECT host_id, backup_id, mtime, component, bytes + CASE WHEN backup_id % 1000 = 2 AND part > 9 THEN 1 ELSE 0 END AS bytes, part
FROM backup_parts WHERE part <> 7
UNION ALL SELECT * FROM backup_parts WHERE backup_id % 1000 = 1 AND part < 5
UNION ALL SELECT host_id, backup_id, mtime, component, bytes, 99 FROM backup_parts WHERE part = 3""",
    "log_lines": """
SELECT CAST(floor(event_id / 5.0) AS BIGINT) AS run_id, event_id AS seq, ts,
  CASE WHEN event_id % 10 = 9 THEN 'free text ' || msg
       WHEN event_id % 2 = 0 THEN substr(CAST(ts AS STRING), 1, 19) || ' - [' || lvl || '] ' || msg
       ELSE '[' || lvl || '] ' || substr(CAST(ts AS STRING), 1, 19) || ' - ' || msg END AS line
FROM (SELECT *,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' WHEN 'purchase' THEN 'SUCCESS'
    ELSE 'INFO' END AS lvl,
  CASE WHEN event_type = 'error' AND event_id % 4 = 0
         THEN 'Script failed with exit code: ' || CAST(1 + event_id % 3 AS STRING)
       WHEN event_type = 'error' AND event_id % 4 = 1
         THEN 'Rollback completed. System restored to previous state.'
       WHEN event_type = 'purchase' AND event_id % 4 < 2 THEN 'Installation completed successfully!'
       WHEN event_type = 'click' AND event_id % 8 = 1 THEN 'Installation cancelled by user'
       WHEN event_type = 'signup' AND event_id % 8 = 2 THEN 'Already running version 9.1-1'
       ELSE event_type END AS msg
  FROM events) e""",
    "table_sizes": """
SELECT CASE WHEN p_size % 3 = 0 THEN 'audit' ELSE 'public' END AS schemaname,
  p_type AS datname, replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING) AS tablename,
  CAST((p_partkey % 997) * (p_partkey % 997) * (p_size + 1) * 512 AS BIGINT) AS bytes
FROM part""",
    "db_listing": """
SELECT CAST(p_partkey % 25 AS INTEGER) AS host_id, p_partkey AS line_no,
  ' ' || CASE WHEN p_partkey % 25 >= 20 AND p_partkey % 3 = 0 THEN 'template0'
    WHEN p_partkey % 3 = 0 THEN 'myappdb' WHEN p_partkey % 3 = 1 THEN 'myappdb_old' ELSE 'postgres' END
   || ' | owner' || CAST(p_size AS STRING) || ' | UTF8' AS line
FROM part""",
    "backups": """
SELECT o_custkey AS host_id, o_orderkey AS backup_id, o_orderdate AS mtime,
  CASE o_orderstatus WHEN 'F' THEN 'etc' WHEN 'O' THEN 'data' ELSE 'web' END AS component,
  CAST(floor(o_totalprice) AS BIGINT) AS bytes
FROM orders""",
    "snapshot_parts": """
SELECT o_custkey AS host_id,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'logs' WHEN o_orderstatus = 'F' THEN 'etc' WHEN o_orderstatus = 'O' THEN 'data'
    ELSE 'web' END AS component,
  CAST(count(*) AS BIGINT) AS files
FROM orders GROUP BY 1, 2""",
    "doc_lines": """
SELECT doc_id AS file_id, CAST(pos AS BIGINT) AS line_no, parts[pos] AS line
FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
      FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) a) b""",
}

# Later steps that several statements share, each over the views above.
STEPS = {
    "tuning": """
SELECT host_id, tier, disk_type,
  CASE status WHEN 'ok' THEN CASE tier WHEN 'low' THEN '256MB' WHEN 'medium' THEN '1GB'
    WHEN 'high' THEN CAST(ram // 4 AS VARCHAR) || 'MB'
    ELSE coalesce(nullif(custom_shared_buffers, ''), '256MB') END END AS shared_buffers,
  CASE status WHEN 'ok' THEN CASE tier WHEN 'medium' THEN '3GB'
    WHEN 'high' THEN CAST(ram * 3 // 4 AS VARCHAR) || 'MB' ELSE '1GB' END END AS effective_cache_size,
  CASE status WHEN 'ok' THEN CASE tier WHEN 'medium' THEN '256MB' WHEN 'high' THEN '512MB' ELSE '64MB' END END
    AS maintenance_work_mem,
  CASE status WHEN 'ok' THEN CASE tier WHEN 'medium' THEN '16MB' WHEN 'high' THEN '32MB' ELSE '4MB' END END
    AS work_mem,
  CASE status WHEN 'ok' THEN CASE tier WHEN 'medium' THEN '200' WHEN 'high' THEN '300' ELSE '100' END END
    AS max_connections,
  CASE status WHEN 'ok' THEN CASE tier WHEN 'medium' THEN '2GB' WHEN 'high' THEN '4GB' ELSE '1GB' END END
    AS max_wal_size,
  CASE status WHEN 'ok' THEN CASE tier WHEN 'medium' THEN '1GB' WHEN 'high' THEN '2GB' ELSE '80MB' END END
    AS min_wal_size,
  CASE status WHEN 'ok' THEN '0.9' END AS checkpoint_completion_target,
  CASE status WHEN 'ok' THEN '16MB' END AS wal_buffers,
  CASE status WHEN 'ok' THEN '100' END AS default_statistics_target,
  CASE status WHEN 'ok' THEN coalesce(nullif(custom_random_page_cost, ''),
    CASE disk_type WHEN 'SSD' THEN '1.1' ELSE '4.0' END) END AS random_page_cost,
  CASE status WHEN 'ok' THEN CASE disk_type WHEN 'SSD' THEN '200' ELSE '2' END END AS effective_io_concurrency,
  status
FROM (SELECT *, CASE WHEN tier IN ('low', 'medium', 'high', 'custom') THEN 'ok' ELSE 'unknown_profile' END AS status
  FROM (SELECT *, mem_total_kb // 1024 AS ram,
      CASE WHEN profile <> 'auto' THEN profile WHEN mem_total_kb // 1024 < 2048 THEN 'low'
        WHEN mem_total_kb // 1024 < 8192 THEN 'medium' ELSE 'high' END AS tier,
      CASE WHEN rotational = 0 THEN 'SSD' ELSE 'HDD' END AS disk_type
    FROM hosts) a) b""",
    "params": """
SELECT host_id, CAST(k.ord AS BIGINT) AS ord, k.name AS name,
  CASE k.ord WHEN 1 THEN '''' || shared_buffers || '''' WHEN 2 THEN '''' || effective_cache_size || ''''
    WHEN 3 THEN '''' || maintenance_work_mem || '''' WHEN 4 THEN '''' || work_mem || ''''
    WHEN 5 THEN max_connections WHEN 6 THEN '''' || max_wal_size || '''' WHEN 7 THEN '''' || min_wal_size || ''''
    WHEN 8 THEN checkpoint_completion_target WHEN 9 THEN '''' || wal_buffers || ''''
    WHEN 10 THEN default_statistics_target WHEN 11 THEN random_page_cost ELSE effective_io_concurrency END AS value
FROM tuning CROSS JOIN (VALUES (1, 'shared_buffers'), (2, 'effective_cache_size'), (3, 'maintenance_work_mem'),
  (4, 'work_mem'), (5, 'max_connections'), (6, 'max_wal_size'), (7, 'min_wal_size'),
  (8, 'checkpoint_completion_target'), (9, 'wal_buffers'), (10, 'default_statistics_target'),
  (11, 'random_page_cost'), (12, 'effective_io_concurrency')) AS k(ord, name)
WHERE status = 'ok'""",
    "upserted": """
SELECT file_id, line_no, line FROM (
  SELECT l.file_id, l.line_no,
    CASE WHEN l.state = 'a' OR (l.state = 'c' AND NOT l.any_active) THEN coalesce(d.name || ' = ' || d.value, l.line)
      ELSE l.line END AS line
  FROM (SELECT *, coalesce(bool_or(state = 'a') OVER (PARTITION BY file_id, name), false) AS any_active
    FROM (SELECT *,
        CASE WHEN regexp_matches(line, '^\\s*[a-z_]+\\s*=') THEN 'a'
          WHEN regexp_matches(line, '^\\s*#\\s*[a-z_]+\\s*=') THEN 'c' END AS state,
        regexp_extract(line, '^\\s*#?\\s*([a-z_]+)\\s*=', 1) AS name
      FROM conf_lines) p) l
  LEFT JOIN desired d ON d.file_id = l.file_id AND d.name = l.name
  UNION ALL
  SELECT m.file_id, coalesce(t.last, 0) + 3 * (m.nth - 1) + x.pos,
    CASE x.pos WHEN 1 THEN '' WHEN 2 THEN '# Added by install script for performance tuning'
      ELSE m.name || ' = ' || m.value END
  FROM (SELECT d.*, row_number() OVER (PARTITION BY d.file_id ORDER BY d.ord) AS nth FROM desired d
    WHERE NOT EXISTS (SELECT 1 FROM conf_lines c WHERE c.file_id = d.file_id
      AND regexp_extract(c.line, '^\\s*#?\\s*([a-z_]+)\\s*=', 1) = d.name)) m
  LEFT JOIN (SELECT file_id, max(line_no) AS last FROM conf_lines GROUP BY file_id) t ON t.file_id = m.file_id
  CROSS JOIN (VALUES (1), (2), (3)) AS x(pos)) u""",
    "rules": """
SELECT f.file_id, CAST(r.rule_ord AS BIGINT) AS rule_ord, r.rule_id, r.key,
  CASE r.test WHEN 'set' THEN coalesce(v.value, '') <> ''
    WHEN 'len8' THEN length(coalesce(v.value, '')) >= 8 WHEN 'len6' THEN length(coalesce(v.value, '')) >= 6
    WHEN 'flag' THEN coalesce(v.value, '') IN ('yes', 'no')
    WHEN 'digits' THEN coalesce(v.value, '') = '' OR regexp_full_match(v.value, '[0-9]+')
    ELSE coalesce(s.value, '') <> 'yes' OR coalesce(v.value, '') <> '' END AS ok
FROM (SELECT DISTINCT c_custkey AS file_id FROM customer) f
CROSS JOIN (VALUES
  (1, 'install_db_password_set', 'POSTGRES_PASSWORD', 'set'), (2, 'install_db_password_length', 'POSTGRES_PASSWORD', 'len8'),
  (3, 'install_ui_email_set', 'PGADMIN_EMAIL', 'set'), (4, 'install_ui_password_set', 'PGADMIN_PASSWORD', 'set'),
  (5, 'install_ui_password_length', 'PGADMIN_PASSWORD', 'len6'),
  (6, 'upgrade_target_version_set', 'TARGET_VERSION', 'set'), (7, 'upgrade_backup_base_dir_set', 'BACKUP_BASE_DIR', 'set'),
  (8, 'upgrade_preserve_user_data_flag', 'PRESERVE_USER_DATA', 'flag'),
  (9, 'upgrade_auto_rollback_flag', 'AUTO_ROLLBACK_ON_FAILURE', 'flag'), (10, 'upgrade_dry_run_flag', 'DRY_RUN', 'flag'),
  (11, 'upgrade_backup_web_configs_flag', 'BACKUP_APACHE_CONFIGS', 'flag'),
  (12, 'upgrade_backup_ssl_certs_flag', 'BACKUP_SSL_CERTS', 'flag'),
  (13, 'upgrade_skip_preflight_flag', 'SKIP_PREFLIGHT_CHECKS', 'flag'), (14, 'upgrade_test_https_flag', 'TEST_HTTPS', 'flag'),
  (15, 'upgrade_force_flag', 'FORCE_UPGRADE', 'flag'), (16, 'upgrade_verify_timeout_number', 'VERIFY_TIMEOUT', 'digits'),
  (17, 'domain_name_set', 'DOMAIN_NAME', 'set'), (18, 'domain_enable_ssl_set', 'ENABLE_SSL', 'set'),
  (19, 'domain_enable_ssl_flag', 'ENABLE_SSL', 'flag'), (20, 'domain_ssl_country_set', 'SSL_COUNTRY', 'ssl'),
  (21, 'domain_ssl_state_set', 'SSL_STATE', 'ssl'), (22, 'domain_ssl_city_set', 'SSL_CITY', 'ssl'),
  (23, 'domain_ssl_org_set', 'SSL_ORG', 'ssl'), (24, 'domain_config_name_set', 'APACHE_CONFIG_NAME', 'set')
  ) AS r(rule_ord, rule_id, key, test)
LEFT JOIN conf_values v ON v.file_id = f.file_id AND v.key = r.key
LEFT JOIN conf_values s ON s.file_id = f.file_id AND s.key = 'ENABLE_SSL'""",
    "preflight": """
SELECT host_id, k.script, k.chk AS "check",
  CASE k.chk
    WHEN 'os' THEN CASE WHEN os_id = 'ubuntu' THEN 'pass' WHEN k.script = 'install' THEN 'fail' ELSE 'warn' END
    WHEN 'os_version' THEN CASE WHEN os_version = '24.04' THEN 'pass' ELSE 'warn' END
    WHEN 'existing_database' THEN CASE WHEN db_running OR client_present THEN 'warn' ELSE 'pass' END
    WHEN 'existing_web_ui' THEN CASE WHEN ui_installed THEN 'warn' ELSE 'pass' END
    WHEN 'web_ui_package' THEN CASE WHEN ui_installed THEN 'pass' ELSE 'fail' END
    WHEN 'web_server_present' THEN CASE WHEN web_present THEN 'pass' ELSE 'fail' END
    WHEN 'web_server_running' THEN CASE WHEN web_running THEN 'pass' ELSE 'fail' END
    ELSE CASE WHEN ui_reachable THEN 'pass' ELSE 'fail' END END AS level
FROM host_facts CROSS JOIN (VALUES ('install', 'os'), ('install', 'os_version'), ('install', 'existing_database'),
  ('install', 'existing_web_ui'), ('upgrade', 'os'), ('upgrade', 'os_version'), ('upgrade', 'web_ui_package'),
  ('upgrade', 'web_server_running'), ('domain', 'os'), ('domain', 'os_version'), ('domain', 'web_server_present'),
  ('domain', 'web_server_running'), ('domain', 'web_ui_reachable')) AS k(script, chk)""",
    "resolved": """
SELECT host_id, package, installed_version, new_version,
  CASE WHEN coalesce(target_version, '') = '' THEN 'not_found'
    WHEN new_version IS NULL AND target_version = 'latest' THEN 'undetermined'
    WHEN new_version IS NULL THEN 'not_found'
    WHEN new_version = installed_version AND force_upgrade <> 'yes' THEN 'up_to_date' ELSE 'available' END AS status
FROM (SELECT t.*, o.new_version FROM pkg_targets t LEFT JOIN (
    SELECT w.package, w.target_version, arg_min(c.version, c.listing_rank) AS new_version
    FROM (SELECT DISTINCT package, target_version FROM pkg_targets) w
    JOIN pkg_candidates c ON c.package = w.package AND w.target_version <> ''
      AND (w.target_version = 'latest' OR starts_with(c.version, w.target_version))
    GROUP BY w.package, w.target_version) o
  ON o.package = t.package AND o.target_version = t.target_version) r""",
    "judged": """
SELECT *, CASE WHEN passed THEN NULL WHEN check_kind IN ('default_url', 'after_rollback', 'domain_https',
    'web_server_running', 'web_config_present', 'database_running', 'database_connection', 'web_server_after_rollback')
    THEN 'error' ELSE 'warning' END AS severity
FROM (SELECT *, CASE
    WHEN check_kind IN ('custom_domain', 'domain_http') THEN http_code IN ('200', '301', '302')
    WHEN check_kind = 'custom_https' THEN http_code IN ('200', '301', '302')
      OR coalesce(fallback_code IN ('200', '302'), false)
    WHEN check_kind IN ('web_server_running', 'database_running', 'web_server_after_rollback') THEN http_code = 'active'
    WHEN check_kind IN ('web_config_present', 'custom_database', 'data_file') THEN http_code = 'present'
    WHEN check_kind = 'database_connection' THEN http_code = 'ok'
    WHEN check_kind = 'storage_writable' THEN http_code = 'writable'
    ELSE http_code IN ('200', '302') END AS passed
  FROM health_checks) j""",
    "parsed": """
SELECT run_id, seq,
  try_cast(CASE WHEN good THEN regexp_extract(line, '(\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2})', 1) END AS TIMESTAMP) AS ts,
  CASE WHEN good THEN regexp_extract(line, '\\[([A-Z]+)\\]', 1) END AS level,
  CASE WHEN good THEN regexp_replace(line,
    '^(\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2} - \\[[A-Z]+\\]|\\[[A-Z]+\\] \\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2} -) ', '')
    ELSE line END AS msg,
  NOT good AS bad
FROM (SELECT *, regexp_matches(line,
    '^(\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2} - \\[(INFO|SUCCESS|WARNING|ERROR)\\]|\\[(INFO|SUCCESS|WARNING|ERROR)\\] \\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2} -) ')
    AS good FROM log_lines) g""",
}

PRETTY = (
    "CASE WHEN {b} < 10240 THEN CAST({b} AS VARCHAR) || ' bytes'"
    " WHEN {b} // 512 < 20479 THEN CAST(({b} // 512 + 1) // 2 AS VARCHAR) || ' kB'"
    " WHEN {b} // 524288 < 20479 THEN CAST(({b} // 524288 + 1) // 2 AS VARCHAR) || ' MB'"
    " WHEN {b} // 536870912 < 20479 THEN CAST(({b} // 536870912 + 1) // 2 AS VARCHAR) || ' GB'"
    " WHEN {b} // 549755813888 < 20479 THEN CAST(({b} // 549755813888 + 1) // 2 AS VARCHAR) || ' TB'"
    " ELSE CAST(({b} // 562949953421312 + 1) // 2 AS VARCHAR) || ' PB' END"
)


def _sql(select: str, *steps: str, **extra: str) -> str:
    """A statement with the named views and steps, in order, as common table expressions."""
    ctes = [(s, VIEWS.get(s) or STEPS.get(s) or extra[s]) for s in steps]
    return ("WITH " + ",\n".join(f"{n} AS ({text})" for n, text in ctes) + "\n" if ctes else "") + select.strip()


_FLEET_WIDE = """
SELECT f.file_id, k.ord, k.name, k.value FROM (SELECT DISTINCT file_id FROM conf_lines) f
CROSS JOIN (VALUES (1, 'work_mem', '''16MB'''), (2, 'shared_buffers', '''1GB'''), (3, 'max_connections', '200'))
  AS k(ord, name, value)"""

_PER_HOST = "SELECT host_id AS file_id, ord, name, value FROM params"

_FIRST_LINE = """
SELECT host_group, nullif(arg_min(regexp_extract(line, '^\\s*(?:\\S+\\s+){2}(\\S+)', 1), line_no)
  FILTER (WHERE HIT), '') AS version FROM pkg_listing GROUP BY host_group"""

_DATABASES = "(VALUES ('myappdb'), ('postgres'), ('reports')) AS w(name)"

RUNS = """SELECT file_id, CAST(run_no AS BIGINT) AS run_no, run_start, file_id || '#' || run_no AS run_id, line_no FROM (
  SELECT l.file_id, l.line_no, (SELECT count(DISTINCT s.at) FROM starts s WHERE s.file_id = l.file_id AND s.at <= l.line_no) AS run_no,
    (SELECT max(s.at) FROM starts s WHERE s.file_id = l.file_id AND s.at <= l.line_no) AS run_start
  FROM appended_lines l) q"""
RUNS = RUNS.replace("starts s", """(SELECT file_id, line_no - 1 AS at FROM appended_lines WHERE contains(line, '] Temporary log file: ')
    UNION SELECT file_id, line_no FROM appended_lines WHERE ends_with(line, ' - Starting Apache domain configuration...')) s""")

FINGERPRINTS = """SELECT part, count(*) AS row_count, CAST(sum(CAST('0x' || substr(d, 1, 15) AS BIGINT)) AS VARCHAR) AS sum_one,
  CAST(sum(CAST('0x' || substr(d, 16, 15) AS BIGINT)) AS VARCHAR) AS sum_two
FROM (SELECT part, sha256(list_aggregate([length(x) || ':' || x FOR x IN [CAST(backup_id AS VARCHAR), CAST(bytes AS VARCHAR), component,
  CAST(host_id AS VARCHAR), CAST(mtime AS VARCHAR), CAST(part AS VARCHAR)]], 'string_agg', '')) AS d FROM {table}) q GROUP BY part"""


ORACLES: dict[str, str] = {
    "fleet_tuning": _sql("SELECT * FROM tuning", "hosts", "tuning"),
    "host_resources": _sql(
        """SELECT host_id, mem_total_kb // 1024 AS ram_mb, mem_total_kb // 1048576 AS ram_gb, cpu_cores,
  CASE WHEN rotational = 0 THEN 'SSD' ELSE 'HDD' END AS disk_type FROM hosts""",
        "hosts",
    ),
    "tuned_params_long": _sql("SELECT * FROM params", "hosts", "tuning", "params"),
    "upsert_params": _sql("SELECT * FROM upserted", "conf_lines", "desired", "upserted", desired=_FLEET_WIDE),
    "apply_tuning": _sql(
        "SELECT * FROM upserted", "conf_lines", "hosts", "tuning", "params", "desired", "upserted", desired=_PER_HOST
    ),
    "settings_lookup": _sql(
        """SELECT p.host_id, p.name, s.value AS actual, replace(p.value, '''', '') AS desired,
  coalesce(s.value = replace(p.value, '''', ''), false) AS matches
FROM params p LEFT JOIN settings s ON s.host_id = p.host_id AND s.name = p.name""",
        "hosts",
        "settings",
        "tuning",
        "params",
    ),
    "show_settings": _sql(
        "SELECT host_id, name, value FROM settings WHERE name IN ('shared_buffers', 'max_connections')", "settings"
    ),
    "config_folders": _sql(
        """SELECT c_custkey AS host_id, '/etc/server/' || CAST(c_nationkey AS VARCHAR) || '/main' AS folder
FROM customer WHERE c_custkey % 5 <> 0"""
    ),
    "parse_conf": _sql(
        """SELECT file, max(line_no) AS line_no, key,
  CASE WHEN contains(key, 'PASSWORD') THEN '********' ELSE arg_max(value, line_no) END AS value,
  CAST(length(arg_max(value, line_no)) AS BIGINT) AS value_len
FROM (SELECT file, CAST(pos AS BIGINT) AS line_no, regexp_extract(line, '^\\s*([A-Z_]+)=', 1) AS key,
    trim(trim(regexp_extract(line, '^\\s*[A-Z_]+=("[^"]*"|''[^'']*''|[^\\s"'']*)', 1), '"'), '''') AS value
  FROM (SELECT file, pos, parts[pos] AS line FROM (SELECT file, parts, unnest(range(1, len(parts) + 1)) AS pos
    FROM (SELECT file, string_split(text, chr(10)) AS parts FROM conf_texts) a) b) c
  WHERE regexp_matches(line, '^\\s*[A-Z_]+=')) d
GROUP BY file, key""",
        "conf_texts",
    ),
    "validate_conf": _sql("SELECT * FROM rules", "conf_values", "rules"),
    "first_failures": _sql(
        """SELECT file_id, min(rule_ord) AS rule_ord, arg_min(rule_id, rule_ord) AS rule_id
FROM rules WHERE NOT ok AND rule_ord <= 5 GROUP BY file_id""",
        "conf_values",
        "rules",
    ),
    "insert_if_absent": _sql(
        """SELECT file_id, line_no, line FROM host_lines
UNION ALL
SELECT w.file_id, (SELECT max(l.line_no) FROM host_lines l WHERE l.file_id = w.file_id)
    + row_number() OVER (PARTITION BY w.file_id ORDER BY w.domain),
  '127.0.0.1    ' || w.domain
FROM (SELECT DISTINCT s_suppkey AS file_id, k.name || CAST(s_suppkey AS VARCHAR) || '.local' AS domain
  FROM supplier CROSS JOIN (VALUES ('node', 1), ('app', 2), ('db', 3)) AS k(name, ord) WHERE k.ord <= 1 + s_suppkey % 3) w
WHERE NOT EXISTS (SELECT 1 FROM host_lines h WHERE h.file_id = w.file_id
  AND regexp_matches(h.line, '^127\\.0\\.0\\.1\\s.*' || regexp_escape(w.domain)))""",
        "host_lines",
    ),
    "listed_modules": _sql("SELECT host_id, module AS item FROM loaded_modules", "loaded_modules"),
    "missing_items": _sql(
        """SELECT c_custkey AS host_id, m.item
FROM customer CROSS JOIN (VALUES ('headers', false), ('rewrite', false), ('ssl', true), ('socache_shmcb', true))
  AS m(item, for_ssl)
WHERE (NOT m.for_ssl OR c_custkey % 2 = 0)
  AND NOT EXISTS (SELECT 1 FROM loaded_modules l WHERE l.host_id = c_custkey AND l.module = m.item)""",
        "loaded_modules",
    ),
    "preflight_report": _sql("SELECT * FROM preflight", "host_facts", "preflight"),
    "preflight_verdict": _sql(
        """SELECT host_id, script, bool_and(level <> 'fail') AS can_run, bool_or(level = 'warn') AS must_confirm
FROM preflight GROUP BY host_id, script""",
        "host_facts",
        "preflight",
    ),
    "resolve_versions": _sql("SELECT * FROM resolved", "pkg_targets", "pkg_candidates", "resolved"),
    "version_change": _sql(
        """SELECT host_id, CASE WHEN status <> 'available' THEN status
  WHEN split_part(installed_version, '.', 1) <> split_part(new_version, '.', 1) THEN 'major' ELSE 'minor' END AS change
FROM resolved""",
        "pkg_targets",
        "pkg_candidates",
        "resolved",
    ),
    "installed_version": _sql(_FIRST_LINE.replace("HIT", "contains(line, 'pgadmin4-web')"), "pkg_listing"),
    "installed_version_marked": _sql(
        _FIRST_LINE.replace("HIT", "contains(line, 'pgadmin4-web') AND starts_with(line, 'ii')"), "pkg_listing"
    ),
    "backed_up_version": _sql(
        """SELECT backup_id, max(CASE WHEN starts_with(line, 'Old Version:') THEN split_part(line, ' ', 3) END) AS version
FROM state_lines GROUP BY backup_id""",
        "state_lines",
    ),
    "candidate_version": _sql(
        """SELECT p_partkey AS host_id,
  CASE WHEN p_partkey % 9 <> 0 THEN CAST(2 + p_size % 7 AS VARCHAR) || '.1-1' END AS version FROM part"""
    ),
    "judge_checks": _sql("SELECT * FROM judged", "health_checks", "judged"),
    "health_report": _sql(
        """SELECT host_id, NOT bool_or(coalesce(severity = 'error', false)) AS ok,
  count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings
FROM judged GROUP BY host_id""",
        "health_checks",
        "judged",
    ),
    "parse_run_logs": _sql("SELECT * FROM parsed", "log_lines", "parsed"),
    "run_outcomes": _sql(
        """SELECT run_id, CASE WHEN bool_or(starts_with(m, 'Rollback completed')) THEN 'rolled_back'
  WHEN bool_or(starts_with(m, 'Script failed with exit code: ')) THEN 'failed'
  WHEN bool_or(ends_with(m, ' cancelled by user')) THEN 'cancelled'
  WHEN bool_or(starts_with(m, 'Already running')) THEN 'no-op'
  WHEN bool_or(ends_with(m, 'completed successfully!')) THEN 'success' ELSE 'unknown' END AS outcome,
  CAST(arg_max(split_part(m, ': ', 2), seq) FILTER (WHERE starts_with(m, 'Script failed with exit code: ')) AS INTEGER)
    AS exit_code
FROM (SELECT run_id, seq, CASE WHEN bad THEN '' ELSE msg END AS m FROM parsed) p GROUP BY run_id""",
        "log_lines",
        "parsed",
    ),
    "table_size_report": _sql(
        f"SELECT tablename, {PRETTY.format(b='bytes')} AS size FROM table_sizes WHERE schemaname = 'public'"
        " ORDER BY bytes DESC, tablename",
        "table_sizes",
    ),
    "database_size_report": _sql(
        f"""SELECT datname, {PRETTY.format(b='total')} AS size
FROM (SELECT datname, CAST(sum(bytes) AS BIGINT) AS total FROM table_sizes GROUP BY datname) t""",
        "table_sizes",
    ),
    "activity_scan": _sql("SELECT * FROM events"),
    "list_databases": _sql(
        "SELECT DISTINCT host_id, trim(split_part(line, '|', 1)) AS name FROM db_listing", "db_listing"
    ),
    "database_exists": _sql(
        f"""SELECT host_id, w.name, bool_or(regexp_matches(split_part(line, '|', 1), '\\b' || w.name || '\\b')) AS "exists"
FROM db_listing CROSS JOIN {_DATABASES} GROUP BY host_id, w.name""",
        "db_listing",
    ),
    "database_exists_exact": _sql(
        f"""SELECT n_nationkey AS host_id, w.name, EXISTS (SELECT 1 FROM db_listing l
  WHERE l.host_id = n_nationkey AND trim(split_part(l.line, '|', 1)) = w.name) AS "exists"
FROM nation CROSS JOIN {_DATABASES}""",
        "db_listing",
    ),
    "manifest": _sql(
        """SELECT c_custkey AS host_id, k.component,
  CASE WHEN (k.component = 'data' AND c_custkey % 5 = 0) OR (k.component = 'web' AND c_custkey % 7 = 0)
    THEN 'switched_off' WHEN p.files > 0 THEN 'present' ELSE 'missing' END AS state,
  CASE WHEN (k.component = 'data' AND c_custkey % 5 = 0) OR (k.component = 'web' AND c_custkey % 7 = 0)
    THEN 0 ELSE coalesce(p.files, 0) END AS files
FROM customer CROSS JOIN (VALUES ('etc'), ('data'), ('web')) AS k(component)
LEFT JOIN snapshot_parts p ON p.host_id = c_custkey AND p.component = k.component""",
        "snapshot_parts",
    ),
    "backup_inventory_sizes": _sql(
        f"""SELECT host_id, backup_id, mtime, total AS bytes, {PRETTY.format(b='total')} AS size
FROM (SELECT host_id, backup_id, max(mtime) AS mtime, CAST(sum(bytes) AS BIGINT) AS total
  FROM backups GROUP BY host_id, backup_id) b ORDER BY mtime DESC, backup_id DESC""",
        "backups",
    ),
    "backup_inventory_latest": _sql(
        """SELECT host_id, mtime, backup_id FROM (SELECT *,
  row_number() OVER (PARTITION BY host_id ORDER BY mtime DESC, backup_id DESC) AS n FROM backups) b WHERE n = 1""",
        "backups",
    ),
    "backup_inventory_expired": _sql(
        """SELECT host_id, backup_id, max(mtime) AS mtime FROM backups GROUP BY host_id, backup_id
HAVING floor(epoch(TIMESTAMP '2001-01-01 00:00:00' - max(mtime)) / 86400) > 30""",
        "backups",
    ),
    "backup_inventory_stamps": _sql(
        """SELECT o_orderkey AS backup_id,
  CASE WHEN o_orderkey % 6 <> 0 THEN 'conf_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') ELSE 'conf_other' END AS folder,
  CASE WHEN o_orderkey % 6 <> 0 THEN date_trunc('second', o_orderdate) END AS taken
FROM orders"""
    ),
    "find_references": _sql(
        """SELECT doc_id AS file, CAST(len(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'data')))
  AS BIGINT) AS hits FROM documents WHERE contains(text, 'data')"""
    ),
    "find_references_summary": _sql(
        """SELECT count(*) AS files, CASE WHEN count(*) = 0 THEN 'No files referencing the text were found' END AS warning
FROM documents WHERE contains(text, 'data')"""
    ),
    "rewrite_lines_endings": _sql(
        """SELECT file_id, line_no, CASE WHEN ends_with(marked, chr(13)) THEN left(marked, length(marked) - 1)
  ELSE marked END AS line
FROM (SELECT *, line || CASE WHEN line_no % 3 = 0 THEN chr(13) ELSE '' END AS marked FROM doc_lines) m""",
        "doc_lines",
    ),
    "rewrite_lines_delete": _sql(
        "SELECT file_id, line_no, line FROM doc_lines WHERE NOT (contains(line, 'the ') OR contains(line, 'The '))",
        "doc_lines",
    ),
    "rewrite_lines_after": _sql(
        """SELECT file_id, line_no, line FROM (SELECT *, max(CASE WHEN contains(line, 'the ') OR contains(line, 'The ')
  THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS near
FROM doc_lines) w WHERE near = 1""",
        "doc_lines",
    ),
    "rewrite_lines_first": _sql(
        """SELECT file_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS n
FROM doc_lines) w WHERE n <= 5""",
        "doc_lines",
    ),
    "segment_runs": _sql(RUNS, "log_lines", "appended_lines"),
    "appended_run_outcomes": _sql(
        f"""SELECT run_id, CASE WHEN bool_or(starts_with(m, 'Rollback completed')) THEN 'rolled_back'
  WHEN bool_or(starts_with(m, 'Script failed with exit code: ')) THEN 'failed'
  WHEN bool_or(ends_with(m, ' cancelled by user')) THEN 'cancelled'
  WHEN bool_or(starts_with(m, 'Already running')) THEN 'no-op'
  WHEN bool_or(ends_with(m, 'completed successfully!')) THEN 'success' ELSE 'unknown' END AS outcome,
  CAST(arg_max(split_part(m, ': ', 2), line_no) FILTER (WHERE starts_with(m, 'Script failed with exit code: ')) AS INTEGER)
    AS exit_code
FROM (SELECT r.run_id, a.line_no, CASE WHEN starts_with(a.line, 'free text ') THEN ''
    WHEN starts_with(a.line, '[') THEN regexp_replace(a.line, '^\\[[A-Z]+\\] .{{19}} - ', '')
    ELSE regexp_replace(a.line, '^.{{19}} - \\[[A-Z]+\\] ', '') END AS m
  FROM appended_lines a JOIN ({RUNS}) r ON r.file_id = a.file_id AND r.line_no = a.line_no) x GROUP BY run_id""",
        "log_lines",
        "appended_lines",
    ),
    "number_splits": _sql(
        """SELECT file_id % 40 AS file_id, row_number() OVER (PARTITION BY file_id % 40 ORDER BY file_id, line_no) AS line_no, line
FROM doc_lines""",
        "doc_lines",
    ),
    "table_fingerprints": _sql(FINGERPRINTS.format(table="backup_parts"), "backups", "backup_parts"),
    "differing_parts": _sql(
        f"""SELECT coalesce(a.part, b.part) AS part, CASE WHEN b.part IS NULL THEN 'missing' WHEN a.part IS NULL THEN 'extra'
  ELSE 'changed' END AS state, coalesce(a.row_count, 0) AS rows_original, coalesce(b.row_count, 0) AS rows_copy
FROM ({FINGERPRINTS.format(table="backup_parts")}) a FULL JOIN ({FINGERPRINTS.format(table="copied_backups")}) b ON a.part = b.part
WHERE a.part IS NULL OR b.part IS NULL OR a.row_count <> b.row_count OR a.sum_one <> b.sum_one OR a.sum_two <> b.sum_two""",
        "backups",
        "backup_parts",
        "copied_backups",
    ),
    "prune_plan": _sql(
        """SELECT e.host_id, e.backup_id, e.mtime, CASE WHEN l.backup_id IS NOT NULL THEN 'keep_newest'
  WHEN e.backup_id % 9 = 0 THEN 'keep_in_use' ELSE 'delete' END AS action
FROM (SELECT host_id, backup_id, max(mtime) AS mtime FROM backups GROUP BY host_id, backup_id
  HAVING floor(epoch(TIMESTAMP '2001-01-01 00:00:00' - max(mtime)) / 86400) > 30) e
LEFT JOIN (SELECT host_id, backup_id FROM (SELECT *,
  row_number() OVER (PARTITION BY host_id ORDER BY mtime DESC, backup_id DESC) AS n FROM backups) b WHERE n = 1) l
  ON l.host_id = e.host_id AND l.backup_id = e.backup_id""",
        "backups",
    ),
    "rewrite_lines_last": _sql(
        """SELECT file_id, line_no, line FROM (SELECT *,
  row_number() OVER (PARTITION BY file_id ORDER BY line_no DESC) AS n FROM doc_lines) w WHERE n <= 5""",
        "doc_lines",
    ),
}
