"""DuckDB SQL restating each registered query over the same Parquet tables.

Views ``region nation customer supplier part orders lineitem events documents
embeddings pages benchmark labels conversations`` are pre-registered by the
checker.  Column names match the Spark results one for one.
"""

from __future__ import annotations

# The metrics adaptor (fleetlens.sources.adaptors.metrics) in SQL.
METRICS = """
metrics AS (
  SELECT event_id AS _id, ts AS "timestamp", 'node_stats' AS metric_type,
         user_id % 7 AS cluster_id, event_type AS cluster_name, user_id AS node_id,
         event_type AS status, value,
         CASE WHEN event_type <> 'signup' THEN CAST(hour(ts) * 60 + minute(ts) + 1 AS BIGINT) END AS ops,
         CASE WHEN event_type <> 'error'
              THEN CAST((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 10 AS BIGINT) + CAST(floor(value * 100) AS BIGINT) END AS time_ms
  FROM events
)"""


def bucketed(interval_ms: int) -> str:
    return f"""
b AS (
  SELECT *, CAST((epoch_us("timestamp") - (epoch_us("timestamp") % {interval_ms * 1000})) // 1000 AS BIGINT) AS bucket_ms
  FROM metrics WHERE cluster_id IS NOT NULL AND node_id IS NOT NULL
),
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster_id, node_id, bucket_ms ORDER BY "timestamp" DESC, _id DESC) AS rn FROM b
  ) WHERE rn = 1
)"""


def prev(col: str) -> str:
    return (
        f"last_value(CAST({col} AS DOUBLE) IGNORE NULLS) OVER (PARTITION BY cluster_id, node_id ORDER BY bucket_ms "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )


def rate(col: str, seconds: float) -> str:
    c, p = f"CAST({col} AS DOUBLE)", f"p_{col}"
    return (
        f"CASE WHEN {c} IS NULL THEN NULL WHEN {p} IS NULL THEN {c} "
        f"ELSE (CASE WHEN {c} - {p} < 0 THEN {c} ELSE {c} - {p} END) / {seconds} END"
    )


def both(t: str, n: str) -> str:
    """The last earlier bucket that holds both inputs."""
    pair = f"CASE WHEN {t} IS NOT NULL AND {n} IS NOT NULL THEN {{'t': CAST({t} AS DOUBLE), 'n': CAST({n} AS DOUBLE)}} END"
    return f"last_value({pair} IGNORE NULLS) OVER (PARTITION BY cluster_id, node_id ORDER BY bucket_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def latency(t: str, n: str, pair: str = "pair") -> str:
    def delta(c: str, p: str) -> str:
        return f"(CASE WHEN CAST({c} AS DOUBLE) < {p} THEN CAST({c} AS DOUBLE) ELSE CAST({c} AS DOUBLE) - {p} END)"

    below = delta(n, f"{pair}.n")
    return (
        f"CASE WHEN {t} IS NOT NULL AND {n} IS NOT NULL AND {pair} IS NOT NULL THEN "
        f"(CASE WHEN {below} = 0 THEN 0.0 ELSE {delta(t, f'{pair}.t')} / {below} END) ELSE CAST(NULL AS DOUBLE) END"
    )


SQL: dict[str, str] = {}

SQL["sample_latest_1h"] = f"""
WITH {METRICS}, {bucketed(3_600_000)}
SELECT cluster_id, node_id, bucket_ms, _id, "timestamp", status, value, ops, time_ms FROM latest
"""

SQL["sample_max_1d"] = f"""
WITH {METRICS}, {bucketed(86_400_000)},
mx AS (SELECT cluster_id, node_id, bucket_ms, max(value) AS max_value FROM b GROUP BY cluster_id, node_id, bucket_ms)
SELECT l.cluster_id, l.node_id, l.bucket_ms, l._id, l."timestamp", coalesce(mx.max_value, l.value) AS value
FROM latest l JOIN mx USING (cluster_id, node_id, bucket_ms)
"""

SQL["rate_with_reset_1h"] = f"""
WITH {METRICS}, {bucketed(3_600_000)},
w AS (SELECT *, {prev('ops')} AS p_ops, {prev('time_ms')} AS p_time_ms FROM latest)
SELECT cluster_id, node_id, bucket_ms, _id, {rate('ops', 3600.0)} AS ops, {rate('time_ms', 3600.0)} AS time_ms FROM w
"""

SQL["latency_1h"] = f"""
WITH {METRICS}, {bucketed(3_600_000)},
w AS (SELECT *, {both('time_ms', 'ops')} AS pair FROM latest)
SELECT cluster_id, node_id, bucket_ms, _id, CAST(ops AS BIGINT) AS ops, CAST(time_ms AS BIGINT) AS time_ms,
       {latency('time_ms', 'ops')} AS latency_ms
FROM w
"""

SQL["ratio_1h"] = f"""
WITH {METRICS}, {bucketed(3_600_000)},
w AS (SELECT *, {both('ops', 'time_ms')} AS pair FROM latest)
SELECT cluster_id, node_id, bucket_ms, _id, {latency('ops', 'time_ms')} AS ops_per_time FROM w
"""

SQL["sample_full_pipeline"] = f"""
WITH {METRICS}, {bucketed(900_000)},
mx AS (SELECT cluster_id, node_id, bucket_ms, max(value) AS max_value FROM b GROUP BY cluster_id, node_id, bucket_ms),
w AS (SELECT l.*, mx.max_value, {prev('ops')} AS p_ops, {prev('time_ms')} AS p_time_ms, {both('time_ms', 'ops')} AS pair
      FROM latest l JOIN mx USING (cluster_id, node_id, bucket_ms))
SELECT cluster_id, node_id, bucket_ms, _id, "timestamp", metric_type, status,
       coalesce(max_value, value) AS value,
       {rate('ops', 900.0)} AS ops, {rate('time_ms', 900.0)} AS time_ms,
       {latency('time_ms', 'ops')} AS latency_ms
FROM w
"""

SQL["sample_blocked_15m"] = SQL["sample_full_pipeline"]

SQL["sample_store_15m"] = SQL["sample_full_pipeline"]

SQL["sample_text_max_1d"] = f"""
WITH {METRICS}, {bucketed(86_400_000)},
mx AS (SELECT cluster_id, node_id, bucket_ms, max(value) AS max_value FROM b GROUP BY cluster_id, node_id, bucket_ms)
SELECT l.cluster_id, l.node_id, l.bucket_ms, l._id, l.status, coalesce(mx.max_value, l.value) AS value
FROM latest l JOIN mx USING (cluster_id, node_id, bucket_ms)
"""

SQL["sample_avg_mode_1d"] = f"""
WITH {METRICS}, {bucketed(86_400_000)},
av AS (SELECT cluster_id, node_id, bucket_ms, avg(value) AS avg_value FROM b GROUP BY cluster_id, node_id, bucket_ms),
sc AS (SELECT cluster_id, node_id, bucket_ms, status, count(*) AS n FROM b WHERE status IS NOT NULL GROUP BY ALL),
md AS (SELECT cluster_id, node_id, bucket_ms, status FROM (
         SELECT *, row_number() OVER (PARTITION BY cluster_id, node_id, bucket_ms ORDER BY n DESC, status ASC) AS rn FROM sc
       ) WHERE rn = 1)
SELECT l.cluster_id, l.node_id, l.bucket_ms, l._id, l."timestamp", md.status AS status, round(av.avg_value, 6) AS value
FROM latest l JOIN av USING (cluster_id, node_id, bucket_ms) LEFT JOIN md USING (cluster_id, node_id, bucket_ms)
"""

SQL["estimate_sample"] = f"""
WITH {METRICS},
w AS (SELECT * FROM metrics WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-30 23:59:59'),
a AS (SELECT count(*) AS rows,
             count(DISTINCT coalesce(CAST(cluster_id AS VARCHAR), '') || '|' || coalesce(CAST(node_id AS VARCHAR), '')) AS groups
      FROM w)
SELECT rows, groups, CAST(720 AS BIGINT) AS buckets, CAST(least(rows, groups * 720) AS BIGINT) AS estimate FROM a
"""

SQL["estimate_sketches"] = f"""
WITH {METRICS},
w AS (SELECT * FROM metrics, (VALUES (10), (30)) AS u(until) WHERE CAST("timestamp" AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-01' + until - 1),
e AS (SELECT until, cluster_id, count(*) AS rows, CAST(until * 24 AS BIGINT) AS buckets, count(DISTINCT node_id) AS groups FROM w GROUP BY until, cluster_id)
SELECT until, cluster_id, rows, buckets, CAST(round(groups / pow(10, greatest(length(CAST(groups AS VARCHAR)) - 2, 0))) * pow(10, greatest(length(CAST(groups AS VARCHAR)) - 2, 0)) AS BIGINT) AS groups
FROM e
"""

SQL["cluster_metrics"] = f"""
WITH {METRICS}
SELECT CAST(cluster_id AS VARCHAR) AS cluster_id, CAST(node_id AS VARCHAR) AS node_id, count(*) AS docs FROM metrics WHERE cluster_id IN (1, 4, 6) GROUP BY ALL
"""

IPV4 = r"'\b[0-9]{1,3}\.[0-9]{1,3}\.([0-9]{1,3})\.([0-9]{1,3})\b'"

SQL["mask_ip_documents"] = f"""
SELECT doc_id, regexp_replace(text, {IPV4}, '*.*.\\1.\\2', 'g') AS text FROM documents
"""

SQL["mask_ip_pages"] = f"""
SELECT page_id, regexp_replace(url, {IPV4}, '*.*.\\1.\\2', 'g') AS url,
       regexp_replace(html, {IPV4}, '*.*.\\1.\\2', 'g') AS html
FROM pages
"""

SQL["slim_project"] = f"""
WITH {METRICS},
d AS (
  SELECT *, '10.' || CAST(cluster_id AS VARCHAR) || '.0.' || CAST(node_id AS VARCHAR) AS addr,
         CAST(floor(value * 1024) AS BIGINT) AS size_bytes
  FROM metrics
)
SELECT "timestamp",
       CAST(cluster_id AS VARCHAR) AS "metadata.labels.cluster_id",
       CAST(node_id AS VARCHAR) AS "metadata.labels.node_id",
       'node-' || CAST(node_id AS VARCHAR) AS "metadata.labels.node_name",
       regexp_replace(addr || ':9300', {IPV4}, '*.*.\\1.\\2', 'g') AS "metadata.labels.transport_address",
       size_bytes AS "payload.elasticsearch.node_stats.indices.store.size_in_bytes",
       CAST(size_bytes AS VARCHAR) || 'b' AS "payload.elasticsearch.node_stats.indices.store.size",
       ops AS "payload.elasticsearch.node_stats.indices.search.query_total",
       time_ms AS "payload.elasticsearch.node_stats.indices.search.query_time_in_millis",
       regexp_replace('publish ' || addr || ' up', {IPV4}, '*.*.\\1.\\2', 'g') AS "payload.elasticsearch.node_stats.transport.publish_address"
FROM d
"""

# What is left of the free documents: addresses masked in values, scalar sizes
# and everything that no path names gone, the array cut to its objects.
SQL["variant_shape"] = """
SELECT event_id,
       '{"addr":"publish *.*.0.' || user_id || ' up","disk":{"10.1.1.1":"x","size_in_bytes":' || CAST(floor(value * 1024) AS BIGINT)
       || '},"list":[{"at":"*.*.2.' || user_id || '"},{}],"props":{"k":' || json_extract_string(props, '$.k') || '},"store":{"left":[' || user_id || ']}}' AS doc
FROM events
"""

# Slim drops the size texts that are called store; the bytes and the text called size stay.
SQL["export_documents"] = f"""
WITH {METRICS}
SELECT CAST(cluster_id AS VARCHAR) AS cluster_id, strftime("timestamp", '%Y-%m-%dT%H:%M:%S') AS "at", CAST(node_id AS VARCHAR) AS node_id,
       'zone *.*.0.' || node_id || ':9300' AS zone, CAST(NULL AS VARCHAR) AS store, '["' || node_id || '","*.*.2.3"]' AS seen,
       'publish *.*.0.' || node_id || ' up' AS publish, CAST(floor(value * 1024) AS BIGINT) || 'b' AS size, CAST(CAST(floor(value * 1024) AS BIGINT) AS VARCHAR) AS bytes,
       CAST(ops AS VARCHAR) AS queries
FROM metrics
"""

SQL["export_manifest"] = """
WITH e AS (SELECT ts, greatest(to_timestamp(epoch(ts)::BIGINT // 1209600 * 1209600)::TIMESTAMP, TIMESTAMP '2024-01-01') AS low FROM (SELECT date_trunc('second', ts) AS ts FROM events))
SELECT strftime(low, '%Y%m%dT%H%M%S') AS slice, 'node_stats' AS type, count(*) AS rows, count(*) AS rows_read, true AS capped, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_time
FROM e GROUP BY low
"""

ALERTS = """
msgs AS (SELECT o_orderkey AS _id, o_custkey AS rule_id, o_orderstatus AS status, o_orderpriority AS priority,
                o_orderdate AS created FROM orders)"""

SQL["time_window"] = f"""
WITH {ALERTS}
SELECT _id, rule_id, status, created FROM msgs
WHERE created >= TIMESTAMP '1995-01-01 00:00:00' AND created <= TIMESTAMP '1995-12-31 23:59:59'
"""

SQL["keyset_after"] = f"""
WITH {ALERTS}
SELECT _id, created FROM msgs
WHERE created < TIMESTAMP '1996-06-01 00:00:00' OR (created = TIMESTAMP '1996-06-01 00:00:00' AND _id > 30000)
"""


# --- fleet inventory ----------------------------------------------------------


def fmt2(x: str) -> str:
    return f"printf('%.2f', CAST({x} AS DOUBLE))"


def fmt_bytes(x: str) -> str:
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    parts = [f"WHEN {x} IS NULL OR {x} = 0 THEN '0 B'"]
    for k, u in enumerate(units):
        parts.append(f"WHEN abs(CAST({x} AS DOUBLE)) < {1024.0 ** (k + 1)!r} THEN {fmt2(f'CAST({x} AS DOUBLE) / {1024.0**k!r}')} || ' {u}'")
    return "CASE " + " ".join(parts) + f" ELSE {fmt2(f'CAST({x} AS DOUBLE) / {1024.0**6!r}')} || ' EB' END"


def fmt_duration(x: str) -> str:
    s = f"({x} // 1000)"
    d, h, m, sec = f"({s} // 86400)", f"(({s} % 86400) // 3600)", f"(({s} % 3600) // 60)", f"({s} % 60)"
    parts = (
        f"list_filter([CASE WHEN {d} > 0 THEN CAST({d} AS VARCHAR) || 'd' END, CASE WHEN {h} > 0 THEN CAST({h} AS VARCHAR) || 'h' END, "
        f"CASE WHEN {m} > 0 THEN CAST({m} AS VARCHAR) || 'm' END, CASE WHEN {sec} > 0 THEN CAST({sec} AS VARCHAR) || 's' END], lambda v: v IS NOT NULL)"
    )
    return f"CASE WHEN {x} IS NULL OR {x} = 0 OR len({parts}) = 0 THEN '0s' ELSE array_to_string(list_slice({parts}, 1, 2), ' ') END"


def py_round(x: str, d: int) -> str:
    """Spark's ``round``: HALF_UP on the shortest decimal text of the double."""
    return f"CAST(round(CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,12)), {d}) AS DOUBLE)"


REGISTRY = """
reg AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id,
         CASE WHEN s_nationkey = 0 THEN 'console-system-' || s_name ELSE s_name END AS name,
         '7.' || CAST(s_nationkey AS VARCHAR) || '.0' AS version,
         s_acctbal > 0 AS enabled, s_acctbal > 1000 AS monitored
  FROM supplier
)"""

STATUS = """
st AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS st_id, n_regionkey <> 4 AS st_available,
         CASE WHEN n_regionkey <= 1 THEN 'green' WHEN n_regionkey = 2 THEN 'yellow' WHEN n_regionkey = 3 THEN 'red' END AS h_status,
         CAST(n_regionkey + 1 AS BIGINT) AS h_nodes, CAST(n_nationkey AS BIGINT) AS h_primary,
         CAST(n_nationkey * 2 AS BIGINT) AS h_shards,
         CAST(CASE WHEN n_regionkey = 3 THEN n_nationkey ELSE 0 END AS BIGINT) AS h_unassigned
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0
)"""

SUMMARY = """
g AS (
  SELECT l_suppkey, count(*) AS n,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_r,
         sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS n_f,
         sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS n_o,
         max(l_linenumber) AS max_line, max(l_shipdate) AS last_ship, min(l_shipdate) AS first_ship,
         sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS parts,
         sum(CASE WHEN l_linenumber <= 2 THEN 1 ELSE 0 END) AS orders,
         sum(CAST(l_quantity AS BIGINT)) AS qty,
         sum(CAST(floor(l_extendedprice) AS BIGINT)) AS price,
         max(CAST(floor(l_extendedprice) AS BIGINT)) AS max_price
  FROM lineitem GROUP BY l_suppkey
),
sm AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS sm_id,
         CASE WHEN n > 600 THEN 'es-' || CAST(l_suppkey AS VARCHAR) END AS cluster_name,
         CASE WHEN n_r * 3 > n THEN 'yellow' END AS status,
         CASE WHEN n > 600 THEN ['8.' || CAST(max_line AS VARCHAR), '7.0'] END AS sm_version,
         epoch_ms(last_ship) - epoch_ms(first_ship) AS uptime,
         CAST(greatest(n_f - n_o, 0) AS BIGINT) AS nodes_count,
         CAST(parts AS BIGINT) AS indices_count, CAST(orders AS BIGINT) AS primary_shards,
         CAST(n AS BIGINT) AS total_shards, CAST(n - n_r - parts AS BIGINT) AS unassigned_shards,
         CAST(qty AS BIGINT) AS document_count,
         CAST(price * 1024 AS BIGINT) AS used_store_bytes, CAST(price * 2048 AS BIGINT) AS max_store_bytes,
         CAST(max_price * 1024 AS BIGINT) AS used_jvm_bytes,
         CAST(CASE WHEN n > 550 THEN max_price * 3072 ELSE 0 END AS BIGINT) AS max_jvm_bytes
  FROM g
)"""


def falsy(a: str, b: str) -> str:
    return f"CAST(coalesce(nullif({a}, 0), nullif({b}, 0), 0) AS BIGINT)"


FLEET_REPORT = f"""
WITH {REGISTRY}, {STATUS}, {SUMMARY},
j AS (
  SELECT * FROM reg LEFT JOIN st ON reg.id = st.st_id LEFT JOIN sm ON reg.id = sm.sm_id
  WHERE NOT (upper(coalesce(reg.name, '')) LIKE '%CONSOLE-SYSTEM%')
),
r AS (
  SELECT id AS cluster_id, name AS display_name,
         coalesce(nullif(cluster_name, ''), name) AS cluster_name,
         coalesce(nullif(sm_version[1], ''), version) AS version,
         coalesce(nullif(status, ''), h_status, 'unknown') AS health_status,
         coalesce(st_available, false) AS available,
         coalesce(monitored, false) AS monitored,
         CASE WHEN coalesce(uptime, 0) <> 0 THEN {fmt_duration('uptime')} ELSE 'Unknown' END AS uptime,
         {falsy('nodes_count', 'h_nodes')} AS nodes_count,
         CAST(coalesce(indices_count, 0) AS BIGINT) AS indices_count,
         {falsy('primary_shards', 'h_primary')} AS primary_shards,
         {falsy('total_shards', 'h_shards')} AS total_shards,
         {falsy('unassigned_shards', 'h_unassigned')} AS unassigned_shards,
         CAST(coalesce(document_count, 0) AS BIGINT) AS documents_count,
         CAST(coalesce(used_store_bytes, 0) AS BIGINT) AS storage_used_bytes,
         CAST(coalesce(max_store_bytes, 0) AS BIGINT) AS storage_total_bytes,
         CAST(coalesce(used_jvm_bytes, 0) AS BIGINT) AS jvm_used_bytes,
         CAST(coalesce(max_jvm_bytes, 0) AS BIGINT) AS jvm_total_bytes
  FROM j
),
report AS (
  SELECT *, {fmt_bytes('storage_used_bytes')} AS storage_used_formatted,
         {fmt_bytes('storage_total_bytes')} AS storage_total_formatted,
         {fmt_bytes('jvm_used_bytes')} AS jvm_used_formatted,
         {fmt_bytes('jvm_total_bytes')} AS jvm_total_formatted,
         CASE WHEN jvm_total_bytes > 0 THEN {py_round('CAST(jvm_used_bytes AS DOUBLE) / jvm_total_bytes * 100.0', 2)} ELSE 0.0 END AS jvm_used_percent
  FROM r
)"""

SQL["registry_rows"] = f"""
WITH {REGISTRY}
SELECT id, CASE WHEN CAST(id AS BIGINT) % 10 <> 0 THEN name ELSE 'Unknown' END AS name,
       CASE WHEN CAST(id AS BIGINT) % 4 <> 0 THEN enabled ELSE false END AS enabled, monitored
FROM reg
"""

SQL["fleet_report"] = FLEET_REPORT + "\nSELECT * FROM report\n"

SQL["fleet_summary"] = (
    FLEET_REPORT
    + f"""
, t AS (
  SELECT count(*) AS total_clusters, count_if(available) AS available_clusters, count_if(monitored) AS monitored_clusters,
         CAST(coalesce(sum(nodes_count), 0) AS BIGINT) AS total_nodes,
         CAST(coalesce(sum(indices_count), 0) AS BIGINT) AS total_indices,
         CAST(coalesce(sum(documents_count), 0) AS BIGINT) AS total_documents,
         CAST(coalesce(sum(storage_used_bytes), 0) AS BIGINT) AS total_storage_used
  FROM report
)
SELECT *, {fmt_bytes('total_storage_used')} AS total_storage_used_formatted FROM t
"""
)

SQL["health_distribution"] = FLEET_REPORT + "\nSELECT health_status, count(*) AS clusters FROM report GROUP BY health_status\n"

SQL["active_clusters"] = f"""
WITH {METRICS},
pn AS (SELECT cluster_id, cluster_name AS name, count(*) AS n FROM metrics GROUP BY cluster_id, cluster_name),
tot AS (SELECT cluster_id, sum(n) AS doc_count FROM pn GROUP BY cluster_id),
best AS (SELECT cluster_id, name FROM (
           SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, name ASC) AS rk FROM pn WHERE name IS NOT NULL
         ) WHERE rk = 1)
SELECT CAST(t.cluster_id AS VARCHAR) AS cluster_id, coalesce(b.name, CAST(t.cluster_id AS VARCHAR)) AS cluster_name,
       CAST(t.doc_count AS BIGINT) AS doc_count
FROM tot t LEFT JOIN best b USING (cluster_id)
"""

SQL["resolve_name"] = f"""
WITH {REGISTRY},
req AS (
  SELECT DISTINCT trim(name) AS request FROM (
    SELECT s_name AS name FROM supplier UNION ALL SELECT lower(s_name) FROM supplier
    UNION ALL SELECT right(s_name, 4) FROM supplier UNION ALL SELECT c_name FROM customer
  ) WHERE trim(name) <> ''
),
r2 AS (SELECT id AS cid, trim(name) AS cname FROM reg WHERE id IS NOT NULL AND name IS NOT NULL AND trim(name) <> ''),
m AS (
  SELECT request, cid, 1 AS rank FROM req JOIN r2 ON request = cname
  UNION ALL SELECT request, cid, 2 FROM req JOIN r2 ON lower(request) = lower(cname)
  UNION ALL SELECT request, cid, 3 FROM req JOIN r2 ON contains(lower(cname), lower(request))
),
pr AS (SELECT request, rank, count(DISTINCT cid) AS candidates, min(cid) AS cid FROM m GROUP BY request, rank),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY rank) AS rn FROM pr) WHERE rn = 1)
SELECT req.request AS name, CASE WHEN candidates = 1 THEN cid END AS cluster_id,
       CASE rank WHEN 1 THEN 'exact' WHEN 2 THEN 'case_insensitive' WHEN 3 THEN 'substring' END AS match_type,
       CAST(coalesce(candidates, 0) AS BIGINT) AS candidates,
       CASE WHEN rank IS NULL THEN 'not_found' WHEN candidates > 1 THEN 'ambiguous' ELSE 'ok' END AS status
FROM req LEFT JOIN best USING (request)
"""

SQL["glob_filter"] = f"""
WITH {REGISTRY},
chosen AS (
  SELECT id FROM reg
  WHERE NOT (upper(coalesce(name, '')) LIKE '%CONSOLE-SYSTEM%')
    AND (regexp_full_match(id, '^Supplier#0000000[0-4].*$|^.*9$') OR regexp_full_match(name, '^Supplier#0000000[0-4].*$|^.*9$'))
    AND NOT (regexp_full_match(id, '^.*7$|^1.$') OR regexp_full_match(name, '^.*7$|^1.$'))
)
SELECT CAST(l_suppkey AS VARCHAR) AS cluster_id, count(*) AS docs
FROM lineitem WHERE CAST(l_suppkey AS VARCHAR) IN (SELECT id FROM chosen)
GROUP BY 1
"""

# --- catalog sampling ---------------------------------------------------------

CATALOG = """
cat AS (
  SELECT p_brand AS cluster_id, CASE WHEN p_type = 'PROMO' THEN '.promo' ELSE lower(p_type) END AS index_name,
         CASE WHEN p_type = 'LARGE' THEN 'Unavailable' ELSE 'green' END AS health,
         CASE WHEN p_type = 'SMALL' THEN 'n/a' ELSE CAST(count(*) AS VARCHAR) END AS docs_count
  FROM part GROUP BY p_brand, p_type
),
brands AS (SELECT DISTINCT p_brand AS id FROM part),
creg AS (SELECT id, 'cluster ' || id AS name FROM brands),
cst AS (SELECT id AS cluster_id, NOT (id LIKE '%3') AS available FROM brands WHERE NOT (id LIKE '%7')),
elig AS (
  SELECT c.cluster_id, r.name AS cluster_name, c.index_name, c.health,
         CAST(coalesce(TRY_CAST(trim(c.docs_count) AS BIGINT), 0) AS BIGINT) AS doc_count
  FROM cat c JOIN creg r ON c.cluster_id = r.id JOIN cst s ON s.cluster_id = r.id
  WHERE s.available AND NOT starts_with(c.index_name, '.') AND lower(coalesce(c.health, '')) <> 'unavailable'
),
capped AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY index_name) AS rn FROM elig) WHERE rn <= 3
)"""

SQL["index_caps"] = f"WITH {CATALOG}\nSELECT * FROM capped\n"

SQL["index_samples"] = f"""
WITH {CATALOG},
docs AS (
  SELECT p_brand AS cluster_id, CASE WHEN p_type = 'PROMO' THEN '.promo' ELSE lower(p_type) END AS index_name,
         CAST(p_partkey AS VARCHAR) AS _id, p_partkey AS seq,
         '{{"p_name":' || to_json(p_name) || ',"p_size":' || CAST(p_size AS VARCHAR) || ',"p_retailprice":' || CAST(p_retailprice AS VARCHAR) || '}}' AS _source
  FROM part
),
k AS (SELECT d.* FROM docs d SEMI JOIN elig c ON d.cluster_id = c.cluster_id AND d.index_name = c.index_name)
SELECT cluster_id, index_name, CAST(doc_rank AS INTEGER) AS doc_rank, _id, _source FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id, index_name ORDER BY seq, _id) AS doc_rank FROM k
) WHERE doc_rank <= 2
"""

# --- benchmark runs -----------------------------------------------------------

RUNS = """
runs AS (
  SELECT p_brand || ' (' || CASE l_returnflag WHEN 'R' THEN 'original' WHEN 'A' THEN 'optimized' ELSE 'other' END || ')' AS name,
         p_brand AS base_name,
         CASE l_returnflag WHEN 'R' THEN 'original' WHEN 'A' THEN 'optimized' ELSE 'other' END AS query_type,
         CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS query_index,
         l_linenumber AS iteration, l_linenumber <= 2 AS is_warmup,
         CASE WHEN l_linenumber > 2 THEN l_linenumber - 2 END AS measured_iteration,
         CASE WHEN l_discount <> 0 THEN l_quantity END AS took,
         CAST(floor(l_extendedprice / 10) AS DOUBLE) AS duration,
         l_linestatus = 'O' AS success
  , l_orderkey * 10 + l_linenumber AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
mr AS (SELECT * FROM runs WHERE NOT coalesce(is_warmup, false))"""


def stats(v: str, p: str) -> str:
    return (
        f"coalesce({py_round(f'avg({v})', 2)}, 0.0) AS avg_{p}, CAST(coalesce(min({v}), 0.0) AS DOUBLE) AS min_{p}, "
        f"CAST(coalesce(max({v}), 0.0) AS DOUBLE) AS max_{p}"
    )


DUR = "CASE WHEN success THEN duration END"

SQL["bench_summary"] = f"""
WITH {RUNS},
a AS (
  SELECT count(*) AS total, count_if(success) AS passed,
         {stats(DUR, 'duration')}, {stats('took', 'took')},
         {py_round(f'coalesce(sum({DUR}), 0.0)', 2)} AS total_duration_sum,
         {py_round('coalesce(sum(took), 0.0)', 2)} AS total_took_sum,
         {py_round(f"coalesce(sum(CASE WHEN query_type = 'original' THEN {DUR} END), 0.0)", 2)} AS original_duration_sum,
         {py_round("coalesce(sum(CASE WHEN query_type = 'original' THEN took END), 0.0)", 2)} AS original_took_sum,
         count(CASE WHEN query_type = 'original' THEN took END) AS original_took_count,
         coalesce({py_round("avg(CASE WHEN query_type = 'original' THEN took END)", 2)}, 0.0) AS original_avg_took,
         {py_round(f"coalesce(sum(CASE WHEN query_type = 'optimized' THEN {DUR} END), 0.0)", 2)} AS optimized_duration_sum,
         {py_round("coalesce(sum(CASE WHEN query_type = 'optimized' THEN took END), 0.0)", 2)} AS optimized_took_sum,
         count(CASE WHEN query_type = 'optimized' THEN took END) AS optimized_took_count,
         coalesce({py_round("avg(CASE WHEN query_type = 'optimized' THEN took END)", 2)}, 0.0) AS optimized_avg_took
  FROM mr
)
SELECT *, total - passed AS failed,
       CASE WHEN total > 0 THEN printf('%.2f', passed / total * 100.0) || '%' ELSE '0.00%' END AS pass_rate
FROM a
"""

SQL["bench_per_query"] = f"""
WITH {RUNS}
SELECT name, min(query_index) AS query_index, min(query_type) AS query_type,
       count({DUR}) AS duration_count, {stats(DUR, 'duration')},
       count(took) AS took_count, {stats('took', 'took')}
FROM mr GROUP BY name
"""

SQL["bench_rounds"] = f"""
WITH {RUNS}
SELECT measured_iteration, query_type, avg(took) AS took_avg, sum(took) AS took_total,
       avg({DUR}) AS duration_avg, sum({DUR}) AS duration_total
FROM mr WHERE query_type IN ('original', 'optimized') GROUP BY measured_iteration, query_type
"""

SQL["bench_compare"] = f"""
WITH {RUNS},
g AS (
  SELECT base_name,
         count_if(query_type = 'original') AS n_orig, count_if(query_type = 'optimized') AS n_opt,
         avg(CASE WHEN query_type = 'original' THEN took END) AS orig_took,
         avg(CASE WHEN query_type = 'optimized' THEN took END) AS opt_took,
         avg(CASE WHEN query_type = 'original' THEN {DUR} END) AS orig_dur,
         avg(CASE WHEN query_type = 'optimized' THEN {DUR} END) AS opt_dur
  FROM mr GROUP BY base_name
),
h AS (
  SELECT base_name,
         CASE WHEN orig_took IS NOT NULL AND opt_took IS NOT NULL THEN 'took' ELSE 'duration' END AS metric,
         CASE WHEN orig_took IS NOT NULL AND opt_took IS NOT NULL THEN orig_took ELSE orig_dur END AS a,
         CASE WHEN orig_took IS NOT NULL AND opt_took IS NOT NULL THEN opt_took ELSE opt_dur END AS b
  FROM g WHERE n_orig > 0 AND n_opt > 0
),
k AS (SELECT *, CASE WHEN a = 0 THEN NULL ELSE (a - b) / a * 100.0 END AS imp FROM h WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT base_name, metric, {py_round('a', 2)} AS avg_original, {py_round('b', 2)} AS avg_optimized,
       {py_round('imp', 2)} AS improvement_percent, imp > 0 AS is_faster
FROM k
"""

SQL["bench_pairs"] = f"""
WITH {RUNS},
last AS (
  SELECT * FROM (
    SELECT *, {DUR} AS dur, row_number() OVER (PARTITION BY query_index, measured_iteration, query_type ORDER BY seq DESC) AS rk FROM mr
  ) WHERE rk = 1
),
o AS (SELECT query_index, measured_iteration, base_name AS original_name, took AS original_took, dur AS original_duration FROM last WHERE query_type = 'original'),
p AS (SELECT query_index, measured_iteration, base_name AS optimized_name, took AS optimized_took, dur AS optimized_duration FROM last WHERE query_type = 'optimized')
SELECT query_index, measured_iteration,
       CASE WHEN original_name IS NOT NULL AND optimized_name IS NOT NULL AND original_name <> optimized_name
            THEN original_name || ' vs ' || optimized_name
            ELSE coalesce(original_name, optimized_name, 'Query ' || CAST(query_index + 1 AS VARCHAR)) END AS display_name,
       CAST(original_took AS DOUBLE) AS original_took, CAST(optimized_took AS DOUBLE) AS optimized_took, original_duration, optimized_duration
FROM o FULL OUTER JOIN p USING (query_index, measured_iteration)
"""

# --- search profiles ----------------------------------------------------------

SHARDS = """
ex AS (SELECT *, unnest(generate_series(1, CAST(substr(o_orderpriority, 1, 1) AS INTEGER))) AS i FROM orders),
sh AS (
  SELECT o_orderkey AS rid, o_orderkey AS run_id, CAST(i AS INTEGER) AS id,
         'idx-' || o_orderstatus AS "index", 'node-' || CAST(o_custkey + i AS VARCHAR) AS node_id,
         CAST(floor(o_totalprice * 1000 / i) AS BIGINT) AS q,
         CAST(o_custkey * 10 * i AS BIGINT) AS rw,
         CAST(floor(o_totalprice / 10) * i AS BIGINT) AS f,
         CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice / 100) * i AS BIGINT) ELSE 0 END AS ag,
         'TermQuery' || o_orderstatus AS qtype, 'cust:' || CAST(o_custkey AS VARCHAR) AS descr, i AS pos, o_totalprice AS price
  FROM ex
)"""


def ms(x: str) -> str:
    return py_round(f"CAST({x} AS DOUBLE) / 1000000.0", 3)


SQL["profile_rollup"] = f"""
WITH {SHARDS}
SELECT run_id, CAST(count(*) AS INTEGER) AS shard_count, {ms('sum(q)')} AS total_query_time_ms,
       {ms('sum(f)')} AS total_fetch_time_ms, {ms('sum(ag)')} AS total_aggregation_time_ms,
       {ms('sum(rw)')} AS total_rewrite_time_ms
FROM sh GROUP BY rid, run_id
"""

SQL["slowest_shard"] = f"""
WITH {SHARDS},
t AS (SELECT *, q + f + ag AS total,
             row_number() OVER (PARTITION BY rid ORDER BY q + f + ag DESC, pos ASC) AS rk FROM sh)
SELECT run_id, id AS shard_id, "index", node_id, {ms('total')} AS total_time_ms, {ms('q')} AS query_time_ms,
       {ms('f')} AS fetch_time_ms, {ms('ag')} AS aggregation_time_ms, {ms('rw')} AS rewrite_time_ms
FROM t WHERE rk = 1
"""

SQL["profile_top3"] = f"""
WITH {SHARDS},
c AS (SELECT *, {ms('q')} AS time_ms FROM sh),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY time_ms DESC, pos ASC) AS rank FROM c)
SELECT run_id, CAST(rank AS INTEGER) AS rank, qtype AS type, descr AS description, time_ms, id AS shard, "index"
FROM r WHERE rank <= 3
"""

SQL["profile_collectors"] = f"""
WITH {SHARDS},
c AS (SELECT *, {ms('CAST(floor(price) * pos AS BIGINT)')} AS time_ms FROM sh),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY time_ms DESC, pos ASC) AS rank FROM c)
SELECT run_id, CAST(rank AS INTEGER) AS rank, 'SimpleTopScoreDocCollector' AS name, 'search_top_hits' AS reason, time_ms, id AS shard, "index"
FROM r WHERE rank <= 3
"""

SQL["profile_phases"] = f"""
WITH {SHARDS},
t AS (
  SELECT rid, run_id, 'score' AS phase, 0 AS pos, {ms('sum(q // 2)')} AS time_ms FROM sh GROUP BY rid, run_id
  UNION ALL
  SELECT rid, run_id, 'build_scorer', 1, {ms('sum(q // 4)')} FROM sh GROUP BY rid, run_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY time_ms DESC, pos ASC) AS rank FROM t)
SELECT run_id, CAST(rank AS INTEGER) AS rank, phase, time_ms FROM r WHERE rank <= 3
"""


# --- request logs -------------------------------------------------------------

CASES = """
od AS (
  SELECT *, o_orderkey AS file_id, substr(o_orderpriority, 1, 1) AS d, o_orderstatus AS st FROM orders
),
li AS (
  SELECT *,
         CASE WHEN st = 'F' AND d = '2' THEN '{"query":'
              ELSE '{"query":{"term":{"cust":' || CAST(o_custkey AS VARCHAR) || '}},"size":' || d || '}' END AS body_json,
         d = '4' AND st = 'O' AS missing
  FROM od
),
parsed AS (
  SELECT file_id, 1 AS seq,
         CASE WHEN d = '5' THEN 'Query 1' ELSE 'Q' || d || ' ' || st END AS title,
         CASE WHEN missing THEN NULL WHEN st = 'P' THEN 'POST' ELSE 'GET' END AS method,
         CASE WHEN missing THEN NULL WHEN st = 'P' THEN '_msearch'
              WHEN st = 'F' THEN 'idx-f,idx-' || d || '/_search?size=' || d
              ELSE '/_cat/indices/idx-o' END AS path,
         CASE WHEN missing THEN NULL
              WHEN st = 'P' THEN '{"index":"idx-p"}' || chr(10) || '{"query":{"match_all":{}},"size":' || d || '}'
              WHEN st = 'F' THEN body_json
              WHEN d = '1' THEN '' ELSE body_json END AS body_raw,
         CASE WHEN missing THEN NULL ELSE st = 'P' END AS body_is_ndjson,
         CASE WHEN missing OR st = 'P' OR (st = 'O' AND d = '1') THEN NULL ELSE NOT (st = 'F' AND d = '2') END AS body_valid,
         CASE WHEN missing THEN 'missing method line'
              WHEN st = 'F' AND d = '2' THEN 'invalid JSON body' END AS error,
         st, d
  FROM li
  UNION ALL
  SELECT file_id, 2, 'Count ' || st, 'GET', 'idx-' || lower(st) || '/_count',
         '{"query":{"match_all":{}}}', false, true, NULL, st, d
  FROM li
  UNION ALL
  SELECT file_id, 0, NULL, NULL, NULL, NULL, NULL, NULL, 'content before the first title', st, d
  FROM li WHERE d = '3' AND st = 'F'
),
targets AS (
  SELECT file_id, seq, 0 AS target_pos, 'idx-f' AS target FROM parsed WHERE seq = 1 AND error IS NULL AND st = 'F'
  UNION ALL
  SELECT file_id, seq, 1, 'idx-' || d FROM parsed WHERE seq = 1 AND error IS NULL AND st = 'F'
  UNION ALL
  SELECT file_id, seq, 0, 'idx-' || lower(st) FROM parsed WHERE seq = 2
),
aliases AS (
  SELECT DISTINCT 'idx-' || lower(o_orderstatus) AS alias, 'idx-' || lower(o_orderstatus) || '-' || substr(o_orderpriority, 1, 1) AS "index" FROM orders
),
firsts AS (
  SELECT file_id, seq, coalesce(a."index", t.target) AS index_name, min(target_pos) AS first_pos
  FROM targets t LEFT JOIN aliases a ON a.alias = t.target GROUP BY ALL
),
resolved AS (
  SELECT file_id, seq, index_name, CAST(row_number() OVER (PARTITION BY file_id, seq ORDER BY first_pos, index_name) AS INTEGER) AS resolved_pos
  FROM firsts
)"""

SQL["request_parse"] = f"""
WITH {CASES}
SELECT file_id, CAST(seq AS INTEGER) AS seq, title, method, path, body_raw,
       body_raw || CASE WHEN body_is_ndjson THEN chr(10) ELSE '' END AS body_sent, body_is_ndjson, body_valid, error FROM parsed
"""

# The same cases in 64 logs: numbered over all orders of a log, no preambles.
SQL["request_logs"] = f"""
WITH {CASES},
n AS (SELECT o_orderkey, CAST(2 * (row_number() OVER (PARTITION BY o_orderkey % 64 ORDER BY o_orderkey) - 1) AS INTEGER) AS earlier FROM orders)
SELECT o_orderkey % 64 AS log, CAST(seq + earlier AS INTEGER) AS seq, CASE WHEN title = 'Query 1' THEN 'Query ' || (seq + earlier) ELSE title END AS title,
       method, path, body_raw, body_raw || CASE WHEN body_is_ndjson THEN chr(10) ELSE '' END AS body_sent, body_is_ndjson, body_valid, error
FROM parsed JOIN n ON file_id = o_orderkey WHERE seq > 0
"""

SQL["request_bodies"] = f"""
WITH {CASES}
SELECT file_id, CAST(seq AS INTEGER) AS seq, body_raw AS body FROM parsed WHERE body_valid AND error IS NULL
"""

SQL["request_bodies_pretty"] = f"""
WITH {CASES}
SELECT file_id, CAST(seq AS INTEGER) AS seq, replace(json_pretty(body_raw), '    ', '  ') AS body FROM parsed WHERE body_valid AND error IS NULL
"""

SQL["request_targets"] = f"""
WITH {CASES}
SELECT file_id, CAST(seq AS INTEGER) AS seq, CAST(target_pos AS INTEGER) AS target_pos, target FROM targets
"""

SQL["alias_resolve"] = f"WITH {CASES}\nSELECT file_id, CAST(seq AS INTEGER) AS seq, index_name, resolved_pos FROM resolved\n"

REQUEST_REPORT = f"""
WITH {CASES},
ov AS (
  SELECT 'idx-' || lower(o_orderstatus) || '-' || substr(o_orderpriority, 1, 1) AS index_name, 'green' AS health, 'open' AS status,
         any_value(substr(o_orderpriority, 1, 1)) AS pri, '1' AS rep, count(*) AS docs, count(*) % 1000 AS deleted,
         CAST(sum(floor(o_totalprice)) AS BIGINT) AS store, any_value(lower(o_orderstatus)) AS st
  FROM orders GROUP BY 1
), report AS (
  SELECT file_id, CAST(seq AS INTEGER) AS seq, resolved_pos, index_name, coalesce(health, '-') AS health, coalesce(status, '-') AS status,
         coalesce(pri, '-') AS pri, coalesce(rep, '-') AS rep,
         CASE WHEN docs IS NULL THEN '-' ELSE format('{{:,}}', docs) END AS docs_count,
         CASE WHEN docs IS NULL THEN '-' ELSE format('{{:,}}', deleted) END AS docs_deleted,
         coalesce(CAST(store AS VARCHAR) || 'kb', '-') AS store_size, coalesce(CAST(store // 2 AS VARCHAR) || 'kb', '-') AS pri_store_size,
         CASE WHEN pri <> '5' THEN '{{"properties":{{"' || st || '":{{"type":"long"}}}}}}' END AS mapping,
         CASE WHEN pri <> '1' THEN '{{"number_of_shards":"' || pri || '"}}' END AS settings
  FROM resolved LEFT JOIN ov USING (index_name)
)
"""

SQL["request_overview"] = REQUEST_REPORT + "SELECT * EXCLUDE (mapping, settings) FROM report"
SQL["request_report"] = REQUEST_REPORT + "SELECT * FROM report"


# --- alerts, diagnostics, responses, settings, scalars -------------------------

SQL["alerts_join"] = f"""
WITH {ALERTS},
rules AS (SELECT c_custkey AS rule_id, c_name AS rule_name, c_acctbal > 0 AS rule_enabled, c_mktsegment AS rule_resource_type FROM customer)
SELECT _id, created, status, rule_id, rule_name, rule_enabled, rule_resource_type
FROM msgs LEFT JOIN rules USING (rule_id)
WHERE created >= TIMESTAMP '1995-01-01 00:00:00' AND created <= TIMESTAMP '1995-12-31 23:59:59'
ORDER BY created DESC, _id
"""

SQL["diag_cluster"] = (
    FLEET_REPORT
    + f"""
SELECT cluster_id, health_status = 'red' AS is_red, health_status = 'yellow' AS is_yellow,
       unassigned_shards > 0 AS has_unassigned,
       {py_round(f"CASE WHEN jvm_total_bytes > 0 THEN CAST(total_shards AS DOUBLE) / (CAST(jvm_total_bytes AS DOUBLE) / {float(1024**3)!r}) END", 2)} AS shards_per_gb_heap,
       coalesce(CASE WHEN jvm_total_bytes > 0 THEN CAST(total_shards AS DOUBLE) / (CAST(jvm_total_bytes AS DOUBLE) / {float(1024**3)!r}) END >= 20.0, false) AS too_many_shards,
       jvm_used_percent > 75.0 AS heap_high,
       storage_total_bytes - storage_used_bytes AS disk_free_bytes
FROM report
"""
)

SQL["diag_node"] = f"""
WITH {METRICS}, {bucketed(900_000)},
mx AS (SELECT cluster_id, node_id, bucket_ms, max(value) AS max_value FROM b GROUP BY cluster_id, node_id, bucket_ms),
w AS (SELECT l.*, mx.max_value, {prev('ops')} AS p_ops, {prev('time_ms')} AS p_time_ms, {both('time_ms', 'ops')} AS pair
      FROM latest l JOIN mx USING (cluster_id, node_id, bucket_ms)),
s AS (SELECT cluster_id, node_id, bucket_ms, status, coalesce(max_value, value) AS value,
             {rate('ops', 900.0)} AS ops, {latency('time_ms', 'ops')} AS latency_ms FROM w),
h AS (SELECT *, least(value, 100.0) AS heap_pct,
             count(*) OVER (PARTITION BY cluster_id, node_id ORDER BY bucket_ms RANGE BETWEEN 1800000 PRECEDING AND CURRENT ROW) AS n3,
             min(coalesce(ops, 0)) OVER (PARTITION BY cluster_id, node_id ORDER BY bucket_ms RANGE BETWEEN 1800000 PRECEDING AND CURRENT ROW) AS m3
      FROM s)
SELECT cluster_id, node_id, bucket_ms,
       CASE WHEN heap_pct IS NULL THEN NULL WHEN heap_pct > 85.0 THEN 'critical' WHEN heap_pct > 75.0 THEN 'warning' ELSE 'ok' END AS heap_level,
       ops * 60.0 >= 1.0 AS old_gc_frequent, heap_pct >= 70.0 AS cpu_high,
       CASE WHEN status <> 'purchase' THEN value * 9 / 1000.0 * 100.0 >= 80.0 END AS fd_high,
       CASE WHEN status = 'error' THEN value ELSE 0 END <> 0 AS swap_used,
       CASE WHEN status <> 'signup' THEN floor(value) % 2 <> 0 END AS breaker_tripped,
       latency_ms > 100.0 AS search_slow, n3 = 3 AND m3 > 0 AS persistent
FROM h
"""

SQL["diag_relocating"] = """
WITH d AS (
  SELECT CAST(user_id % 7 AS VARCHAR) AS cluster_id, (CAST(floor(value / 10) AS BIGINT) + 1) % 4 AS relocating_shards,
         (epoch_us(ts) // 86400000000) * 86400000 AS bucket_ms, ts, event_id
  FROM events WHERE user_id IS NOT NULL
),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, bucket_ms ORDER BY ts DESC, event_id DESC) AS rn FROM d) WHERE rn = 1)
SELECT cluster_id, CAST(bucket_ms AS BIGINT) AS bucket_ms, relocating_shards,
       count(*) OVER w = 3 AND min(coalesce(relocating_shards, 0)) OVER w > 0 AS relocation_unsettled
FROM l WINDOW w AS (PARTITION BY cluster_id ORDER BY bucket_ms RANGE BETWEEN 172800000 PRECEDING AND CURRENT ROW)
"""

SQL["diag_shards"] = f"""
WITH sh AS (
  SELECT p_brand AS cluster_id, lower(p_type) AS index_name, p_partkey AS shard_id,
         CAST(floor(p_retailprice) * {64 * 1024 * 1024} AS BIGINT) AS size_in_bytes,
         CAST(p_size * 1000000 AS BIGINT) AS docs_count,
         CAST(floor(p_retailprice) * 1000 AS BIGINT) AS docs_deleted
  FROM part
),
st AS (SELECT cluster_id, index_name, max(CAST(size_in_bytes AS DOUBLE)) AS mx, avg(CAST(size_in_bytes AS DOUBLE)) AS av FROM sh GROUP BY ALL),
f AS (
  SELECT sh.*, {py_round('mx / av', 4)} AS size_skew, size_in_bytes > {50 * 1024**3} AS too_large, docs_count > 45000000 AS too_many_docs
  FROM sh LEFT JOIN st USING (cluster_id, index_name)
)
SELECT *, {py_round('CASE WHEN docs_count + docs_deleted > 0 THEN CAST(docs_deleted AS DOUBLE) / (CAST(docs_count AS DOUBLE) + CAST(docs_deleted AS DOUBLE)) END', 4)} AS deleted_share,
       coalesce(CASE WHEN docs_count + docs_deleted > 0 THEN CAST(docs_deleted AS DOUBLE) / (CAST(docs_count AS DOUBLE) + CAST(docs_deleted AS DOUBLE)) END > 0.05, false) AS force_merge_candidate
FROM f
"""

SQL["took_extract"] = """
SELECT o_orderkey AS response_id,
       CASE WHEN o_orderstatus = 'P' THEN 'logs-*/_msearch' ELSE 'logs-*/_search' END AS path,
       CASE WHEN o_orderstatus = 'P'
            THEN CAST(list_max([floor(o_totalprice / 100), CASE WHEN o_orderpriority NOT IN ('1-URGENT', '3-MEDIUM') THEN floor(o_custkey / 10) END,
                                CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)]) AS DOUBLE)
            ELSE CAST(floor(o_totalprice / 1000) AS DOUBLE) END AS took
FROM orders
"""

SQL["flatten_settings"] = """
WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events WHERE json_valid(props))
SELECT event_id, 'index.' || key AS key,
       CASE WHEN json_type(props, '$."' || key || '"') = 'VARCHAR' THEN json_extract_string(props, '$."' || key || '"')
            ELSE CAST(json_extract(props, '$."' || key || '"') AS VARCHAR) END AS value
FROM k
"""


def fmt_count_text(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN '-' WHEN regexp_full_match(trim({x}), '-?[0-9]+') THEN format('{{:,}}', CAST(trim({x}) AS HUGEINT)) "
        f"WHEN trim({x}) = '' THEN '-' ELSE trim({x}) END"
    )


SQL["format_scalars"] = f"""
WITH o AS (
  SELECT *, CAST(floor(o_totalprice * o_totalprice * 1000) AS BIGINT) AS size,
         epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1992-01-01 00:00:00') + o_orderkey * 1000 AS ms,
         lower(o_orderpriority) || ',' || lower(o_orderstatus) AS seg
  FROM orders
),
b AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN -size ELSE size END AS sz FROM o)
SELECT o_orderkey, {fmt_bytes('sz')} AS bytes_text, {fmt_duration('ms')} AS duration_text,
       {fmt_count_text('CAST(o_custkey AS VARCHAR)')} AS count_text,
       {fmt_count_text('o_orderpriority')} AS priority_text,
       array_to_string(list_filter(list_transform(string_split(seg, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS targets,
       true AS is_search, false AS is_msearch,
       o_orderpriority AS base_name
FROM b
"""


# --- catalog metadata and cluster status --------------------------------------

SQL["index_settings"] = """
WITH g AS (
  SELECT p_brand AS cluster_id, CASE WHEN p_type = 'PROMO' THEN '.promo' ELSE lower(p_type) END AS index_name, count(*) AS n
  FROM part GROUP BY p_brand, p_type
)
SELECT cluster_id, index_name, 'index.number_of_shards' AS key, CAST(n AS VARCHAR) AS value FROM g
UNION ALL SELECT cluster_id, index_name, 'index.number_of_replicas', '1' FROM g
UNION ALL SELECT cluster_id, index_name, 'index.routing.allocation.include._tier_preference', 'data_hot' FROM g
"""

SQL["index_mappings"] = f"""
WITH {CATALOG}
SELECT cluster_id, index_name, doc_count, true AS has_mapping,
       CASE WHEN index_name = 'small' THEN '{{"error":"no such index"}}'
            ELSE '{{"properties":{{"p_name":{{"type":"text"}},"p_size":{{"type":"integer"}}}}}}' END AS mapping
FROM elig
"""

SQL["cluster_latest_status"] = """
WITH d AS (
  SELECT event_id AS _id, ts AS "timestamp", CAST(user_id % 7 AS VARCHAR) AS cluster_id,
         CASE WHEN event_type = 'error' THEN 'red' WHEN event_type = 'signup' THEN 'yellow' ELSE 'green' END AS status,
         CAST(floor(value / 10) + 1 AS BIGINT) AS number_of_nodes
  FROM events
)
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY "timestamp" DESC, _id DESC) AS rn FROM d) WHERE rn = 1
"""


SQL["profile_records"] = f"""
WITH {SHARDS},
ranked AS (
  SELECT *, q + f + ag AS total, row_number() OVER (PARTITION BY rid ORDER BY q + f + ag DESC, pos) AS slow,
         row_number() OVER (PARTITION BY rid ORDER BY {ms('q')} DESC, pos) AS rq,
         row_number() OVER (PARTITION BY rid ORDER BY {ms('CAST(floor(price) * pos AS BIGINT)')} DESC, pos) AS rc
  FROM sh
),
t AS (
  SELECT rid, count(*) AS shard_count, {ms('sum(q)')} AS total_query_time_ms, {ms('sum(f)')} AS total_fetch_time_ms,
         {ms('sum(ag)')} AS total_aggregation_time_ms, {ms('sum(rw)')} AS total_rewrite_time_ms,
         max(CASE WHEN slow = 1 THEN id END) AS slowest_shard_id, {ms('max(CASE WHEN slow = 1 THEN total END)')} AS slowest_shard_ms,
         string_agg(CAST(id AS VARCHAR), ',' ORDER BY rq) FILTER (rq <= 3) AS top_component_shards,
         string_agg(CAST(id AS VARCHAR), ',' ORDER BY rc) FILTER (rc <= 3) AS top_collector_shards,
         CASE WHEN {ms('sum(q // 4)')} > {ms('sum(q // 2)')} THEN 'build_scorer,score' ELSE 'score,build_scorer' END AS top_phases
  FROM ranked GROUP BY rid
)
SELECT 'Q' || o_orderpriority AS name, 'idx-' || lower(o_orderstatus) || '/_search' AS path, 'GET' AS method,
       CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS iteration,
       CASE WHEN o_orderstatus = 'F' THEN 'original' ELSE 'optimized' END AS query_type,
       CAST(floor(o_totalprice / 100) AS DOUBLE) AS duration_ms, CAST(floor(o_totalprice / 1000) AS DOUBLE) AS took_ms,
       CAST(shard_count AS INTEGER) AS shard_count, total_query_time_ms, total_fetch_time_ms, total_aggregation_time_ms, total_rewrite_time_ms,
       slowest_shard_id, slowest_shard_ms, top_component_shards, top_collector_shards, top_phases
FROM orders JOIN t ON o_orderkey = t.rid
"""


# The default classification of node documents, field by field (see
# adaptors.metric_documents): two counters, their latency and two gauges.
SQL["sample_documents_1h"] = f"""
WITH {METRICS}, m2 AS (
  SELECT *, CAST(cluster_id AS VARCHAR) AS c, CAST(node_id AS VARCHAR) AS n, CAST(floor(value * 1024) AS BIGINT) AS size_bytes FROM metrics
), {bucketed(3_600_000).replace("FROM metrics", "FROM m2")},
mx AS (SELECT cluster_id, node_id, bucket_ms, max(size_bytes * 4) AS max_heap, max(size_bytes) AS max_size FROM b GROUP BY cluster_id, node_id, bucket_ms),
w AS (SELECT l.*, mx.max_heap, mx.max_size, {prev('ops')} AS p_ops, {prev('time_ms')} AS p_time_ms, {both('time_ms', 'ops')} AS pair
      FROM latest l JOIN mx USING (cluster_id, node_id, bucket_ms))
SELECT c AS cluster_id, n AS node_id, bucket_ms, _id, {rate('ops', 3600.0)} AS query_total, {rate('time_ms', 3600.0)} AS query_time_in_millis,
       {latency('time_ms', 'ops')} AS query_latency, CAST(max_heap AS DOUBLE) AS heap_used_in_bytes, CAST(max_size AS DOUBLE) AS size_in_bytes
FROM w
"""


# --- reports ------------------------------------------------------------------

SQL["report_clusters"] = (
    FLEET_REPORT
    + """
SELECT display_name, cluster_name, version, health_status, CASE WHEN available THEN 'yes' ELSE 'no' END AS available, uptime, nodes_count,
       indices_count, primary_shards, total_shards, unassigned_shards, documents_count, storage_used_formatted, storage_total_formatted,
       jvm_used_formatted, jvm_total_formatted, jvm_used_percent, '2024-01-31 00:00:00' AS collection_time
FROM report
"""
)

SQL["report_indices"] = f"""
WITH {CATALOG}
SELECT e.cluster_id, e.index_name, e.doc_count, 'yes' AS has_mapping, least(n, 2) AS sample_count
FROM elig e JOIN (
  SELECT p_brand AS cluster_id, CASE WHEN p_type = 'PROMO' THEN '.promo' ELSE lower(p_type) END AS index_name, count(*) AS n FROM part GROUP BY ALL
) USING (cluster_id, index_name)
"""

SQL["report_runs"] = f"""
WITH {RUNS}
SELECT iteration, CASE WHEN is_warmup THEN 'yes' ELSE 'no' END AS is_warmup, query_type, name, took, duration,
       CASE WHEN success THEN 'success' ELSE 'failure' END AS status
FROM runs
"""

SQL["report_run_statistics"] = f"""
WITH {RUNS},
r AS (SELECT measured_iteration, query_type, sum(took) AS took, sum({DUR}) AS duration FROM mr WHERE query_type IN ('original', 'optimized') GROUP BY ALL),
l AS (SELECT query_type, 'took' AS measure, CAST(took AS DOUBLE) AS total FROM r UNION ALL SELECT query_type, 'duration', CAST(duration AS DOUBLE) FROM r)
SELECT query_type, measure, coalesce({py_round('avg(total)', 2)}, 0.0) AS avg, coalesce(min(total), 0.0) AS min,
       coalesce(max(total), 0.0) AS max, coalesce({py_round('sum(total)', 2)}, 0.0) AS sum
FROM l GROUP BY ALL
"""

SQL["report_record"] = f"""
WITH {RUNS}
SELECT '2024-01-31 00:00:00' AS timestamp, count(*) AS total, count_if(success) AS passed,
       printf('%.2f', count_if(success) / count(*) * 100.0) || '%' AS pass_rate, 2 AS notes
FROM mr
"""


SQL["estimate_approximate"] = f"""
WITH {METRICS}
SELECT count(*) AS rows, count(DISTINCT coalesce(CAST(cluster_id AS VARCHAR), '') || '|' || coalesce(CAST(node_id AS VARCHAR), '')) AS groups,
       true AS within_error
FROM metrics
"""

SQL["sample_null_groups"] = f"""
WITH {METRICS}, {bucketed(86_400_000).replace("node_id IS NOT NULL", "node_id % 3 <> 0")}
SELECT cluster_id, node_id, bucket_ms, _id, status FROM latest
"""

SQL["full_export"] = f"WITH {METRICS} SELECT _id, \"timestamp\", cluster_id, node_id, status, value FROM metrics"

SQL["newest_documents"] = f"WITH {METRICS} SELECT _id, \"timestamp\", status FROM metrics ORDER BY \"timestamp\" DESC, _id LIMIT 500"


SQL["run_logs_pairs"] = SQL["bench_pairs"]

SQL["alert_history"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_orderdate AS "timestamp", o_custkey AS rule_id, o_orderstatus AS state,
       CASE WHEN o_custkey < 1000 THEN '*.*.0.' || o_custkey ELSE '10.0.0.' || o_custkey END AS node
FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1996-06-30 23:59:59'
"""

SQL["alert_rule_list"] = """
SELECT c_custkey AS _id, c_name AS name, c_acctbal > 0 AS enabled, c_mktsegment AS resource_type FROM customer
"""

# Both slices are sampled by themselves, so a bucket that either cuts still ends with its newest document.
SQL["sample_slices"] = f"""
WITH {METRICS}, {bucketed(3_600_000)},
n AS (
  SELECT cluster_id, node_id, bucket_ms,
         CAST(bool_or("timestamp" < TIMESTAMP '2024-01-16 10:20:00') AS BIGINT) + CAST(bool_or("timestamp" >= TIMESTAMP '2024-01-14 22:40:00') AS BIGINT) AS outputs
  FROM b GROUP BY ALL
)
SELECT cluster_id, node_id, bucket_ms, _id, status, value, outputs FROM latest JOIN n USING (cluster_id, node_id, bucket_ms)
"""

SQL["export_nodes"] = f"""
WITH {METRICS},
n AS (SELECT 'node-' || node_id AS name FROM metrics),
k AS (SELECT count(*) AS rows FROM n WHERE regexp_full_match(name, 'node-1.*|node-.') AND NOT regexp_full_match(name, '.*[37]'))
SELECT 'node_stats' AS type, rows, 0 AS failed_types, rows AS rows_read, true AS has_file FROM k
UNION ALL SELECT 'index_stats', 0, 0, 0, true
UNION ALL SELECT 'all', rows, 0, NULL, NULL FROM k
"""

SQL["nested_paths"] = f"""
WITH {METRICS}
SELECT _id, 'node-' || node_id AS node, CAST(ops AS VARCHAR) AS queries, CAST(NULL AS VARCHAR) AS cpu, CAST(NULL AS VARCHAR) AS through FROM metrics
"""

SQL["report_clusters_csv"] = SQL["report_clusters"]

SQL["report_cluster_samples"] = f"""
WITH s AS ({SQL["index_samples"]}),
e AS (WITH {CATALOG} SELECT * FROM elig)
SELECT e.cluster_id, e.cluster_name, e.index_name, e.doc_count, s.doc_rank, s._id, s._source FROM s JOIN e USING (cluster_id, index_name)
"""

SQL["report_index_details"] = f"""
SELECT cluster_id, index_name || '/a\\b' || cluster_id AS index_name, doc_rank, _id, _source FROM ({SQL["index_samples"]})
"""

SQL["report_run_files"] = f"""
SELECT *, (SELECT pass_rate FROM ({SQL["report_record"]})) AS pass_rate FROM ({SQL["report_runs"]})
"""
