"""Plain SQL for each registered query, to be run by another engine over the same tables."""

from __future__ import annotations

from rowferry.functions.typemap import TYPE_MAP
from rowferry.plans.queries import RAW_TYPES

DRIFTED = """
drifted AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         o_totalprice + CASE WHEN o_orderkey % 70 = 0 THEN 1 ELSE 0 END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 50 <> 0)
"""

_KINDS = ", ".join(f"'{k}'" for k in RAW_TYPES)

CATALOG = f"""
catalog AS (
  SELECT 't' || CAST(p_partkey // 40 AS VARCHAR) AS "table",
         CAST(p_partkey % 40 + 1 AS INTEGER) AS ordinal,
         replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 40 AS VARCHAR) AS name,
         replace(([{_KINDS}])[CAST(p_size % {len(RAW_TYPES)} + 1 AS INTEGER)], '%s', CAST(p_size AS VARCHAR)) AS raw_type,
         p_partkey % 3 <> 0 AS nullable,
         CASE WHEN p_partkey % 11 = 0 THEN '0' END AS default_val,
         p_partkey % 40 = 0 AS is_primary
  FROM part)
"""


def _mapped(dialect: str) -> str:
    """A CTE ``map_<dialect>(raw_type, mapped)`` that translates every raw type of the catalog."""
    pairs = ", ".join(f"('{k}', '{v}')" for k, v in TYPE_MAP[("mysql", dialect)].items())
    return f"""
known_{dialect}(base, mapped) AS (VALUES {pairs}),
map_{dialect} AS (
  SELECT c.raw_type,
         COALESCE(w.mapped,
                  CASE WHEN b.mapped IN ('VARCHAR', 'VARCHAR2', 'CHAR', 'DECIMAL', 'NUMERIC', 'NUMBER')
                       THEN b.mapped || regexp_extract(upper(c.raw_type), '\\(.*\\)$') ELSE b.mapped END,
                  upper(c.raw_type)) AS mapped
  FROM (SELECT DISTINCT raw_type FROM catalog) c
  LEFT JOIN known_{dialect} w ON w.base = upper(c.raw_type)
  LEFT JOIN known_{dialect} b ON strpos(c.raw_type, '(') > 0 AND b.base = split_part(upper(c.raw_type), '(', 1))
"""


DRIFTED_CATALOG = f"""
{CATALOG}, {_mapped('postgresql')},
there AS (
  SELECT c."table", c.ordinal,
         CASE WHEN c.ordinal % 10 = 0 THEN 'old_' || c.name WHEN c.ordinal % 4 = 0 THEN upper(c.name) ELSE c.name END AS name,
         CASE WHEN c.ordinal % 7 = 0 THEN 'TEXT' WHEN c.ordinal % 5 = 0 THEN lower(m.mapped) ELSE m.mapped END AS raw_type
  FROM catalog c JOIN map_postgresql m USING (raw_type) WHERE c.ordinal % 9 <> 0),
here AS (
  SELECT c."table", c.ordinal, c.name, m.mapped AS raw_type, c.nullable
  FROM catalog c JOIN map_postgresql m USING (raw_type)),
diffs AS (
  SELECT h."table", CASE WHEN t.name IS NULL THEN 'add' ELSE 'modify' END AS action,
         COALESCE(t.name, h.name) AS name, h.raw_type, h.nullable, h.ordinal AS position
  FROM here h LEFT JOIN there t ON t."table" = h."table" AND lower(t.name) = lower(h.name)
  WHERE t.name IS NULL OR upper(t.raw_type) <> upper(h.raw_type)
  UNION ALL
  SELECT t."table", 'drop', t.name, t.raw_type, TRUE, 1000000 + t.ordinal
  FROM there t WHERE NOT EXISTS (SELECT 1 FROM here h WHERE h."table" = t."table" AND lower(h.name) = lower(t.name)))
"""

FEED = """
feed AS (
  SELECT event_id AS seq, user_id, event_type, value, ts,
         CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op
  FROM events)
"""

USERS = """
users AS (
  SELECT c_custkey AS user_id, 'seed' AS event_type, c_acctbal AS value, CAST(NULL AS TIMESTAMP) AS ts, c_name AS home
  FROM customer WHERE c_custkey % 3 = 0)
"""


def fold_sql(
    feed: str, insert_on_present: bool = False, update_on_absent: bool = False, columns: str = "user_id, event_type, value, ts, home"
) -> str:
    """The feed replayed event by event and key by key.

    ``feed`` defines a CTE of that name with ``seq, op, user_id, event_type, value, ts`` and
    ``keep_value`` (the event leaves ``value`` as it was).
    """
    takes = ["(op = 'I' AND NOT f.present)", "(op = 'U' AND f.present)"]
    takes += ["(op = 'I' AND f.present)"] if insert_on_present else []
    takes += ["(op = 'U' AND NOT f.present)"] if update_on_absent else []
    take = " OR ".join(takes)
    return f"""
WITH RECURSIVE {feed}, {USERS},
steps AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n FROM feed),
ids AS (SELECT user_id FROM users UNION SELECT user_id FROM feed),
fold AS (
  SELECT i.user_id, CAST(0 AS BIGINT) AS n, u.user_id IS NOT NULL AS present, u.event_type, u.value, u.ts, u.home
  FROM ids i LEFT JOIN users u ON u.user_id = i.user_id
  UNION ALL
  SELECT f.user_id, s.n,
         CASE WHEN s.op = 'D' THEN FALSE WHEN {take} THEN TRUE ELSE f.present END,
         CASE WHEN s.op = 'D' THEN NULL WHEN {take} THEN s.event_type ELSE f.event_type END,
         CASE WHEN s.op = 'D' THEN NULL WHEN ({take}) AND NOT s.keep_value THEN s.value ELSE f.value END,
         CASE WHEN s.op = 'D' THEN NULL WHEN {take} THEN s.ts ELSE f.ts END,
         CASE WHEN s.op = 'D' THEN NULL ELSE f.home END
  FROM fold f JOIN steps s ON s.user_id = f.user_id AND s.n = f.n + 1),
final AS (SELECT * FROM fold QUALIFY n = max(n) OVER (PARTITION BY user_id))
SELECT {columns} FROM final WHERE present
"""


PLAIN_FEED = "feed AS (SELECT *, FALSE AS keep_value FROM (WITH " + FEED + " SELECT * FROM feed))"
HOT_FEED = "feed AS (SELECT * REPLACE (CASE WHEN seq % 2 = 0 THEN 3 ELSE user_id END AS user_id), FALSE AS keep_value FROM (WITH " + FEED + " SELECT * FROM feed))"
KEPT_FEED = "feed AS (SELECT *, event_type = 'click' AS keep_value FROM (WITH " + FEED + " SELECT * FROM feed))"
PHASES = "(event_id >= (SELECT (max(event_id) + 1) // 3 FROM events))::INT + (event_id >= 2 * (SELECT (max(event_id) + 1) // 3 FROM events))::INT"
MESSAGE_FEED = f"""
feed AS (
  SELECT seq, op, user_id, event_type, CASE WHEN phase < 2 THEN value END AS value, CASE WHEN phase > 0 THEN props END AS ts, phase = 2 AS keep_value
  FROM (SELECT f.*, props, {PHASES} AS phase FROM (WITH {FEED} SELECT * FROM feed) f JOIN events ON event_id = seq))
"""
MESSAGE_SQL = fold_sql(MESSAGE_FEED, columns="user_id, event_type, value, ts AS props, home").replace("CAST(NULL AS TIMESTAMP) AS ts", "CAST(NULL AS VARCHAR) AS ts")
KEYLESS_SQL = f"""
WITH {FEED}, {USERS},
gone AS (SELECT user_id, max(seq) AS seq FROM feed WHERE op = 'D' GROUP BY 1)
SELECT user_id, event_type FROM users WHERE user_id NOT IN (SELECT user_id FROM gone)
UNION ALL
SELECT f.user_id, f.event_type FROM feed f LEFT JOIN gone g USING (user_id)
WHERE f.op = 'I' AND (g.seq IS NULL OR f.seq > g.seq)"""
MOVED_FEED = """
moved AS (
  SELECT event_id AS seq, user_id AS old_id, event_type, value, ts,
         CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN (user_id * 7 + event_id) % 150 ELSE user_id END AS new_id,
         CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op
  FROM events),
feed AS (
  SELECT seq * 4 AS seq, op, new_id AS user_id, event_type, value, ts, FALSE AS keep_value FROM moved WHERE new_id = old_id
  UNION ALL SELECT seq * 4, 'D', old_id, NULL, NULL, NULL, FALSE FROM moved WHERE new_id <> old_id
  UNION ALL SELECT seq * 4 + 1, 'D', new_id, NULL, NULL, NULL, FALSE FROM moved WHERE new_id <> old_id
  UNION ALL SELECT seq * 4 + 2, 'I', new_id, event_type, value, ts, FALSE FROM moved WHERE new_id <> old_id)
"""

RUNS = """
runs AS (
  SELECT event_id AS id, user_id AS task_id, ts AS start_time,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'success' END AS status,
         CASE WHEN event_type = 'purchase' THEN '/exports/' || CAST(event_id AS VARCHAR) || '.csv' END AS file_path
  FROM events),
jobs AS (
  SELECT c_custkey AS id, c_name AS name, CASE WHEN c_nationkey = 3 THEN 'running' ELSE 'idle' END AS status
  FROM customer WHERE c_custkey % 7 <> 0)
"""

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

ORACLES = {
    "table_scan": """
SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45""",
    "filtered_count": "SELECT count(*) AS rows FROM lineitem WHERE l_discount >= 0.05",
    "filtered_copy": """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus, o_totalprice
FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 200000""",
    "mapped_copy": "SELECT c_custkey AS id, c_name AS full_name, c_mktsegment FROM customer",
    "or_filter_with_watermark": """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE (o_orderstatus = 'P' OR o_totalprice > 200000) AND o_orderkey > 700""",
    "incremental_id": """
SELECT o_orderkey, o_custkey, o_orderdate FROM orders
WHERE o_orderpriority LIKE '1%' AND o_orderkey > 500
  AND o_orderkey <= (SELECT max(o_orderkey) FROM orders WHERE o_orderpriority LIKE '1%')""",
    "incremental_ts": """
SELECT event_id, ts, user_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-20 04:00:00'""",
    "incremental_two_runs": "SELECT * FROM events",
    "next_watermark": "SELECT max(o_orderkey) AS high_water FROM orders WHERE o_orderstatus <> 'P'",
    "point_lookup": """
SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey < 1500 AND l_orderkey % 15 = 0""",
    "key_bounds": """
SELECT COALESCE(min(l_orderkey), 0) AS low, COALESCE(max(l_orderkey), 0) AS high FROM lineitem WHERE l_returnflag = 'N'""",
    "shard_counts": """
WITH b AS (SELECT min(l_orderkey) AS lo, (max(l_orderkey) - min(l_orderkey) + 8) // 8 AS step FROM lineitem)
SELECT CAST(least((l_orderkey - b.lo) // b.step, 7) AS INTEGER) AS shard, count(*) AS rows FROM lineitem, b GROUP BY 1""",
    "balanced_shards": "SELECT unnest(['squared', 'name', 'at']) AS key, 8 AS shards, TRUE AS even, (SELECT count(*) FROM lineitem) AS rows",
    "balanced_union": "SELECT l_orderkey, l_linenumber, 'k' || CAST(l_orderkey * l_orderkey AS VARCHAR) AS name FROM lineitem",
    "resumed_job": "SELECT o_orderkey AS order_id, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 200000",
    "late_rows": "SELECT * FROM events",
    "resumed_upsert": "SELECT * FROM events",
    "shard_union": "SELECT * FROM labels",
    "resumed_copy": "SELECT * FROM orders",
    "insert_skip": f"""
WITH {DRIFTED}
SELECT * FROM drifted UNION ALL
SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM drifted)""",
    "upsert": f"""
WITH {DRIFTED},
src AS (SELECT o_orderkey, o_totalprice, lower(o_orderstatus) AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 1)
SELECT COALESCE(d.o_orderkey, s.o_orderkey) AS o_orderkey, d.o_custkey,
       CASE WHEN s.o_orderkey IS NULL THEN d.o_orderstatus ELSE s.o_orderstatus END AS o_orderstatus,
       CASE WHEN s.o_orderkey IS NULL THEN d.o_totalprice ELSE s.o_totalprice END AS o_totalprice,
       d.o_orderdate, d.o_orderpriority, 't' || CAST(d.o_custkey AS VARCHAR) AS note
FROM drifted d FULL JOIN src s ON s.o_orderkey = d.o_orderkey""",
    "upsert_last_wins": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_shipdate DESC, l_quantity DESC) = 1""",
    "upsert_job": """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 25 = 0 THEN CAST(o_custkey AS DOUBLE) ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders""",
    "replace_docs": """
SELECT doc_id, lang, source, n_chars, NULL AS revision FROM documents WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, upper(lang), NULL, NULL, 'v2' FROM documents WHERE doc_id % 3 = 0""",
    "duplicate_keys": """
WITH n AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
     o AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT n.l_orderkey, n.l_linenumber, n.c AS new_rows, COALESCE(o.c, 0) AS existing_rows
FROM n LEFT JOIN o USING (l_orderkey, l_linenumber) WHERE n.c + COALESCE(o.c, 0) > 1""",
    "append_job": "SELECT * FROM customer",
    "structure_job": "SELECT s_suppkey, s_nationkey, CAST(NULL AS VARCHAR) AS s_name, CAST(NULL AS DOUBLE) AS s_acctbal FROM supplier",
    "export_query": """
SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(count(*) AS VARCHAR) AS orders, CAST(min(o_orderkey) AS VARCHAR) AS first_order
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey""",
    "feed_rejects": f"""
WITH {FEED}
SELECT seq, CASE WHEN seq % 97 = 0 THEN 'T' ELSE op END AS op,
       CASE WHEN seq % 97 = 0 THEN 'unknown operation' WHEN seq % 89 = 0 THEN 'no row image' ELSE 'null key' END AS reason
FROM feed WHERE seq % 97 = 0 OR seq % 89 = 0 OR seq % 83 = 0""",
    "csv_round_trip": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, COALESCE(lang, '') AS lang, COALESCE(text, '') AS text FROM documents",
    "type_map": f"""
WITH {CATALOG}, {_mapped('postgresql')}, {_mapped('oracle')}
SELECT "table", ordinal, raw_type, p.mapped AS pg_type, o.mapped AS oracle_type
FROM catalog JOIN map_postgresql p USING (raw_type) JOIN map_oracle o USING (raw_type)""",
    "catalog_primary_keys": f"""
WITH {CATALOG} SELECT "table", ordinal, name, ordinal % 13 = 0 AS is_primary FROM catalog""",
    "auto_map": f"""
WITH {DRIFTED_CATALOG}
SELECT h."table", h.name AS source_field, t.name AS target_field, TRUE AS enabled
FROM here h JOIN there t ON t."table" = h."table" AND lower(t.name) = lower(h.name)""",
    "create_table_ddl": f"""
WITH {CATALOG}, {_mapped('postgresql')},
lines AS (
  SELECT "table", ordinal, is_primary, '"' || name || '"' AS quoted,
         '"' || name || '" ' || mapped || CASE WHEN NOT nullable AND NOT is_primary THEN ' NOT NULL' ELSE '' END
           || COALESCE(' DEFAULT ' || default_val, '') AS line
  FROM catalog JOIN map_postgresql USING (raw_type))
SELECT "table", 'CREATE TABLE "' || "table" || '" (' || chr(10) || '  ' || string_agg(line, ',' || chr(10) || '  ' ORDER BY ordinal)
         || COALESCE(',' || chr(10) || '  PRIMARY KEY (' || string_agg(quoted, ', ' ORDER BY ordinal) FILTER (WHERE is_primary) || ')', '')
         || chr(10) || ')' AS ddl
FROM lines GROUP BY "table" """,
    "schema_diff": f"""
WITH {DRIFTED_CATALOG} SELECT "table", action, name, raw_type, CAST(position AS INTEGER) AS position FROM diffs""",
    "alter_ddl": f"""
WITH {DRIFTED_CATALOG}
SELECT "table", CAST(position AS INTEGER) AS position,
       'ALTER TABLE "' || "table" || '" ' ||
       CASE action WHEN 'add' THEN 'ADD COLUMN "' || name || '" ' || raw_type || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END
                   WHEN 'modify' THEN 'ALTER COLUMN "' || name || '" TYPE ' || raw_type
                   ELSE 'DROP COLUMN "' || name || '"' END AS ddl
FROM diffs""",
    "quality_counts": f"""
WITH {DRIFTED}
SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 0) AS source_rows, (SELECT count(*) FROM drifted) AS target_rows""",
    "quality_sample": f"""
WITH {DRIFTED}, sample AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50)
SELECT count(*) AS sample_total,
       count(*) FILTER (WHERE d.o_orderkey IS NOT NULL AND abs(s.o_totalprice - d.o_totalprice) < 0.0001
         AND s.o_custkey = d.o_custkey AND s.o_orderstatus = d.o_orderstatus AND s.o_orderdate = d.o_orderdate
         AND s.o_orderpriority = d.o_orderpriority) AS sample_matched
FROM sample s LEFT JOIN drifted d ON d.o_orderkey = s.o_orderkey""",
    "quality_random_sample": "SELECT least(count(*), 50) AS sample_total, least(count(*), 50) AS sample_matched FROM orders",
    "quality_status": """
SELECT count(*) AS source_rows, count(*) AS target_rows, least(count(*), 50) AS sample_total,
       count(*) FILTER (WHERE n <= 50 AND o_orderkey % 20 <> 0) AS sample_matched,
       CASE WHEN count(*) FILTER (WHERE n <= 50 AND o_orderkey % 20 <> 0) / least(count(*), 50) < 0.98 THEN 'failed' ELSE 'passed' END AS status
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)""",
    "full_compare": """
SELECT count(*) AS source_keys,
       count(*) FILTER (WHERE there AND same_q AND same_r) AS matched,
       count(*) FILTER (WHERE NOT there) AS missing, CAST(0 AS BIGINT) AS extra,
       count(*) FILTER (WHERE there AND NOT same_q) AS diff_l_quantity, CAST(0 AS BIGINT) AS diff_l_extendedprice,
       count(*) FILTER (WHERE there AND NOT same_r) AS diff_l_returnflag, CAST(0 AS BIGINT) AS diff_l_shipdate,
       (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) FROM lineitem) AS source_repeats,
       (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) FROM lineitem WHERE l_orderkey % 50 <> 0) AS target_repeats
FROM (SELECT l_orderkey % 50 <> 0 AS there, l_partkey % 70 <> 0 AS same_q, l_suppkey % 9 <> 0 AS same_r
      FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem))""",
    "compare_tables": """
SELECT count(*) AS source_keys,
       count(*) FILTER (WHERE there AND same_q AND same_r) AS matched,
       count(*) FILTER (WHERE NOT there) AS missing, CAST(0 AS BIGINT) AS extra,
       count(*) FILTER (WHERE there AND NOT same_q) AS diff_l_quantity, CAST(0 AS BIGINT) AS diff_l_extendedprice,
       count(*) FILTER (WHERE there AND NOT same_r) AS diff_l_returnflag, CAST(0 AS BIGINT) AS diff_l_shipdate,
       (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) FROM lineitem) AS source_repeats,
       (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) FROM lineitem WHERE l_orderkey % 50 <> 0) AS target_repeats
FROM (SELECT l_orderkey % 50 <> 0 AS there, l_partkey % 70 <> 0 AS same_q, l_suppkey % 9 <> 0 AS same_r
      FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem))""",
    "differing_keys": """
SELECT o_orderkey, CAST(1 AS BIGINT) AS source_rows, CAST(CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE 1 END AS BIGINT) AS target_rows
FROM orders WHERE o_orderkey % 50 = 0 OR o_orderkey % 70 = 0""",
    "descend_keys": """
SELECT o_orderkey, CAST(1 AS BIGINT) AS source_rows, CAST(CASE WHEN o_orderkey = n // 3 THEN 0 ELSE 1 END AS BIGINT) AS target_rows
FROM orders, (SELECT max(o_orderkey) AS n FROM orders) WHERE o_orderkey BETWEEN n * 2 // 5 AND n * 2 // 5 + 20 OR o_orderkey = n // 3""",
    "tolerant_match": """
SELECT l_returnflag, count(*) AS rows, count(*) FILTER (WHERE l_linenumber <> 7 AND l_suppkey % 5 <> 0) AS matched
FROM lineitem GROUP BY 1""",
    "param_query": """
SELECT c.c_mktsegment AS segment, 'since 1995-03-01' AS label, count(*) AS orders, max(o.o_totalprice) AS top_price
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
WHERE o.o_orderdate >= TIMESTAMP '1995-03-01' AND o.o_orderstatus = 'O' AND c.c_nationkey < 12
GROUP BY c.c_mktsegment""",
    "sql_import": """
SELECT c_custkey, c_name, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey
WHERE o_totalprice > 100000 GROUP BY ALL""",
    "preview_page": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 20
ORDER BY 1, 2, 3, 4 LIMIT 500 OFFSET 1000""",
    "page_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 250 OFFSET 100",
    "page_deep": """
SELECT l_returnflag, l_linenumber, l_orderkey, l_partkey, l_suppkey FROM lineitem
ORDER BY l_linenumber, l_orderkey, l_partkey, l_suppkey LIMIT 300 OFFSET 4000""",
    "page_text_rest": """
SELECT lang, source, doc_id FROM (SELECT nullif(lang, 'en') AS lang, source, text, doc_id FROM documents)
ORDER BY lang NULLS FIRST, source NULLS FIRST, text NULLS FIRST, doc_id OFFSET (SELECT count(*) // 3 FROM documents)""",
    "page_ties": """
SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem
ORDER BY l_linestatus, l_returnflag, l_linenumber LIMIT (SELECT count(*) // 2 FROM lineitem) OFFSET 5000""",
    "apply_changes_strict": fold_sql(PLAIN_FEED),
    "apply_changes_upsert": fold_sql(PLAIN_FEED, True, True),
    "apply_changes_hot": fold_sql(PLAIN_FEED),
    "apply_changes_one_key": fold_sql(HOT_FEED),
    "apply_key_moves": fold_sql(MOVED_FEED),
    "apply_unchanged_values": fold_sql(KEPT_FEED),
    "apply_keyless": KEYLESS_SQL,
    "stream_keyless": KEYLESS_SQL,
    "apply_schema_messages": MESSAGE_SQL,
    "stream_schema_messages": MESSAGE_SQL,
    "schema_message_rejects": """
SELECT event_id * 2 + 1 AS seq, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS kind, 99::BIGINT AS relation, 'unknown relation' AS reason
FROM events WHERE event_id % 50 = 0""",
    "mapped_feed": fold_sql(PLAIN_FEED, True, True, "user_id, event_type AS last_event, ts, home"),
    "stream_replicate": fold_sql(PLAIN_FEED),
    "flatten_documents": f"""
SELECT event_id AS _id, user_id, event_type AS "event.type", {K} AS "event.detail.k", value AS "event.detail.amount" FROM events""",
    "document_filter": f"""
SELECT event_id AS _id, user_id FROM events
WHERE ((event_type = 'purchase' AND value >= 15) OR {K} IN (1, 2, 3) OR (event_type = 'signup' AND {K} > 90 AND {K} <= 95))
  AND user_id <> 7""",
    "document_round_trip": f"""
SELECT event_id AS _id, {K} AS "event.detail.k", value AS "event.detail.amount" FROM events WHERE event_type NOT IN ('click', 'view')""",
    "run_report": f"""
WITH {RUNS} SELECT r.id, r.task_id, r.status, j.name AS task_name FROM runs r LEFT JOIN jobs j ON j.id = r.task_id WHERE r.status = 'failed'""",
    "verified_job": """
WITH n AS (SELECT count(*) AS whole, count(*) FILTER (o_orderstatus = 'P' OR o_totalprice > 200000) AS copied FROM orders)
SELECT 'orders-copy' AS job, 'success' AS status, copied AS rows_synced, whole AS source_rows, copied AS target_rows, least(whole, 50) AS sample_total,
       CASE WHEN whole - copied > 0.01 * whole THEN 'failed' WHEN whole <> copied THEN 'warning' ELSE 'passed' END AS quality_status FROM n""",
    "run_log_rows": """
WITH n AS (SELECT count(*) FILTER (o_orderstatus = 'P' OR o_totalprice > 200000) AS copied FROM orders)
SELECT 'orders-copy' AS job, 'success' AS status, copied AS rows_synced, FALSE AS has_error, TRUE AS ended, 'manual' AS triggered_by, NULL AS quality_status FROM n
UNION ALL SELECT 'no-table', 'failed', 0, TRUE, TRUE, 'manual', NULL
UNION ALL SELECT 'again', 'success', copied, FALSE, TRUE, 'manual', 'passed' FROM n""",
    "latest_runs": f"""
WITH {RUNS}
SELECT r.id, r.task_id, r.status, j.name AS task_name FROM runs r LEFT JOIN jobs j ON j.id = r.task_id ORDER BY r.id DESC LIMIT 10""",
    "latest_files": f"""
WITH {RUNS}
SELECT task_id, max(id) AS last_run, arg_max(status, id) AS last_status,
       arg_max(file_path, id) FILTER (WHERE status = 'success' AND file_path IS NOT NULL) AS file_path
FROM runs GROUP BY task_id""",
    "run_summary": f"""
WITH {RUNS}
SELECT (SELECT count(*) FROM supplier) AS endpoints, (SELECT count(*) FROM jobs) AS jobs,
       (SELECT count(*) FROM jobs WHERE status = 'running') AS running_jobs,
       (SELECT count(*) FROM runs WHERE CAST(start_time AS DATE) = DATE '2024-01-15') AS runs_today""",
    "differing_keys_nulls": "SELECT o_orderkey, CAST(1 AS BIGINT) AS source_rows, CAST(1 AS BIGINT) AS target_rows FROM orders WHERE o_orderkey % 4 IN (1, 2)",
    "compare_tables_nulls": """
SELECT count(*) AS source_keys, count(*) FILTER (WHERE o_orderkey % 4 NOT IN (1, 2)) AS matched, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra,
       count(*) FILTER (WHERE o_orderkey % 4 IN (1, 2)) AS diff_a, count(*) FILTER (WHERE o_orderkey % 4 IN (1, 2)) AS diff_b,
       CAST(0 AS BIGINT) AS source_repeats, CAST(0 AS BIGINT) AS target_repeats
FROM orders""",
    "full_compare_repeats": """
SELECT count(*) AS source_keys, count(*) AS matched, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS diff_o_totalprice,
       CAST(0 AS BIGINT) AS source_repeats, CAST(2 * count(*) FILTER (WHERE o_orderkey % 10 = 0) AS BIGINT) AS target_repeats
FROM orders""",
    "decimal_match": """
SELECT o_orderstatus, count(*) FILTER (WHERE o_orderkey % 3 <> 1) AS decimals, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS longs FROM orders GROUP BY 1""",
    "chained_upsert": "SELECT * FROM orders WHERE o_orderkey % 2 = 0",
    "incremental_ltz_whole": "SELECT event_id, 1700000000 + event_id AS seconds FROM events",
    "inferred_schema": """
SELECT * FROM (VALUES (1, '_id', 'int', false, true), (2, 'mixed', 'string', true, false), (3, 'sub.even', 'bool', true, false), (4, 'sub.rare', 'double', true, false)) AS t(ordinal, name, raw_type, nullable, is_primary)
WHERE EXISTS (SELECT 1 FROM events)""",
    "schema_columns": """
SELECT table_name AS "table", CAST(ordinal_position AS INTEGER) AS ordinal, column_name AS name,
       CASE data_type WHEN 'VARCHAR' THEN 'STRING' WHEN 'INTEGER' THEN 'INT' WHEN 'TIMESTAMP' THEN 'TIMESTAMP_NTZ' ELSE data_type END AS raw_type,
       column_name IN ('n_nationkey', 'o_orderkey') AS is_primary
FROM (SELECT table_name, column_index AS ordinal_position, column_name, data_type FROM duckdb_columns()
      WHERE table_name IN ('nation', 'orders', 'lineitem'))""",
    "param_quoted": r"""
SELECT c_mktsegment, '<\' || chr(39) || ' OR true --|F>' AS said, 'it' || chr(39) || 's' AS plain, count(*) AS n
FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1""",
    "feed_unfit": """
SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op,
       CASE WHEN event_id % 71 = 0 THEN 'key of another type' ELSE 'value of another type' END AS reason
FROM events WHERE event_id % 71 = 0 OR (event_id % 53 = 0 AND event_type <> 'error')""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
