"""The same answers stated independently in SQL over the Parquet tables."""

_EXPIRED = "o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 7 DAY"
_K = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


def _batches(size: int | str) -> str:
    return f"""SELECT o_orderkey AS job_id,
        CAST((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // {size} AS INTEGER) AS batch_no
      FROM orders WHERE {_EXPIRED}"""


ANSWERS = {
    "expired_keys": f"""SELECT o_orderkey AS job_id FROM orders WHERE {_EXPIRED}
      ORDER BY o_orderdate, o_orderkey LIMIT 5000""",
    "batch_assign": _batches(1000),
    "batch_count": "SELECT CAST(ceil(count(*) / 700.0) AS BIGINT) AS n_batches FROM orders",
    "children_semi": f"""SELECT * FROM lineitem
      WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE {_EXPIRED})""",
    "children_in_ranges": f"""SELECT * FROM lineitem
      WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE {_EXPIRED})""",
    "retained_anti": f"""SELECT * FROM lineitem
      WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE {_EXPIRED})""",
    "delete_by_key": f"""SELECT kind, orders.*, CAST(year(o_orderdate) AS INTEGER) AS year
      FROM orders, (VALUES ('whole'), ('by year')) t(kind) WHERE NOT ({_EXPIRED})""",
    "run_summary": f"""WITH k AS ({_batches(1000)})
      SELECT batch_no, count(DISTINCT job_id) AS n_jobs, count(l_orderkey) AS n_trace
      FROM k LEFT JOIN lineitem ON l_orderkey = job_id GROUP BY batch_no""",
    "json_fields": _K,
    "json_unescape": _K,
    "xz_json_lines": _K,
    "json_parse_status": """SELECT CASE event_id % 5 WHEN 0 THEN 'null_input' WHEN 1 THEN 'blank'
        WHEN 2 THEN 'malformed' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY 1""",
    "sample_failed_rows": """SELECT event_id, substring('not json ' || repeat(props, 30), 1, 150) AS snippet,
        'not json ' || repeat(props, 30) AS text FROM events WHERE event_id % 5 = 2 ORDER BY event_id LIMIT 3""",
    "json_infer_flatten": """SELECT o_orderkey AS id,
        CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS meta__pri FROM orders""",
    "json_infer_fallback": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        'say "hi"' AS s FROM events""",
    "blank_json_shape": "SELECT event_id AS job_id, '' AS LPMPASSNAME FROM events",
    "preferred_field": "SELECT event_id, event_type AS pass_name FROM events",
    "to_json_cells": """SELECT c_custkey AS key, '[' || c_custkey || ',' || c_nationkey || ']' AS arr_json,
        '{"name":"' || c_name || '"}' AS obj_json FROM customer""",
    "fill_empty_strings": """SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), '') AS o_orderstatus,
        nullif(o_custkey, 1) AS o_custkey FROM orders""",
    "flatten_structs": """SELECT c_custkey AS key, c_name AS info__name, c_nationkey AS info__loc__nation
      FROM customer""",
    "cast_columns": "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders",
    "union_missing_columns": """
      SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_mktsegment AS segment,
        CAST(NULL AS DOUBLE) AS bal FROM customer
      UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL, s_acctbal FROM supplier
      UNION ALL SELECT 'r' || r_regionkey, r_name, NULL, NULL FROM region""",
    "reconcile_types": """SELECT o_orderkey AS id,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS num,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1 END AS tags_n,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS tags_0,
        '[1,' || (o_orderkey % 7) || ']' AS note,
        '{"s":"' || o_orderstatus || '"}' AS obj, CAST(NULL AS DOUBLE) AS gone FROM orders""",
    "create_append_roundtrip": "SELECT * FROM orders UNION ALL SELECT * FROM orders",
    "partitioned_write": "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders",
    "evolve_append": """SELECT p_partkey AS key, p_name AS name,
        CASE WHEN p_partkey % 10 <> 5 THEN p_size END AS size,
        CASE WHEN p_partkey % 2 = 1 THEN p_type END AS type,
        CASE WHEN p_partkey % 10 = 5 THEN '{"size":"unknown"}' END AS lost_values FROM part""",
    "nested_growth": f"""SELECT o_orderkey AS id, 'ok' AS parse_status, o_orderstatus AS code,
        CASE WHEN year(o_orderdate) >= 1996 THEN o_orderpriority END AS pri,
        CAST(CASE WHEN year(o_orderdate) >= 1996 THEN 2 ELSE 1 END AS INTEGER) AS n_items, o_orderkey AS first_k,
        CASE WHEN year(o_orderdate) >= 1996 THEN CAST(o_orderkey % 9 + 0.5 AS DOUBLE) END AS second_w
      FROM orders WHERE {_EXPIRED}""",
    "next_batch_index": """SELECT 'empty' AS state, 1 AS next_index
      UNION ALL SELECT 'loaded', CAST(max(l_linenumber) + 1 AS INTEGER) FROM lineitem""",
    "batch_index_append": """SELECT CAST(event_id % 3 + 1 AS INTEGER) AS batch_index, count(*) AS n,
        CAST(sum(event_id) AS BIGINT) AS sum_event_id, CAST(sum(user_id) AS BIGINT) AS sum_user_id
      FROM events GROUP BY 1""",
    "idempotent_append": """SELECT CAST(o_orderkey % 4 AS INTEGER) AS batch_no, count(*) AS n,
        CAST(sum(o_orderkey) AS BIGINT) AS sum_o_orderkey, CAST(sum(o_custkey) AS BIGINT) AS sum_o_custkey
      FROM orders GROUP BY 1""",
    "compact_batches": """SELECT CAST(o_orderkey % 3 AS INTEGER) AS batch_no, count(*) AS n,
        CASE WHEN o_orderkey % 3 < 2 THEN 1 ELSE count(DISTINCT month(o_orderdate)) END AS n_files,
        CAST(sum(o_orderkey) AS BIGINT) AS sum_o_orderkey, CAST(sum(o_custkey) AS BIGINT) AS sum_o_custkey
      FROM orders GROUP BY o_orderkey % 3""",
    "archive_end_to_end": f"""WITH k AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE {_EXPIRED}),
      items AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1),
      docs AS (SELECT event_id, CASE WHEN event_id % 5 IN (0, 2) THEN 1 ELSE 0 END AS bad,
          CASE WHEN event_id % 5 NOT IN (0, 2) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k
        FROM events)
      SELECT 'archived ' || o_orderstatus AS part, count(*) AS n_jobs,
        CAST(coalesce(sum(n), 0) AS BIGINT) AS n_details, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_trace,
        CAST(coalesce(sum(qty), 0) AS BIGINT) AS qty, count(event_id) AS n_docs,
        CAST(coalesce(sum(bad), 0) AS BIGINT) AS n_rejected, CAST(coalesce(sum(docs.k), 0) AS BIGINT) AS sum_k
      FROM k LEFT JOIN items ON l_orderkey = o_orderkey LEFT JOIN docs ON event_id = o_orderkey
      GROUP BY o_orderstatus
      UNION ALL SELECT 'jobs', count(*), NULL, NULL, NULL, NULL, NULL, NULL FROM orders WHERE NOT ({_EXPIRED})
      UNION ALL SELECT t, count(*), NULL, NULL, NULL, NULL, NULL, NULL
        FROM lineitem, (VALUES ('details'), ('trace')) v(t)
        WHERE l_orderkey NOT IN (SELECT o_orderkey FROM k) GROUP BY t
      UNION ALL SELECT 'documents', count(*), NULL, NULL, NULL, NULL, NULL, NULL
        FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM k)""",
    "manifest_gate": f"""WITH k AS ({_batches("CAST(ceil(count(*) OVER () / 24.0) AS BIGINT)")})
      SELECT job_id FROM k WHERE batch_no NOT IN (
        SELECT batch_no FROM k JOIN orders ON o_orderkey = job_id
        WHERE (month(o_orderdate) <= 6 AND day(o_orderdate) = 1) OR job_id = (SELECT max(job_id) FROM k))""",
    "archive_sql_view": f"""SELECT l_returnflag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS sum_key,
        CAST(sum(l_partkey) AS BIGINT) AS sum_part FROM lineitem
      WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE {_EXPIRED}) GROUP BY l_returnflag""",
}
