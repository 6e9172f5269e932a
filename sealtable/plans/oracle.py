"""DuckDB counterparts of the registered queries, on the same Parquet tables."""

from __future__ import annotations

# Customers' canonical JSON, hashed.
H = (
    """sha256('{"c_acctbal": ' || c_acctbal::varchar || ', "c_custkey": ' || c_custkey::varchar || ', "c_mktsegment": "' """
    """|| c_mktsegment || '", "c_name": "' || c_name || '", "c_nationkey": ' || c_nationkey::varchar || '}')"""
)
T = f"(SELECT row_number() OVER (ORDER BY c_custkey) AS id, *, {H} AS hash FROM customer)"
LINE_HASH = (
    """sha256('{"l_linestatus": "' || l_linestatus || '", "l_partkey": ' || l_partkey::varchar || ', "l_quantity": ' """
    """|| l_quantity::varchar || ', "l_returnflag": "' || l_returnflag || '"}')"""
)
L = (
    "(SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
    "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS id, l_partkey, l_quantity, l_returnflag, l_linestatus, "
    f"{LINE_HASH} AS hash FROM lineitem)"
)


def _json(text: str) -> str:
    """A string's JSON body where it has quotes, backslashes, line feeds and tabs, but nothing beyond ASCII."""
    return rf"""replace(replace(replace(replace({text}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t')"""


def _ascii(text: str) -> str:
    r"""The same with characters beyond ASCII as \uXXXX (of the basic plane)."""
    each = (
        "CASE WHEN ord(c) > 126 THEN '\\u' || lpad(lower(to_hex(ord(c))), 4, '0') ELSE c END"
    )
    return f"list_aggregate(list_transform(string_split({_json(text)}, ''), lambda c: {each}), 'string_agg', '')"


def oracle_sql() -> dict[str, str]:
    return {
        "scan_all": "SELECT * FROM customer",
        "select_eq": "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'",
        "select_conjunction": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'",
        "select_limit_ordered": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10",
        "select_eq_limit": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 5",
        "select_type_mismatch_count": "SELECT count(*) AS n FROM customer WHERE false",
        "select_eq_null": "WITH u AS (SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN NULL ELSE c_mktsegment END AS seg FROM customer) SELECT * FROM u WHERE seg IS NULL",
        "insert_rows": "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 25, 'ATLANTIS', 0",
        "insert_autoincrement_id": "SELECT row_number() OVER (ORDER BY c_custkey) AS id, c_custkey FROM customer",
        "update_eq": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0::double ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer",
        "update_count": "SELECT count(*) AS updated_count FROM customer WHERE c_mktsegment = 'BUILDING'",
        "update_rehash": f"SELECT c_custkey, {H} AS hash FROM (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0::double ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer)",
        "delete_eq": "SELECT * FROM customer WHERE NOT coalesce(c_mktsegment = 'BUILDING', false)",
        "delete_count": "SELECT count(*) AS deleted_count FROM customer WHERE c_mktsegment = 'BUILDING'",
        "delete_all_remaining": "SELECT count(*) AS n FROM customer WHERE false",
        "value_hash": "SELECT p_partkey, sha256(p_name) AS value_hash FROM part",
        "row_hash": f"SELECT c_custkey, {H} AS hash FROM customer",
        "find_by_hash": f"SELECT id, c_custkey, c_name FROM {T} WHERE hash = (SELECT hash FROM {T} WHERE id = 42)",
        "find_by_hash_prefix": f"SELECT id, c_custkey, hash FROM {T} WHERE starts_with(hash, 'a')",
        "find_by_hash_duplicates": f"SELECT id, l_partkey FROM {L} WHERE hash = (SELECT min(hash) FROM (SELECT hash FROM {L} GROUP BY hash HAVING count(*) > 1))",
        "find_by_hashed_value": f"SELECT id, c_custkey FROM {T} WHERE c_custkey = 7",
        "find_by_hash_and_column": f"SELECT id, c_custkey FROM {T} WHERE hash = (SELECT hash FROM {T} WHERE id = 42) AND c_nationkey = (SELECT c_nationkey FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 41)",
        "verify_integrity_summary": "SELECT count(*) AS total_rows, count(*) FILTER (WHERE c_custkey % 100 <> 0) AS valid_hashes, count(*) FILTER (WHERE c_custkey % 100 = 0) AS invalid_hashes FROM customer",
        "verify_integrity_corrupted": f"SELECT id, repeat('0', 64) AS stored_hash, hash AS computed_hash FROM {T} WHERE c_custkey % 100 = 0",
        "hash_stats": f"SELECT (SELECT count(*) FROM lineitem) AS total_rows, count(*) AS unique_hashes, count(*) FILTER (WHERE n > 1) AS duplicate_hash_count, (sum(n) - count(*))::double / greatest(sum(n), 1)::double AS hash_collision_rate FROM (SELECT {LINE_HASH} AS hash, count(*) AS n FROM lineitem GROUP BY 1)",
        "hash_duplicates": f"SELECT hash, count(*) AS n, min(id) AS min_id, max(id) AS max_id FROM {L} GROUP BY hash HAVING count(*) > 1",
        "repair_hash_index": f"SELECT count(*) AS repaired_rows, count(DISTINCT {LINE_HASH}) AS unique_hashes FROM lineitem",
        "compare_hash_row": "SELECT true AS matches",
        "index_build": "SELECT c_mktsegment AS key, count(*) AS n_ids FROM customer GROUP BY 1",
        "index_lookup": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders)",
        "index_statistics": "SELECT count(DISTINCT o_orderpriority) AS unique_values, count(*) AS total_entries FROM orders",
        "txn_commit": "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'AMERICAS_' || n_name ELSE n_name END AS n_name, n_regionkey FROM (SELECT * FROM nation UNION ALL SELECT 25, 'ATLANTIS', 1) WHERE n_regionkey <> 0",
        "txn_rollback": "SELECT * FROM nation",
        "export_json_rows": "SELECT r_regionkey, r_name FROM region",
        "import_json_roundtrip": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
        "table_row_counts": "SELECT 'customer' AS table_name, count(*) AS row_count FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem",
        "database_info": "SELECT 3 AS tables_count, ((SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem))::bigint AS total_rows",
        "document_row_hash_dedup": "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
        "db_insert": f"SELECT id, * EXCLUDE (id), {H} AS hash FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS id, * FROM customer UNION ALL SELECT (SELECT count(*) + 1 FROM customer), -1, 'ATLANTIS', 1, 0.5, 'NONE')",
        "db_update": f"SELECT *, {H} AS hash FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS id, * REPLACE (CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0::double ELSE c_acctbal END AS c_acctbal) FROM customer)",
        "db_update_one": f"SELECT *, {H} AS hash FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS id, * REPLACE (CASE WHEN c_custkey = 7 THEN 'SEVEN' ELSE c_name END AS c_name) FROM customer)",
        "db_delete": f"SELECT * FROM {T} WHERE c_mktsegment <> 'BUILDING'",
        "db_select_limit": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 7",
        "db_find_by_hash": f"SELECT id, c_custkey, hash FROM {T}, range(2) WHERE id = 42",
        "db_verify": "SELECT 'damaged' AS state, count(*) AS total_rows, count(*) FILTER (WHERE c_custkey % 2 = 0) AS valid_hashes, count(*) FILTER (WHERE c_custkey % 2 <> 0) AS invalid_hashes FROM customer UNION ALL SELECT 'repaired', count(*), count(*), 0 FROM customer",
        "db_index": "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS key, count(*) AS n_ids FROM customer GROUP BY 1",
        "db_info": "SELECT 1::bigint AS tables_count, count(*) AS total_rows, 5::bigint AS version, 4::bigint AS page_count FROM customer",
        "db_time_travel": f"SELECT * FROM {T}",
        "event_row_hash": f"""SELECT event_id, sha256('{{"event_id": ' || event_id::varchar || ', "event_type": "' || event_type || '", "props": "' || {_json("props")} || '", "ts": "' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '", "user_id": ' || user_id::varchar || ', "value": ' || value::varchar || '}}') AS hash FROM events""",
        "conversation_row_hash": f"""SELECT conv_id, turn, sha256('{{"conv_id": ' || conv_id::varchar || ', "role": "' || role || '", "text": "' || {_ascii("text")} || '", "turn": ' || turn::varchar || '}}') AS hash FROM conversations""",
    }
