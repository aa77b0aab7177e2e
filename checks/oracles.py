"""DuckDB SQL for the registered queries, written independently of the operators."""

from __future__ import annotations

from .queries import (
    CANDIDATE_KEYS,
    CAPTURED_AT,
    COVERAGE_MAP,
    ENTITY,
    FEED_MAP,
    KEY_COLUMNS,
    SINCE,
    UNTIL,
    WINDOW,
)

# --- the derived changelog -------------------------------------------------------------------

LOG = """
e0 AS (
  SELECT event_id AS id,
    CASE user_id % 3 WHEN 0 THEN 'vessel' WHEN 1 THEN 'voyage' ELSE 'crew' END AS entity_type,
    CAST(user_id AS VARCHAR) AS entity_id,
    CASE WHEN event_id % 4 = 0 THEN 'root' ELSE 'child' || (event_id % 3) END AS table_name,
    CAST(event_id % 50 + event_id // 5000 * 50 AS VARCHAR) AS row_id,
    CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation,
    '{"id":' || (event_id % 50 + event_id // 5000 * 50) || ',"k":' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 5)
      || ',"kind":"' || event_type || '"}' AS image,
    user_id || '-' || strftime(ts, '%Y%m%d') AS transaction_id,
    ts AS created_at
  FROM events),
log AS (
  SELECT id, entity_type, entity_id, table_name, row_id, operation,
    CASE operation WHEN 'DELETE' THEN image WHEN 'UPDATE' THEN
      coalesce(lag(image) OVER (PARTITION BY entity_type, entity_id ORDER BY created_at, id),
               '{"id":-1,"k":-1,"kind":"none"}') END AS old_values,
    CASE WHEN operation <> 'DELETE' THEN image END AS new_values,
    transaction_id, created_at
  FROM e0)"""

SKEWED = """,
skewed AS (
  SELECT id, CASE WHEN id % 3 = 0 THEN 'vessel' ELSE entity_type END AS entity_type,
    CASE WHEN id % 3 = 0 THEN 'hot' ELSE entity_id END AS entity_id,
    table_name, row_id, operation, transaction_id, created_at
  FROM log)"""


def versions(source: str = "log", scope: str = "entity_type, entity_id", window: int = WINDOW) -> str:
    """CTEs `grouped` (entries with their group), `changesets` and `versioned` (the flat form)."""
    keys = f"{scope}, " if scope else ""
    part = f"PARTITION BY {scope}" if scope else ""
    return f""",
counted AS (
  SELECT *, epoch_us(created_at) // 1000 AS ms,
    count(*) OVER (PARTITION BY {keys}transaction_id) AS tx_rows
  FROM {source}),
flagged AS (
  SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY {keys}tx_rows > 1 ORDER BY created_at, id)
                      <= {window} THEN 0 ELSE 1 END AS opens
  FROM counted),
grouped AS (
  SELECT *, CASE WHEN tx_rows > 1 THEN 't:' || transaction_id ELSE 'a:' ||
      sum(opens) OVER (PARTITION BY {keys}tx_rows > 1 ORDER BY created_at, id
                       ROWS UNBOUNDED PRECEDING) END AS group_key
  FROM flagged),
changesets AS (
  SELECT {keys}group_key, min(ms) AS first_ms, count(*) AS n_operations,
    max(tx_rows) = 1 AS is_auto, min(created_at) AS first_at,
    first(id ORDER BY created_at, id) AS first_id,
    first(transaction_id ORDER BY created_at, id) AS first_tx
  FROM grouped GROUP BY {keys}group_key),
numbered AS (
  SELECT *, row_number() OVER ({part} ORDER BY first_ms, is_auto, first_at, first_id) AS version
  FROM changesets),
versioned AS (
  SELECT g.*, c.version, c.first_tx AS changeset_transaction_id,
    make_timestamp(c.first_ms * 1000) AS "timestamp", c.n_operations,
    c.is_auto AND c.n_operations > 1 AS is_autocommit_grouped,
    row_number() OVER (PARTITION BY {keys}version ORDER BY g.created_at, g.id) AS position
  FROM grouped g JOIN numbered c USING ({keys}group_key))"""


SUMMARY = """version, first_tx AS transaction_id, make_timestamp(first_ms * 1000) AS "timestamp",
  n_operations, is_auto AND n_operations > 1 AS is_autocommit_grouped"""
ENTRY = """id, entity_type, entity_id, table_name, row_id, operation, old_values, new_values,
  transaction_id, created_at"""
VERSION = """version, changeset_transaction_id, "timestamp", n_operations, is_autocommit_grouped"""
CONTEXT = "id, entity_type, entity_id, table_name, row_id, transaction_id, created_at"
RANGE = f"created_at >= TIMESTAMP '{SINCE}' AND created_at <= TIMESTAMP '{UNTIL}'"
ONE_ENTITY = f"entity_type = '{ENTITY[0]}' AND entity_id = '{ENTITY[1]}'"


def joined_parts(*parts: str) -> str:
    text = "CAST({} AS VARCHAR)"
    return " || ".join(
        f"coalesce(length({text.format(p)}) || ':' || {text.format(p)}, '-')" for p in parts
    )


def content_id(*parts: str) -> str:
    bits = f"CAST('0x' || substr(md5({joined_parts(*parts)}), 1, 16) AS UBIGINT)"
    return f"CAST({bits} & CAST(9223372036854775807 AS UBIGINT) AS BIGINT)"


def content_hash(*parts: str) -> str:
    return f"sha256({joined_parts(*parts)})"


def values_list(rows) -> str:
    def text(value) -> str:
        if isinstance(value, list):
            return "[" + ", ".join(map(text, value)) + "]"
        return str(value).lower() if isinstance(value, bool) else f"'{value}'"

    return ", ".join(f"({', '.join(map(text, row))})" for row in rows)


def _map(rows) -> str:
    return f""",
entity_map(m_entity_type, m_table_name, is_root, entity_key_col, row_key_cols) AS (
  VALUES {values_list(rows)})"""


# --- text ------------------------------------------------------------------------------------


def _value(image: str, key: str) -> str:
    return f"""coalesce(json_extract_string({image}, '$."' || {key} || '"'), 'NULL')"""


def _fields(image: str, hide_id: bool) -> str:
    keys = f"json_keys({image})"
    if hide_id:
        keys = f"list_filter({keys}, lambda k: k <> 'id')"
    pair = f"k || '=' || {_value(image, 'k')}"
    return f"array_to_string(list_transform({keys}, lambda k: {pair}), ', ')"


def _changed() -> str:
    path = """'$."' || k || '"'"""
    old, new = f"json_extract(old_values, {path})", f"json_extract(new_values, {path})"
    changed = f"list_filter(json_keys(new_values), lambda k: {old} IS DISTINCT FROM {new})"
    pair = f"k || ': ' || {_value('old_values', 'k')} || ' -> ' || {_value('new_values', 'k')}"
    return f"array_to_string(list_transform({changed}, lambda k: {pair}), ', ')"


def text_lines_sql(verbose: bool) -> str:
    """Common table expressions up to ``lines``: (entity, version, position, text)."""
    deleted = f"'     DELETE  ' || {_fields('old_values', False)}" if verbose else "'     DELETE'"
    return f"""
WITH {LOG}{versions()},
blocks AS (
  SELECT *, '  -- ' || table_name || ' (id=' || row_id || ')' || chr(10) || CASE operation
      WHEN 'INSERT' THEN '     INSERT  ' || {_fields('new_values', not verbose)}
      WHEN 'UPDATE' THEN '     UPDATE  ' || {_changed()}
      ELSE {deleted} END AS block
  FROM versioned),
named AS (
  SELECT entity_type, entity_id, version, string_agg(table_name, ', ' ORDER BY p) AS tables
  FROM (SELECT entity_type, entity_id, version, table_name, min(position) AS p
        FROM versioned GROUP BY ALL) GROUP BY ALL),
lines AS (
  SELECT entity_type, entity_id, version, position, block AS text FROM blocks
  UNION ALL
  SELECT entity_type, entity_id, version, 0,
    'changeset v' || version || '  [tx: ' || substr(any_value(changeset_transaction_id), 1, 8) || ']  '
    || strftime(any_value("timestamp"), '%Y-%m-%d %H:%M:%S') || ' UTC' || chr(10)
    || '  tables: ' || any_value(tables)
  FROM blocks JOIN named USING (entity_type, entity_id, version) GROUP BY entity_type, entity_id, version)
"""


def text_sql() -> str:
    return f"""{text_lines_sql(False)}
SELECT entity_type, entity_id, version, string_agg(text, chr(10) ORDER BY position) AS text
FROM lines GROUP BY entity_type, entity_id, version"""


# --- the fleet of databases ------------------------------------------------------------------


def _name(number: str) -> str:
    return f"CASE WHEN {number} = 38 THEN '__tidemark_t' ELSE 't' END || lpad(CAST({number} AS VARCHAR), 2, '0')"


LINES = f"""
lines AS (
  SELECT 'db' || l_suppkey AS schema_name, {_name('(l_partkey % 40)')} AS table_name,
    l_suppkey AS s, l_partkey % 40 AS t, l_linenumber AS n, l_orderkey AS o
  FROM lineitem)"""

FLEET = f"""{LINES},
targets AS (
  SELECT *, CASE
      WHEN t BETWEEN 4 AND 11 AND n <= 2 THEN o % 4
      WHEN t BETWEEN 12 AND 33 AND n IN (1, 7) AND o % 3 = 0 THEN o % 8 + 4
      WHEN t BETWEEN 12 AND 33 AND n = 2 THEN o % 4
      WHEN t BETWEEN 12 AND 33 AND n = 3 AND t % 5 = 0 THEN t END AS u
  FROM lines),
fks AS (
  SELECT DISTINCT schema_name, table_name AS from_table, 'r' || u || '_' || n AS from_column,
    {_name('u')} AS to_table, 'id' AS to_column,
    table_name || '_r' || u || '_' || n || '_fkey' AS constraint_name, u, n
  FROM targets WHERE u IS NOT NULL),
columns AS (
  SELECT DISTINCT schema_name, table_name, t, 1 AS ordinal,
    CASE WHEN t % 13 = 7 THEN 'payload' ELSE 'id' END AS name,
    CASE WHEN t % 13 = 7 THEN 'jsonb' ELSE 'integer' END AS data_type, t % 13 = 7 AS nullable
  FROM lines
  UNION ALL
  SELECT DISTINCT schema_name, table_name, t, n + 1, 'c' || n,
    CASE n % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'varchar' ELSE 'timestamptz' END, n % 2 = 0
  FROM lines
  UNION ALL
  SELECT schema_name, from_table, CAST(right(from_table, 2) AS BIGINT), u * 8 + n + 10, from_column,
    'integer', true FROM fks),
catalog AS (
  SELECT schema_name, table_name, CAST(ordinal AS INTEGER) AS ordinal, name, data_type, nullable,
    name = 'id' OR (name = 'c1' AND t % 11 = 3) AS is_pk
  FROM columns WHERE t < 38)"""

CLASSES = f"""{FLEET},
tables AS (SELECT DISTINCT schema_name, table_name FROM catalog),
nodes AS (
  SELECT * FROM tables
  UNION SELECT schema_name, from_table FROM fks WHERE from_table <> to_table
  UNION SELECT schema_name, to_table FROM fks WHERE from_table <> to_table),
degrees AS (
  SELECT schema_name, table_name,
    (SELECT count(DISTINCT to_table) FROM fks f WHERE f.schema_name = nodes.schema_name
       AND f.from_table = nodes.table_name AND f.to_table <> f.from_table) AS out_degree,
    (SELECT count(DISTINCT from_table) FROM fks f WHERE f.schema_name = nodes.schema_name
       AND f.to_table = nodes.table_name AND f.to_table <> f.from_table) AS in_degree
  FROM nodes),
classes AS (
  SELECT schema_name, table_name, CASE WHEN out_degree = 0 AND in_degree = 0 THEN 'isolated'
      WHEN out_degree = 0 THEN 'lookup' WHEN in_degree >= 1 THEN 'root' ELSE 'other' END AS class
  FROM degrees)"""

RESOLVED = f"""{CLASSES},
keyed AS (
  SELECT schema_name, table_name, first(name ORDER BY ordinal) FILTER (WHERE is_pk) AS pk
  FROM catalog GROUP BY ALL),
roots AS (
  SELECT c.schema_name, c.table_name, k.pk FROM classes c JOIN keyed k USING (schema_name, table_name)
  WHERE class = 'root'),
claims AS (
  SELECT f.*, k.pk IS NOT NULL OR k.table_name IS NULL AS eligible
  FROM fks f
  JOIN roots r ON r.schema_name = f.schema_name AND r.table_name = f.to_table AND r.pk IS NOT NULL
  JOIN classes c ON c.schema_name = f.schema_name AND c.table_name = f.from_table
    AND c.class NOT IN ('lookup', 'root')
  LEFT JOIN keyed k ON k.schema_name = f.schema_name AND k.table_name = f.from_table
  WHERE f.from_table <> f.to_table),
entity_map AS (
  SELECT schema_name, table_name AS entity_type, table_name, true AS is_root, pk AS entity_key_col,
    pk AS row_key_cols
  FROM roots WHERE pk IS NOT NULL
  UNION ALL
  SELECT schema_name, to_table, from_table, false,
    first(from_column ORDER BY constraint_name), 'id'
  FROM claims WHERE eligible GROUP BY schema_name, to_table, from_table),
child_counts AS (
  SELECT schema_name, entity_type, count(*) FILTER (WHERE NOT is_root) AS children
  FROM entity_map GROUP BY ALL),
conflicts AS (
  SELECT schema_name, table_name, string_agg(entity_type, ',' ORDER BY entity_type) AS claimed_by
  FROM entity_map WHERE NOT is_root GROUP BY ALL HAVING count(*) > 1)"""

MAP_COLUMNS = "schema_name, entity_type, table_name, is_root, entity_key_col, row_key_cols"

# --- schema states ---------------------------------------------------------------------------

STATES = f"""{LINES},
seen AS (SELECT schema_name, table_name, s, t, n, min(o % 3) AS since FROM lines GROUP BY ALL),
states AS (
  SELECT DISTINCT schema_name, table_name, s, t, k, 1 AS ordinal, 'id' AS name,
    'integer' AS data_type, false AS nullable, true AS is_pk
  FROM seen, (VALUES (0), (1), (2), (3)) v(k)
  UNION ALL
  SELECT schema_name, table_name, s, t, k, n + 1, 'c' || n,
    CASE WHEN n = 5 AND k >= 2 THEN 'bigint' WHEN n % 3 = 0 THEN 'integer'
         WHEN n % 3 = 1 THEN 'varchar' ELSE 'timestamptz' END,
    CASE n WHEN 4 THEN k >= 1 WHEN 7 THEN k >= 3 ELSE n % 2 = 0 END, false
  FROM seen, (VALUES (0), (1), (2), (3)) v(k)
  WHERE since <= k AND NOT (n = 6 AND k = 2)),
snaps AS (
  SELECT (s * 40 + t) * 4 + k AS id, schema_name, table_name, s, t, k,
    TIMESTAMP '2024-01-01' + k * INTERVAL 1 DAY AS captured_at,
    string_agg(concat_ws(':', name, data_type, nullable, is_pk), ',' ORDER BY ordinal) AS columns,
    string_agg(concat_ws(':', name, data_type, nullable), ',' ORDER BY ordinal) AS compared,
    '[' || string_agg('{{"name":"' || name || '","dataType":"' || data_type || '","nullable":' || nullable
      || ',"isPrimaryKey":' || is_pk || '}}', ',' ORDER BY ordinal) || ']' AS json
  FROM states GROUP BY schema_name, table_name, s, t, k)"""

DRIFT = f"""{STATES},
newest AS (SELECT * FROM states WHERE k = 2 AND t < 34),
live AS (SELECT * FROM states WHERE k = 3 AND t % 17 <> 5 AND t < 34),
pairs AS (
  SELECT coalesce(a.schema_name, b.schema_name) AS schema_name,
    coalesce(a.table_name, b.table_name) AS table_name, coalesce(a.name, b.name) AS name,
    a.ordinal AS old_ordinal, b.ordinal AS new_ordinal,
    CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed'
         WHEN a.data_type <> b.data_type OR a.nullable <> b.nullable THEN 'modified' END AS change
  FROM newest a FULL JOIN live b
    ON a.schema_name = b.schema_name AND a.table_name = b.table_name AND a.name = b.name),
drift AS (
  SELECT schema_name, table_name,
    coalesce(string_agg(name, ',' ORDER BY new_ordinal) FILTER (WHERE change = 'added'), '') AS added_columns,
    coalesce(string_agg(name, ',' ORDER BY old_ordinal) FILTER (WHERE change = 'removed'), '') AS removed_columns,
    coalesce(string_agg(name, ',' ORDER BY new_ordinal) FILTER (WHERE change = 'modified'), '') AS modified_columns
  FROM pairs GROUP BY ALL HAVING count(change) > 0)"""

RECORDED_TX = content_hash("schema_name", "table_name", f"epoch_us(TIMESTAMP '{CAPTURED_AT}')")

RECORDED = f"""{DRIFT},
recorded AS (
  SELECT schema_name, table_name, old.json AS old_values, coalesce(new.json, '[]') AS new_values,
    coalesce(new.columns, '') AS columns, {RECORDED_TX} AS transaction_id
  FROM drift
  JOIN (SELECT * FROM snaps WHERE k = 2) old USING (schema_name, table_name)
  LEFT JOIN (SELECT * FROM snaps WHERE k = 3 AND t % 17 <> 5) new USING (schema_name, table_name))"""

TIMELINE = f"""{STATES},
followed AS (
  SELECT *, lag(json) OVER w AS old_json, lag(compared) OVER w AS old_compared,
    lag(k) OVER w AS old_k
  FROM snaps WHERE k < 3
  WINDOW w AS (PARTITION BY schema_name, table_name ORDER BY captured_at, id)),
timeline AS (
  SELECT *, {content_hash('schema_name', 'table_name', 'epoch_us(captured_at)', 'id')} AS transaction_id
  FROM followed WHERE old_json IS NOT NULL AND old_compared <> compared),
timeline_changes AS (
  SELECT tl.schema_name, tl.table_name, tl.k, tl.transaction_id, tl.captured_at, c.*
  FROM timeline tl, LATERAL (
    SELECT 1 AS kind, 'added' AS change, n.ordinal, n.name, n.data_type, n.nullable FROM states n
    WHERE n.schema_name = tl.schema_name AND n.table_name = tl.table_name AND n.k = tl.k
      AND NOT EXISTS (SELECT 1 FROM states p WHERE p.schema_name = tl.schema_name
        AND p.table_name = tl.table_name AND p.k = tl.k - 1 AND p.name = n.name)
    UNION ALL
    SELECT 2, 'removed', p.ordinal, p.name, p.data_type, p.nullable FROM states p
    WHERE p.schema_name = tl.schema_name AND p.table_name = tl.table_name AND p.k = tl.k - 1
      AND NOT EXISTS (SELECT 1 FROM states n WHERE n.schema_name = tl.schema_name
        AND n.table_name = tl.table_name AND n.k = tl.k AND n.name = p.name)) c)"""

SCHEMA_ENTRY = f"""{content_id('schema_name', 'table_name', 'transaction_id')} AS id,
  '__schema' AS entity_type, '*' AS entity_id, table_name, '*' AS row_id,
  'SCHEMA_CHANGE' AS operation"""


def _profile(table: str, columns: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS n_rows,
  count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct,
  count(*) > count({c}) AS nullable, count(DISTINCT {c}) = count(*) AS is_unique FROM {table}"""
        for c in columns.split()
    )


def _key_check(a: str, x: str, b: str, y: str) -> str:
    orphans = f"(SELECT count(*) FROM {a} WHERE {x} IS NOT NULL AND {x} NOT IN (SELECT {y} FROM {b}))"
    unique = f"(SELECT count({y}) = count(DISTINCT {y}) FROM {b})"
    return f"""SELECT '{a}' AS from_table, '{x}' AS from_column, '{b}' AS to_table, '{y}' AS to_column,
  {orphans} AS orphan_rows, {unique} AS target_unique, {orphans} = 0 AND {unique} AS holds"""


def _resolved_changes(source: str) -> str:
    image = "CASE WHEN operation = 'DELETE' THEN old_values ELSE new_values END"
    key = "json_extract_string({i}, '$.' || {k})"
    keys = f"list_transform(row_key_cols, lambda c: {key.format(i=image, k='c')})"
    row = f"CASE WHEN len(row_key_cols) > 1 THEN CAST(to_json({keys}) AS VARCHAR) ELSE {keys}[1] END"
    return f""",
resolved AS (
  SELECT l.*, m_entity_type AS r_entity_type,
    {key.format(i=image, k='entity_key_col')} AS r_entity_id, {row} AS r_row_id
  FROM {source} l JOIN entity_map ON m_table_name = l.table_name)"""


ORACLES: dict[str, str] = {
    "catalog_columns": f"WITH {FLEET} SELECT * FROM catalog WHERE table_name <> 't39'",
    "foreign_keys": f"""WITH {FLEET}
SELECT schema_name, from_table, from_column, to_table, to_column, constraint_name FROM fks""",
    "profile_keys": _profile(
        "orders",
        "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    )
    + " UNION ALL "
    + _profile(
        "lineitem",
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
        "l_returnflag l_linestatus l_shipdate",
    ),
    "check_foreign_keys": " UNION ALL ".join(_key_check(*c) for c in CANDIDATE_KEYS),
    "schema_snapshot": f"""WITH {FLEET}
SELECT schema_name, table_name,
  string_agg(concat_ws(':', name, data_type, nullable, is_pk), ',' ORDER BY ordinal) AS columns,
  TIMESTAMP '{CAPTURED_AT}' AS captured_at
FROM catalog GROUP BY ALL""",
    "changelog_roundtrip": f"WITH {LOG} SELECT * FROM log",
    "capture_snapshot_diff": f"""
WITH before AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st,
    CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders WHERE o_orderkey % 10 <> 0),
after AS (
  SELECT o_orderkey AS k, o_custkey AS c,
    CASE WHEN o_orderkey % 10 = 2 THEN 'X' ELSE o_orderstatus END AS st,
    CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 10 = 3 THEN 100 ELSE 0 END AS p
  FROM orders WHERE o_orderkey % 10 <> 1),
changes AS (
  SELECT 'UPDATE' AS operation, a.k, a.c, b AS o, a AS n FROM before b JOIN after a ON a.k = b.k
    WHERE a.c <> b.c OR a.st <> b.st OR a.p <> b.p
  UNION ALL SELECT 'INSERT', k, c, NULL, a FROM after a WHERE k NOT IN (SELECT k FROM before)
  UNION ALL SELECT 'DELETE', k, c, b, NULL FROM before b WHERE k NOT IN (SELECT k FROM after))
SELECT {content_id("'customer'", "'orders'", 'k', 'operation', "'snapshot-1'", f"epoch_us(TIMESTAMP '{CAPTURED_AT}')")} AS id, 'customer' AS entity_type,
  CAST(c AS VARCHAR) AS entity_id, 'orders' AS table_name, CAST(k AS VARCHAR) AS row_id, operation,
  '{{"k":' || o.k || ',"c":' || o.c || ',"st":"' || o.st || '","p":' || o.p || '}}' AS old_values,
  '{{"k":' || n.k || ',"c":' || n.c || ',"st":"' || n.st || '","p":' || n.p || '}}' AS new_values,
  'snapshot-1' AS transaction_id, TIMESTAMP '{CAPTURED_AT}' AS created_at
FROM changes""",
    "capture_change_feed": f"""WITH {LOG}{_map(FEED_MAP)}{_resolved_changes('log')}
SELECT id, r_entity_type AS entity_type, r_entity_id AS entity_id, table_name, r_row_id AS row_id,
  operation, old_values, new_values,
  CASE WHEN id % 2 = 0 THEN transaction_id ELSE
    {content_hash('table_name', 'r_row_id', 'operation', 'epoch_us(created_at)', 'id')} END
    AS transaction_id, created_at
FROM resolved""",
    "capture_stream": f"""WITH {LOG},
known AS (SELECT *, lag(new_values) OVER (PARTITION BY table_name, row_id ORDER BY id) AS prev FROM log)
SELECT table_name, row_id, id AS seq, transaction_id, created_at,
  CASE WHEN new_values IS NULL THEN 'DELETE' WHEN prev IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS operation,
  prev AS old_values, new_values FROM known""",
    "capture_stream_hot": f"""WITH {LOG},
hot AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN 'hot' ELSE table_name END AS table_name,
  CASE WHEN id % 3 = 0 THEN 'hot' ELSE row_id END AS row_id) FROM log),
known AS (SELECT *, lag(new_values) OVER (PARTITION BY table_name, row_id ORDER BY id) AS prev FROM hot)
SELECT table_name, row_id, id AS seq, transaction_id, created_at,
  CASE WHEN new_values IS NULL THEN 'DELETE' WHEN prev IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS operation,
  prev AS old_values, new_values FROM known""",
    "resolve_entity_ids": f"""WITH {LOG}{_map(FEED_MAP)}{_resolved_changes('log')}
SELECT id, table_name, operation, r_entity_type AS entity_type, r_entity_id AS entity_id,
  r_row_id AS row_id FROM resolved""",
    "row_image": """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey
  || ',"o_orderstatus":"' || o_orderstatus || '","urgent":' ||
  CASE WHEN o_orderpriority = '1-URGENT' THEN '"1-URGENT"' ELSE 'null' END || '}' AS image FROM orders""",
    "assign_transaction_id": f"""WITH {LOG}
SELECT id AS seq, CASE WHEN id % 2 = 0 THEN transaction_id ELSE
  {content_hash('table_name', 'row_id', 'operation', 'epoch_us(created_at)', 'id')} END AS transaction_id
FROM log""",
    "query_changelog": f"WITH {LOG} SELECT * FROM log WHERE entity_type = 'vessel' ORDER BY created_at, id",
    "query_changelog_range": f"WITH {LOG} SELECT * FROM log WHERE {RANGE} ORDER BY created_at, id",
    "query_changelog_topk": f"""WITH {LOG} SELECT * FROM log WHERE entity_type = 'voyage'
ORDER BY created_at, id LIMIT 100""",
    "transaction_groups": f"""WITH {LOG}
SELECT transaction_id, count(*) AS "count", min(created_at) AS min_created_at,
  max(created_at) AS max_created_at FROM log GROUP BY transaction_id ORDER BY min_created_at""",
    "changelog_stats": f"""WITH {LOG}
SELECT count(*) AS total, count(DISTINCT entity_type) AS entity_types, min(created_at) AS oldest,
  max(created_at) AS newest FROM log""",
    "entity_stats": f"""WITH {LOG}
SELECT entity_type, entity_id, count(*) AS total,
  count(*) FILTER (WHERE operation = 'INSERT') AS inserts,
  count(*) FILTER (WHERE operation = 'UPDATE') AS updates,
  count(*) FILTER (WHERE operation = 'DELETE') AS deletes,
  min(created_at) AS oldest, max(created_at) AS newest FROM log GROUP BY ALL""",
    "classify_transactions": f"""WITH {LOG}{versions()}
SELECT id, entity_type, entity_id, transaction_id, tx_rows AS transaction_rows,
  tx_rows > 1 AS is_explicit FROM grouped""",
    "sessionize_autocommit": f"""WITH {LOG}{versions()}
SELECT g.entity_type, g.entity_id, g.transaction_id, make_timestamp(c.first_ms * 1000) AS session_start,
  c.first_id AS session_first_id
FROM grouped g JOIN changesets c USING (entity_type, entity_id, group_key) WHERE g.tx_rows = 1""",
    "build_changesets": f"WITH {LOG}{versions()} SELECT entity_type, entity_id, {SUMMARY} FROM numbered",
    "changesets_all_entities": f"WITH {LOG}{versions()} SELECT {ENTRY}, {VERSION} FROM versioned",
    "changesets_unscoped": f"WITH {LOG}{versions(scope='')} SELECT {SUMMARY} FROM numbered",
    "changesets_hot_entity": f"""WITH {LOG}{SKEWED}{versions('skewed')}
SELECT entity_type, entity_id, {SUMMARY} FROM numbered""",
    "versions_hot_entity": f"""WITH {LOG}{SKEWED}{versions('skewed')}
SELECT id, entity_type, entity_id, table_name, row_id, operation, transaction_id, created_at,
  {VERSION} FROM versioned""",
    "entity_history": f"""WITH {LOG},
slice AS (SELECT * FROM log WHERE {ONE_ENTITY} AND {RANGE}){versions('slice')}
SELECT {ENTRY}, {VERSION} FROM versioned""",
    "entity_history_full": f"""WITH {LOG}{versions()}
SELECT {ENTRY}, {VERSION} FROM versioned WHERE {ONE_ENTITY} AND {RANGE}""",
    "entity_history_version": f"""WITH {LOG}{versions()}
SELECT {ENTRY}, {VERSION} FROM versioned WHERE {ONE_ENTITY} AND version = 3""",
    "changeset_tables": f"""WITH {LOG}{versions()}
SELECT entity_type, entity_id, version, string_agg(table_name, ',' ORDER BY p) AS tables
FROM (SELECT entity_type, entity_id, version, table_name, min(position) AS p FROM versioned GROUP BY ALL)
GROUP BY ALL""",
    "nested_changesets": f"""WITH {LOG}{versions()}
SELECT entity_type, entity_id, version, (position - 1) // 3 AS part,
  string_agg(CAST(id AS VARCHAR), ',' ORDER BY position) AS ids
FROM versioned GROUP BY entity_type, entity_id, version, (position - 1) // 3""",
    "stream_sessions": f"""WITH {LOG},
own AS (SELECT * REPLACE (CAST(id AS VARCHAR) AS transaction_id) FROM log){versions('own')}
SELECT entity_type, entity_id, make_timestamp(first_ms * 1000) AS "timestamp", first_id,
  first_tx AS transaction_id, n_operations, n_operations > 1 AS is_autocommit_grouped FROM changesets""",
    "stream_changesets": f"WITH {LOG}{versions()} SELECT entity_type, entity_id, {SUMMARY} FROM numbered",
    "stream_changesets_corrected": f"WITH {LOG}{versions()} SELECT entity_type, entity_id, {SUMMARY} FROM numbered",
    "stream_late_rows": f"""WITH {LOG},
bounds AS (SELECT min(epoch_us(created_at)) AS low, max(epoch_us(created_at)) AS high FROM log),
delivered AS (SELECT *, (epoch_us(created_at) - low) * 3 // (high - low + 1)
  + CASE WHEN id % 50 = 7 THEN 1 ELSE 0 END AS turn FROM log, bounds),
newest AS (SELECT turn, max(epoch_ms(created_at)) AS ms FROM delivered GROUP BY turn),
marks AS (SELECT t.turn, (SELECT max(ms) FROM newest n WHERE n.turn < t.turn) - 3600000 AS mark FROM newest t)
SELECT id, entity_type, entity_id, coalesce(epoch_ms(created_at) <= mark, false) AS is_late
FROM delivered JOIN marks USING (turn)""",
    "field_diff": f"""WITH {LOG},
fields AS (SELECT *, unnest(json_keys(new_values)) AS field FROM log WHERE operation = 'UPDATE')
SELECT {CONTEXT}, field, {_value('old_values', 'field')} AS old_value,
  {_value('new_values', 'field')} AS new_value,
  NOT list_contains(json_keys(old_values), field) AS was_missing
FROM fields WHERE json_extract(old_values, '$.' || field) IS DISTINCT FROM json_extract(new_values, '$.' || field)""",
    "field_change_counts": f"""WITH {LOG},
fields AS (SELECT *, unnest(json_keys(new_values)) AS field FROM log WHERE operation = 'UPDATE')
SELECT entity_type, table_name, field, count(*) AS changes
FROM fields WHERE json_extract(old_values, '$.' || field) IS DISTINCT FROM json_extract(new_values, '$.' || field)
GROUP BY ALL""",
    "insert_fields": f"""WITH {LOG},
fields AS (SELECT *, unnest(json_keys(new_values)) AS field FROM log WHERE operation = 'INSERT')
SELECT {CONTEXT}, field, {_value('new_values', 'field')} AS value FROM fields WHERE field <> 'id'""",
    "delete_fields": f"""WITH {LOG},
fields AS (SELECT *, unnest(json_keys(old_values)) AS field FROM log WHERE operation = 'DELETE')
SELECT {CONTEXT}, field, {_value('old_values', 'field')} AS value FROM fields""",
    "schema_change_diff": f"""WITH {TIMELINE}
SELECT {content_id('schema_name', 'table_name', 'transaction_id')} AS id, '__schema' AS entity_type,
  '*' AS entity_id, table_name, '*' AS row_id, transaction_id, change, name, data_type, nullable
FROM timeline_changes""",
    "format_value": f"""WITH {LOG},
fields AS (SELECT id, new_values, unnest(json_keys(new_values)) AS field FROM log WHERE new_values IS NOT NULL)
SELECT id, field, {_value('new_values', 'field')} AS text FROM fields""",
    "render_text": text_sql(),
    "render_text_verbose": f"{text_lines_sql(True)} SELECT * FROM lines",
    "render_schema_text": f"""WITH {TIMELINE},
lines_of AS (
  SELECT transaction_id, string_agg(CASE change
      WHEN 'added' THEN '     + column ''' || name || ''' (' || data_type
        || CASE WHEN nullable THEN ', nullable' ELSE '' END || ')'
      ELSE '     - column ''' || name || '''' END, chr(10) ORDER BY kind, ordinal) AS changes
  FROM timeline_changes GROUP BY transaction_id),
entries AS (
  SELECT {SCHEMA_ENTRY}, schema_name, transaction_id, captured_at AS created_at,
    '  -- ' || table_name || coalesce(chr(10) || changes, '') AS block
  FROM timeline LEFT JOIN lines_of USING (transaction_id)){versions('entries', 'schema_name, entity_type, entity_id', 0)}
SELECT schema_name, entity_type, entity_id, version,
  'schema change  ' || strftime(any_value("timestamp"), '%Y-%m-%d %H:%M:%S') || ' UTC' || chr(10)
  || string_agg(block, chr(10) ORDER BY position) AS text
FROM versioned GROUP BY schema_name, entity_type, entity_id, version""",
    "changesets_json": f"""WITH {LOG}{versions()}
SELECT entity_type, entity_id, version, changeset_transaction_id AS transaction_id,
  strftime(any_value("timestamp"), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp_text,
  is_autocommit_grouped, string_agg(CAST(id AS VARCHAR), ',' ORDER BY position) AS ids,
  string_agg(strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z', ',' ORDER BY position) AS times,
  string_agg(coalesce(json_extract_string(new_values, '$.kind'), 'NULL'), ',' ORDER BY position) AS kinds
FROM versioned GROUP BY entity_type, entity_id, version, changeset_transaction_id, is_autocommit_grouped""",
    "fk_degrees": f"WITH {CLASSES} SELECT * FROM degrees",
    "classify_tables": f"WITH {CLASSES} SELECT * FROM classes",
    "resolve_entities": f"WITH {RESOLVED} SELECT * FROM entity_map",
    "entity_child_counts": f"WITH {RESOLVED} SELECT * FROM child_counts",
    "entity_conflicts": f"WITH {RESOLVED} SELECT * FROM conflicts",
    "unassigned_tables": f"""WITH {RESOLVED} SELECT schema_name, table_name FROM classes
WHERE class NOT IN ('lookup', 'isolated')
EXCEPT SELECT schema_name, table_name FROM entity_map""",
    "entity_warnings": f"""WITH {RESOLVED}
SELECT schema_name, table_name, '' AS root_table, '' AS constraint_name,
  'Table ''' || table_name || ''' has no primary key, skipping as entity root' AS message
FROM roots WHERE pk IS NULL
UNION ALL
SELECT schema_name, from_table, to_table, constraint_name,
  'Table ''' || from_table || ''' has no primary key, skipping as child of ''' || to_table || ''''
FROM claims WHERE NOT eligible""",
    "apply_overrides": f"""WITH {RESOLVED},
moved AS (
  SELECT m.schema_name, m.table_name, first(entity_key_col
      ORDER BY m.entity_type <> 't05', children DESC, m.entity_type) AS entity_key_col
  FROM entity_map m JOIN child_counts c ON c.schema_name = m.schema_name AND c.entity_type = m.entity_type
  WHERE NOT is_root AND m.table_name = 't13' GROUP BY ALL)
SELECT {MAP_COLUMNS} FROM entity_map WHERE is_root OR table_name NOT IN ('t12', 't13', 't14')
UNION ALL
SELECT schema_name, 't05', table_name, false, entity_key_col, 'id' FROM moved
WHERE schema_name IN (SELECT schema_name FROM entity_map WHERE entity_type = 't05')""",
    "default_entity_map": f"""WITH {RESOLVED}
SELECT * FROM entity_map m WHERE is_root OR NOT EXISTS (
  SELECT 1 FROM conflicts c WHERE c.schema_name = m.schema_name AND c.table_name = m.table_name)""",
    "ignored_tables": f"""WITH {RESOLVED}
SELECT schema_name, table_name, class AS reason FROM classes WHERE class IN ('isolated', 'lookup')
UNION ALL SELECT schema_name, table_name, 'conflict' FROM conflicts""",
    "validate_entity_map": f"""WITH {RESOLVED},
owners AS (
  SELECT schema_name, table_name, entity_type,
    lag(entity_type) OVER (PARTITION BY schema_name, table_name ORDER BY entity_type) AS owner
  FROM entity_map)
SELECT schema_name, table_name,
  'Table ''' || table_name || ''' is assigned to both ''' || owner || ''' and ''' || entity_type || '''' AS error
FROM owners WHERE owner IS NOT NULL
UNION ALL
SELECT DISTINCT schema_name, '', 'At least one entity is required' FROM classes
WHERE schema_name NOT IN (SELECT schema_name FROM entity_map)""",
    "latest_snapshot": f"WITH {STATES} SELECT schema_name, table_name, columns, captured_at FROM snaps WHERE k = 2",
    "schema_drift": f"WITH {DRIFT} SELECT * FROM drift",
    "record_schema_changes": f"""WITH {RECORDED}
SELECT {SCHEMA_ENTRY}, old_values, new_values, transaction_id,
  TIMESTAMP '{CAPTURED_AT}' AS created_at, schema_name FROM recorded""",
    "recorded_snapshots": f"""WITH {RECORDED}
SELECT {content_id('schema_name', 'table_name', 'transaction_id')} AS id, schema_name, table_name,
  columns, TIMESTAMP '{CAPTURED_AT}' AS captured_at FROM recorded""",
    "schema_timeline": f"""WITH {TIMELINE}
SELECT {SCHEMA_ENTRY}, old_json AS old_values, json AS new_values, transaction_id,
  captured_at AS created_at, schema_name FROM timeline WHERE t < 34""",
    "capture_coverage": f"""WITH {LOG}{_map(COVERAGE_MAP)}
SELECT m_entity_type AS entity_type, m_table_name AS table_name, count(id) AS entries,
  count(id) = 0 AS is_missing
FROM entity_map LEFT JOIN log ON entity_type = m_entity_type AND table_name = m_table_name GROUP BY ALL""",
    "capture_health": f"""WITH {LOG},{DRIFT}{_map(COVERAGE_MAP)},
coverage AS (
  SELECT m_entity_type, m_table_name, count(id) AS entries
  FROM entity_map LEFT JOIN log ON entity_type = m_entity_type AND log.table_name = m_table_name GROUP BY ALL)
SELECT (SELECT count(*) FROM coverage) AS expected_tables,
  (SELECT count(*) FROM coverage WHERE entries > 0) AS seen_tables,
  (SELECT count(*) FROM drift) AS drifted_tables,
  (SELECT count(*) = count(*) FILTER (WHERE entries > 0) FROM coverage)
    AND (SELECT count(*) FROM drift) = 0 AS ok""",
}

ORACLES["stream_sessions_corrected"] = ORACLES["stream_sessions"]
ORACLES["stream_changesets_hot"] = (
    f"WITH {LOG}{SKEWED}{versions('skewed')} SELECT entity_type, entity_id, {SUMMARY} FROM numbered"
)

# A number of eight digits that begin and end with 1, as in the images.
_DIGITS = "'1' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || '1'"
ORACLES["field_diff_numbers"] = """
SELECT o_orderkey AS id, 'e' AS field, CAST(o_orderkey AS VARCHAR) AS old_value,
  o_orderkey || '.25' AS new_value, false AS was_missing
FROM orders WHERE o_orderkey % 4 = 3"""
ORACLES["format_numbers"] = f"""
WITH numbers AS (SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS k, {_DIGITS} AS m FROM orders)
SELECT id, 'a' AS field, '[1' || k || '00,{{"b":' || k || '.5}}]' AS value FROM numbers
UNION ALL SELECT id, 'c', '1.' || substr(m, 2) || 'e+32' FROM numbers
UNION ALL SELECT id, 'd', '1.' || substr(m, 2) || 'e-9' FROM numbers"""
ORACLES["unmapped_changes"] = f"""WITH {LOG}{_map(FEED_MAP[:2])}
SELECT table_name, count(*) AS changes, min(created_at) AS first_at, max(created_at) AS last_at
FROM log WHERE table_name NOT IN (SELECT m_table_name FROM entity_map) GROUP BY table_name"""

_FLEET_LOG = f"WITH {LOG}, fleet AS (SELECT *, 'db' || id % 2 AS schema_name FROM log)"
ORACLES["entity_history_fleet"] = f"""{_FLEET_LOG}{versions('fleet', 'schema_name, entity_type, entity_id')}
SELECT {ENTRY}, schema_name, {VERSION} FROM versioned WHERE {ONE_ENTITY} AND {RANGE}"""
ORACLES["changesets_without_zone"] = ORACLES["build_changesets"]
ORACLES["capture_coverage_fleet"] = f"""{_FLEET_LOG}{_map(COVERAGE_MAP)},
captured AS (SELECT * FROM fleet WHERE schema_name = 'db0' OR table_name = 'root')
SELECT d.schema_name, m_entity_type AS entity_type, m_table_name AS table_name, count(id) AS entries,
  count(id) = 0 AS is_missing
FROM entity_map CROSS JOIN (VALUES ('db0'), ('db1')) d(schema_name)
LEFT JOIN captured c ON entity_type = m_entity_type AND table_name = m_table_name AND c.schema_name = d.schema_name
GROUP BY ALL"""

_REFERENCES = [(a, x, b, y) for a, xs in KEY_COLUMNS.items() for x in xs for b, ys in KEY_COLUMNS.items() for y in ys if (a, x) != (b, y)]
ORACLES["discover_foreign_keys"] = "SELECT * FROM (" + " UNION ALL ".join(_key_check(*r) for r in _REFERENCES) + ") WHERE holds"
_POSSIBLE_KEYS = {
    "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority",
    "customer": "c_custkey c_name c_nationkey c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey",
    "part": "p_partkey p_name p_brand p_type p_size",
}
ORACLES["find_keys"] = "SELECT table_name, column_name, n_rows FROM (" + " UNION ALL ".join(
    _profile(table, columns) for table, columns in _POSSIBLE_KEYS.items()
) + ") WHERE is_unique"
ORACLES["refresh_roundtrip"] = f"""WITH {RECORDED}
SELECT {content_id('schema_name', 'table_name', 'transaction_id')} AS id, schema_name, table_name,
  new_values, transaction_id, columns FROM recorded"""
