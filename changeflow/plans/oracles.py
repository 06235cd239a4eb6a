"""The registered queries as DuckDB SQL over the given tables.

Each is written from the definition of the result, not from the Spark plan: row
messages come from the generator in closed form, ordered decisions from recursive
queries, times from generated series.
"""

LOG = """
log AS (
  SELECT event_id AS seq,
         CAST(floor(epoch(ts)) AS BIGINT) AS ts_s,
         concat('srv', CAST(user_id % 2 AS VARCHAR)) AS server_uuid,
         row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id) AS gno,
         concat('bin.', lpad(CAST(event_id // 2500 + 1 AS VARCHAR), 6, '0')) AS binlog_file,
         4 + 40 * (event_id % 2500) AS binlog_pos,
         concat('db', CAST(user_id % 3 AS VARCHAR)) AS schema_name,
         concat('t', CAST((user_id + event_id) % 5 AS VARCHAR)) AS table_name,
         CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'delete'
                         WHEN 'error' THEN 'ddl' ELSE 'update' END AS action,
         1 + event_id % 3 AS n_rows,
         user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, props
  FROM events
)"""

MSG = LOG + """,
msg AS (
  SELECT seq, ts_s, schema_name, table_name, action,
         schema_name || '.' || table_name AS key,
         CAST(i AS INTEGER) AS row_index,
         CAST(user_id AS VARCHAR) AS id, event_type AS kind, props,
         CASE WHEN action = 'update' THEN cents + 100 + i ELSE cents + i END AS new_cents,
         CASE WHEN action = 'update' THEN cents + i END AS old_cents
  FROM (SELECT *, unnest(range(n_rows)) AS i FROM log WHERE action <> 'ddl')
)"""

CAT = """,
cat AS (
  SELECT 'db' || d AS schema_name, 't' || t AS table_name,
         CASE WHEN t = 3 THEN 'id,kind,cents,props,extra' ELSE 'id,kind,cents,props' END AS columns,
         CASE WHEN t = 3 THEN 5 ELSE 4 END AS n_cols
  FROM range(3) a(d), range(4) b(t)
)"""

AUDIT = MSG + CAT + """,
audited AS (
  SELECT m.*, c.n_cols, c.columns,
         CASE WHEN c.n_cols IS NULL THEN 'unknown_table'
              WHEN c.n_cols <> 4 THEN 'arity_mismatch' ELSE 'delivered' END AS outcome
  FROM msg m LEFT JOIN cat c USING (schema_name, table_name)
  WHERE m.schema_name IN ('db0', 'db1')
)"""

VERSIONS = """,
versions AS (
  SELECT schema_name, table_name, columns, n_cols, CAST(0 AS BIGINT) AS valid_from FROM cat
  UNION ALL
  SELECT schema_name, table_name,
         CASE WHEN seq % 2 = 1 THEN 'id,kind,cents,props,extra' ELSE 'id,kind,cents,props' END,
         CASE WHEN seq % 2 = 1 THEN 5 ELSE 4 END, seq
  FROM log WHERE action = 'ddl' AND table_name <> 't4'
)"""

GTIDS = """,
gtids AS (
  SELECT seq, ts_s, server_uuid, server_uuid || ':' || CAST(gno AS VARCHAR) AS gtid_set,
         seq % 500 = 0 AS force
  FROM log
)"""

# The wait starts at the first event; the next id kept is the first that is
# forced or comes more than 3600 s after the last one kept.
KEPT = GTIDS + """,
kept(server_uuid, seq, ts_s) AS (
  SELECT server_uuid, CAST(-1 AS BIGINT), min(ts_s) FROM gtids GROUP BY server_uuid
  UNION ALL
  SELECT g.server_uuid, min(g.seq), min(g.ts_s)
  FROM kept k JOIN gtids g
    ON g.server_uuid = k.server_uuid AND g.seq > k.seq AND (g.force OR g.ts_s - k.ts_s > 3600)
  GROUP BY g.server_uuid
),
checkpoints AS (SELECT g.* FROM gtids g JOIN kept k USING (server_uuid, seq))"""

STATES = """,
states AS (
  SELECT component, ts_s, arg_max(state, seq) AS state
  FROM (SELECT seq, ts_s,
               CASE user_id % 3 WHEN 0 THEN 'canal' WHEN 1 THEN 'endpoint' ELSE 'transfer' END AS component,
               CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS state
        FROM log)
  GROUP BY component, ts_s
),
ticks AS (
  SELECT unnest(generate_series(lo, hi, 60)) AS ts_s
  FROM (SELECT CAST(ceil(min(ts_s) / 60.0) AS BIGINT) * 60 AS lo,
               CAST(ceil(max(ts_s) / 60.0) AS BIGINT) * 60 AS hi
        FROM states WHERE component <> 'transfer')
),
health AS (
  SELECT t.ts_s, coalesce(c.state, 0) AS canal_state, coalesce(e.state, 0) AS endpoint_state
  FROM ticks t
  ASOF LEFT JOIN (SELECT * FROM states WHERE component = 'canal') c ON t.ts_s >= c.ts_s
  ASOF LEFT JOIN (SELECT * FROM states WHERE component = 'endpoint') e ON t.ts_s >= e.ts_s
  WHERE coalesce(c.state, 0) = 0 OR coalesce(e.state, 0) = 0
),
channels AS (SELECT unnest(['email', 'dingtalk', 'wechat_work']) AS channel)"""

QUEUE = """,
queue AS (
  SELECT seq, ts_s, server_uuid, 1 AS delta FROM log
  UNION ALL
  SELECT seq, ts_s + 60 * (1 + seq % 5), server_uuid, -1 FROM log
)"""

# Transaction sets as one row per transaction; islands are runs of neighbouring numbers.
EXECUTED = """,
executed AS (
  SELECT 'srv' || s AS server_uuid, unnest(range(1, 1001 - 500 * s)) AS gno FROM range(2) t(s)
)"""

ISLANDS = """
SELECT server_uuid, min(gno) AS gno_start, max(gno) AS gno_end
FROM (SELECT server_uuid, gno, gno - row_number() OVER (PARTITION BY server_uuid ORDER BY gno) AS island
      FROM ({}))
GROUP BY server_uuid, island"""
SET_OF = "SELECT server_uuid, gno FROM log WHERE action IN ({})"
ROWS_SET = SET_OF.format("'insert', 'update', 'delete'")


def _with(ctes, select, recursive=False):
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


def _batches(keys, items):
    """Walk each tick's items one by one, closing a batch when it is full."""
    on = " AND ".join(f"i.{k} = w.{k}" for k in [*keys, "tick_s"])
    part = ", ".join([*keys, "tick_s"])
    walked = ", ".join(f"i.{k}" for k in [*keys, "tick_s"])
    return f""",
items AS ({items}),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY seq, is_rows) AS rn FROM items
),
walk AS (
  SELECT {part}, rn, seq, is_rows, weight, 0 AS batch,
         CASE WHEN NOT is_rows OR weight >= 100 THEN 0 ELSE weight END AS held,
         NOT is_rows OR weight >= 100 AS closes
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT {walked}, i.rn, i.seq, i.is_rows, i.weight,
         CASE WHEN w.closes THEN w.batch + 1 ELSE w.batch END,
         CASE WHEN NOT i.is_rows OR w.held + i.weight >= 100 THEN 0 ELSE w.held + i.weight END,
         NOT i.is_rows OR w.held + i.weight >= 100
  FROM walk w JOIN ordered i ON {on} AND i.rn = w.rn + 1
)
SELECT {part}, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_events,
       CAST(sum(weight) AS BIGINT) AS n_rows
FROM walk WHERE is_rows GROUP BY {part}, batch"""


ROW_ITEMS = """SELECT server_uuid, ts_s - ts_s % 86400 AS tick_s, seq, true AS is_rows, n_rows AS weight
  FROM log WHERE action <> 'ddl'"""
SAVED_ITEMS = ROW_ITEMS + """
  UNION ALL SELECT server_uuid, ts_s - ts_s % 86400, seq, false, 0 FROM checkpoints"""

MESSAGES = """,
messages AS (
  SELECT seq, unnest(CASE WHEN action = 'ddl'
    THEN [struct_pack(o := 0, kind := 'position', payload := pos),
          struct_pack(o := 1, kind := 'ddl', payload := query),
          struct_pack(o := 2, kind := 'gtid', payload := gtid)]
    ELSE [struct_pack(o := 0, kind := 'gtid', payload := gtid),
          struct_pack(o := 1, kind := 'rows', payload := schema_name || '.' || table_name),
          struct_pack(o := 2, kind := 'position', payload := pos)] END) AS m,
    action, schema_name
  FROM (SELECT *, binlog_file || ':' || CAST(binlog_pos AS VARCHAR) AS pos,
               server_uuid || ':' || CAST(gno AS VARCHAR) AS gtid,
               'ALTER TABLE ' || table_name || ' ADD COLUMN c' || CAST(seq AS VARCHAR) || ' INT' AS query
        FROM log)
)"""

RESUME = """,
entries AS (
  SELECT binlog_file, server_uuid, min(gno) - 1 AS purged,
         max(gno) AS last_gno, max(seq) AS last_seq
  FROM log GROUP BY binlog_file, server_uuid
),
saved AS (
  SELECT binlog_file, arg_max(server_uuid, last_seq) AS saved_uuid,
         arg_max(CAST(last_gno AS VARCHAR), last_seq) AS saved_pos
  FROM entries GROUP BY binlog_file
),
texts AS (
  SELECT e.*, s.saved_uuid, s.saved_pos,
         CASE WHEN purged >= 100 THEN server_uuid || ':1-50:60-' || CAST(purged AS VARCHAR)
              WHEN purged >= 1 THEN server_uuid || ':1-' || CAST(purged AS VARCHAR) END AS entry
  FROM entries e JOIN saved s USING (binlog_file)
)
SELECT binlog_file, any_value(saved_uuid || ':' || saved_pos) AS saved_gtid,
       coalesce(string_agg(entry, E',\\n' ORDER BY server_uuid), '') AS purged_set,
       coalesce(string_agg(CASE WHEN entry IS NULL THEN NULL
                                WHEN server_uuid = saved_uuid THEN server_uuid || ':1-' || saved_pos
                                ELSE entry END, ',' ORDER BY server_uuid), '') AS resume_set
FROM texts GROUP BY binlog_file"""

RENDER = """
SELECT ts_s, canal_state, endpoint_state, channel,
  CASE channel
    WHEN 'email' THEN '<div>' || replace(text, chr(10), '<br>') || '</div>'
    WHEN 'dingtalk' THEN '### alert' || chr(10) || '> '
      || replace(replace(text, chr(10), chr(10) || chr(10) || '> '), 'failed', '**failed**')
    ELSE '### alert' || chr(10) || '> 主机 :<font color="comment"> host-1  </font>'
      || chr(10) || '> IP :<font color="comment"> 10.0.0.1  </font>'
      || chr(10) || '> 数据库 :<font color="comment"> db.local:3306   </font>'
      || chr(10) || '> canal  状态 :<font color="comment"> ' || replace(canal, 'failed', mark) || '.   </font>'
      || chr(10) || '> endpoint :<font color="comment"> kafka , version:0.10.2.2  状态 : '
      || replace(endpoint, 'failed', mark) || '</font>'
  END AS body
FROM (
  SELECT *, '<font color="warning">**failed**</font>' AS mark,
    '主机 : host-1  ' || chr(10) || 'IP : 10.0.0.1  ' || chr(10) || '数据库 : db.local:3306   '
    || chr(10) || 'canal  状态 : ' || canal || '.   ' || chr(10)
    || 'endpoint : kafka , version:0.10.2.2  状态 : ' || endpoint AS text
  FROM (SELECT *, CASE canal_state WHEN 1 THEN 'ok' ELSE 'failed' END AS canal,
               CASE endpoint_state WHEN 1 THEN 'ok' ELSE 'failed' END AS endpoint
        FROM health, channels))"""

ENVELOPE = """
SELECT seq, row_index, action, ts_s AS timestamp, schema_name AS schema, table_name AS table,
       id, kind, new_cents AS cents, props, old_cents, action <> 'update' AS old_is_null
FROM audited WHERE outcome = 'delivered'"""

COUNTS = """
  CAST(count(*) FILTER (action = 'insert') AS BIGINT) AS insert_count,
  CAST(count(*) FILTER (action = 'update') AS BIGINT) AS update_count,
  CAST(count(*) FILTER (action = 'delete') AS BIGINT) AS delete_count"""

FIT = """
SELECT m.seq, m.row_index, m.key, v.valid_from, v.n_cols, v.n_cols = 4 AS fits
FROM msg m {join} WHERE m.schema_name IN ('db0', 'db1')"""

NEWEST = """(
  SELECT * FROM versions
  QUALIFY row_number() OVER (PARTITION BY schema_name, table_name ORDER BY valid_from DESC) = 1)"""

# The next alert sent is the first at least 1800 s after the last one that was
# sent with success; failed ones in between are tried as well.
SENDS = """,
sends AS (SELECT channel, ts_s, ts_s % 11 <> 0 AS send_ok FROM health, channels),
sent(channel, ts_s) AS (
  SELECT channel, min(ts_s) FROM sends WHERE send_ok GROUP BY channel
  UNION ALL
  SELECT a.channel, min(a.ts_s) FROM sent s JOIN sends a
    ON a.channel = s.channel AND a.send_ok AND a.ts_s >= s.ts_s + 1800 GROUP BY a.channel
)
SELECT a.channel, a.ts_s, a.send_ok
FROM sends a ASOF LEFT JOIN sent s ON a.channel = s.channel AND a.ts_s > s.ts_s
WHERE s.ts_s IS NULL OR a.ts_s - s.ts_s >= 1800"""

SILENCE = """
sent(event_type, seq, ts_s) AS (
  SELECT event_type, arg_min(event_id, event_id), arg_min(CAST(floor(epoch(ts)) AS BIGINT), event_id)
  FROM events GROUP BY event_type
  UNION ALL
  SELECT e.event_type, min(e.event_id), arg_min(CAST(floor(epoch(e.ts)) AS BIGINT), e.event_id)
  FROM sent s JOIN events e
    ON e.event_type = s.event_type AND e.event_id > s.seq
   AND CAST(floor(epoch(e.ts)) AS BIGINT) - s.ts_s >= 1800
  GROUP BY e.event_type
)
SELECT seq AS event_id, event_type, ts_s FROM sent"""

METRIC = """,
depth AS (
  SELECT server_uuid, ts_s, sum(sum(delta)) OVER (PARTITION BY server_uuid ORDER BY ts_s) AS backlog
  FROM queue GROUP BY server_uuid, ts_s
),
samples AS (
  SELECT server_uuid, unnest(generate_series(lo, hi, 600)) AS ts_s
  FROM (SELECT server_uuid, CAST(ceil(min(ts_s) / 600.0) AS BIGINT) * 600 AS lo,
               CAST(ceil(max(ts_s) / 600.0) AS BIGINT) * 600 AS hi
        FROM queue GROUP BY server_uuid)
)
SELECT s.server_uuid, s.ts_s, CAST(d.backlog AS BIGINT) AS backlog
FROM samples s ASOF JOIN depth d ON s.server_uuid = d.server_uuid AND s.ts_s >= d.ts_s
QUALIFY row_number() OVER (PARTITION BY s.server_uuid ORDER BY s.ts_s DESC) <= 900"""

# The 32-bit murmur2 hash of the key's bytes, four at a time, in bigints.
MURMUR2 = """,
sent AS (SELECT CAST(seq AS VARCHAR) AS key FROM audited WHERE outcome = 'delivered'),
bytes AS (
  SELECT key, length(key) AS n, [ascii(key[i]) for i in range(1, length(key) + 1)] AS b FROM sent
),
words AS (
  SELECT key, n, b, [CAST(b[4*i+1] + 256 * b[4*i+2] + 65536 * b[4*i+3] + 16777216 * b[4*i+4] AS BIGINT)
                     for i in range(0, n // 4)] AS w FROM bytes
),
mixed AS (
  SELECT key, n, b,
         list_prepend(CAST(xor(2538058380, n) AS BIGINT),
           [((xor(((x * 1540483477) & 4294967295), ((x * 1540483477) & 4294967295) >> 24)) * 1540483477) & 4294967295
            for x in w]) AS w
  FROM words
),
body AS (
  SELECT key, n, b, list_reduce(w, lambda h, x: xor((h * 1540483477) & 4294967295, x)) AS h FROM mixed
),
tail AS (
  SELECT key, CASE WHEN n % 4 = 0 THEN h ELSE (xor(h, CAST(
           b[n - n % 4 + 1] + CASE WHEN n % 4 > 1 THEN 256 * b[n - n % 4 + 2] ELSE 0 END
           + CASE WHEN n % 4 > 2 THEN 65536 * b[n - n % 4 + 3] ELSE 0 END AS BIGINT)) * 1540483477) & 4294967295 END AS h
  FROM body
),
middle AS (SELECT key, (xor(h, h >> 13) * 1540483477) & 4294967295 AS h FROM tail)
SELECT CAST((xor(h, h >> 15) & 2147483647) % 12 AS INTEGER) AS partition, count(*) AS n_records,
       CAST(sum(CAST(key AS BIGINT)) AS BIGINT) AS key_sum
FROM middle GROUP BY 1"""

DDL = """
SELECT seq, 'ddl' AS Action, schema_name AS Schema,
       'ALTER TABLE ' || table_name || ' ADD COLUMN c' || CAST(seq AS VARCHAR) || ' INT' AS Query,
       '0' AS ErrorCode, CAST(seq % 4 AS VARCHAR) AS ExecutionTime, base64(encode(props)) AS StatusVars
FROM log WHERE action = 'ddl' AND schema_name IN ('db0', 'db1')"""


def _escaped(text):
    """A text as it stands in a JSON string of a message body."""
    codes = {c: f"\\u{c:04x}" for c in [*range(1, 0x20), *b"<>&", 0x2028, 0x2029]}
    codes |= {ord("\n"): "\\n", ord("\r"): "\\r", ord("\t"): "\\t", ord('"'): '\\"'}
    sql = f"replace({text}, '\\', '\\\\')"
    for code, escape in codes.items():
        sql = f"replace({sql}, chr({code}), '{escape}')"
    return sql


SEEK = """
SELECT seq, binlog_file, binlog_pos FROM log
WHERE (binlog_file, binlog_pos) >= ('bin.000002', 40004)"""

ORACLES = {
    "q_change_events": _with(LOG, """
SELECT seq, ts_s, server_uuid, gno, binlog_file, binlog_pos, schema_name, table_name, action,
       CAST(CASE action WHEN 'ddl' THEN 0
            WHEN 'update' THEN 2 * n_rows + CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END
            ELSE n_rows END AS INTEGER) AS n_images
FROM log"""),
    "q_seek_position": _with(LOG, SEEK),
    "q_stream_seek_position": _with(LOG, SEEK),
    "q_gtid_union": _with(LOG + EXECUTED, ISLANDS.format(f"SELECT * FROM executed UNION {ROWS_SET}")),
    "q_gtid_subtract": _with(LOG + EXECUTED, ISLANDS.format(
        SET_OF.format("'update', 'ddl'") + " EXCEPT SELECT * FROM executed")),
    "q_gtid_intersect": _with(LOG + EXECUTED, ISLANDS.format(
        SET_OF.format("'insert', 'delete'") + " INTERSECT SELECT * FROM executed")),
    "q_gtid_contained": _with(LOG + EXECUTED + f""", have AS ({ROWS_SET})""", """
SELECT e.server_uuid, count(h.gno) = count(*) AS contained, count(*) - count(h.gno) AS n_missing
FROM executed e LEFT JOIN have h USING (server_uuid, gno) GROUP BY e.server_uuid"""),
    "q_gtid_set_text": _with(LOG + f""", islands AS ({ISLANDS.format(ROWS_SET)})""", """
SELECT server_uuid, server_uuid || ':' || string_agg(
         CASE WHEN gno_start = gno_end THEN CAST(gno_start AS VARCHAR) ELSE gno_start || '-' || gno_end END,
         ':' ORDER BY gno_start) AS gtid_set
FROM islands GROUP BY server_uuid"""),
    "q_seek_gtid": _with(LOG, """
SELECT seq, server_uuid, gno FROM log
WHERE NOT (server_uuid = 'srv0' AND gno BETWEEN 1 AND 1000)
  AND NOT (server_uuid = 'srv1' AND gno BETWEEN 1 AND 500)"""),
    "q_resume_gtid_set": _with(LOG + RESUME, ""),
    "q_catalog_scan": _with(LOG, """
SELECT DISTINCT schema_name, table_name,
       CASE table_name WHEN 't3' THEN 'id,kind,cents,props,extra' ELSE 'id,kind,cents,props' END AS columns,
       CASE table_name WHEN 't3' THEN 5 ELSE 4 END AS n_cols
FROM log WHERE schema_name IN ('db0', 'db1') AND table_name IN ('t0', 't1', 't3')"""),
    "q_snapshot_bootstrap": _with(MSG, """
SELECT 0 AS phase, 'shop.orders' AS key, 'insert' AS action, CAST(NULL AS BIGINT) AS seq,
       array_to_string([coalesce(CAST(x AS VARCHAR), 'NULL') FOR x IN
         [CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus,
          CAST(o_totalprice AS VARCHAR), CAST(o_orderdate AS VARCHAR), o_orderpriority]], '|') AS image
FROM orders
UNION ALL
SELECT 0, 'shop.nation', 'insert', NULL,
       CAST(n_nationkey AS VARCHAR) || '|' || n_name || '|' || CAST(n_regionkey AS VARCHAR) FROM nation
UNION ALL
SELECT 1, key, action, seq,
       id || '|' || kind || '|' || CAST(new_cents AS VARCHAR) || '|' || coalesce(props, 'NULL')
FROM msg WHERE schema_name IN ('db0', 'db1') AND seq >= 500"""),
    "q_snapshot_chunks": _with(MSG, """
SELECT schema_name, table_name, id, l.kind AS kind, l.cents AS cents, l.props AS props
FROM (SELECT schema_name, table_name, id,
             max_by({'action': action, 'kind': kind, 'cents': new_cents, 'props': props}, seq * 4 + row_index) AS l
      FROM msg WHERE schema_name IN ('db0', 'db1') GROUP BY schema_name, table_name, id)
WHERE l.action <> 'delete'"""),
    "q_resume_from_checkpoint": _with(LOG + KEPT, """
SELECT l.seq, l.server_uuid, l.gno FROM log l
WHERE l.gno > (SELECT max(k.gno) FROM log k JOIN checkpoints c USING (seq) WHERE k.server_uuid = l.server_uuid)""", True),
    "q_read_checkpoint": _with(LOG + KEPT, """
SELECT arg_max(gtid_set, seq) AS gtid_set, max(seq) AS saved_seq FROM checkpoints""", True),
    "q_allow_rows": _with(LOG, """
SELECT seq, schema_name, table_name, action FROM log
WHERE action <> 'ddl' AND schema_name IN ('db0', 'db1') AND table_name IN ('t0', 't1')"""),
    "q_allow_ddl": _with(LOG, """
SELECT seq, schema_name,
       'ALTER TABLE ' || table_name || ' ADD COLUMN c' || CAST(seq AS VARCHAR) || ' INT' AS query
FROM log WHERE action = 'ddl' AND schema_name IN ('db0', 'db1')"""),
    "q_allow_ddl_relaxed": _with(LOG, """
SELECT 'relaxed' AS mode, seq, schema_name
FROM log WHERE action = 'ddl' AND schema_name IN ('db0', 'db1')"""),
    "q_route_kinds": _with(LOG + MESSAGES, """
SELECT seq, CAST(m.o AS INTEGER) AS ordinal, m.kind AS kind, m.payload AS payload FROM messages"""),
    "q_oversize": """
SELECT doc_id, CAST(octet_length(encode(text)) AS INTEGER) AS n_bytes,
       octet_length(encode(text)) <= 10000 AS fits FROM documents""",
    "q_oversize_exact": rf"""
WITH bodies AS (
  SELECT doc_id, text, CASE WHEN text IS NULL THEN '{{"text":null}}' ELSE '{{"text":"' || {_escaped("text")} || '"}}' END AS body
  FROM documents)
SELECT doc_id,
       CAST(CASE WHEN text IS NULL THEN 13 ELSE 11 + octet_length(encode(text))
         + length(regexp_replace(text, '[^"\\\n\r\t]', '', 'g'))
         + 5 * length(regexp_replace(text, '[^<>&\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'))
         + 3 * length(regexp_replace(text, '[^\x{{2028}}\x{{2029}}]', '', 'g')) END AS INTEGER) AS n_bytes,
       n_bytes <= 10000 AS fits, md5(body) AS body_md5
FROM bodies""",
    "q_arity_mismatch": _with(AUDIT, """
SELECT seq, row_index, key, n_cols, 4 AS n_values FROM audited WHERE outcome = 'arity_mismatch'"""),
    "q_delivery_audit": _with(AUDIT, """
SELECT outcome, count(*) AS n_rows, CAST(sum(new_cents) AS BIGINT) AS new_cents,
       CAST(sum(old_cents) AS BIGINT) AS old_cents
FROM audited GROUP BY outcome"""),
    "q_dead_letters": _with(AUDIT, """
SELECT outcome, seq, row_index, key, action, CAST(new_cents AS VARCHAR) AS new_cents,
       CAST(old_cents AS VARCHAR) AS old_cents
FROM audited WHERE outcome <> 'delivered'"""),
    "q_explode_rows": _with(MSG, """
SELECT seq, row_index, action, id, kind, CAST(new_cents AS VARCHAR) AS cents, props
FROM msg WHERE action IN ('insert', 'delete')"""),
    "q_pair_updates": _with(MSG, """
SELECT seq, row_index, id, CAST(old_cents AS VARCHAR) AS old_cents,
       CAST(new_cents AS VARCHAR) AS new_cents
FROM msg WHERE action = 'update'"""),
    "q_table_key": _with(MSG, "SELECT seq, row_index, key FROM msg"),
    "q_named_values": _with(AUDIT, """
SELECT seq, row_index, column_name, value
FROM (SELECT seq, row_index, id, kind, CAST(new_cents AS VARCHAR) AS cents, props
      FROM audited WHERE outcome = 'delivered')
UNPIVOT (value FOR column_name IN (id, kind, cents, props))"""),
    "q_old_values": _with(AUDIT, """
SELECT seq, row_index, column_name, value
FROM (SELECT seq, row_index, id, kind, CAST(old_cents AS VARCHAR) AS cents, props
      FROM audited WHERE outcome = 'delivered' AND action = 'update')
UNPIVOT (value FOR column_name IN (id, kind, cents, props))"""),
    "q_bytes_to_text": _with(LOG, """
SELECT seq, props, event_type AS kind, table_name FROM log"""),
    "q_changed_columns": _with(AUDIT, """
SELECT seq, row_index, 'cents' AS column_name, CAST(old_cents AS VARCHAR) AS old_value,
       CAST(new_cents AS VARCHAR) AS new_value
FROM audited WHERE outcome = 'delivered' AND action = 'update'"""),
    "q_ddl_fanout": _with(LOG + MESSAGES, """
SELECT seq, CAST(m.o AS INTEGER) AS ordinal, m.kind AS kind, m.payload AS payload
FROM messages WHERE action = 'ddl' AND schema_name IN ('db0', 'db1')"""),
    "q_position_events": _with(LOG, """
SELECT seq, CASE action WHEN 'ddl' THEN 'ddl' ELSE 'xid' END AS origin, binlog_file, binlog_pos,
       true AS force FROM log
UNION ALL
SELECT min(seq), 'rotate', binlog_file, 4, true FROM log GROUP BY binlog_file"""),
    "q_gtid_events": _with(LOG + GTIDS, "SELECT * FROM gtids"),
    "q_catalog_lookup": _with(AUDIT, """
SELECT seq, row_index, key, columns, n_cols FROM audited WHERE outcome <> 'unknown_table'"""),
    "q_unknown_tables": _with(AUDIT, """
SELECT seq, row_index, key FROM audited WHERE outcome = 'unknown_table'"""),
    "q_schema_latest": _with(MSG + CAT + VERSIONS, FIT.format(
        join=f"LEFT JOIN {NEWEST} v USING (schema_name, table_name)")),
    "q_schema_as_of": _with(MSG + CAT + VERSIONS, FIT.format(
        join="ASOF LEFT JOIN versions v ON m.schema_name = v.schema_name "
        "AND m.table_name = v.table_name AND m.seq >= v.valid_from")),
    "q_stream_schema_as_of": _with(MSG + CAT + VERSIONS, FIT.format(
        join="ASOF LEFT JOIN versions v ON m.schema_name = v.schema_name "
        "AND m.table_name = v.table_name AND m.seq >= v.valid_from")),
    "q_stream_health": _with(LOG + STATES, "SELECT * FROM health"),
    "q_stream_backlog": _with(LOG + QUEUE, """
SELECT server_uuid, ts_s,
       CAST(sum(sum(delta)) OVER (PARTITION BY server_uuid ORDER BY ts_s) AS BIGINT) AS backlog
FROM queue GROUP BY server_uuid, ts_s"""),
    "q_stream_catalog": _with(LOG + CAT + VERSIONS, """
SELECT schema_name, table_name, arg_max(columns, valid_from) AS columns,
       arg_max(n_cols, valid_from) AS n_cols, max(valid_from) AS valid_from
FROM versions WHERE schema_name IN ('db0', 'db1') AND valid_from > 0 GROUP BY schema_name, table_name"""),
    "q_stream_executed": _with(LOG, ISLANDS.format("SELECT server_uuid, seq AS gno FROM log")),
    "q_catalog_upsert": _with(LOG + CAT + VERSIONS, f"""
SELECT schema_name, table_name, columns, n_cols, valid_from FROM {NEWEST} v
WHERE schema_name IN ('db0', 'db1')"""),
    "q_dml_counts": _with(AUDIT, f"""
SELECT schema_name, table_name, {COUNTS} FROM audited WHERE outcome = 'delivered'
GROUP BY schema_name, table_name"""),
    "q_table_report": _with(AUDIT, f"""
SELECT c.schema_name, c.table_name, {COUNTS}
FROM cat c LEFT JOIN (SELECT * FROM audited WHERE outcome = 'delivered') a
  USING (schema_name, table_name)
GROUP BY c.schema_name, c.table_name"""),
    "q_ddl_report": _with(LOG + CAT, """
SELECT c.schema_name, count(l.seq) AS ddl_count
FROM (SELECT DISTINCT schema_name FROM cat) c
LEFT JOIN (SELECT * FROM log WHERE action = 'ddl' AND schema_name IN ('db0', 'db1')) l
  USING (schema_name) GROUP BY c.schema_name"""),
    "q_component_state": _with(LOG + STATES, """
SELECT component, arg_max(state, ts_s) AS state FROM states GROUP BY component"""),
    "q_metric_series": _with(LOG + QUEUE + METRIC, ""),
    "q_stream_metric_series": _with(LOG + QUEUE + METRIC, ""),
    "q_latest_position": _with(LOG, """
SELECT server_uuid, seq, binlog_file, binlog_pos FROM log
QUALIFY row_number() OVER (PARTITION BY server_uuid ORDER BY seq DESC) = 1"""),
    "q_latest_gtid": _with(LOG + KEPT, """
SELECT server_uuid, arg_max(gtid_set, seq) AS gtid_set FROM checkpoints GROUP BY server_uuid""", True),
    "q_progress_info": _with(LOG + KEPT, """
SELECT l.server_uuid, arg_max(binlog_file, l.seq) AS binlog_file,
       arg_max(binlog_pos, l.seq) AS binlog_pos,
       (SELECT arg_max(gtid_set, seq) FROM checkpoints c WHERE c.server_uuid = l.server_uuid) AS gtid_set
FROM log l GROUP BY l.server_uuid""", True),
    "q_backlog": _with(LOG + QUEUE, """
SELECT seq, ts_s, delta,
       CAST(sum(delta) OVER (ORDER BY ts_s, seq, delta DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS backlog
FROM queue"""),
    "q_micro_batches": _with(LOG + _batches([], ROW_ITEMS), "", True),
    "q_micro_batches_saved": _with(LOG + KEPT + _batches(["server_uuid"], SAVED_ITEMS), "", True),
    "q_checkpoint_throttle": _with(LOG + KEPT, "SELECT * FROM checkpoints", True),
    "q_checkpoint_log": _with(LOG + KEPT, """
SELECT server_uuid, seq AS saved_seq, ts_s, gtid_set FROM checkpoints""", True),
    "q_health_alerts": _with(LOG + STATES, "SELECT * FROM health"),
    "q_alert_fanout": _with(LOG + STATES, "SELECT * FROM health, channels"),
    "q_alert_silence": _with(SILENCE, "", True),
    "q_alert_sends": _with(LOG + STATES + SENDS, "", True),
    "q_alert_render": _with(LOG + STATES, RENDER),
    "q_row_envelope": _with(AUDIT, ENVELOPE),
    "q_row_envelope_typed": _with(AUDIT, """
SELECT seq, row_index, action, CAST(id AS BIGINT) AS id, kind, new_cents AS cents, props,
       true AS id_is_number, old_cents
FROM audited WHERE outcome = 'delivered'"""),
    "q_stream_ddl": _with(LOG, DDL),
    "q_stream_progress": _with(LOG, """
SELECT server_uuid, arg_max(binlog_file, seq) AS binlog_file, arg_max(binlog_pos, seq) AS binlog_pos,
       server_uuid || ':' || CAST(max(seq) AS VARCHAR) AS gtid_set
FROM log GROUP BY server_uuid"""),
    "q_stream_sends": _with(LOG + STATES + SENDS, "", True),
    "q_ddl_envelope": _with(LOG, DDL),
    "q_kafka_records": _with(AUDIT, """
SELECT 'log' AS topic, CAST(seq AS VARCHAR) AS key, ts_s AS sent_s,
       CAST(new_cents AS VARCHAR) AS cents
FROM audited WHERE outcome = 'delivered'"""),
    "q_kafka_partitions": _with(AUDIT, MURMUR2),
    "q_sink_roundtrip": _with(AUDIT, ENVELOPE),
    "q_stream_relay": _with(AUDIT, ENVELOPE),
    "q_stream_committed": _with(AUDIT, ENVELOPE),
    "q_stream_dml_counts": _with(AUDIT, f"""
SELECT schema_name, table_name, {COUNTS} FROM audited WHERE outcome = 'delivered'
GROUP BY schema_name, table_name"""),
    "q_stream_checkpoints": _with(LOG + KEPT, """
SELECT seq, ts_s, server_uuid, server_uuid || ':' || CAST(seq AS VARCHAR) AS gtid_set, force
FROM checkpoints""", True),
    "q_stream_silence": _with(SILENCE, "", True),
}
