"""Independent DuckDB SQL for every registered query (the correctness oracle).

The bridges of FIXTURES.md are spelled out as CTEs over the raw test tables;
each query is ``WITH <the CTEs it needs> SELECT ...``.  Order-dependent
operators are written the straightforward way: windows over whole items for
running stock and lifecycle, and recursive CTEs that step through each key's
scans one at a time for the debounce rules.
"""

from __future__ import annotations

RP, RQ = 10, 24  # fixed business defaults (reorder point, reorder quantity)
W_US = 3_000_000  # debounce window, microseconds

CTE: dict[str, str] = {}

CTE["bronze"] = """
bronze AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS event_ts,
    CASE WHEN event_type IN ('signup', 'view') THEN 'INTAKE'
         WHEN event_type IN ('purchase', 'click') THEN 'CONSUME' ELSE upper(event_type) END AS event_type,
    'ST-' || CAST(event_id % 5 AS VARCHAR) AS station_id,
    'ITEM=PART-' || CAST(user_id AS VARCHAR) || ';QTY=' || CAST(CAST(floor(value / 4) AS INTEGER) AS VARCHAR) AS barcode_raw,
    'PART-' || CAST(user_id AS VARCHAR) AS item_id,
    CAST(floor(value / 4) AS INTEGER) AS qty,
    CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'user' || CAST(user_id AS VARCHAR) || '@example.com' END AS user_email
  FROM events)"""

CTE["silver"] = """
silver AS (
  SELECT *, CAST(event_ts AS DATE) AS event_date, CAST(hour(event_ts) AS INTEGER) AS event_hour
  FROM bronze
  WHERE event_type IN ('INTAKE', 'CONSUME') AND qty > 0 AND item_id IS NOT NULL AND length(item_id) > 0)"""

CTE["acks"] = """
acks AS (SELECT event_id, event_ts, item_id FROM bronze WHERE event_type = 'ERROR')"""

CTE["bronze_l"] = """
bronze_l AS (
  SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER),
                       CAST(round(l_extendedprice * 100) AS BIGINT))) AS event_id,
    l_shipdate + to_seconds(CAST((l_orderkey * 7 + l_linenumber * 131) % 86400 AS BIGINT)) AS event_ts,
    CASE WHEN l_linestatus = 'O' THEN 'INTAKE' ELSE 'CONSUME' END AS event_type,
    'SUP-' || CAST(l_suppkey AS VARCHAR) AS station_id,
    'ITEM=PART-' || CAST(l_partkey AS VARCHAR) || ';QTY=' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS barcode_raw,
    'PART-' || CAST(l_partkey AS VARCHAR) AS item_id,
    CAST(l_quantity AS INTEGER) AS qty,
    CAST(NULL AS VARCHAR) AS user_email
  FROM lineitem)"""

CTE["silver_l"] = """
silver_l AS (
  SELECT *, CAST(event_ts AS DATE) AS event_date, CAST(hour(event_ts) AS INTEGER) AS event_hour
  FROM bronze_l
  WHERE event_type IN ('INTAKE', 'CONSUME') AND qty > 0 AND item_id IS NOT NULL AND length(item_id) > 0)"""


def _lifecycle(name: str, scans: str, acks: str | None) -> str:
    ack_part = f"""
    UNION ALL SELECT item_id, event_ts, event_id, 'ACK', CAST(0 AS BIGINT) FROM {acks}""" if acks else ""
    return f"""
{name}_led AS (
    SELECT item_id, event_ts, event_id, event_type AS kind,
           CAST(CASE WHEN event_type = 'INTAKE' THEN qty ELSE -qty END AS BIGINT) AS delta
    FROM {scans} WHERE event_type IN ('INTAKE', 'CONSUME'){ack_part}),
{name}_bal AS (
    SELECT *, SUM(delta) OVER (PARTITION BY item_id ORDER BY event_ts, event_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance
    FROM {name}_led),
{name}_lab AS (
    SELECT * FROM (
      SELECT *, CASE WHEN kind = 'CONSUME' AND balance <= {RP} THEN 'O'
                     WHEN kind = 'INTAKE' AND balance > {RP} THEN 'F'
                     WHEN kind = 'ACK' THEN 'A' END AS label
      FROM {name}_bal) WHERE label IS NOT NULL),
{name}_emit AS (
    SELECT * FROM (
      SELECT *, CASE WHEN label = 'O' AND prev IS DISTINCT FROM 'O' THEN 'OPEN'
                     WHEN label = 'F' AND prev = 'O' THEN 'FULFILLED'
                     WHEN label = 'A' AND prev = 'O' THEN 'ACKNOWLEDGED' END AS status
      FROM (SELECT *, LAG(label) OVER (PARTITION BY item_id ORDER BY event_ts, event_id) AS prev
            FROM {name}_lab)) WHERE status IS NOT NULL),
{name}_fill AS (
    SELECT *,
      last_value(CASE WHEN status = 'OPEN' THEN event_id END IGNORE NULLS) OVER w AS open_event_id,
      last_value(CASE WHEN status = 'OPEN' THEN balance END IGNORE NULLS) OVER w AS open_balance
    FROM {name}_emit
    WINDOW w AS (PARTITION BY item_id ORDER BY event_ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name} AS (
    SELECT TRY_CAST(event_id AS BIGINT) AS id, md5(item_id || '|' || open_event_id) AS signal_id,
           event_ts AS created_ts, item_id, CAST(open_balance AS BIGINT) AS triggered_at_qty,
           {RP} AS reorder_point, {RQ} AS reorder_qty,
           CASE WHEN status = 'ACKNOWLEDGED' THEN open_event_id ELSE event_id END AS trigger_event_id, status
    FROM {name}_fill)"""


CTE["signals"] = _lifecycle("signals", "silver", "acks")
CTE["signals_noack"] = _lifecycle("signals_noack", "silver", None)
CTE["signals_l"] = _lifecycle("signals_l", "silver_l", None)

CTE["silver_signals"] = """
silver_signals AS (
  SELECT *, CAST(created_ts AS DATE) AS signal_date, reorder_point - triggered_at_qty AS qty_below_reorder
  FROM signals WHERE status IN ('OPEN', 'ACKNOWLEDGED', 'FULFILLED'))"""


def _latest(name: str, src: str) -> str:
    return f"""
{name} AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY created_ts DESC, id DESC NULLS LAST,
              CASE status WHEN 'FULFILLED' THEN 3 WHEN 'ACKNOWLEDGED' THEN 2 WHEN 'OPEN' THEN 1 ELSE 0 END DESC) AS rn
    FROM {src}) WHERE rn = 1)"""


CTE["latest"] = _latest("latest", "signals")
CTE["latest_silver"] = _latest("latest_silver", "silver_signals")

CTE["inventory"] = """
inventory AS (
  SELECT item_id,
    CAST(sum(CASE WHEN event_type = 'INTAKE' THEN qty ELSE -qty END) AS BIGINT) AS on_hand_qty,
    count(*) AS total_events,
    CAST(sum(CASE WHEN event_type = 'INTAKE' THEN qty ELSE 0 END) AS BIGINT) AS total_intake,
    CAST(sum(CASE WHEN event_type = 'CONSUME' THEN qty ELSE 0 END) AS BIGINT) AS total_consumed,
    max(event_ts) AS last_activity
  FROM silver GROUP BY item_id)"""

CTE["totals"] = """
totals AS (
  SELECT item_id,
    CAST(coalesce(sum(CASE WHEN event_type = 'INTAKE' THEN qty ELSE 0 END), 0) AS BIGINT) AS intake_total,
    CAST(coalesce(sum(CASE WHEN event_type = 'CONSUME' THEN qty ELSE 0 END), 0) AS BIGINT) AS consume_total,
    CAST(coalesce(sum(CASE WHEN event_type = 'INTAKE' THEN qty ELSE 0 END), 0)
         - coalesce(sum(CASE WHEN event_type = 'CONSUME' THEN qty ELSE 0 END), 0) AS BIGINT) AS on_hand_qty,
    max(event_ts) AS last_activity_ts
  FROM bronze GROUP BY item_id)"""

CTE["daily"] = """
daily AS (
  SELECT event_date, event_type, count(*) AS event_count, CAST(sum(qty) AS BIGINT) AS total_qty,
         count(DISTINCT item_id) AS unique_items, count(DISTINCT station_id) AS unique_stations
  FROM silver GROUP BY event_date, event_type)"""

CTE["gold_open"] = """
gold_open AS (
  SELECT s.signal_id, s.item_id, s.triggered_at_qty AS qty_at_signal, i.on_hand_qty AS current_on_hand,
         s.reorder_point, s.reorder_qty, s.created_ts, s.signal_date,
         i.on_hand_qty > s.reorder_point AS already_restocked
  FROM latest_silver s LEFT JOIN inventory i ON s.item_id = i.item_id
  WHERE s.status = 'OPEN')"""

CTE["asof"] = """
asof_t AS (SELECT max(event_ts) AS t, CAST(max(event_ts) AS DATE) AS d FROM silver)"""

CTE["running"] = """
running AS (
  SELECT *, CAST(SUM(CASE WHEN event_type = 'INTAKE' THEN qty WHEN event_type = 'CONSUME' THEN -qty ELSE 0 END)
         OVER (PARTITION BY item_id ORDER BY event_ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS on_hand_qty
  FROM silver)"""

CTE["rescans"] = """
rescans AS (
  SELECT event_id, event_ts, event_type, station_id, barcode_raw, item_id, qty, user_email
  FROM bronze WHERE CAST(event_id AS BIGINT) % 4 <> 0
  UNION ALL
  SELECT event_id || '#' || CAST(o AS VARCHAR), event_ts + to_seconds(o), event_type, station_id, barcode_raw,
         item_id, qty, user_email
  FROM (SELECT *, unnest([0, 2, 4, 7]) AS o FROM bronze WHERE CAST(event_id AS BIGINT) % 4 = 0))"""

CTE["raw_scans"] = """
raw_scans AS (
  SELECT r.event_id AS scan_id, r.event_ts,
         CASE WHEN r.event_type = 'ERROR' THEN 'CONSUME' ELSE r.event_type END AS kind,
         r.station_id,
         CASE WHEN r.event_type = 'ERROR' THEN e.props ELSE r.barcode_raw END AS barcode_raw,
         r.user_email
  FROM rescans r LEFT JOIN events e ON split_part(r.event_id, '#', 1) = CAST(e.event_id AS VARCHAR))"""


def _parse(col: str) -> str:
    """(parsed_item_id, parsed_qty, parse_error) expressions for a raw barcode column."""
    s = f"regexp_replace(coalesce({col}, ''), '^\\s+|\\s+$', '', 'g')"
    pat = "'^ITEM=([^;]+);QTY=([0-9]+)$'"
    ok = f"regexp_full_match({s}, {pat})"
    q = f"TRY_CAST(regexp_extract({s}, {pat}, 2) AS INTEGER)"
    err = (f"CASE WHEN NOT {ok} THEN 'bad_format' WHEN {q} IS NULL THEN 'overflow' "
           f"WHEN {q} <= 0 THEN 'non_positive' END")
    item = f"CASE WHEN ({err}) IS NULL THEN regexp_extract({s}, {pat}, 1) END"
    qty = f"CASE WHEN ({err}) IS NULL THEN {q} END"
    return item, qty, err


def _debounce(name: str, src: str, key: str, id_col: str, w_us: int, adjacent: bool = False) -> str:
    """Sequential simulation, one step per scan of each key (recursive CTE)."""
    if not adjacent:
        return f"""
{name}_in AS (
  SELECT *, epoch_us(event_ts) AS t,
         row_number() OVER (PARTITION BY {key} ORDER BY event_ts, {id_col}) AS rn FROM {src}),
{name}_rec AS (
  SELECT {key} AS k, rn, t AS last_t, true AS kept, {id_col} AS rid FROM {name}_in WHERE rn = 1
  UNION ALL
  SELECT r.k, i.rn,
         CASE WHEN i.t - r.last_t >= {w_us} THEN i.t ELSE r.last_t END,
         i.t - r.last_t >= {w_us}, i.{id_col}
  FROM {name}_rec r JOIN {name}_in i ON i.{key} IS NOT DISTINCT FROM r.k AND i.rn = r.rn + 1),
{name} AS (SELECT rid, kept FROM {name}_rec)"""
    return f"""
{name}_in AS (
  SELECT *, epoch_us(event_ts) AS t,
         row_number() OVER (PARTITION BY station_id ORDER BY event_ts, {id_col}) AS rn FROM {src}),
{name}_rec AS (
  SELECT station_id AS k, rn, t AS last_t, {key} AS last_code, true AS kept, {id_col} AS rid
  FROM {name}_in WHERE rn = 1
  UNION ALL
  SELECT r.k, i.rn,
         CASE WHEN i.{key} IS DISTINCT FROM r.last_code OR i.t - r.last_t >= {w_us} THEN i.t ELSE r.last_t END,
         CASE WHEN i.{key} IS DISTINCT FROM r.last_code OR i.t - r.last_t >= {w_us} THEN i.{key} ELSE r.last_code END,
         i.{key} IS DISTINCT FROM r.last_code OR i.t - r.last_t >= {w_us}, i.{id_col}
  FROM {name}_rec r JOIN {name}_in i ON i.station_id = r.k AND i.rn = r.rn + 1),
{name} AS (SELECT rid, kept FROM {name}_rec)"""


CTE["deb3"] = _debounce("deb3", "rescans", "barcode_raw", "event_id", W_US)
CTE["deb48"] = _debounce("deb48", "rescans", "barcode_raw", "event_id", 48 * 3600 * 1_000_000)
CTE["debadj"] = _debounce("debadj", "rescans", "barcode_raw", "event_id", W_US, adjacent=True)
CTE["debraw"] = _debounce("debraw", "raw_scans", "barcode_raw", "scan_id", W_US)

_pi, _pq, _pe = _parse("barcode_raw")
CTE["ingest"] = f"""
ingest AS (
  SELECT r.*, {_pi} AS p_item, {_pq} AS p_qty,
         CASE WHEN NOT d.kept THEN 'duplicate' ELSE {_pe} END AS reason
  FROM raw_scans r JOIN debraw d ON d.rid = r.scan_id)"""

# the same with scans without a time: rejected, or given a time before the debounce
CTE["raw_untimed"] = """
raw_untimed AS (
  SELECT * REPLACE (CASE WHEN md5(scan_id)[1:1] <> '0' THEN event_ts END AS event_ts) FROM raw_scans),
raw_timed AS (SELECT * FROM raw_untimed WHERE event_ts IS NOT NULL),
raw_defaulted AS (SELECT * REPLACE (coalesce(event_ts, TIMESTAMP '2024-03-01 00:00:00') AS event_ts) FROM raw_untimed)"""
CTE["debtimed"] = _debounce("debtimed", "raw_timed", "barcode_raw", "scan_id", W_US)
CTE["debdefault"] = _debounce("debdefault", "raw_defaulted", "barcode_raw", "scan_id", W_US)

# ---- packing slips (bridge P) ----
CTE["slip_src"] = r"""
slip_src AS (
  SELECT l_orderkey AS slip_id, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         'PART-' || CAST(l_partkey AS VARCHAR) AS item_id, CAST(l_quantity AS INTEGER) AS qty,
         'supplier ' || CAST(l_suppkey AS VARCHAR) AS description,
         CASE WHEN l_returnflag = 'N' THEN 'high' WHEN l_returnflag = 'A' THEN NULL
              WHEN l_discount = 0.0 THEN 'unsure' ELSE 'low' END AS confidence
  FROM lineitem),
slip_json AS (
  SELECT slip_id, '{"items":[' || string_agg('{"item_id":"' || item_id || '","qty":' || CAST(qty AS VARCHAR) || ',"description":"' || description || '"'
           || coalesce(',"confidence":"' || confidence || '"', '') || '}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
           l_extendedprice, item_id, qty, description, confidence NULLS FIRST) || '],"po_number":"PO-' || CAST(slip_id AS VARCHAR)
           || '","ship_date":"' || strftime(any_value(o_orderdate), '%Y-%m-%d') || '"}' AS j
  FROM slip_src JOIN orders ON o_orderkey = slip_id GROUP BY slip_id),
slip_text AS (
  SELECT slip_id, CASE slip_id % 4 WHEN 0 THEN j WHEN 1 THEN '```json' || j || '```' WHEN 2 THEN '```' || j || '```'
                  ELSE 'Extracted items: ```json' || j || '``` Done.' END AS response FROM slip_json
  UNION ALL
  SELECT -slip_id, CASE slip_id % 25 WHEN 7 THEN left(j, length(j) - 2) WHEN 8 THEN j || ' x'
                   WHEN 9 THEN replace(j, '"item_id":"PART-', '"item_id":"') WHEN 10 THEN replace(j, '"confidence":"high"', '"confidence":null')
                   WHEN 11 THEN '{"items":null}' WHEN 12 THEN '```json' || j || '``` or ```json{}```'
                   WHEN 13 THEN '{"vendor":5,' || substring(j, 2) WHEN 14 THEN regexp_replace(j, '"qty":([0-9]+)', '"qty":"+\1"', 'g')
                   WHEN 15 THEN regexp_replace(j, '"item_id":"[^"]*"', '"item_id":"' || chr(160) || ' "', 'g')
                   WHEN 16 THEN regexp_replace(j, '"item_id":"PART-([0-9]+)"', '"item_id":\1', 'g') END
  FROM slip_json WHERE slip_id % 25 BETWEEN 7 AND 16),
slip_body AS (
  SELECT slip_id, trim(CASE WHEN contains(response, '```json') THEN split_part(split_part(response, '```json', 2), '```', 1)
                       WHEN contains(response, '```') THEN split_part(response, '```', 2) ELSE response END, chr(10) || ' ') AS b
  FROM slip_text),
slip_doc AS (
  SELECT slip_id, CASE WHEN json_valid(b) THEN CASE WHEN json_type(b) = 'OBJECT' THEN b END END AS d FROM slip_body),
slip_item AS (
  SELECT slip_id, line_no - 1 AS line_no, x ->> '$.item_id' AS item_id, json_type(x, '$.item_id') AS t_item,
         CASE WHEN json_type(x, '$.qty') IN ('UBIGINT', 'BIGINT') OR (json_type(x, '$.qty') = 'VARCHAR'
              AND regexp_full_match(x ->> '$.qty', '\s*[+-]?[0-9]+\s*')) THEN TRY_CAST(replace(trim(x ->> '$.qty'), '+', '') AS INTEGER) END AS qty,
         x ->> '$.description' AS description, json_type(x, '$.description') AS t_desc,
         CASE WHEN json_type(x, '$.confidence') IS NULL THEN 'medium' WHEN json_type(x, '$.confidence') = 'VARCHAR' THEN x ->> '$.confidence' END AS confidence
  FROM (SELECT slip_id, unnest(json_extract(d, '$.items[*]')) AS x, generate_subscripts(json_extract(d, '$.items[*]'), 1) AS line_no
        FROM slip_doc WHERE json_type(d, '$.items') = 'ARRAY')),
slip_ok AS (
  SELECT d.slip_id, d.d, d.d IS NOT NULL AS readable, coalesce(i.n, 0) AS n_lines,
         coalesce(i.ok, true) AND coalesce(json_type(d.d, '$.items') = 'ARRAY', true) AS lines_ok,
         coalesce(json_type(d.d, '$.vendor'), 'NULL') IN ('NULL', 'VARCHAR') AND coalesce(json_type(d.d, '$.po_number'), 'NULL') IN ('NULL', 'VARCHAR')
           AND coalesce(json_type(d.d, '$.ship_date'), 'NULL') IN ('NULL', 'VARCHAR') AS header_ok
  FROM slip_doc d LEFT JOIN (
    SELECT slip_id, count(*) AS n, bool_and(coalesce(t_item = 'VARCHAR' AND qty >= 1 AND confidence IN ('high', 'medium', 'low')
           AND coalesce(t_desc, 'NULL') IN ('NULL', 'VARCHAR'), false)) AS ok
    FROM slip_item GROUP BY slip_id) i USING (slip_id)),
slip_lines AS (
  SELECT i.slip_id, d ->> '$.vendor' AS vendor, d ->> '$.po_number' AS po_number, d ->> '$.ship_date' AS ship_date,
         CAST(i.line_no AS INTEGER) AS line_no, i.item_id, i.qty, i.description, i.confidence
  FROM slip_item i JOIN slip_ok USING (slip_id) WHERE readable AND lines_ok AND header_ok)"""

CTE["bulk"] = """
bulk_raw AS (
  SELECT CAST(l.slip_id AS VARCHAR) || '-' || CAST(l.line_no AS VARCHAR) AS scan_id, o.o_orderdate AS event_ts,
         'INTAKE' AS kind, 'PACKING_SLIP' AS station_id,
         'ITEM=' || l.item_id || ';QTY=' || CAST(l.qty AS VARCHAR) AS barcode_raw, 'clerk' || CAST(o.o_custkey % 9 AS VARCHAR) || '@example.com' AS user_email
  FROM slip_lines l JOIN orders o ON o.o_orderkey = l.slip_id
  WHERE length(trim(coalesce(l.item_id, ''), chr(9) || chr(10) || chr(13) || ' ' || chr(160))) > 0 AND coalesce(l.qty, 0) > 0)"""
CTE["debbulk"] = _debounce("debbulk", "bulk_raw", "barcode_raw", "scan_id", W_US)
_bi, _bq, _be = _parse("b.barcode_raw")
CTE["bulk_ok"] = f"""
bulk_ok AS (
  SELECT b.scan_id AS event_id, b.event_ts, b.kind AS event_type, b.station_id, b.barcode_raw,
         {_bi} AS item_id, {_bq} AS qty, b.user_email
  FROM bulk_raw b JOIN debbulk d ON d.rid = b.scan_id WHERE d.kept AND ({_be}) IS NULL)"""

CTE["silver_hot"] = """
silver_hot AS (
  SELECT event_id, event_ts, event_type, station_id,
         CASE WHEN hot THEN 'ITEM=PART-HOT;QTY=' || CAST(qty AS VARCHAR) ELSE barcode_raw END AS barcode_raw,
         CASE WHEN hot THEN 'PART-HOT' ELSE item_id END AS item_id, qty, user_email, event_date, event_hour
  FROM (SELECT *, CAST(('0x' || substring(event_id, 1, 8)) AS BIGINT) % 3 = 0 AS hot FROM silver_l))"""
CTE["signals_hot"] = _lifecycle("signals_hot", "silver_hot", None)
CTE["rescans_hot"] = """
rescans_hot AS (
  SELECT event_id, event_ts,
         CASE WHEN CAST(split_part(event_id, '#', 1) AS BIGINT) % 3 = 0 THEN 'ITEM=PART-HOT;QTY=1'
              ELSE barcode_raw END AS barcode_raw
  FROM rescans)"""
CTE["debhot"] = _debounce("debhot", "rescans_hot", "barcode_raw", "event_id", 48 * 3600 * 1_000_000)

DEPS = {
    "silver": ["bronze"], "acks": ["bronze"], "silver_l": ["bronze_l"],
    "signals": ["silver", "acks"], "signals_noack": ["silver"], "signals_l": ["silver_l"],
    "silver_signals": ["signals"], "latest": ["signals"], "latest_silver": ["silver_signals"],
    "inventory": ["silver"], "totals": ["bronze"], "daily": ["silver"],
    "gold_open": ["latest_silver", "inventory"], "asof": ["silver"], "running": ["silver"],
    "rescans": ["bronze"], "raw_scans": ["rescans"], "deb3": ["rescans"], "deb48": ["rescans"],
    "debadj": ["rescans"], "debraw": ["raw_scans"], "ingest": ["raw_scans", "debraw"],
    "raw_untimed": ["raw_scans"], "debtimed": ["raw_untimed"], "debdefault": ["raw_untimed"],
    "silver_hot": ["silver_l"], "signals_hot": ["silver_hot"], "rescans_hot": ["rescans"],
    "debhot": ["rescans_hot"],
    "bulk": ["slip_src"], "debbulk": ["bulk"], "bulk_ok": ["debbulk"],
}


def with_(*names: str) -> str:
    """WITH clause holding the named CTEs and everything they depend on, in order."""
    seen: list[str] = []

    def add(n: str) -> None:
        for d in DEPS.get(n, []):
            add(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        add(n)
    rec = any(n.startswith("deb") or n in ("ingest", "bulk_ok") for n in seen)
    return ("WITH RECURSIVE " if rec else "WITH ") + ",".join(CTE[n] for n in seen) + "\n"


SIG_COLS = "id, signal_id, created_ts, item_id, triggered_at_qty, reorder_point, reorder_qty, trigger_event_id, status"
SCAN_COLS = "event_id, event_ts, event_type, station_id, barcode_raw, item_id, qty, user_email"
STATUS_OK = "CASE status WHEN 'FULFILLED' THEN 3 WHEN 'ACKNOWLEDGED' THEN 2 WHEN 'OPEN' THEN 1 ELSE 0 END"


def _stock_status(q: str) -> str:
    below = f"({q} <= {RP})"
    return (f"CASE WHEN {q} <= 5 OR ({below} AND {q} <= 10) THEN 'critical' "
            f"WHEN {q} <= 15 OR {below} THEN 'low' ELSE 'ok' END")


def _secs(a: str, b: str) -> str:
    return f"(epoch_us({a}) - epoch_us({b})) / 1000000.0"


def _live_page(status: str | None) -> str:
    cond = f"WHERE s.status = '{status}'" if status else ""
    return f"""
  SELECT s.signal_id, s.created_ts, s.item_id, coalesce(i.on_hand_qty, CAST(0 AS BIGINT)) AS current_qty,
         s.triggered_at_qty, s.reorder_point, s.reorder_qty, s.status
  FROM latest s LEFT JOIN totals i ON s.item_id = i.item_id {cond}
  ORDER BY s.created_ts DESC, s.signal_id LIMIT 50"""


def _rate() -> str:
    return f"""(SELECT item_id, round(avg(consumed_qty), 6) AS avg_daily_consumption,
        max(consumed_qty) AS max_daily_consumption, count(DISTINCT event_date) AS active_days
   FROM (SELECT item_id, event_date, CAST(sum(qty) AS BIGINT) AS consumed_qty FROM silver
         WHERE event_type = 'CONSUME' AND event_date >= (SELECT d FROM asof_t) - 7
         GROUP BY item_id, event_date) GROUP BY item_id)"""


def _risk() -> str:
    return f"""(SELECT i.item_id, i.on_hand_qty, r.avg_daily_consumption,
        round(CASE WHEN r.avg_daily_consumption = 0 THEN NULL
                   ELSE i.on_hand_qty / r.avg_daily_consumption END, 6) AS days_of_cover
   FROM inventory i JOIN {_rate()} r ON i.item_id = r.item_id
   ORDER BY days_of_cover ASC NULLS LAST, i.item_id LIMIT 10)"""


def _cut() -> str:
    return ("(SELECT epoch_ms((min(epoch_ms(event_ts)) + max(epoch_ms(event_ts))) // 2) FROM silver)")


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    w = with_
    # A
    q["bronze_scan_events"] = w("bronze") + f"SELECT {SCAN_COLS} FROM bronze"
    q["bronze_replenishment_signals"] = w("signals") + f"SELECT {SIG_COLS} FROM signals"
    q["materialize"] = w("inventory") + "SELECT * FROM inventory"
    q["append_scans"] = w("ingest") + """SELECT scan_id AS event_id, event_ts, kind AS event_type, station_id,
        barcode_raw, p_item AS item_id, p_qty AS qty, user_email FROM ingest WHERE reason IS NULL"""
    q["append_signals"] = q["bronze_replenishment_signals"]
    q["load_slip_files"] = """
        WITH f AS (
          SELECT o_custkey AS c, string_agg(line, chr(10) ORDER BY line) AS t
          FROM (SELECT o_custkey, o_orderkey || ' ' || strftime(o_orderdate, '%Y-%m-%d') AS line FROM orders) GROUP BY 1),
        k AS (
          SELECT 'slip-' || c || ['.jpg', '.JPEG', '.png', '.webp', '.gif', '.PDF', '.tif', '.txt', ''][c % 9 + 1] AS file, strlen(t) AS length, t,
                 ['image/jpeg', 'image/jpeg', 'image/png', 'image/webp', 'image/gif', 'application/pdf', 'image/jpeg'][c % 9 + 1] AS m FROM f)
        SELECT file, length, CASE WHEN length <= 250 THEN m END AS media_type,
               CASE WHEN m IS NOT NULL AND length <= 250 THEN sha256(t) END AS sha256,
               CASE WHEN m IS NULL THEN 'not_an_image_or_pdf' WHEN length > 250 THEN 'too_large' END AS reason FROM k"""
    q["inventory_current"] = w("totals") + "SELECT * FROM totals"
    q["signals_current"] = w("latest") + f"SELECT {SIG_COLS} FROM latest"
    q["migrate_signals_v1_to_v2"] = w("signals") + f"""SELECT row_number() OVER (PARTITION BY signal_id
        ORDER BY created_ts, {STATUS_OK}) AS id, signal_id, created_ts, item_id, triggered_at_qty, reorder_point,
        reorder_qty, trigger_event_id, status FROM signals"""
    # B
    q["silver_scan_events"] = w("silver") + "SELECT * FROM silver"
    q["silver_replenishment_signals"] = w("silver_signals") + "SELECT * FROM silver_signals"
    q["expect_or_drop"] = w("silver") + f"SELECT {SCAN_COLS} FROM silver"
    q["expectation_metrics"] = w("bronze") + """
        SELECT 'valid_event_type' AS expectation_name,
               count(*) FILTER (WHERE coalesce(event_type IN ('INTAKE', 'CONSUME'), false)) AS passed_records,
               count(*) FILTER (WHERE NOT coalesce(event_type IN ('INTAKE', 'CONSUME'), false)) AS failed_records
        FROM bronze
        UNION ALL SELECT 'valid_qty', count(*) FILTER (WHERE coalesce(qty > 0, false)),
               count(*) FILTER (WHERE NOT coalesce(qty > 0, false)) FROM bronze
        UNION ALL SELECT 'valid_item_id',
               count(*) FILTER (WHERE coalesce(item_id IS NOT NULL AND length(item_id) > 0, false)),
               count(*) FILTER (WHERE NOT coalesce(item_id IS NOT NULL AND length(item_id) > 0, false)) FROM bronze"""
    q["expectation_log"] = w("bronze") + f"""SELECT (SELECT max(event_ts) FROM bronze) AS timestamp, m.*
        FROM ({q["expectation_metrics"].removeprefix(w("bronze"))}) m"""
    q["quarantine"] = w("bronze") + f"""SELECT * FROM (
        SELECT {SCAN_COLS}, concat_ws(',',
          CASE WHEN NOT coalesce(event_type IN ('INTAKE', 'CONSUME'), false) THEN 'valid_event_type' END,
          CASE WHEN NOT coalesce(qty > 0, false) THEN 'valid_qty' END,
          CASE WHEN NOT coalesce(item_id IS NOT NULL AND length(item_id) > 0, false) THEN 'valid_item_id' END)
          AS failed_rules FROM bronze) WHERE failed_rules <> ''"""
    q["with_below_reorder_point"] = w("totals") + f"SELECT *, on_hand_qty <= {RP} AS below_reorder_point FROM totals"
    q["with_stock_status"] = w("inventory") + \
        f"SELECT item_id, on_hand_qty, {_stock_status('on_hand_qty')} AS stock_status FROM inventory"
    q["inventory_item"] = w("totals") + "SELECT * FROM totals WHERE item_id = 'PART-1'"
    q["inventory_item_unknown"] = w("totals") + "SELECT * FROM totals WHERE item_id = 'PART-NONE'"
    for key, item in (("on_hand_qty", "PART-1"), ("on_hand_qty_unknown", "PART-NONE")):
        q[key] = w("bronze") + f"""SELECT '{item}' AS item_id, CAST(coalesce(sum(CASE WHEN event_type = 'INTAKE'
            THEN qty WHEN event_type = 'CONSUME' THEN -qty ELSE 0 END), 0) AS BIGINT) AS on_hand_qty
            FROM bronze WHERE item_id = '{item}'"""
    q["signals_by_status"] = w("latest") + f"SELECT {SIG_COLS} FROM latest WHERE status = 'OPEN'"
    q["items_at_or_below"] = w("inventory") + f"SELECT * FROM inventory WHERE on_hand_qty <= {RP}"
    q["out_of_stock_items"] = w("inventory") + "SELECT * FROM inventory WHERE on_hand_qty <= 0"
    q["stale_items"] = w("inventory", "asof") + \
        "SELECT * FROM inventory WHERE last_activity < (SELECT t FROM asof_t) - INTERVAL 3 DAY"
    q["urgent_open_signals"] = w("gold_open") + "SELECT * FROM gold_open WHERE current_on_hand <= 0"
    q["closeable_signals"] = w("gold_open") + "SELECT * FROM gold_open WHERE already_restocked"
    q["depleting_items"] = w("inventory") + "SELECT * FROM inventory WHERE total_consumed > total_intake"
    q["balanced_items"] = w("inventory") + "SELECT * FROM inventory WHERE total_consumed = total_intake"
    q["valid_slip_lines"] = w("slip_src") + """SELECT * FROM slip_lines
        WHERE length(trim(coalesce(item_id, ''), chr(9) || chr(10) || chr(13) || ' ' || chr(160))) > 0 AND coalesce(qty, 0) > 0"""
    q["with_actor_name"] = w("bronze") + """SELECT event_id, user_email,
        CASE WHEN coalesce(length(user_email), 0) > 0 THEN split_part(user_email, '@', 1) ELSE 'Unknown' END
        AS actor_name FROM bronze"""
    # C
    q["gold_open_replenishment_signals"] = w("gold_open") + "SELECT * FROM gold_open"
    q["signals_with_live_stock"] = w("latest", "totals") + _live_page(None)
    q["signals_with_live_stock_open"] = w("latest", "totals") + _live_page("OPEN")
    q["signals_dashboard_overlay"] = w("latest", "totals") + f"""
        SELECT s.signal_id, s.item_id, s.status, s.current_qty, coalesce(p.on_hand_qty, s.current_qty) AS display_qty
        FROM ({_live_page(None)}) s
        LEFT JOIN (SELECT * FROM totals ORDER BY item_id LIMIT 100) p ON s.item_id = p.item_id"""
    q["recent_activity"] = w("totals") + """
        SELECT e.event_id, e.event_ts, e.event_type, e.station_id, e.item_id, e.qty,
               coalesce(t.on_hand_qty, CAST(0 AS BIGINT)) AS on_hand_qty
        FROM (SELECT * FROM bronze ORDER BY event_ts DESC, event_id LIMIT 20) e
        LEFT JOIN totals t ON e.item_id = t.item_id"""
    q["orphan_signals"] = w("signals") + f"""SELECT {SIG_COLS} FROM signals s
        WHERE trigger_event_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bronze b WHERE b.event_id = s.trigger_event_id)"""
    q["signals_with_trigger_event"] = w("signals") + """
        SELECT s.*, b.event_type AS trigger_type, b.station_id AS trigger_station, b.event_ts AS trigger_ts
        FROM signals s JOIN bronze b ON b.event_id = s.trigger_event_id"""
    q["new_signals"] = w("inventory", "latest") + f"""
        SELECT CAST(NULL AS BIGINT) AS id, md5(c.item_id || '|' || c.trigger_event_id) AS signal_id, c.created_ts,
               c.item_id, CAST(c.triggered_at_qty AS BIGINT) AS triggered_at_qty, {RP} AS reorder_point,
               {RQ} AS reorder_qty, c.trigger_event_id, 'OPEN' AS status
        FROM (SELECT i.item_id, i.on_hand_qty AS triggered_at_qty, e.event_ts AS created_ts, e.event_id AS trigger_event_id
              FROM inventory i JOIN (
                SELECT * EXCLUDE (rn) FROM (SELECT item_id, event_id, event_ts, row_number() OVER (
                    PARTITION BY item_id ORDER BY event_ts DESC, event_id DESC) AS rn
                  FROM silver WHERE event_type = 'CONSUME') WHERE rn = 1) e ON e.item_id = i.item_id
              WHERE i.on_hand_qty <= {RP}) c
        WHERE c.item_id NOT IN (SELECT item_id FROM latest WHERE status = 'OPEN')"""
    q["acknowledge_signals"] = w("latest", "asof") + """
        SELECT CAST(NULL AS BIGINT) AS id, signal_id, (SELECT t FROM asof_t) AS created_ts, item_id, triggered_at_qty,
               reorder_point, reorder_qty, trigger_event_id, 'ACKNOWLEDGED' AS status
        FROM latest WHERE status = 'OPEN'"""
    half = _lifecycle("half", "silver_first", None)
    q["fulfill_signals"] = w("running").rstrip("\n") + f""",
        silver_first AS (SELECT * FROM silver WHERE event_ts < {_cut()}),{half},
        {_latest("half_latest", "half").strip()}
        SELECT CAST(NULL AS BIGINT) AS id, s.signal_id, f.event_ts AS created_ts, s.item_id, s.triggered_at_qty,
               s.reorder_point, s.reorder_qty, f.event_id AS trigger_event_id, 'FULFILLED' AS status
        FROM half_latest s JOIN (
          SELECT * EXCLUDE (rn) FROM (SELECT item_id, event_id, event_ts, row_number() OVER (
              PARTITION BY item_id ORDER BY event_ts, event_id) AS rn
            FROM running WHERE event_ts >= {_cut()} AND event_type = 'INTAKE' AND on_hand_qty > {RP}) WHERE rn = 1) f
          ON f.item_id = s.item_id
        WHERE s.status = 'OPEN'"""
    q["pct_items_with_open_signal"] = w("inventory", "latest") + """
        SELECT count(*) AS total_items, count(*) FILTER (WHERE o.item_id IS NOT NULL) AS items_with_open_signal,
               round(CASE WHEN count(*) = 0 THEN NULL
                     ELSE count(*) FILTER (WHERE o.item_id IS NOT NULL) * 100.0 / count(*) END, 4)
                 AS pct_items_with_open_signal
        FROM inventory i LEFT JOIN (SELECT DISTINCT item_id FROM latest WHERE status = 'OPEN') o
          ON i.item_id = o.item_id"""
    q["inventory_as_of"] = w("silver") + """
        SELECT p.item_id, p.probe_ts, CAST(coalesce(sum(CASE WHEN s.event_type = 'INTAKE' THEN s.qty
                 ELSE -s.qty END), 0) AS BIGINT) AS on_hand_qty
        FROM (SELECT DISTINCT item_id, CAST(event_date AS TIMESTAMP) + INTERVAL 15 HOUR AS probe_ts FROM silver) p
        LEFT JOIN silver s ON s.item_id = p.item_id AND s.event_ts <= p.probe_ts
        GROUP BY p.item_id, p.probe_ts"""
    q["signal_snapshot_audit"] = w("signals", "running") + """
        SELECT s.signal_id, s.item_id, s.trigger_event_id, s.triggered_at_qty, r.on_hand_qty AS replayed_qty
        FROM signals s LEFT JOIN running r ON r.event_id = s.trigger_event_id
        WHERE s.status = 'OPEN' AND r.on_hand_qty IS DISTINCT FROM s.triggered_at_qty"""
    # D
    q["gold_inventory_summary"] = w("inventory") + "SELECT * FROM inventory"
    q["inventory_snapshot_plus_tail"] = q["gold_inventory_summary"]
    q["all_inventory"] = w("totals") + "SELECT * FROM totals ORDER BY item_id LIMIT 100"
    q["gold_daily_activity"] = w("daily") + "SELECT * FROM daily"
    q["gold_replenishment_metrics"] = w("latest_silver") + """
        SELECT status, count(*) AS signal_count, count(DISTINCT item_id) AS unique_items,
               round(avg(qty_below_reorder), 6) AS avg_qty_below_reorder
        FROM latest_silver GROUP BY status"""
    lt = """(SELECT signal_id, item_id,
               min(CASE WHEN status = 'OPEN' THEN created_ts END) AS opened_at,
               min(CASE WHEN status = 'ACKNOWLEDGED' THEN created_ts END) AS acknowledged_at,
               min(CASE WHEN status = 'FULFILLED' THEN created_ts END) AS fulfilled_at
             FROM silver_signals GROUP BY signal_id, item_id)"""
    q["replenishment_sla"] = w("silver_signals") + f"""
        SELECT signal_id, item_id, opened_at, acknowledged_at, fulfilled_at,
               {_secs('fulfilled_at', 'opened_at')} AS seconds_to_fulfill,
               {_secs('acknowledged_at', 'opened_at')} AS seconds_to_acknowledge
        FROM {lt} WHERE fulfilled_at IS NOT NULL"""
    q["consumption_rate"] = w("silver", "asof") + f"SELECT * FROM {_rate()}"
    q["peak_hours"] = w("silver") + """
        SELECT event_hour, count(*) FILTER (WHERE event_type = 'INTAKE') AS intake_events,
               count(*) FILTER (WHERE event_type = 'CONSUME') AS consume_events, count(*) AS total_events
        FROM silver GROUP BY event_hour"""
    q["frequent_low_items"] = w("silver_signals") + """
        SELECT item_id, count(DISTINCT signal_id) AS signal_count, round(avg(qty_below_reorder), 6) AS avg_qty_below,
               min(triggered_at_qty) AS min_triggered_qty
        FROM silver_signals WHERE status = 'OPEN' GROUP BY item_id HAVING count(DISTINCT signal_id) > 1"""
    q["open_signal_alert"] = w("latest") + """
        SELECT open_count, open_count > 0 AS triggered,
               'Replenishment Alert: ' || CAST(open_count AS VARCHAR) || ' open signals' AS summary
        FROM (SELECT count(*) FILTER (WHERE status = 'OPEN') AS open_count FROM latest)"""
    q["table_status"] = w("latest") + """
        SELECT (SELECT count(*) FROM bronze) AS total_events, (SELECT count(*) FROM signals) AS signal_rows,
               (SELECT count(DISTINCT signal_id) FROM signals) AS distinct_signals,
               (SELECT count(*) FILTER (WHERE status = 'OPEN') FROM latest) AS open_signals"""
    q["dashboard_kpis"] = w("totals", "latest") + f"""
        SELECT count(*) AS total_items,
               count(*) FILTER (WHERE {_stock_status('on_hand_qty')} = 'critical') AS critical_items,
               count(*) FILTER (WHERE {_stock_status('on_hand_qty')} = 'low') AS low_items,
               (SELECT count(*) FILTER (WHERE status = 'OPEN') FROM latest) AS open_signals
        FROM totals"""
    q["slip_totals"] = w("slip_src") + \
        "SELECT slip_id, count(*) AS lines, CAST(sum(qty) AS BIGINT) AS units FROM slip_lines GROUP BY slip_id"
    q["bulk_totals"] = w("bulk_ok") + """SELECT CAST(split_part(event_id, '-', 1) AS BIGINT) AS slip_id,
        count(*) AS lines, CAST(sum(qty) AS BIGINT) AS units FROM bulk_ok GROUP BY 1"""
    q["usage_rate"] = w("asof") + """
        SELECT item_id, CAST(sum(qty) AS BIGINT) AS consumed_qty, count(*) AS consume_events FROM silver
        WHERE event_type = 'CONSUME' AND event_ts > (SELECT t FROM asof_t) - INTERVAL 1440 MINUTE
          AND event_ts <= (SELECT t FROM asof_t)
        GROUP BY item_id"""
    q["time_since_last_scan"] = w("asof") + f"""
        SELECT item_id, max(event_ts) AS last_scan_ts,
               {_secs('(SELECT t FROM asof_t)', 'max(event_ts)')} AS seconds_since_last_scan
        FROM silver GROUP BY item_id"""
    q["total_units"] = w("inventory") + \
        "SELECT CAST(sum(on_hand_qty) AS BIGINT) AS total_units, count(*) AS items FROM inventory"
    q["mean_time_to_acknowledge"] = w("silver_signals") + f"""
        SELECT count(*) AS acknowledged_signals,
               round(avg({_secs('acknowledged_at', 'opened_at')}), 3) AS avg_seconds_to_acknowledge
        FROM {lt} WHERE acknowledged_at IS NOT NULL"""
    q["stations_activity"] = w("silver") + \
        "SELECT station_id, count(*) AS event_count, CAST(sum(qty) AS BIGINT) AS total_qty FROM silver GROUP BY 1"
    q["intake_vs_consume"] = w("asof") + """
        SELECT event_date,
               CAST(sum(CASE WHEN event_type = 'INTAKE' THEN qty ELSE 0 END) AS BIGINT) AS intake_qty,
               CAST(sum(CASE WHEN event_type = 'CONSUME' THEN qty ELSE 0 END) AS BIGINT) AS consume_qty,
               CAST(sum(CASE WHEN event_type = 'INTAKE' THEN qty ELSE 0 END)
                    - sum(CASE WHEN event_type = 'CONSUME' THEN qty ELSE 0 END) AS BIGINT) AS net_qty
        FROM silver WHERE event_date >= (SELECT d FROM asof_t) - 7 GROUP BY event_date"""
    q["unique_items_on"] = w("asof") + """
        SELECT (SELECT d FROM asof_t) - 1 AS day, count(DISTINCT item_id) AS unique_items, count(*) AS events
        FROM silver WHERE event_date = (SELECT d FROM asof_t) - 1"""
    q["turnover_top_items"] = w("running", "inventory") + """
        SELECT i.item_id, i.total_consumed, round(c.avg_close, 6) AS avg_closing_stock,
               round(CASE WHEN c.avg_close = 0 THEN NULL ELSE i.total_consumed / c.avg_close END, 6) AS turnover
        FROM inventory i JOIN (
          SELECT item_id, avg(closing) AS avg_close FROM (
            SELECT item_id, CAST(event_ts AS DATE) AS d, arg_max(on_hand_qty, (event_ts, event_id)) AS closing
            FROM running GROUP BY item_id, CAST(event_ts AS DATE)) GROUP BY item_id) c ON c.item_id = i.item_id
        ORDER BY turnover DESC NULLS LAST, i.item_id LIMIT 10"""
    q["signal_frequency"] = w("silver_signals") + \
        "SELECT item_id, count(DISTINCT signal_id) AS signal_count FROM silver_signals GROUP BY item_id"
    q["daily_summary"] = w("asof", "latest") + """
        SELECT (SELECT d FROM asof_t) AS day, count(*) AS events,
               count(*) FILTER (WHERE event_type = 'INTAKE') AS intake_events,
               count(*) FILTER (WHERE event_type = 'CONSUME') AS consume_events,
               CAST(coalesce(sum(CASE WHEN event_type = 'INTAKE' THEN qty END), 0) AS BIGINT) AS units_in,
               CAST(coalesce(sum(CASE WHEN event_type = 'CONSUME' THEN qty END), 0) AS BIGINT) AS units_out,
               count(DISTINCT item_id) AS items_touched,
               (SELECT count(*) FILTER (WHERE status = 'OPEN') FROM signals
                 WHERE CAST(created_ts AS DATE) = (SELECT d FROM asof_t)) AS signals_opened,
               (SELECT count(*) FILTER (WHERE status = 'ACKNOWLEDGED') FROM signals
                 WHERE CAST(created_ts AS DATE) = (SELECT d FROM asof_t)) AS signals_acknowledged,
               (SELECT count(*) FILTER (WHERE status = 'FULFILLED') FROM signals
                 WHERE CAST(created_ts AS DATE) = (SELECT d FROM asof_t)) AS signals_fulfilled,
               (SELECT count(*) FILTER (WHERE status = 'OPEN') FROM latest) AS open_signals
        FROM silver WHERE event_date = (SELECT d FROM asof_t)"""
    q["demand_balance"] = w("silver_signals") + """
        SELECT coalesce(u.week_start, s.week_start) AS week_start,
               coalesce(u.intake_qty, 0) AS intake_qty, coalesce(u.consume_qty, 0) AS consume_qty,
               coalesce(u.intake_qty, 0) - coalesce(u.consume_qty, 0) AS net_qty,
               coalesce(s.signals_opened, 0) AS signals_opened, coalesce(s.signals_fulfilled, 0) AS signals_fulfilled,
               coalesce(s.signals_opened, 0) - coalesce(s.signals_fulfilled, 0) AS backlog_change
        FROM (SELECT CAST(date_trunc('week', event_ts) AS DATE) AS week_start,
                     CAST(sum(CASE WHEN event_type = 'INTAKE' THEN qty ELSE 0 END) AS BIGINT) AS intake_qty,
                     CAST(sum(CASE WHEN event_type = 'CONSUME' THEN qty ELSE 0 END) AS BIGINT) AS consume_qty
              FROM silver GROUP BY 1) u
        FULL OUTER JOIN (SELECT CAST(date_trunc('week', created_ts) AS DATE) AS week_start,
                     count(*) FILTER (WHERE status = 'OPEN') AS signals_opened,
                     count(*) FILTER (WHERE status = 'FULFILLED') AS signals_fulfilled
              FROM silver_signals GROUP BY 1) s ON u.week_start = s.week_start"""
    # E
    q["latest_by"] = q["signals_current"]
    q["running_on_hand"] = w("running") + \
        "SELECT event_id, item_id, event_ts, event_type, qty, on_hand_qty FROM running"
    q["running_on_hand_lineitem"] = w("silver_l") + """
        SELECT event_id, item_id, event_ts, CAST(SUM(CASE WHEN event_type = 'INTAKE' THEN qty ELSE -qty END)
               OVER (PARTITION BY item_id ORDER BY event_ts, event_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS on_hand_qty
        FROM bronze_l"""
    q["signal_lifecycle"] = q["bronze_replenishment_signals"]
    q["signal_lifecycle_two_halves"] = q["signal_lifecycle"]
    q["signal_lifecycle_no_acks"] = w("signals_noack") + f"SELECT {SIG_COLS} FROM signals_noack"
    q["signal_lifecycle_lineitem"] = w("signals_l") + f"SELECT {SIG_COLS} FROM signals_l"
    q["signal_lifecycle_hot_item"] = w("signals_hot") + f"SELECT {SIG_COLS} FROM signals_hot"
    q["debounce_hot_48h"] = w("debhot") + """SELECT r.event_id, r.event_ts, r.barcode_raw
        FROM rescans_hot r JOIN debhot d ON d.rid = r.event_id WHERE d.kept"""
    q["debounce"] = w("deb3") + \
        "SELECT r.event_id, r.event_ts, r.barcode_raw FROM rescans r JOIN deb3 d ON d.rid = r.event_id WHERE d.kept"
    q["debounce_two_halves"] = q["debounce"]
    q["debounce_48h"] = w("deb48") + \
        "SELECT r.event_id, r.event_ts, r.barcode_raw FROM rescans r JOIN deb48 d ON d.rid = r.event_id WHERE d.kept"
    q["debounce_adjacent"] = w("debadj") + """SELECT r.event_id, r.event_ts, r.station_id, r.barcode_raw
        FROM rescans r JOIN debadj d ON d.rid = r.event_id WHERE d.kept"""
    q["week_over_week"] = w("silver") + """
        SELECT week_start, event_type, event_count, total_qty,
               lag(event_count) OVER w AS prev_event_count, lag(total_qty) OVER w AS prev_total_qty,
               event_count - lag(event_count) OVER w AS event_count_change
        FROM (SELECT CAST(date_trunc('week', event_ts) AS DATE) AS week_start, event_type, count(*) AS event_count,
                     CAST(sum(qty) AS BIGINT) AS total_qty FROM silver GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY event_type ORDER BY week_start)"""
    q["receiving_forecast"] = w("daily") + """
        SELECT event_date, intake_qty, event_date + 1 AS forecast_date,
               round(avg(intake_qty) OVER (ORDER BY event_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 3)
                 AS forecast_qty
        FROM (SELECT CAST(g AS DATE) AS event_date, coalesce(d.total_qty, CAST(0 AS BIGINT)) AS intake_qty
              FROM (SELECT unnest(generate_series(min(event_date), max(event_date), INTERVAL 1 DAY)) AS g
                    FROM daily WHERE event_type = 'INTAKE') s
              LEFT JOIN daily d ON d.event_date = CAST(s.g AS DATE) AND d.event_type = 'INTAKE')"""
    q["daily_trend"] = w("daily", "asof") + """
        SELECT CAST(g AS DATE) AS event_date, 'CONSUME' AS event_type,
               coalesce(d.event_count, CAST(0 AS BIGINT)) AS event_count,
               coalesce(d.total_qty, CAST(0 AS BIGINT)) AS total_qty
        FROM (SELECT unnest(generate_series((SELECT d FROM asof_t) - 29, (SELECT d FROM asof_t), INTERVAL 1 DAY)) AS g) s
        LEFT JOIN daily d ON d.event_date = CAST(s.g AS DATE) AND d.event_type = 'CONSUME'"""
    # F
    q["recent_events"] = w("bronze") + f"SELECT {SCAN_COLS} FROM bronze ORDER BY event_ts DESC, event_id LIMIT 20"
    q["lowest_stock"] = w("inventory") + \
        "SELECT item_id, on_hand_qty, total_intake, total_consumed, last_activity FROM inventory"
    q["top_stock"] = w("inventory") + \
        "SELECT item_id, on_hand_qty FROM inventory ORDER BY on_hand_qty DESC, item_id LIMIT 10"
    q["high_velocity_items"] = w("inventory") + """SELECT item_id, total_consumed, on_hand_qty FROM inventory
        ORDER BY total_consumed DESC, item_id LIMIT 10"""
    q["busiest_days"] = w("daily") + """SELECT event_date, event_type, event_count, total_qty FROM daily
        WHERE event_type = 'INTAKE' ORDER BY event_count DESC, event_date, event_type LIMIT 10"""
    q["busiest_days_this_month"] = w("daily", "asof") + """SELECT event_date, event_type, event_count, total_qty
        FROM daily WHERE event_type = 'INTAKE'
          AND strftime(event_date, '%Y-%m') = strftime((SELECT t FROM asof_t), '%Y-%m')
        ORDER BY event_count DESC, event_date, event_type LIMIT 1"""
    q["oldest_open_signals"] = w("gold_open") + """
        SELECT signal_id, item_id, created_ts, qty_at_signal, current_on_hand, reorder_point - qty_at_signal AS severity
        FROM gold_open ORDER BY created_ts, signal_id LIMIT 10"""
    q["stockout_risk"] = w("inventory", "asof") + f"SELECT * FROM {_risk()}"
    q["top_issues"] = w("inventory", "asof", "gold_open") + f"""
        SELECT * FROM (
          SELECT 1 AS priority, 'out_of_stock' AS issue, item_id AS ref_id, CAST(-on_hand_qty AS DOUBLE) AS score
          FROM inventory WHERE on_hand_qty <= 0
          UNION ALL
          SELECT 2, 'old_open_signal', signal_id, {_secs('(SELECT t FROM asof_t)', 'created_ts')} FROM gold_open
          UNION ALL
          SELECT 3, 'fast_and_low', item_id, -days_of_cover FROM {_risk()} r WHERE days_of_cover IS NOT NULL)
        ORDER BY priority, score DESC, ref_id LIMIT 5"""
    # G
    q["data_freshness"] = w("signals") + f"""
        SELECT table_name, latest_event, {_secs('(SELECT max(event_ts) FROM bronze)', 'latest_event')} AS staleness_seconds
        FROM (SELECT 'scan_events' AS table_name, max(event_ts) AS latest_event FROM bronze
              UNION ALL SELECT 'replenishment_signals', max(created_ts) FROM signals)"""
    # H
    q["parse_barcodes"] = w("raw_scans") + f"""
        SELECT scan_id, barcode_raw, {_pi} AS parsed_item_id, {_pq} AS parsed_qty, {_pe} AS parse_error
        FROM raw_scans"""
    q["parse_slip_responses"] = w("slip_src") + """
        SELECT slip_id, CAST(CASE WHEN readable AND lines_ok AND header_ok THEN n_lines ELSE 0 END AS INTEGER) AS lines,
               CASE WHEN readable AND lines_ok AND header_ok THEN d ->> '$.po_number' END AS po_number,
               CASE WHEN readable AND lines_ok AND header_ok THEN d ->> '$.ship_date' END AS ship_date,
               CASE WHEN NOT readable THEN 'Failed to parse response: not valid JSON'
                    WHEN NOT lines_ok THEN 'Failed to parse response: invalid line item'
                    WHEN NOT header_ok THEN 'Failed to parse response: invalid header' END AS notes
        FROM slip_ok"""
    q["slip_lines"] = w("slip_src") + "SELECT * FROM slip_lines"
    q["bulk_intake"] = w("bulk_ok") + "SELECT * FROM bulk_ok"
    q["ingest_scans"] = q["append_scans"]
    for name, deb, src in (("ingest_missing_times", "debtimed", "raw_timed"), ("ingest_default_times", "debdefault", "raw_defaulted")):
        q[name] = w(deb) + f"""
        SELECT scan_id, event_ts, CASE WHEN NOT kept THEN 'duplicate' ELSE coalesce({_pe}, 'ledger') END AS outcome
        FROM {src} r JOIN {deb} d ON d.rid = r.scan_id"""
    q["ingest_missing_times"] += """
        UNION ALL SELECT scan_id, event_ts, 'no_time' FROM raw_untimed WHERE event_ts IS NULL"""
    q["make_barcode"] = w("silver") + "SELECT event_id, 'ITEM=' || item_id || ';QTY=' || CAST(qty AS VARCHAR) AS barcode FROM silver"
    q["migrate_scans_add_user_email"] = w("bronze") + "SELECT * REPLACE (CAST(NULL AS VARCHAR) AS user_email) FROM bronze"
    counted = [("bronze_scan_events", "bronze", "bronze"), ("bronze_replenishment_signals", "bronze", "signals"),
               ("silver_scan_events", "silver", "silver"), ("silver_replenishment_signals", "silver", "silver_signals"),
               ("gold_inventory_summary", "gold", "inventory"), ("gold_daily_activity", "gold", "daily"),
               ("gold_open_replenishment_signals", "gold", "gold_open"),
               ("gold_replenishment_metrics", "gold", "(SELECT DISTINCT status FROM latest_silver)")]
    q["materialize_layers"] = w("bronze", "silver_signals", "inventory", "daily", "gold_open") + " UNION ALL ".join(
        f"SELECT '{n}' AS layer, '{t}' AS quality, true AS commented, count(*) AS rows FROM {src}" for n, t, src in counted)
    q["ingest_rejects"] = w("ingest") + \
        "SELECT scan_id, event_ts, kind, station_id, barcode_raw, reason FROM ingest WHERE reason IS NOT NULL"
    # audits
    q["duplicate_event_ids"] = w("bronze_l") + \
        "SELECT event_id, count(*) AS copies FROM bronze_l GROUP BY event_id HAVING count(*) > 1"
    q["multiple_open_items"] = w("latest") + """SELECT item_id, count(*) AS open_signals FROM latest
        WHERE status = 'OPEN' GROUP BY item_id HAVING count(*) > 1"""
    q["check_violations"] = w("bronze") + """
        SELECT event_id, 'valid_event_type' AS rule FROM bronze WHERE NOT coalesce(event_type IN ('INTAKE', 'CONSUME'), false)
        UNION ALL SELECT event_id, 'valid_qty' FROM bronze WHERE NOT coalesce(qty > 0, false)
        UNION ALL SELECT event_id, 'valid_item_id' FROM bronze
          WHERE NOT coalesce(item_id IS NOT NULL AND length(item_id) > 0, false)"""
    q["illegal_transitions"] = w("signals") + f"""
        SELECT id, signal_id, created_ts, item_id, prev_status, status FROM (
          SELECT *, lag(status) OVER (PARTITION BY signal_id ORDER BY created_ts, coalesce(id, -1), {STATUS_OK})
                 AS prev_status FROM signals)
        WHERE NOT ((prev_status IS NULL AND status = 'OPEN')
                   OR (prev_status = 'OPEN' AND status IN ('ACKNOWLEDGED', 'FULFILLED'))
                   OR (prev_status = 'ACKNOWLEDGED' AND status = 'FULFILLED'))"""
    # I (streaming forms: same results as batch)
    q["stream_silver"] = q["silver_scan_events"]
    q["stream_daily_activity"] = q["gold_daily_activity"]
    q["stream_inventory"] = q["gold_inventory_summary"]
    q["stream_usage_rate"] = w("silver") + """
        SELECT ws AS window_start, ws + INTERVAL 15 MINUTE AS window_end, item_id, CAST(sum(qty) AS BIGINT) AS consumed_qty
        FROM (SELECT item_id, qty, date_trunc('minute', event_ts) - to_minutes(k) AS ws
              FROM (SELECT *, unnest(range(0, 15)) AS k FROM silver WHERE event_type = 'CONSUME'))
        GROUP BY ws, item_id"""
    q["stream_debounce"] = q["debounce"]
    q["stream_signal_lifecycle"] = q["signal_lifecycle"]
    q["stream_latest_signals"] = q["signals_current"]
    q["stream_open_alert"] = q["open_signal_alert"]
    q["stream_dedupe"] = q["bronze_scan_events"]
    q["stream_late_rows"] = """
        WITH e AS (SELECT event_id % 10 = 0 AS later, epoch_us(ts) AS t FROM events),
        wm AS (SELECT (max(t) // 1000 - 3600000) * 1000 AS m FROM e WHERE NOT later)
        SELECT count(*) + 1 AS delivered, count(*) FILTER (WHERE NOT (later AND t <= m)) AS kept,
               count(*) FILTER (WHERE later AND t <= m) AS late FROM e, wm"""
    return q
