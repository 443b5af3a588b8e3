"""SQL equivalents of the registered queries, written from the definitions of the operators."""

from __future__ import annotations

START = 1704067200000000
STEP = 900000000
DAY = 86400000000
HOUR = 3600000000
# The position behind the last change of `events`, and the number of five-day polls until two quiet ones.
END = "(SELECT max(us) + 1 FROM cdc)"
POLLS = f"((SELECT max(us) FROM cdc) - {START}) // {5 * DAY} + 3"

CDC = """
cdc AS (
  SELECT CAST(user_id AS VARCHAR) AS event_id,
         CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END
           AS change_type,
         'events_' || (1 + event_id % 4) AS table_name,
         ts AS change_timestamp,
         epoch_us(ts) AS us,
         'o-' || event_id AS order_id,
         'u-' || (user_id % 100) AS user_id,
         value AS price,
         epoch_us(ts) + ((event_id * 7919) % 7200) * 1000000 AS arrival_us
  FROM events
)"""

ORDER_TYPE = (
    "CASE o_orderstatus WHEN 'O' THEN 'INSERT' WHEN 'P' THEN 'UPDATE' ELSE 'DELETE' END"
)


def _iso(ts: str, separator: str = "T") -> str:
    whole = f"strftime({ts}, '%Y-%m-%d{separator}%H:%M:%S')"
    return (
        f"CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN {whole} || '+00:00' "
        f"ELSE {whole} || '.' || lpad(CAST(epoch_us({ts}) % 1000000 AS VARCHAR), 6, '0') "
        "|| '+00:00' END"
    )


def _ts_text(us: str) -> str:
    return (
        f"strftime(make_timestamp({us}), '%Y-%m-%d %H:%M:%S') || '.' "
        f"|| lpad(CAST({us} % 1000000 AS VARCHAR), 6, '0')"
    )


def _stamp(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y%m%d-%H%M%S')"


def _facts(seen: str = "us", step: int = STEP) -> str:
    return f"""
polled AS (
  SELECT *, (greatest({seen}, us) - {START}) // {step} AS poll FROM cdc WHERE us >= {START}
),
facts AS (
  SELECT table_name, poll, max(us) AS max_us, count(*) AS rows FROM polled GROUP BY ALL
)"""


# Positions of polls with new rows, from the two claims before.
PROGRESS = f"""
lagged AS (
  SELECT *, lag(poll, 1) OVER w AS poll_1, lag(poll, 2) OVER w AS poll_2,
         lag(max_us, 1) OVER w AS max_1, lag(max_us, 2) OVER w AS max_2
  FROM facts WINDOW w AS (PARTITION BY table_name ORDER BY poll)
),
started AS (
  SELECT *,
         CASE WHEN max_1 IS NULL THEN {START}
              WHEN poll > poll_1 + 1 THEN max_1 + 2 ELSE max_1 + 1 END AS start_us,
         CASE WHEN max_1 IS NULL THEN {START}
              WHEN poll > poll_1 + 1 THEN max_1 + 1
              WHEN max_2 IS NULL THEN {START}
              WHEN poll_1 > poll_2 + 1 THEN max_2 + 2 ELSE max_2 + 1 END AS prev_start_us
  FROM lagged
),
progress AS (
  SELECT table_name, poll, (start_us + prev_start_us) // 2 AS scan_lo_us, start_us, prev_start_us,
         {START} + (poll + 1) * {STEP} AS target_us, rows, max_us, max_us + 1 AS next_start_us
  FROM started
)"""


def _lookback(step: int = STEP, last_poll: str | None = None) -> str:
    """Rows emitted by a range join of polls with rows, straight from the definition."""
    end = "" if last_poll is None else f"WHERE poll <= {last_poll}"
    return f"""{_facts(step=step)},{PROGRESS.replace(str(STEP), str(step))},
quiet AS (
  SELECT p.table_name, p.poll + 1 AS poll, (p.next_start_us + p.start_us) // 2 AS scan_lo_us,
         p.next_start_us AS start_us, p.max_us AS hi_us
  FROM progress p ANTI JOIN progress n ON n.table_name = p.table_name AND n.poll = p.poll + 1
),
polls AS (
  SELECT table_name, poll, scan_lo_us, start_us, max_us AS hi_us FROM progress
  UNION ALL SELECT table_name, poll, scan_lo_us, start_us, hi_us FROM quiet
),
emitted AS (
  SELECT c.*, p.poll, p.start_us AS from_us, c.us < p.start_us AS is_late
  FROM cdc c JOIN polls p
    ON c.table_name = p.table_name AND c.us >= p.scan_lo_us AND c.us <= p.hi_us
  {end}
)"""


LOOKBACK = _lookback()

CALENDAR = f"""
calendar AS (
  SELECT t.table_name, k.poll, f.max_us
  FROM (SELECT DISTINCT table_name FROM facts) t
  JOIN (SELECT unnest(range(0, (SELECT max(poll) + 1 FROM facts))) AS poll) k ON true
  LEFT JOIN facts f ON f.table_name = t.table_name AND f.poll = k.poll
),
ends AS (
  SELECT *, {START} + (poll + 1) * {STEP} AS end_us,
         coalesce(max(CASE WHEN max_us IS NOT NULL THEN {START} + (poll + 1) * {STEP} END)
                  OVER (PARTITION BY table_name ORDER BY poll), {START}) AS active_us
  FROM calendar
)"""


def _line(fields: list[str]) -> str:
    text = "'\"' || {} || '\"'"
    payload = (
        "'{\"order_id\":\"' || order_id || '\",\"user_id\":\"' || user_id || '\",\"price\":' || "
        f"CAST(price AS VARCHAR) || ',\"created_at\":\"' || {_iso('change_timestamp', ' ')} || "
        f"'\",\"updated_at\":\"' || {_iso('change_timestamp', ' ')} || '\"}}'"
    )
    values = {
        "event_id": text.format("event_id"),
        "change_type": text.format("change_type"),
        "change_timestamp": text.format(f"({_iso('change_timestamp')})"),
        "table_name": text.format("table_name"),
        "payload": payload,
        "is_late": "'false'",
        "is_duplicate": "'false'",
        "us": "CAST(us AS VARCHAR)",
    }
    return "'{' || " + " || ',' || ".join(f"'\"{f}\":' || {values[f]}" for f in fields) + " || '}'"


def _windows(seconds: int, source: str, late: str) -> str:
    size = seconds * 1000000
    return f"""
SELECT table_name, us - us % {size} AS win_start_us, us - us % {size} + {size} AS win_end_us,
       count(*) AS rows, CAST({late} AS BIGINT) AS late_rows, min(us) AS min_us, max(us) AS max_us
FROM {source} GROUP BY table_name, us - us % {size}"""


def _watermark(lag: int, initial: int) -> str:
    return f"""WITH {CDC},{_facts("arrival_us")}
SELECT table_name, poll, max_us, rows,
       greatest(max(max_us - {lag}) OVER (PARTITION BY table_name ORDER BY poll),
                {START - initial}) AS watermark_us
FROM facts"""


def _window_rows(where: str = "true") -> str:
    start = "(us - us % 60000000)"
    return f"""
SELECT table_name AS dest, {_stamp(start)} || '-to-' || {_stamp(f"({start} + 60000000)")} AS win,
       count(*) AS rows
FROM cdc WHERE {where} GROUP BY table_name, {start}"""


def _span(where: str) -> str:
    return f"""WITH {CDC}
SELECT table_name, event_id, change_type, order_id, price, us FROM cdc WHERE {where}"""


ORACLES: dict[str, str] = {
    "scan_poll_window": f"""WITH {CDC}
SELECT event_id, change_type, order_id, price, us FROM cdc
WHERE change_timestamp >= TIMESTAMP '2024-01-05 06:30:00'
  AND change_timestamp < TIMESTAMP '2024-01-27 12:00:00.5'""",
    "scan_poll_micros": f"""WITH {CDC}
SELECT order_id, us, us / 1e6 AS seconds, CAST(trunc((us / 1e6) * 1000000) AS BIGINT) AS back_us,
       {_ts_text("us")} AS ts_text
FROM cdc WHERE us >= {START + DAY} AND us < {START + 29 * DAY}""",
    "lookback_scan": f"""WITH {CDC}
SELECT event_id, order_id, us, us < {START + 4 * DAY + 1} AS is_late FROM cdc
WHERE us >= {START + 3 * DAY} AND us < {START + 28 * DAY}""",
    "change_feed_scan": f"""
SELECT {ORDER_TYPE} AS change_type, epoch_us(o_orderdate) AS us,
       o_orderkey, o_custkey, o_totalprice, o_orderpriority
FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2001-01-01'""",
    "multi_table_fanin": f"""WITH {CDC},
merged AS (
  SELECT 'events' AS table_name, event_id, change_type, order_id, price, us FROM cdc
  UNION ALL
  SELECT 'orders', CAST(o_orderkey AS VARCHAR), {ORDER_TYPE}, 'o-' || o_orderkey, o_totalprice,
         epoch_us(o_orderdate) FROM orders
  UNION ALL
  SELECT 'lineitem', l_orderkey || '-' || l_linenumber,
         CASE l_linestatus WHEN 'O' THEN 'INSERT' ELSE 'UPDATE' END, 'o-' || l_orderkey,
         l_extendedprice, epoch_us(l_shipdate) FROM lineitem
)
SELECT * FROM merged""",
    "record_defaults": f"""WITH {CDC}
SELECT 'NULL' AS event_id, {ORDER_TYPE} AS change_type, {_iso("o_orderdate")} AS change_timestamp,
       'orders' AS table_name, false AS is_late, false AS is_duplicate,
       CAST(o_orderkey AS VARCHAR) AS payload_text
FROM orders
UNION ALL
SELECT event_id, 'UNKNOWN', {_iso("change_timestamp")}, table_name, false, false, '{{}}' FROM cdc""",
    "iso_timestamps": f"""WITH {CDC},
stamps AS (
  SELECT order_id, change_timestamp AS ts FROM cdc
  UNION ALL SELECT 'orders-' || o_orderkey, o_orderdate FROM orders
)
SELECT order_id, {_iso("ts")} AS iso, {_ts_text("epoch_us(ts)")} AS ts_text,
       epoch_us(ts) AS back_us
FROM stamps""",
    "poll_progress": f"""WITH {CDC},{LOOKBACK}
SELECT table_name, from_us AS start_us, count(*) AS rows, greatest(max(us), from_us) AS reached_us
FROM emitted GROUP BY table_name, from_us""",
    "contiguous_replay": f"""WITH {CDC}
SELECT table_name, order_id, us, (us - {START}) // {STEP} AS poll,
       {START} + (us - {START}) // {STEP} * {STEP} AS poll_lo_us,
       {START} + ((us - {START}) // {STEP} + 1) * {STEP} AS poll_hi_us
FROM cdc
WHERE us >= {START} AND (arrival_us - {START}) // {STEP} <= (us - {START}) // {STEP}""",
    "contiguous_replay_on_time": f"""WITH {CDC}
SELECT table_name, order_id, us, (us - {START}) // {STEP} AS poll,
       {START} + (us - {START}) // {STEP} * {STEP} AS poll_lo_us,
       {START} + ((us - {START}) // {STEP} + 1) * {STEP} AS poll_hi_us
FROM cdc WHERE us >= {START}""",
    "lookback_replay": f"""WITH {CDC},{LOOKBACK}
SELECT table_name, event_id, order_id, us, poll, is_late FROM emitted""",
    "lookback_replay_delayed": f"""WITH RECURSIVE {CDC},{_facts("arrival_us")},
steps AS (
  SELECT n.table_name, n.poll, f.max_us, p.max_us AS last_max_us,
         row_number() OVER (PARTITION BY n.table_name ORDER BY n.poll) AS i
  FROM (SELECT table_name, poll FROM facts
        UNION SELECT table_name, poll + 1 FROM facts) n
  LEFT JOIN facts f ON f.table_name = n.table_name AND f.poll = n.poll
  LEFT JOIN facts p ON p.table_name = n.table_name AND p.poll = n.poll - 1
),
walk AS (
  SELECT table_name, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS poll,
         CAST(0 AS BIGINT) AS at_start, CAST(0 AS BIGINT) AS at_prev,
         CAST({START} AS BIGINT) AS next_start, CAST({START} AS BIGINT) AS next_prev
  FROM facts GROUP BY table_name
  UNION ALL
  SELECT s.table_name, s.i, s.poll, w.next_start, w.next_prev,
         CASE WHEN coalesce(s.max_us, 0) >= (w.next_start + w.next_prev) // 2
                OR coalesce(s.last_max_us, 0) >= (w.next_start + w.next_prev) // 2
              THEN greatest(w.next_start, coalesce(s.max_us, 0)) + 1 ELSE w.next_start END,
         CASE WHEN coalesce(s.max_us, 0) >= (w.next_start + w.next_prev) // 2
                OR coalesce(s.last_max_us, 0) >= (w.next_start + w.next_prev) // 2
              THEN w.next_start ELSE w.next_prev END
  FROM walk w JOIN steps s ON s.table_name = w.table_name AND s.i = w.i + 1
),
polls AS (
  SELECT table_name, poll, at_start AS start_us, (at_start + at_prev) // 2 AS scan_lo_us
  FROM walk WHERE i > 0
)
SELECT c.table_name, c.event_id, c.order_id, c.us, c.arrival_us, p.poll, c.us < p.start_us AS is_late
FROM polled c JOIN polls p
  ON p.table_name = c.table_name AND p.poll IN (c.poll, c.poll + 1) AND c.us >= p.scan_lo_us""",
    "progress_audit": f"""WITH {CDC},{_facts()},{PROGRESS}
SELECT *, coalesce(lag(next_start_us) OVER (PARTITION BY table_name ORDER BY poll) <= start_us, true)
          AND max_us >= start_us AND scan_lo_us <= start_us AS is_valid
FROM progress""",
    "backlog": f"""WITH {CDC},{_facts()},{PROGRESS}
SELECT table_name, poll, greatest({END} - next_start_us, 0) AS backlog_us,
       CASE WHEN {END} <= start_us THEN 1.0
            ELSE CAST(max_us - start_us AS DOUBLE) / CAST({END} - start_us AS DOUBLE) END
         AS fraction_done
FROM progress""",
    "due_tables": f"""WITH {CDC},{_facts()},{PROGRESS},
state AS (
  SELECT table_name, poll, next_start_us AS start_us,
         target_us + CASE WHEN table_name IN ('events_2', 'events_4') THEN 2 ELSE 1 END * {STEP}
           AS next_due_us,
         target_us + {STEP} AS now_us
  FROM progress
)
SELECT * FROM state WHERE next_due_us <= now_us AND start_us < now_us""",
    "range_chunks": f"""WITH RECURSIVE {CDC},
ranges AS (SELECT table_name, min(us) AS lo, max(us) + 1 AS hi FROM cdc GROUP BY table_name),
chunks AS (
  SELECT table_name, CAST(0 AS BIGINT) AS chunk, lo AS chunk_lo_us, hi,
         CASE WHEN hi - least(lo + 100000000000, hi) < 25000000000 THEN hi
              ELSE least(lo + 100000000000, hi) END AS chunk_hi_us
  FROM ranges
  UNION ALL
  SELECT table_name, chunk + 1, chunk_hi_us, hi,
         CASE WHEN hi - least(chunk_hi_us + 100000000000, hi) < 25000000000 THEN hi
              ELSE least(chunk_hi_us + 100000000000, hi) END
  FROM chunks WHERE chunk_hi_us < hi
)
SELECT k.table_name, k.chunk, k.chunk_lo_us, k.chunk_hi_us, count(c.us) AS rows
FROM chunks k LEFT JOIN cdc c
  ON c.table_name = k.table_name AND c.us >= k.chunk_lo_us AND c.us < k.chunk_hi_us
GROUP BY ALL""",
    "dup_flag": f"""WITH {CDC}
SELECT table_name, event_id, order_id, us, table_name || ':' || event_id AS entity_key,
       row_number() OVER (PARTITION BY table_name, event_id ORDER BY us, order_id) > 1
         AS is_duplicate
FROM cdc""",
    "dup_flag_change_key": f"""WITH {CDC},{LOOKBACK}
SELECT table_name, event_id, change_type, order_id, us, poll, is_late,
       row_number() OVER (PARTITION BY table_name, event_id, change_type, us
                          ORDER BY poll, order_id) > 1 AS is_duplicate
FROM emitted""",
    "dup_flag_copies": f"""WITH {CDC}
SELECT table_name, event_id, us - us % {DAY} AS us,
       row_number() OVER (PARTITION BY table_name, event_id ORDER BY us - us % {DAY}) > 1
         AS is_duplicate
FROM cdc""",
    "dedup_distinct": f"""WITH {CDC},{LOOKBACK},
keyed AS (
  SELECT change_type || '-' || coalesce(nullif(order_id, ''), event_id) || '-'
           || {_iso("change_timestamp")} AS change_key, order_id, poll, is_late
  FROM emitted
)
SELECT change_key, order_id, poll, is_late FROM keyed
QUALIFY row_number() OVER (PARTITION BY change_key ORDER BY poll) = 1""",
    "tumbling_60s": f"WITH {CDC}{_windows(60, 'cdc', '0')}",
    "tumbling_1h": f"WITH {CDC},{LOOKBACK}"
    + _windows(3600, "emitted", "count(*) FILTER (WHERE is_late)"),
    "watermark_single": _watermark(0, 300000000),
    "watermark_lag30": _watermark(30000000, 0),
    "idle_watermark": f"""WITH {CDC},{_facts("arrival_us")},{CALENDAR}
SELECT table_name, poll,
       greatest(max(coalesce(max_us, end_us)) OVER w, {START - 300000000}) AS at_once_us,
       greatest(max(max_us) OVER w, {START - 300000000}) AS never_us,
       greatest(max(CASE WHEN max_us IS NULL AND end_us - active_us >= {HOUR} THEN end_us
                         ELSE max_us END) OVER w, {START - 300000000}) AS one_hour_us
FROM ends WINDOW w AS (PARTITION BY table_name ORDER BY poll)""",
    "min_watermark": f"""WITH {CDC},{_facts("arrival_us")},{CALENDAR},
marks AS (
  SELECT table_name, poll,
         greatest(max(max_us - 30000000) OVER (PARTITION BY table_name ORDER BY poll), {START})
           AS watermark_us
  FROM calendar
)
SELECT poll, min(watermark_us) AS watermark_us, count(*) AS tables FROM marks GROUP BY poll""",
    "late_drop": f"""WITH {CDC},{_facts("arrival_us")},
marks AS (
  SELECT table_name, poll,
         greatest(max(max_us - 30000000) OVER (PARTITION BY table_name ORDER BY poll
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {START}) AS watermark_us
  FROM facts
)
SELECT p.table_name, p.us - p.us % {HOUR} AS win_start_us,
       count(*) FILTER (WHERE p.us - p.us % {HOUR} + {HOUR} > m.watermark_us) AS kept_rows,
       count(*) FILTER (WHERE p.us - p.us % {HOUR} + {HOUR} <= m.watermark_us) AS dropped_rows
FROM polled p JOIN marks m ON m.table_name = p.table_name AND m.poll = p.poll
GROUP BY p.table_name, p.us - p.us % {HOUR}""",
    "ndjson_text": f"""WITH {CDC}
SELECT order_id, {_line(["event_id", "change_type", "change_timestamp", "table_name", "payload",
                         "is_late", "is_duplicate"])} AS line
FROM cdc""",
    "single_table_output": f"""WITH {CDC}
SELECT {_line(["event_id", "change_type", "payload", "change_timestamp"])} AS line
FROM cdc WHERE us >= {START}""",
    "window_paths": f"""WITH {CDC}
SELECT table_name || '/output-' || {_stamp("(us - us % 60000000)")} || '-to-'
         || {_stamp("(us - us % 60000000 + 60000000)")} || '-00000-of-00001.json' AS path,
       count(*) AS rows
FROM cdc GROUP BY table_name, us - us % 60000000""",
    "one_file_per_window": f"WITH {CDC} SELECT *, CAST(1 AS BIGINT) AS files "
    f"FROM ({_window_rows()})",
    "compact_windows": f"WITH {CDC} SELECT *, CAST(1 AS BIGINT) AS files "
    f"FROM ({_window_rows(f'us < {START + 20 * DAY}')})",
    "append_change_rows": _span(f"us >= {START}"),
    "stream_dup_flag": f"""WITH {CDC}
SELECT table_name, event_id, order_id, us,
       row_number() OVER (PARTITION BY table_name, event_id ORDER BY us) > 1 AS is_duplicate
FROM cdc""",
    "stream_dedup": f"WITH {CDC} SELECT DISTINCT table_name, event_id FROM cdc",
    "stream_tumbling": f"""WITH {CDC}
SELECT table_name, us - us % {HOUR} AS win_start_us, us - us % {HOUR} + {HOUR} AS win_end_us,
       count(*) AS rows, min(us) AS min_us, max(us) AS max_us
FROM cdc GROUP BY table_name, us - us % {HOUR}""",
    "stream_record_files": f"WITH {CDC}{_window_rows()}",
    "live_poll": f"""WITH {CDC},{_lookback(step=5 * DAY, last_poll=POLLS + " - 1")}
SELECT table_name, event_id, order_id, us, poll, is_late FROM emitted""",
    "published_windows": f"""WITH {CDC},{_lookback(step=5 * DAY, last_poll=POLLS + " - 1")},
marks AS (SELECT table_name, max(us) - 30000000 AS mark FROM cdc GROUP BY table_name),
slowest AS (SELECT min(mark) AS mark FROM marks),
placed AS (SELECT table_name, us - us % {HOUR} AS win FROM emitted)
SELECT table_name || '/output-' || {_stamp("win")} || '-to-' || {_stamp(f"win + {HOUR}")}
         || '-00000-of-00001.json' AS path, count(*) AS rows
FROM placed, slowest WHERE win + {HOUR} <= mark GROUP BY ALL""",
    "commit_audit": f"""WITH {CDC}
SELECT t.table_name, k.poll,
       NOT (t.table_name = 'events_3' AND k.poll = 3) AS is_chained,
       NOT (t.table_name = 'events_3' AND k.poll = 2) AS is_claim_valid,
       NOT (t.table_name = 'events_2' AND k.poll = 3) AS is_count_valid,
       true AS is_mark_valid
FROM (SELECT DISTINCT table_name FROM cdc) t
JOIN (SELECT unnest(range(0, {POLLS})) AS poll) k ON true""",
    "stream_late": f"""WITH {CDC},
arrived AS (
  SELECT table_name, us, us - us % {HOUR} AS win,
         (us + (CAST(substr(order_id, 3) AS BIGINT) * 7919) % 10 * {DAY} - {START}) // {5 * DAY} AS step
  FROM cdc
),
steps AS (SELECT step, max(us) AS us, row_number() OVER (ORDER BY step) AS place FROM arrived GROUP BY step),
marks AS (
  SELECT s.step, coalesce(max(e.us) - 30000000, 0) AS mark
  FROM steps s LEFT JOIN steps e ON e.place <= s.place - 2 GROUP BY s.step
),
judged AS (SELECT a.*, win + {HOUR} <= mark AS is_late FROM arrived a JOIN marks USING (step))
SELECT table_name, win AS win_start_us, count(*) AS rows, CAST(NULL AS BIGINT) AS step
FROM judged WHERE NOT is_late GROUP BY ALL
UNION ALL
SELECT 'dropped', NULL, count(DISTINCT CASE WHEN is_late THEN (table_name, win) END), step FROM judged GROUP BY step""",
    "append_rejects": f"""WITH {CDC},
lines AS (SELECT table_name, CAST(substr(order_id, 3) AS BIGINT) AS number FROM cdc)
SELECT CASE WHEN number % 83 = 0 THEN 'events_9' ELSE table_name END AS table_name,
       CASE WHEN number % 83 = 0 THEN 'no such table' WHEN number % 97 = 0 THEN 'no change record'
            WHEN number % 89 = 0 THEN 'no timestamp' ELSE 'stored' END AS outcome,
       count(*) AS rows
FROM lines GROUP BY ALL""",
    "backfill_chunks": f"""WITH RECURSIVE {CDC},
chunks AS (
  SELECT CAST(0 AS BIGINT) AS chunk, {START} AS lo, {END} AS hi,
         CASE WHEN {END} - least({START} + 100000000000, {END}) < 25000000000 THEN {END}
              ELSE least({START} + 100000000000, {END}) END AS up
  UNION ALL
  SELECT chunk + 1, up, hi,
         CASE WHEN hi - least(up + 100000000000, hi) < 25000000000 THEN hi ELSE least(up + 100000000000, hi) END
  FROM chunks WHERE up < hi
)
SELECT c.table_name, k.chunk, count(*) AS rows
FROM chunks k JOIN cdc c ON c.us >= k.lo AND c.us < k.up GROUP BY ALL""",
    "live_poll_progress": f"""WITH {CDC},
polls AS (
  SELECT t.table_name, k.poll, {START} + k.poll * {5 * DAY} AS start_us,
         {START} + (k.poll + 1) * {5 * DAY} AS target_us
  FROM (SELECT DISTINCT table_name FROM cdc) t
  JOIN (SELECT unnest(range(0, {POLLS})) AS poll) k ON true
),
read AS (
  SELECT p.table_name, p.poll, p.start_us, p.target_us, count(c.us) AS rows, max(c.us) AS max_us
  FROM polls p LEFT JOIN cdc c
    ON c.table_name = p.table_name AND c.us >= p.start_us AND c.us < p.target_us
  GROUP BY ALL
)
SELECT poll, table_name, start_us, target_us, rows,
       greatest(max(max_us) OVER (PARTITION BY table_name ORDER BY poll), {START - 300000000})
         AS watermark_us
FROM read""",
    "stored_feed": f"""
SELECT 'events' AS table_name, upper(event_type) AS change_type, event_id AS number, epoch_us(ts) AS us,
       (epoch_us(ts) - {START}) // {5 * DAY} AS poll
FROM events WHERE epoch_us(ts) >= {START}""",
    "live_feed": f"""
SELECT 'orders' AS table_name, 'NULL' AS event_id, {ORDER_TYPE} AS change_type, o_orderkey,
       epoch_us(o_orderdate) AS us, (epoch_us(o_orderdate) - 694224000000000) // {365 * DAY} AS poll
FROM orders WHERE epoch_us(o_orderdate) >= 694224000000000""",
}
