"""SQL twins of the packet queries, for an independent engine."""

from __future__ import annotations

FILES = 4

PACKETS = """
raw AS (
  SELECT CAST(user_id % {files} AS INT) AS file_no, event_id, epoch_us(ts) AS ts_us, CAST(round(value * 100) AS BIGINT) AS packet_size, event_type,
         coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) AS tcp_payload_size
  FROM events),
pk AS (
  SELECT file_no, event_id, ts_us, packet_size, tcp_payload_size, CAST(event_type IN ('click', 'view', 'purchase') AS INT) AS is_mqtt,
         CASE event_type WHEN 'click' THEN '3' WHEN 'view' THEN '8' WHEN 'purchase' THEN '1' ELSE '' END AS mqtt_message_type,
         tcp_payload_size % 4 AS mqtt_qos_level, CAST(event_type = 'signup' AS INT) AS tcp_syn_flag, CAST(event_type = 'error' AS INT) AS tcp_fin_flag,
         row_number() OVER (PARTITION BY file_no ORDER BY ts_us, event_id) AS packet_count
  FROM raw),
gp AS (
  SELECT *, ts_us / 1e6 AS t, (ts_us - lag(ts_us) OVER o) / 1e6 AS d,
         abs(packet_size - lag(packet_size) OVER o) AS dv, abs(tcp_payload_size - lag(tcp_payload_size) OVER o) AS dp
  FROM pk WINDOW o AS (PARTITION BY file_no ORDER BY packet_count)),
g2 AS (SELECT *, abs(d - lag(d) OVER (PARTITION BY file_no ORDER BY packet_count)) AS dd FROM gp)"""


def packets(files: int = FILES) -> str:
    return "WITH " + PACKETS.format(files=files).strip()


def over(k: int) -> str:
    return f"(PARTITION BY file_no ORDER BY packet_count ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def windowed(columns: dict[str, str], digits: int | dict[str, int] = 5, windows: tuple[int, ...] = (100, 500), base: str = "g2", extra: str = "", whole: tuple[str, ...] = ()) -> str:
    """SELECT with each expression for each window; ``{w}`` and its like in an expression are the frames' lengths."""
    parts = []
    for w in windows:
        for name, e in columns.items():
            text = e
            for mark, k in (("{w}", w), ("{w-1}", w - 1), ("{w-2}", w - 2), ("{w-19}", w - 19), ("{w-20}", w - 20)):
                text = text.replace("OVER " + mark, "OVER " + over(k)).replace(mark, str(k))
            parts.append(f"CAST({text} AS BIGINT) AS {name}_{w}" if name in whole else f"round({text}, {digits if isinstance(digits, int) else digits[name]}) + 0.0::DOUBLE AS {name}_{w}")
    return f"{packets()}{extra} SELECT file_no, packet_count, {', '.join(parts)} FROM {base} QUALIFY packet_count >= {max(windows)}"


INNER = """,
inn AS (
  SELECT *, var_samp(d) OVER i20 AS rv,
    CASE WHEN avg(packet_size) OVER i20 > 0 THEN max(packet_size) OVER i20 / avg(packet_size) OVER i20 ELSE 0 END AS par,
    CASE WHEN sum(d) OVER i19 > 0 THEN avg(CASE WHEN d > 0 THEN 1 / d END) OVER i19 ELSE 0 END AS rate,
    CASE WHEN sum(d) OVER i19 > 0 THEN max(CASE WHEN d > 0 THEN 1 / d END) OVER i19 ELSE 0 END AS peak,
    CASE WHEN avg(d) OVER i19 > 0 THEN stddev_pop(d) OVER i19 / avg(d) OVER i19 ELSE 0 END AS gaps
  FROM g2 WINDOW i20 AS (PARTITION BY file_no ORDER BY packet_count ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
                 i19 AS (PARTITION BY file_no ORDER BY packet_count ROWS BETWEEN 18 PRECEDING AND CURRENT ROW))"""


def lists(windows: tuple[int, ...] = (100, 500)) -> str:
    """A table with the values of every window as lists."""
    parts = []
    for w in windows:
        for short, c, k in (("v", "packet_size", w), ("d", "d", w - 1), ("p", "tcp_payload_size", w)):
            parts.append(f"list(CAST({c} AS DOUBLE)) OVER {over(k)} AS {short}_{w}")
    return f", ls AS (SELECT file_no, packet_count, {', '.join(parts)} FROM g2 QUALIFY packet_count >= {max(windows)})"


def listed(columns: dict[str, str], digits: int = 5, windows: tuple[int, ...] = (100, 500), files: int = FILES) -> str:
    """SELECT over lists: ``v``, ``d``, ``p`` in braces are the lists of a window."""
    parts = []
    for w in windows:
        for name, e in columns.items():
            text = e.replace("{v}", f"v_{w}").replace("{d}", f"d_{w}").replace("{p}", f"p_{w}")
            parts.append(f"round({text}, {digits}) + 0.0::DOUBLE AS {name}_{w}")
    return f"{packets(files)}{lists(windows)} SELECT file_no, packet_count, {', '.join(parts)} FROM ls"


def percentile(x: str, p: float) -> str:
    return f"list_sort({x})[CAST(floor({p} * (len({x}) - 1)) AS INT) + 1]"


def entropy(x: str, bins: int) -> str:
    place = f"least(floor((q - list_min({x})) * ({bins}.0::DOUBLE / (list_max({x}) - list_min({x})))), {bins - 1})"
    return f"CASE WHEN list_max({x}) > list_min({x}) THEN list_aggregate(list_transform({x}, lambda q: {place}), 'entropy') ELSE 0 END"


#: Measures less their means, so that powers of them lose no digits.
CENTRED = """,
zz AS (
  SELECT *, packet_size - (SELECT avg(packet_size) FROM g2) AS zv, d - (SELECT avg(d) FROM g2) AS zd, tcp_payload_size - (SELECT avg(tcp_payload_size) FROM g2) AS zp
  FROM g2)"""


def shapes(kind: str, z: str, w: str) -> dict[str, str]:
    """Population skewness and excess kurtosis of ``z`` over frames ``w``, from moments about a fixed point."""
    m1, m2, m3, m4 = (f"avg({z} ** {k}) OVER {w}" for k in (1, 2, 3, 4))
    two = f"({m2} - ({m1}) ** 2)"
    three = f"({m3} - 3 * {m1} * {m2} + 2 * ({m1}) ** 3)"
    four = f"({m4} - 4 * {m1} * {m3} + 6 * ({m1}) ** 2 * {m2} - 3 * ({m1}) ** 4)"
    return {f"{kind}skewness": f"CASE WHEN {two} > 1e-9 THEN {three} / {two} ** 1.5 ELSE 0 END", f"{kind}kurtosis": f"CASE WHEN {two} > 1e-9 THEN {four} / {two} ** 2 - 3 ELSE 0 END"}


#: Feature matrix and predictions over events, as in ``catalog``.
MATRIX = """mx AS (
  SELECT CAST(user_id % 20 AS INT) AS file_no, event_id AS seq, CAST(event_type IN ('error', 'signup') AS INT) AS label,
         CAST(round(value * 100) AS DOUBLE) AS size, CAST(coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) AS DOUBLE) AS payload,
         CAST(coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) % 4 AS DOUBLE) AS qos, CAST(event_type IN ('click', 'view') AS DOUBLE) AS mqtt,
         CAST(round(value * 100) AS DOUBLE) * 2 + coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) AS combined
  FROM events)"""
PREDICTIONS = """pr AS (
  SELECT event_id AS row, y, prob, CAST(prob >= 0.5 AS INT) AS pred FROM (
    SELECT event_id, CAST(event_type IN ('error', 'signup') AS INT) AS y, ((event_id * 37) % 70 + 30 * CAST(event_type IN ('error', 'signup') AS INT)) / 100.0::DOUBLE AS prob FROM events))"""
