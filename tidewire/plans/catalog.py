"""Named queries over the packet view of ``events``, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ExtractConfig
from ..functions import columns as C
from ..operators import analysis, dataset, evaluation, gate, labels, windows
from ..sources.capture import packet_view
from . import sqltext as S

#: ``events`` are minutes apart, so thresholds are minutes too.
CFG = ExtractConfig(burst=60.0, silence=600.0)
NAMES = ["size", "payload", "qos", "mqtt", "combined"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def packets(spark: SparkSession, sf_dir: str, files: int = S.FILES) -> DataFrame:
    return packet_view(events(spark, sf_dir), files)


def rounded(rows: DataFrame, digits: int = 5, keys: tuple[str, ...] = ("file_no", "packet_count")) -> DataFrame:
    """Doubles rounded; adding zero turns a negative zero into zero."""
    kinds = dict(rows.dtypes)
    return rows.select(*[(F.round(c, digits) + 0.0).alias(c) if kinds[c] == "double" and c not in keys else F.col(c) for c in rows.columns])


def features(spark: SparkSession, sf_dir: str, names: list[str], digits: int = 5) -> DataFrame:
    """The named features of both windows, by the block kernel."""
    rows = windows.extract(packets(spark, sf_dir), ("file_no",), CFG, names=names)
    return rounded(rows.select("file_no", "packet_count", *[f"{n}_{w}" for w in (100, 500) for n in names]), digits)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All window features of one capture that pass the gate."""
    rows = windows.extract(packets(spark, sf_dir, 1), ("file_no",), CFG)
    return gate.passing(rows)


# --- packets -----------------------------------------------------------------


@query(f"{S.packets()} SELECT file_no, packet_count, ts_us, packet_size, tcp_payload_size, is_mqtt, mqtt_message_type, mqtt_qos_level, tcp_syn_flag, tcp_fin_flag FROM pk")
def packet_rows(spark, sf_dir):
    return packets(spark, sf_dir).select("file_no", "packet_count", "ts_us", "packet_size", "tcp_payload_size", "is_mqtt", "mqtt_message_type", "mqtt_qos_level", "tcp_syn_flag", "tcp_fin_flag")


@query(f"{S.packets()} SELECT file_no, packet_count, round(coalesce(d, 0), 6) + 0.0 AS inter_arrival_time FROM gp")
def inter_arrival(spark, sf_dir):
    from ..sources.capture import gap_seconds

    return packets(spark, sf_dir).select("file_no", "packet_count", (F.round(F.coalesce(gap_seconds(["file_no"]), F.lit(0.0)), 6) + 0.0).alias("inter_arrival_time"))


@query(f"{S.packets()} SELECT file_no, count(*) AS packets, greatest(count(*) - 499, 0) AS rows_out FROM pk GROUP BY 1")
def window_gate(spark, sf_dir):
    p = packets(spark, sf_dir)
    full = F.count_if(F.col("packet_count") >= CFG.large)
    return p.groupBy("file_no").agg(F.count(F.lit(1)).alias("packets"), full.alias("rows_out"))


@query(f"{S.packets()} SELECT file_no, CAST(sum(is_mqtt) AS BIGINT) AS mqtt, count(*) AS n FROM pk GROUP BY 1")
def mqtt_counts(spark, sf_dir):
    return packets(spark, sf_dir).groupBy("file_no").agg(F.sum("is_mqtt").alias("mqtt"), F.count(F.lit(1)).alias("n"))


@query("""SELECT least(a, b) AS lo, greatest(a, b) AS hi, is_mqtt, count(*) AS n FROM (
  SELECT '10.0.0.' || (user_id % 16) || ':' || (1000 + event_id % 7) AS a, '10.0.0.' || (event_id % 16) || ':1883' AS b, CAST(event_type IN ('click', 'view', 'purchase') AS INT) AS is_mqtt FROM events) GROUP BY ALL""")
def flows(spark, sf_dir):
    e = events(spark, sf_dir)
    ip = lambda c: F.concat(F.lit("10.0.0."), (F.col(c) % 16).cast("string"))
    rows = e.select(ip("user_id").alias("src"), (1000 + F.col("event_id") % 7).alias("sport"), ip("event_id").alias("dst"), F.lit(1883).alias("dport"), F.col("event_type").isin("click", "view", "purchase").cast("int").alias("is_mqtt"))
    a, b = (F.concat_ws(":", x, y.cast("string")) for x, y in ((F.col("src"), F.col("sport")), (F.col("dst"), F.col("dport"))))
    rows = rows.withColumns({"flow": C.flow_id(F.col("src"), F.col("sport"), F.col("dst"), F.col("dport"), F.col("is_mqtt")), "lo": F.least(a, b), "hi": F.greatest(a, b)})
    return rows.groupBy("flow").agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.min("is_mqtt").alias("is_mqtt"), F.count(F.lit(1)).alias("n")).drop("flow")


# --- window features ---------------------------------------------------------


@query(S.windowed({
    "total_packets": "count(*) OVER {w}", "total_bytes": "sum(packet_size) OVER {w}",
    "average_packet_size": "avg(packet_size) OVER {w}", "packet_size_range": "max(packet_size) OVER {w} - min(packet_size) OVER {w}",
    "packet_size_variance": "var_pop(packet_size) OVER {w}",
}, 2, whole=("total_packets", "total_bytes")))
def flow_basic(spark, sf_dir):
    return features(spark, sf_dir, ["total_packets", "total_bytes", "average_packet_size", "packet_size_range", "packet_size_variance"], 2)


@query(S.windowed({"flow_duration": "(ts_us - first(ts_us) OVER {w}) / 1e6", "inter_arrival_time_range": "max(d) OVER {w-1} - min(d) OVER {w-1}"}, 6))
def flow_spans(spark, sf_dir):
    return features(spark, sf_dir, ["flow_duration", "inter_arrival_time_range"], 6)


@query(S.windowed({"total_bytes": "sum(packet_size) OVER {w}", "syn": "sum(tcp_syn_flag) OVER {w}", "fin": "sum(tcp_fin_flag) OVER {w}", "payload_bytes": "sum(tcp_payload_size) OVER {w}"}, windows=(500,), base="pk", whole=("total_bytes", "syn", "fin", "payload_bytes")))
def running_sums(spark, sf_dir):
    """Moving sums as differences of running sums."""
    what = {"total_bytes_500": F.col("packet_size"), "syn_500": F.col("tcp_syn_flag"), "fin_500": F.col("tcp_fin_flag"), "payload_bytes_500": F.col("tcp_payload_size")}
    rows = windows.running(packets(spark, sf_dir), what, 500, ["file_no"])
    return rows.where(F.col("packet_count") >= 500).select("file_no", "packet_count", *what)


@query(S.windowed({"packet_rate": "CASE WHEN t > first(t) OVER {w} THEN {w} / (t - first(t) OVER {w}) ELSE 0 END", "byte_rate": "CASE WHEN t > first(t) OVER {w} THEN sum(packet_size) OVER {w} / (t - first(t) OVER {w}) ELSE 0 END"}))
def flow_rates(spark, sf_dir):
    return features(spark, sf_dir, ["packet_rate", "byte_rate"])


#: Means of 99 or 499 whole microseconds never lie just between two numbers of 6 digits.
_GAP_DIGITS = {"mean_inter_arrival_time": 6, "inter_arrival_time_variance": 3, "inter_arrival_time_std_dev": 3}


@query(S.windowed({"mean_inter_arrival_time": "(ts_us - first(ts_us) OVER {w}) / 1e6 / ({w} - 1)", "inter_arrival_time_variance": "var_pop(d) OVER {w-1}", "inter_arrival_time_std_dev": "stddev_pop(d) OVER {w-1}"}, _GAP_DIGITS))
def gap_statistics(spark, sf_dir):
    rows = windows.extract(packets(spark, sf_dir), ("file_no",), CFG, names=list(_GAP_DIGITS))
    return rows.select("file_no", "packet_count", *[(F.round(f"{n}_{w}", k) + 0.0).alias(f"{n}_{w}") for w in (100, 500) for n, k in _GAP_DIGITS.items()])


@query(S.windowed({"burst_count": "sum(CASE WHEN d < 60 THEN 1 ELSE 0 END) OVER {w-1}", "silence_count": "sum(CASE WHEN d > 600 THEN 1 ELSE 0 END) OVER {w-1}"}, whole=("burst_count", "silence_count")))
def bursts(spark, sf_dir):
    return features(spark, sf_dir, ["burst_count", "silence_count"])


@query(S.listed({f"packet_size_{int(p * 100)}th_percentile": S.percentile("{v}", p) for p in (0.25, 0.5, 0.75)}))
def size_percentiles(spark, sf_dir):
    return features(spark, sf_dir, [f"packet_size_{p}th_percentile" for p in (25, 50, 75)])


@query(S.listed({f"inter_arrival_time_{int(p * 100)}th_percentile": S.percentile("{d}", p) for p in (0.25, 0.5, 0.75)}, 6))
def gap_percentiles(spark, sf_dir):
    return features(spark, sf_dir, [f"inter_arrival_time_{p}th_percentile" for p in (25, 50, 75)], 6)


@query(S.listed({"packet_size_entropy": S.entropy("{v}", 50)}))
def size_entropy(spark, sf_dir):
    return features(spark, sf_dir, ["packet_size_entropy"])


@query(S.windowed({"packet_size_z_score": "CASE WHEN var_pop(packet_size) OVER {w} > 0 THEN 0.0::DOUBLE END", "inter_arrival_time_z_score": "CASE WHEN var_pop(d) OVER {w-1} > 0 THEN 0.0::DOUBLE END"}))
def z_scores(spark, sf_dir):
    return features(spark, sf_dir, ["packet_size_z_score", "inter_arrival_time_z_score"])


@query(S.windowed({"moving_linear_regression_slope": "coalesce(regr_slope(packet_size, t - 1.7e9) OVER {w}, 0)"}))
def slope(spark, sf_dir):
    return features(spark, sf_dir, ["moving_linear_regression_slope"])


@query(S.listed({"exponential_moving_average": "list_reduce({v}, lambda a, x: 0.1::DOUBLE * x + 0.9::DOUBLE * a)"}))
def moving_average(spark, sf_dir):
    return features(spark, sf_dir, ["exponential_moving_average"])


@query(S.windowed({"rolling_variance_inter_arrival_times": "sum(rv) OVER {w-20} / ({w} - 1)"}, 3, base="inn", extra=S.INNER))
def rolling_variance(spark, sf_dir):
    return features(spark, sf_dir, ["rolling_variance_inter_arrival_times"], 3)


@query(S.windowed({"peak_to_average_ratio": "sum(par) OVER {w-19} / {w}"}, base="inn", extra=S.INNER))
def peak_ratio(spark, sf_dir):
    return features(spark, sf_dir, ["peak_to_average_ratio"])


@query(S.windowed({"peak_to_average_ratio": "sum(par) OVER {w-19} / {w}", "average_packet_size": "avg(packet_size) OVER {w}"}, windows=(100,), base="inn", extra=S.INNER))
def native_frames(spark, sf_dir):
    """The same by native nested frames."""
    return rounded(windows.native(packets(spark, sf_dir), 100, ["peak_to_average_ratio", "average_packet_size"], cfg=CFG))


@query(S.windowed({"packet_arrival_rate_mean": "sum(rate) OVER {w-19} / {w}", "packet_arrival_rate_max": "greatest(0, max(peak) OVER {w-19})"}, base="inn", extra=S.INNER))
def arrival_rates(spark, sf_dir):
    return features(spark, sf_dir, ["packet_arrival_rate_mean", "packet_arrival_rate_max"])


@query(S.windowed({"time_gaps_between_events": "sum(gaps) OVER {w-19} / {w}"}, base="inn", extra=S.INNER))
def time_gaps(spark, sf_dir):
    return features(spark, sf_dir, ["time_gaps_between_events"])


_COUNT = "sum(CASE WHEN mqtt_message_type = '{n}' THEN 1 ELSE 0 END) OVER {w}"


@query(S.windowed({
    "tcp_syn_to_fin_ratio": "CASE WHEN sum(tcp_fin_flag) OVER {w} > 0 THEN sum(tcp_syn_flag) OVER {w} / sum(tcp_fin_flag) OVER {w} ELSE 0 END",
    "mqtt_publish_subscribe_ratio": f"CASE WHEN {_COUNT.replace('{n}', '8')} > 0 THEN {_COUNT.replace('{n}', '3')} / {_COUNT.replace('{n}', '8')} ELSE 0 END",
    "qos_level_frequency": "avg(CASE WHEN mqtt_qos_level BETWEEN 0 AND 2 THEN 1.0 ELSE 0.0 END) OVER {w}",
}))
def protocol(spark, sf_dir):
    return features(spark, sf_dir, ["tcp_syn_to_fin_ratio", "mqtt_publish_subscribe_ratio", "qos_level_frequency"])


@query(S.windowed({f"qos_{n}_frequency": f"avg(CASE WHEN mqtt_qos_level = {n} THEN 1.0 ELSE 0.0 END) OVER {{w}}" for n in (0, 1, 2)}))
def qos_levels(spark, sf_dir):
    """The share of packets at each level."""
    return features(spark, sf_dir, ["qos_0_frequency", "qos_1_frequency", "qos_2_frequency"])


_KINDS = (("", "packet_size", "{w}"), ("iat_", "d", "{w-1}"), ("payload_", "tcp_payload_size", "{w}"))


@query(S.windowed({f"{k}coefficient_of_variation": f"CASE WHEN avg({c}) OVER {w} != 0 THEN stddev_pop({c}) OVER {w} / avg({c}) OVER {w} ELSE 0 END" for k, c, w in _KINDS}))
def variation(spark, sf_dir):
    return features(spark, sf_dir, [f"{k}coefficient_of_variation" for k, _, _ in _KINDS])


@query(S.windowed({"moving_range": "avg(dv) OVER {w-1}", "iat_moving_range": "avg(dd) OVER {w-2}", "payload_moving_range": "avg(dp) OVER {w-1}"}, 4))
def moving_ranges(spark, sf_dir):
    return features(spark, sf_dir, ["moving_range", "iat_moving_range", "payload_moving_range"], 4)


@query(S.listed({f"{k}interquartile_range": f"{S.percentile(x, 0.75)} - {S.percentile(x, 0.25)}" for k, x in (("", "{v}"), ("iat_", "{d}"), ("payload_", "{p}"))}, 6))
def interquartile(spark, sf_dir):
    return features(spark, sf_dir, [f"{k}interquartile_range" for k, _, _ in _KINDS], 6)


@query(S.windowed(S.shapes("", "zv", "{w}") | S.shapes("iat_", "zd", "{w-1}") | S.shapes("payload_", "zp", "{w}"), 4, base="zz", extra=S.CENTRED))
def shape(spark, sf_dir):
    """Population skewness and excess kurtosis."""
    return features(spark, sf_dir, [f"{k}{n}" for k, _, _ in _KINDS for n in ("skewness", "kurtosis")], 4)


@query(S.listed({f"{k}rolling_entropy": S.entropy(x, 10) for k, x in (("", "{v}"), ("iat_", "{d}"), ("payload_", "{p}"))}))
def rolling_entropy(spark, sf_dir):
    return features(spark, sf_dir, [f"{k}rolling_entropy" for k, _, _ in _KINDS])


#: One feature of each gate that the query spoils, how, and in every how many-th row.
_SPOILT = {"flow": ("total_bytes_500", None, 7), "temporal": ("moving_linear_regression_slope_100", "nan", 11), "protocol": ("qos_level_frequency_500", "inf", 13), "statistical": ("payload_kurtosis_100", "-inf", 17)}


@query(f"{S.packets()} SELECT file_no, count(*) AS rows_in, {', '.join(f'count(*) FILTER (packet_count % {n} <> 0) AS {g}' for g, (_, _, n) in _SPOILT.items())}, count(*) FILTER ({' AND '.join(f'packet_count % {n} <> 0' for _, _, n in _SPOILT.values())}) AS passing FROM pk WHERE packet_count >= 500 GROUP BY 1")
def validity_gates(spark, sf_dir):
    """Rows that pass each gate, and all of them, after some values were made null, NaN or infinite."""
    rows = windows.extract(packets(spark, sf_dir), ("file_no",), CFG)
    kinds = dict(rows.dtypes)
    rows = rows.withColumns({c: F.when(F.col("packet_count") % n != 0, F.col(c)).otherwise(F.lit(None if v is None else float(v)).cast(kinds[c])) for c, v, n in _SPOILT.values()})
    return rows.groupBy("file_no").agg(F.count(F.lit(1)).alias("rows_in"), *[F.count_if(gate.valid(groups=(g,))).alias(g) for g in gate.GROUPS], F.count_if(gate.valid()).alias("passing"))


@query()
def all_features(spark, sf_dir):
    """Every feature of both windows for rows that pass the gate; its parts have twins above."""
    return gate.passing(windows.extract(packets(spark, sf_dir), ("file_no",), CFG))


# --- labels ------------------------------------------------------------------

#: Captures named after events: class by type, process and colour by user, number by event.
_FILES = """files AS (
  SELECT DISTINCT c || '_' || p || '_' || o || '-' || lpad(CAST(n AS VARCHAR), 3, '0') || '.pcapng' AS file_name, c, p, o, n
  FROM (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'Normal' ELSE 'Anomalous' END AS c, CASE user_id % 3 WHEN 0 THEN 'Order' WHEN 1 THEN 'Stock' ELSE 'Order2' END AS p,
    CASE user_id // 3 % 3 WHEN 0 THEN 'Blue' WHEN 1 THEN 'Red' ELSE 'White' END AS o, event_id % 101 AS n FROM events))"""


def _file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda x, names: F.element_at(F.array(*map(F.lit, names)), (x % 3 + 1).cast("int"))
    parts = (
        F.when(F.col("event_type").isin("click", "view"), "Normal").otherwise("Anomalous"), place(F.col("user_id"), ["Order", "Stock", "Order2"]),
        place(F.floor(F.col("user_id") / 3), ["Blue", "Red", "White"]),
    )
    number = F.lpad((F.col("event_id") % 101).cast("string"), 3, "0")
    return events(spark, sf_dir).select(F.concat(F.concat_ws("_", *parts), F.lit("-"), number, F.lit(".pcapng")).alias("file_name")).distinct()


_LABELS = f"""WITH {_FILES}, ids AS (
  SELECT file_name, c, p, o, n + CASE c WHEN 'Normal' THEN 0 ELSE 600 END + (CASE p WHEN 'Order' THEN 0 ELSE 3 END + CASE o WHEN 'Blue' THEN 0 WHEN 'Red' THEN 1 ELSE 2 END) * CASE c WHEN 'Normal' THEN 100 ELSE 60 END AS file_id
  FROM files WHERE p IN ('Order', 'Stock')), an(code, lo, hi) AS (VALUES {", ".join(f"({k}, {lo}, {hi})" for k, (_, lo, hi) in enumerate(labels.ANOMALIES, 1))}), lb AS (
  SELECT file_name, CAST(c = 'Anomalous' AS INT) AS label_1, CAST(p = 'Order' AS INT) AS label_2, CASE o WHEN 'Red' THEN 0 WHEN 'White' THEN 1 ELSE 2 END AS label_3,
         CASE WHEN c = 'Normal' THEN 0 ELSE coalesce(code, 0) END AS label_4, file_id
  FROM ids LEFT JOIN an ON (file_id - 1) % 60 + 1 BETWEEN lo AND hi WHERE file_id BETWEEN 1 AND 960)"""


@query(f"{_LABELS} SELECT * FROM lb")
def file_labels(spark, sf_dir):
    return labels.file_labels(_file_names(spark, sf_dir))


@query(f"{_LABELS} SELECT label_1, label_4, count(*) AS n, min(file_id) AS first_id, max(file_id) AS last_id FROM lb GROUP BY 1, 2")
def anomaly_counts(spark, sf_dir):
    """By a range join with the table of anomalies."""
    found = labels.file_labels(_file_names(spark, sf_dir)).drop("label_4")
    place = (F.col("file_id") - 1) % 60 + 1
    rows = found.join(F.broadcast(labels.anomaly_ranges(spark).limit(len(labels.ANOMALIES))), place.between(F.col("lo"), F.col("hi")), "left")
    code = F.when(F.col("label_1") == 1, F.coalesce("code", F.lit(0))).otherwise(0)
    return rows.groupBy("label_1", code.alias("label_4")).agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("first_id"), F.max("file_id").alias("last_id"))


@query("SELECT event_type AS file_name, row_number() OVER (ORDER BY event_type) - 1 AS file_no FROM (SELECT DISTINCT event_type FROM events)")
def dense_ids(spark, sf_dir):
    return labels.dense_ids(events(spark, sf_dir).withColumnRenamed("event_type", "file_name"))


# --- dataset -----------------------------------------------------------------


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    size = F.round(F.col("value") * 100).cast("double")
    return events(spark, sf_dir).select(
        (F.col("user_id") % 20).cast("int").alias("file_no"), F.col("event_id").alias("seq"), F.col("event_type").isin("error", "signup").cast("int").alias("label"),
        size.alias("size"), k.cast("double").alias("payload"), (k % 4).cast("double").alias("qos"), F.col("event_type").isin("click", "view").cast("double").alias("mqtt"), (size * 2 + k).alias("combined"),
    )


_SPLIT = "sp AS (SELECT file_no, CASE WHEN rk <= 4 THEN 'test' WHEN rk <= 8 THEN 'validation' ELSE 'train' END AS split FROM (SELECT file_no, row_number() OVER (ORDER BY md5(file_no || '|42'), file_no) AS rk FROM (SELECT DISTINCT file_no FROM mx)))"


@query(f"WITH {S.MATRIX}, {_SPLIT} SELECT * FROM sp")
def group_split(spark, sf_dir):
    return dataset.split_groups(matrix(spark, sf_dir), "file_no")


@query(f"WITH {S.MATRIX}, {_SPLIT} SELECT split, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM mx JOIN sp USING (file_no) GROUP BY 1")
def class_histogram(spark, sf_dir):
    m = matrix(spark, sf_dir)
    plan = dataset.split_groups(m, "file_no")
    counts = m.join(plan, "file_no").groupBy("split").pivot("label", [0, 1]).count()
    return counts.select("split", F.coalesce("0", F.lit(0)).cast("long").alias("n0"), F.coalesce("1", F.lit(0)).cast("long").alias("n1"))


_LEAK = "lk AS (SELECT * FROM sp UNION ALL SELECT file_no, 'test' FROM sp WHERE file_no IN (3, 8) UNION ALL SELECT file_no, 'train' FROM sp WHERE file_no IN (5, 8))"


@query(f"WITH {S.MATRIX}, {_SPLIT}, {_LEAK} SELECT file_no, count(DISTINCT split) AS splits FROM lk GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leaks(spark, sf_dir):
    """Captures in several splits, after some were added to a second one; the split itself has none."""
    plan = dataset.split_groups(matrix(spark, sf_dir), "file_no")
    added = lambda files, split: plan.where(F.col("file_no").isin(files)).select("file_no", F.lit(split).alias("split"))
    return dataset.leaking(plan.unionByName(added([3, 8], "test")).unionByName(added([5, 8], "train")), "file_no")


@query(f"WITH {S.MATRIX} SELECT file_no, seq FROM (SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY md5(file_no || '|' || seq || '|42'), seq) AS rk, count(*) OVER (PARTITION BY file_no) AS n FROM mx) WHERE rk <= floor(0.3::DOUBLE * n)")
def row_sample(spark, sf_dir):
    return dataset.sample_rows(matrix(spark, sf_dir), "file_no", "seq", 0.3).select("file_no", "seq")


@query(f"WITH {S.MATRIX}, f AS (SELECT DISTINCT file_no, CASE WHEN file_no % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM mx) SELECT file_no, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(file_no || '|42'), file_no) AS rk FROM f) WHERE rk <= CASE kind WHEN 'even' THEN 3 ELSE 5 END")
def file_sample(spark, sf_dir):
    files = matrix(spark, sf_dir).select("file_no", F.when(F.col("file_no") % 2 == 0, "even").otherwise("odd").alias("kind")).distinct()
    return dataset.sample_files(files, "kind", "file_no", {"even": 3, "odd": 5})


_SCALED = ", ".join(f"round(({c} - min({c}) OVER ()) / CASE WHEN max({c}) OVER () > min({c}) OVER () THEN max({c}) OVER () - min({c}) OVER () ELSE 1 END, 6) + 0.0 AS {c}" for c in NAMES)


@query(f"WITH {S.MATRIX} SELECT file_no, seq, label, {_SCALED} FROM mx")
def min_max_scaled(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return rounded(dataset.min_max(m, dataset.extremes(m, NAMES), NAMES), 6)


_Z = ", ".join(f"round(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END, 5) + 0.0 AS {c}" for c in NAMES)


@query(f"WITH {S.MATRIX} SELECT file_no, seq, label, {_Z} FROM mx")
def standardised(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return rounded(dataset.standardise(m, dataset.moments(m, NAMES), NAMES), 5)


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS code FROM events")
def encoded(spark, sf_dir):
    return dataset.encode_category(events(spark, sf_dir).select("event_id", "event_type"), "event_type", "code").select("event_id", F.col("code").cast("int").alias("code"))


@query(f"WITH {S.MATRIX} SELECT label, count(*) AS n, round(count(*) * 0 + (SELECT count(*) FROM mx) / (2.0::DOUBLE * count(*)), 6) AS weight FROM mx GROUP BY 1")
def class_weights(spark, sf_dir):
    m = dataset.class_weights(matrix(spark, sf_dir))
    return m.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("weight"))


# --- analysis ----------------------------------------------------------------

_PAIRS = [(a, b) for a in NAMES for b in NAMES if a != b]
_CORR = "co AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS corr FROM {{t}}" for a, b in _PAIRS) + ")"
_RANKS = "rk AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in NAMES) + " FROM mx)"


@query(f"WITH {S.MATRIX}, {_CORR.format(t='mx')} SELECT feature_a, feature_b, round(corr, 6) + 0.0 AS corr FROM co")
def pearson(spark, sf_dir):
    return rounded(analysis.correlations(matrix(spark, sf_dir), NAMES, "pearson"), 6)


@query(f"WITH {S.MATRIX}, {_RANKS}, {_CORR.format(t='rk')} SELECT feature_a, feature_b, round(corr, 6) + 0.0 AS corr FROM co")
def spearman(spark, sf_dir):
    return rounded(analysis.correlations(matrix(spark, sf_dir), NAMES), 6)


def _moments(x, y):
    """What Pearson's r needs of some rows: their number, means, and centred sums."""
    return [len(x), x.mean(), y.mean(), ((x - x.mean()) ** 2).sum(), ((y - y.mean()) ** 2).sum(), ((x - x.mean()) * (y - y.mean())).sum()]


def _joined(a, b):
    n, dx, dy = a[0] + b[0], b[1] - a[1], b[2] - a[2]
    share, both = b[0] / n, a[0] * b[0] / n
    return [n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * both, a[4] + b[4] + dy * dy * both, a[5] + b[5] + dx * dy * both]


#: Pearson's r as a user would write it.
OWN_PEARSON = analysis.Merging(_moments, _joined, lambda m: m[5] / (m[3] * m[4]) ** 0.5 if m[3] > 0 and m[4] > 0 else None)


@query(f"WITH {S.MATRIX}, {_CORR.format(t='mx')} SELECT feature_a, feature_b, round(corr, 6) + 0.0 AS corr FROM co")
def own_correlation(spark, sf_dir):
    """A user's correlation, mapped and merged in tasks, over all rows."""
    return rounded(analysis.correlations(matrix(spark, sf_dir), NAMES, OWN_PEARSON), 6)


_TAU = ["size", "payload", "qos"]
_TAUS = " UNION ALL ".join(
    f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, s / sqrt((n0 - tx) * (n0 - ty)) AS corr FROM
  (SELECT CAST(sum(p.n * q.n * (CASE WHEN (p.a < q.a) = (p.b < q.b) THEN 1 ELSE -1 END)) AS DOUBLE) / 2 AS s FROM g_{a}_{b} p JOIN g_{a}_{b} q ON p.a <> q.a AND p.b <> q.b),
  (SELECT CAST(count(*) AS DOUBLE) * (count(*) - 1) / 2 AS n0 FROM mx), (SELECT sum(n * (n - 1.0::DOUBLE)) / 2 AS tx FROM (SELECT count(*) AS n FROM mx GROUP BY {a})), (SELECT sum(n * (n - 1.0::DOUBLE)) / 2 AS ty FROM (SELECT count(*) AS n FROM mx GROUP BY {b}))"""
    for a, b in (("payload", "qos"), ("qos", "payload"), ("size", "qos"), ("qos", "size"))
)
_GROUPS = ", ".join(f"g_{a}_{b} AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM mx GROUP BY 1, 2)" for a, b in (("payload", "qos"), ("qos", "payload"), ("size", "qos"), ("qos", "size")))


@query(f"WITH {S.MATRIX}, {_GROUPS}, tau AS ({_TAUS}) SELECT feature_a, feature_b, round(corr, 6) + 0.0 AS corr FROM tau")
def kendall(spark, sf_dir):
    """Kendall's tau-b over all rows."""
    found = analysis.correlations(matrix(spark, sf_dir), _TAU, "kendall")
    return rounded(found.where("feature_a = 'qos' OR feature_b = 'qos'"), 6)


@query(f"WITH {S.MATRIX}, {_RANKS}, {_CORR.format(t='rk')} SELECT feature_a AS feature, string_agg(feature_b, ',' ORDER BY -abs(corr), feature_b) AS others FROM co WHERE abs(corr) > 0.05 GROUP BY 1")
def correlated_neighbours(spark, sf_dir):
    found = analysis.neighbours(analysis.correlations(matrix(spark, sf_dir), NAMES), 0.05)
    return found.select("feature", F.array_join(F.transform("others", lambda x: x["feature"]), ",").alias("others"))


@query(f"WITH {S.MATRIX}, {_CORR.format(t='mx')} SELECT CASE WHEN abs(corr) > 0.8 THEN 'high' WHEN abs(corr) > 0.5 THEN 'moderate' ELSE 'low' END AS band, count(*) AS n FROM co WHERE feature_a < feature_b GROUP BY 1")
def correlation_bands(spark, sf_dir):
    return analysis.correlation_bands(analysis.correlations(matrix(spark, sf_dir), NAMES, "pearson"))


@query(f"WITH {S.MATRIX}, {_CORR.format(t='mx')} SELECT feature_a, feature_b FROM co WHERE feature_a < feature_b AND abs(corr) > 0.95")
def redundant_pairs(spark, sf_dir):
    return analysis.redundant_pairs(analysis.correlations(matrix(spark, sf_dir), NAMES, "pearson")).select("feature_a", "feature_b")


_LONG = "lg AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, label, seq FROM mx" for c in NAMES) + ")"
_MI = f"""{_LONG}, en AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM lg GROUP BY 1),
bi AS (SELECT feature, CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 20), 19) ELSE 0 END AS bin, label FROM lg JOIN en USING (feature)),
ce AS (SELECT feature, bin, label, count(*) AS n FROM bi GROUP BY ALL),
mi AS (SELECT feature, greatest(sum(v), 0) AS mutual_info FROM (SELECT feature, n / sum(n) OVER (PARTITION BY feature) * ln(n * sum(n) OVER (PARTITION BY feature) / (sum(n) OVER (PARTITION BY feature, bin) * sum(n) OVER (PARTITION BY feature, label))) AS v FROM ce) GROUP BY 1)"""


@query(f"WITH {S.MATRIX}, {_MI} SELECT feature, round(mutual_info, 6) + 0.0 AS mutual_info FROM mi")
def mutual_information(spark, sf_dir):
    return rounded(analysis.binned_information(matrix(spark, sf_dir), NAMES), 6)


@query(f"WITH {S.MATRIX}, {_MI} SELECT feature, round(r, 6) + 0.0 AS correlation, round(mutual_info, 6) + 0.0 AS mutual_info FROM mi JOIN (SELECT feature, corr(value, label) AS r FROM lg GROUP BY 1) USING (feature)")
def leakage(spark, sf_dir):
    return rounded(analysis.leakage(matrix(spark, sf_dir), NAMES), 6).select("feature", "correlation", "mutual_info")


@query()
def leakage_p_values(spark, sf_dir):
    """Two-sided p-values of the correlations with the label, by Student's t; tests compare them with plain sums."""
    return rounded(analysis.leakage(matrix(spark, sf_dir), NAMES).select("feature", "p_value"), 9)


_STABLE = f"""{_LONG}, nu AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY seq) - 1 AS n, count(*) OVER (PARTITION BY feature) AS total FROM lg),
wi AS (SELECT feature, n // 1000 AS w, avg(value) AS m, stddev_pop(value) AS s FROM nu WHERE n // 1000 < (total - 1) // 1000 GROUP BY ALL),
st AS (SELECT feature, greatest(CASE WHEN abs(avg(m)) <= 1e-8 THEN 0 ELSE stddev_pop(m) / avg(m) END, CASE WHEN abs(avg(s)) <= 1e-8 THEN 0 ELSE stddev_pop(s) / avg(s) END) AS score FROM wi GROUP BY 1)"""


@query(f"WITH {S.MATRIX}, {_STABLE} SELECT feature, round(score, 6) + 0.0 AS score FROM st")
def stability(spark, sf_dir):
    return rounded(analysis.stability(matrix(spark, sf_dir), NAMES, "seq"), 6)


@query(f"WITH {S.MATRIX}, {_STABLE} SELECT round(avg(score), 6) + 0.0 AS mean, round(stddev_pop(score), 6) + 0.0 AS sd, round(min(score), 6) + 0.0 AS lo, round(max(score), 6) + 0.0 AS hi FROM st")
def stability_summary(spark, sf_dir):
    return rounded(analysis.summary(analysis.stability(matrix(spark, sf_dir), NAMES, "seq")), 6)


@query(f"WITH {S.MATRIX}, {_STABLE}, {_CORR.format(t='mx')}, ne AS (SELECT feature_a AS feature, max(abs(corr)) AS near FROM co WHERE abs(corr) > 0.5 GROUP BY 1), lk AS (SELECT feature, corr(value, label) AS r FROM lg GROUP BY 1) SELECT feature, round(1 / (1 + score) + abs(r) + coalesce(near, 0), 6) + 0.0 AS importance FROM st JOIN lk USING (feature) LEFT JOIN ne USING (feature)")
def importance(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return rounded(analysis.importance(analysis.stability(m, NAMES, "seq"), analysis.leakage(m, NAMES), analysis.correlations(m, NAMES, "pearson")), 6)


@query(f"WITH {S.MATRIX}, {_LONG}, lk AS (SELECT feature, abs(corr(value, label)) AS r FROM lg GROUP BY 1) SELECT feature FROM lk ORDER BY r DESC, feature LIMIT 2")
def strongest(spark, sf_dir):
    found = analysis.leakage(matrix(spark, sf_dir), NAMES)
    return found.orderBy(F.abs("correlation").desc(), "feature").limit(2).select("feature")


_PLACE = "(VALUES " + ", ".join(f"('{c}', {k})" for k, c in enumerate(NAMES)) + ") o(feature, place)"


@query(f"""WITH {S.MATRIX}, {_STABLE}, {_CORR.format(t='mx')}, lk AS (SELECT feature, abs(corr(value, label)) > 0.9 AS leaks FROM lg GROUP BY 1),
pa AS (SELECT CASE WHEN a.score > b.score THEN feature_a ELSE feature_b END AS gone FROM co JOIN {_PLACE} ON o.feature = feature_a JOIN (SELECT * FROM {_PLACE}) q ON q.feature = feature_b JOIN st a ON a.feature = feature_a JOIN st b ON b.feature = feature_b WHERE o.place < q.place AND abs(corr) > 0.95)
SELECT feature, CASE WHEN leaks THEN 'leakage' WHEN feature IN (SELECT gone FROM pa) THEN 'redundant' ELSE 'selected' END AS outcome FROM lk""")
def selected_features(spark, sf_dir):
    """The outcome of greedy selection; no feature is in two redundant pairs here, so pairs decide one by one."""
    got = analysis.select(matrix(spark, sf_dir), NAMES, "seq", method="pearson")
    gone = {c: k for k, v in got["removed"].items() for c in v}
    return spark.createDataFrame([(c, gone.get(c, "selected")) for c in NAMES], "feature string, outcome string")


@query()
def neighbour_information(spark, sf_dir):
    """Mutual information by nearest neighbours, over all rows."""
    return rounded(analysis.neighbour_information(matrix(spark, sf_dir), NAMES, keys=["seq"]), 6)


# --- evaluation --------------------------------------------------------------


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("event_type").isin("error", "signup").cast("int")
    rows = events(spark, sf_dir).select(F.col("event_id").alias("row"), y.alias("y"), (((F.col("event_id") * 37) % 70 + 30 * y) / 100.0).alias("prob"))
    return rows.withColumn("pred", (F.col("prob") >= 0.5).cast("int"))


@query(f"WITH {S.PREDICTIONS} SELECT y, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM pr GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return rounded(evaluation.confusion(predictions(spark, sf_dir)), 6)


_RATES = "round(sum(CAST(y = pred AS INT)) / count(*), 6) AS accuracy, round(coalesce(sum(y * pred) / nullif(sum(pred), 0), 0), 6) AS precision, round(coalesce(sum(y * pred) / nullif(sum(y), 0), 0), 6) AS recall, round(coalesce(2 * sum(y * pred) / nullif(sum(y) + sum(pred), 0), 0), 6) AS f1"


@query(f"WITH {S.PREDICTIONS} SELECT {_RATES} FROM pr")
def classification_rates(spark, sf_dir):
    return rounded(evaluation.rates(predictions(spark, sf_dir)), 6)


_STEPS = "st AS (SELECT prob, sum(y) AS p, count(*) AS n FROM pr GROUP BY 1), cu AS (SELECT *, sum(p) OVER (ORDER BY prob DESC) AS tp, sum(n) OVER (ORDER BY prob DESC) AS taken, sum(p) OVER () AS pos, sum(n) OVER () AS total FROM st)"


@query(f"WITH {S.PREDICTIONS}, rk AS (SELECT y, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0::DOUBLE AS r FROM pr) SELECT round((sum(r * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)), 6) AS roc_auc FROM rk")
def roc_area(spark, sf_dir):
    return rounded(evaluation.roc_auc(predictions(spark, sf_dir)), 6)


@query(f"WITH {S.PREDICTIONS}, {_STEPS} SELECT round(sum(p / pos * (tp / taken)), 6) AS average_precision FROM cu")
def average_precision(spark, sf_dir):
    return rounded(evaluation.average_precision(predictions(spark, sf_dir)), 6)


@query(f"WITH {S.PREDICTIONS}, {_STEPS} SELECT prob AS threshold, round((taken - tp) / (total - pos), 6) AS fpr, round(tp / pos, 6) AS tpr FROM cu UNION ALL SELECT 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE")
def roc_curve(spark, sf_dir):
    return rounded(evaluation.roc(predictions(spark, sf_dir)), 6, ("threshold",))


@query(f"WITH {S.PREDICTIONS}, {_STEPS} SELECT prob AS threshold, round(tp / taken, 6) AS precision, round(tp / pos, 6) AS recall FROM cu")
def precision_recall_curve(spark, sf_dir):
    return rounded(evaluation.precision_recall(predictions(spark, sf_dir)), 6, ("threshold",))


@query(f"""WITH {S.PREDICTIONS}, {_STEPS}, kn AS (SELECT fpr AS x, max(tpr) AS y FROM (SELECT (taken - tp) / (total - pos) AS fpr, tp / pos AS tpr FROM cu UNION ALL SELECT 0, 0) GROUP BY 1),
gr AS (SELECT n / 99.0::DOUBLE AS x FROM range(0, 100) r(n)), nb AS (SELECT gr.x AS x, (SELECT max(k.x) FROM kn k WHERE k.x <= gr.x) AS a, (SELECT min(k.x) FROM kn k WHERE k.x >= gr.x) AS b FROM gr)
SELECT round(nb.x, 6) AS x, round(CASE WHEN b IS NULL OR b = a THEN ka.y ELSE ka.y + (nb.x - a) / (b - a) * (kb.y - ka.y) END, 6) AS y FROM nb LEFT JOIN kn ka ON ka.x = a LEFT JOIN kn kb ON kb.x = b""")
def roc_on_grid(spark, sf_dir):
    return rounded(evaluation.on_grid(evaluation.roc(predictions(spark, sf_dir)), "fpr", "tpr"), 6, ())


_FOLD = f"WITH {S.PREDICTIONS}, fo AS (SELECT row % 5 AS fold, {_RATES.replace('round(', '(').replace(', 6)', ')')} FROM pr GROUP BY 1), lo AS (SELECT fold, 'accuracy' AS metric, accuracy AS value FROM fo UNION ALL SELECT fold, 'precision', precision FROM fo UNION ALL SELECT fold, 'recall', recall FROM fo UNION ALL SELECT fold, 'f1', f1 FROM fo)"


@query(f"{_FOLD} SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM lo GROUP BY 1")
def fold_averages(spark, sf_dir):
    folds = evaluation.rates(predictions(spark, sf_dir).withColumn("fold", F.col("row") % 5), ["fold"])
    return rounded(evaluation.fold_averages(folds.unpivot(["fold"], evaluation.METRICS, "metric", "value")), 6)


_T4 = 2.7764451051977987  # Student's t with 4 degrees of freedom at 0.975


@query(f"{_FOLD} SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(avg(value) - {_T4} * stddev_samp(value) / sqrt(5), 6) AS ci_lower, round(avg(value) + {_T4} * stddev_samp(value) / sqrt(5), 6) AS ci_upper, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM lo GROUP BY 1")
def fold_intervals(spark, sf_dir):
    """Averages over folds with t-intervals."""
    folds = evaluation.rates(predictions(spark, sf_dir).withColumn("fold", F.col("row") % 5), ["fold"])
    return rounded(evaluation.fold_intervals(folds.unpivot(["fold"], evaluation.METRICS, "metric", "value")), 6)


_GRID = "gr AS (SELECT n / 99.0::DOUBLE AS x FROM range(0, 100) r(n))"


@query(f"""WITH {S.PREDICTIONS}, st AS (SELECT row % 3 AS fold, prob, sum(y) AS p, count(*) AS n FROM pr GROUP BY 1, 2),
cu AS (SELECT fold, sum(p) OVER (PARTITION BY fold ORDER BY prob DESC) AS tp, sum(n) OVER (PARTITION BY fold ORDER BY prob DESC) AS taken, sum(p) OVER (PARTITION BY fold) AS pos, sum(n) OVER (PARTITION BY fold) AS total FROM st),
pt AS (SELECT fold, 'roc' AS kind, (taken - tp) / (total - pos) AS x, tp / pos AS y FROM cu UNION ALL SELECT DISTINCT fold, 'roc', 0, 0 FROM cu UNION ALL SELECT fold, 'pr', tp / pos, tp / taken FROM cu UNION ALL SELECT DISTINCT fold, 'pr', 0, 1 FROM cu),
kn AS (SELECT fold, kind, x, max(y) AS y FROM pt GROUP BY ALL), {_GRID},
ix AS (SELECT fold, kind, gr.x AS x, max(kn.x) FILTER (kn.x <= gr.x) AS a, min(kn.x) FILTER (kn.x >= gr.x) AS b FROM kn, gr GROUP BY ALL),
iy AS (SELECT ix.fold, ix.kind, ix.x, CASE WHEN a IS NULL THEN kb.y WHEN b IS NULL OR a = b THEN ka.y ELSE ka.y + (ix.x - a) / (b - a) * (kb.y - ka.y) END AS y
  FROM ix LEFT JOIN kn ka ON ka.fold = ix.fold AND ka.kind = ix.kind AND ka.x = a LEFT JOIN kn kb ON kb.fold = ix.fold AND kb.kind = ix.kind AND kb.x = b)
SELECT kind, round(x, 6) AS x, round(avg(y), 6) AS y, round(stddev_pop(y), 6) AS sd FROM iy GROUP BY 1, 2""")
def mean_curves(spark, sf_dir):
    """ROC and precision-recall curves of three folds at 100 even places, averaged."""
    rows = predictions(spark, sf_dir).withColumn("fold", F.col("row") % 3)
    return rounded(evaluation.mean_curves(evaluation.fold_curves(rows, range(3))), 6, ())


@query()
def bootstrap_intervals(spark, sf_dir):
    """t-intervals of the four rates and ROC AUC over 1,000 resamples of all predictions."""
    return rounded(evaluation.intervals(evaluation.bootstrap_all(predictions(spark, sf_dir)), [*evaluation.METRICS, "roc_auc"]), 6)


# --- models and streams ------------------------------------------------------


@query()
def classifier_scores(spark, sf_dir):
    """Predictions of a classifier fitted on the training groups, over the test groups."""
    from ..operators.classifier import AnomalyClassifier

    parts = evaluation.holdout(matrix(spark, sf_dir), "file_no")
    names = ["size", "payload", "qos"]
    model = AnomalyClassifier(names).fit(parts["train"].withColumn("label", F.col("label").cast("double")), max_iter=20)
    return rounded(model.predict(parts["test"]).select("file_no", "seq", "label", "pred", "prob"), 4, ())


def standardised_rows(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    m = matrix(spark, sf_dir)
    return dataset.standardise(m, dataset.moments(m, names), names)


@query()
def huber_scores(spark, sf_dir):
    """Margins of a model of the modified Huber loss, by averaged stochastic steps over all rows."""
    from ..operators import sgd

    names = ["size", "payload", "qos"]
    rows = standardised_rows(spark, sf_dir, names)
    dealt = sgd.dealt(rows, names)
    w = sgd.fit_many(dealt, [sgd.Settings(schedule="adaptive", average=True)], epochs=60).weights[0].tolist()
    dealt.unpersist()
    margin = sum((F.col(c) * x for c, x in zip(names, w, strict=False)), F.lit(w[-1]))
    return rounded(rows.select("file_no", "seq", "label", margin.alias("score"), (margin > 0).cast("int").alias("pred")), 3, ())


@query()
def search_scores(spark, sf_dir):
    """Settings drawn for a search with their accuracy over left-out captures; all trials on all folds share each pass."""
    from ..operators import sgd

    names = ["size", "payload", "qos", "combined"]
    rows = standardised_rows(spark, sf_dir, names).join(dataset.group_folds(matrix(spark, sf_dir), "file_no", "label"), "file_no")
    dealt = sgd.dealt(rows, names, fold="fold")
    found = sgd.search(dealt, range(5), epochs=12)
    dealt.unpersist()
    return spark.createDataFrame([(r["loss"], r["penalty"], r["alpha"], r["eta0"], r["accuracy"]) for r in found], "loss string, penalty string, alpha double, eta0 double, accuracy double")


@query()
def group_folds(spark, sf_dir):
    return dataset.group_folds(matrix(spark, sf_dir), "file_no", "label")
