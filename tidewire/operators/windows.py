"""Sliding count windows over captures: stride 1, by capture, in the order of packet_count.

``extract`` is the engine's path: captures are cut into blocks by packet_count, each
block also gets the rows before it that its windows reach (a halo), and an Arrow
kernel computes all windows of a block.  A long capture is many tasks, and no
step needs it in one place.

``native`` builds the same features from window frames and higher-order functions.
Frames nest: an inner statistic of the last 20 packets is a column, and the
outer frame covers the rows whose inner frame lies inside it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..config import ExtractConfig
from ..functions import columns as C
from ..functions.kernels import COUNTS, FEATURES, features

NEEDED = ["ts_us", "packet_size", "tcp_payload_size", "tcp_syn_flag", "tcp_fin_flag", "is_mqtt", "mqtt_message_type", "mqtt_qos_level"]


def with_halo(packets: DataFrame, keys: Sequence[str], halo: int, block: int) -> DataFrame:
    """Adds ``block`` and ``own``: rows of a block, and copies of the ``halo`` rows before it."""
    home = F.floor((F.col("packet_count") - 1) / block).cast("long")
    last = F.floor((F.col("packet_count") - 1 + halo) / block).cast("long")
    return packets.withColumn("block", F.explode(F.sequence(home, last))).withColumn("own", F.col("block") == home)


def extract(packets: DataFrame, keys: Sequence[str] = ("file_no",), cfg: ExtractConfig = ExtractConfig(), windows: Sequence[int] | None = None, names: Sequence[str] = FEATURES, carry: Sequence[str] = ()) -> DataFrame:
    """Window features of every packet that has a full large window before it.

    Returns ``keys``, packet_count, ts_us, the packet's own columns ``carry`` and each of
    the features ``names`` with its window length as suffix.  A capture of fewer packets than the
    large window gives no rows.
    """
    windows = list(windows or (cfg.small, cfg.large))
    halo = max(windows) - 1
    carry = [c for c in carry if c not in (*keys, "packet_count", "ts_us")]
    rows = with_halo(packets.select(*keys, "packet_count", *NEEDED, *[c for c in carry if c not in NEEDED]), keys, halo, max(cfg.block, halo))
    fields = {f.name: f.dataType.simpleString() for f in packets.schema}
    schema = ", ".join([*(f"`{k}` {fields[k]}" for k in keys), "packet_count long", "ts_us long", *(f"`{c}` {fields[c]}" for c in carry), *(f"`{n}_{w}` {'long' if n in COUNTS else 'double'}" for w in windows for n in names)])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("packet_count")
        own = t["own"].to_numpy()
        number = t["packet_count"].to_numpy()
        us = t["ts_us"].to_numpy()
        code = t["mqtt_message_type"].to_pylist()
        mqtt = t["is_mqtt"].to_numpy() > 0
        named = lambda word, n: np.array([c == word or (cfg.message_numbers and c == n) for c in code]) & mqtt
        a = {"size": t["packet_size"].to_numpy(), "us": us, "payload": t["tcp_payload_size"].to_numpy(), "syn": t["tcp_syn_flag"].to_numpy(), "fin": t["tcp_fin_flag"].to_numpy(), "publish": named("PUBLISH", "3"), "subscribe": named("SUBSCRIBE", "8"), "qos": t["mqtt_qos_level"].to_numpy()}
        keep = own & (number >= halo + 1)
        at = np.flatnonzero(keep)
        columns = [t[k].take(pa.array(at)) for k in (*keys, "packet_count", "ts_us", *carry)]
        for w in windows:
            if len(at):
                x = features({k: v[at[0] - w + 1 :] for k, v in a.items()}, w, cfg.inner, cfg.burst, cfg.silence, cfg.ema_alpha, cfg.flow_bins, cfg.entropy_bins, names)
            for n in names:
                values = x[n] if len(at) else np.zeros(0)
                columns.append(pa.array(values.astype(np.int64)) if n in COUNTS else pa.array(values, from_pandas=True))
        return pa.table(columns, names=[*keys, "packet_count", "ts_us", *carry, *(f"{n}_{w}" for w in windows for n in names)])

    return rows.groupBy(*keys, "block").applyInArrow(run, schema)


def frame(k: int, keys: Sequence[str]) -> WindowSpec:
    """The last ``k`` rows."""
    return Window.partitionBy(*keys).orderBy("packet_count").rowsBetween(1 - k, 0)


def running(packets: DataFrame, what: dict[str, Column], w: int, keys: Sequence[str]) -> DataFrame:
    """Moving sums of whole numbers over ``w`` rows as differences of running sums.

    Exact in 64-bit integers, and a row costs the same for every ``w``.
    """
    upto = Window.partitionBy(*keys).orderBy("packet_count").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("packet_count")
    out = packets.withColumns({f"_sum_{n}": F.sum(c.cast("long")).over(upto) for n, c in what.items()})
    out = out.withColumns({n: F.col(f"_sum_{n}") - F.coalesce(F.lag(f"_sum_{n}", w).over(before), F.lit(0)) for n in what})
    return out.drop(*[f"_sum_{n}" for n in what])


def native(packets: DataFrame, w: int, names: Sequence[str], keys: Sequence[str] = ("file_no",), cfg: ExtractConfig = ExtractConfig(), full: int | None = None) -> DataFrame:
    """``keys``, packet_count and the features ``names`` (with suffix), for rows that have ``full`` packets."""
    full = full or w
    order = Window.partitionBy(*keys).orderBy("packet_count")
    fr = lambda k: frame(k, keys)
    size, load = F.col("packet_size"), F.col("tcp_payload_size")
    rows = packets.withColumn("t", F.col("ts_us") / 1e6).withColumn("d", (F.col("ts_us") - F.lag("ts_us").over(order)) / 1e6)
    rows = rows.withColumns({"_dv": F.abs(size - F.lag("packet_size").over(order)), "_dp": F.abs(load - F.lag("tcp_payload_size").over(order)), "_dd": F.abs(F.col("d") - F.lag("d").over(order))})
    if any(n in ("peak_to_average_ratio", "packet_arrival_rate_mean", "packet_arrival_rate_max", "time_gaps_between_events", "rolling_variance_inter_arrival_times") for n in names):
        k, rate = cfg.inner, F.when(F.col("d") > 0, 1 / F.col("d"))
        some = F.sum("d").over(fr(k - 1)) > 0
        rows = rows.withColumns({
            "_rv": F.var_samp("d").over(fr(k)),
            "_par": F.when(F.avg(size).over(fr(k)) > 0, F.max(size).over(fr(k)) / F.avg(size).over(fr(k))).otherwise(0.0),
            "_rate": F.when(some, F.avg(rate).over(fr(k - 1))).otherwise(0.0), "_peak": F.when(some, F.max(rate).over(fr(k - 1))).otherwise(0.0),
            "_gaps": F.when(F.avg("d").over(fr(k - 1)) > 0, F.stddev_pop("d").over(fr(k - 1)) / F.avg("d").over(fr(k - 1))).otherwise(0.0),
        })
    rows = rows.withColumns({f"_a_{c}": F.collect_list(c).over(fr(n)) for c, n in (("packet_size", w), ("d", w - 1), ("tcp_payload_size", w)) if _arrays(names, c)})
    rows = rows.withColumns({f"_s_{c}": F.sort_array(f"_a_{c}") for c in ("packet_size", "d", "tcp_payload_size") if _arrays(names, c)})
    rows = rows.withColumns({f"_{e}_{c}": f(c).over(fr(n)) for c, n in (("packet_size", w), ("d", w - 1), ("tcp_payload_size", w)) if _arrays(names, c) for e, f in (("lo", F.min), ("hi", F.max))})
    made = _expressions(w, fr, cfg)
    return rows.select(*keys, "packet_count", *[made[n]().alias(f"{n}_{w}") for n in names]).where(F.col("packet_count") >= full)


def _arrays(names: Sequence[str], column: str) -> bool:
    kind = {"packet_size": ("packet_size_", "exponential", "interquartile", "rolling_entropy"), "d": ("inter_arrival_time_2", "inter_arrival_time_5", "inter_arrival_time_7", "iat_inter", "iat_rolling"), "tcp_payload_size": ("payload_inter", "payload_rolling")}[column]
    return any(n.startswith(kind) for n in names)


def _expressions(w: int, fr, cfg: ExtractConfig) -> dict:
    size = F.col("packet_size")
    first = F.first("ts_us").over(fr(w))
    duration = (F.col("ts_us") - first) / 1e6
    mqtt = F.col("is_mqtt") > 0
    kind = F.col("mqtt_message_type")
    named = lambda word, n: F.sum(F.when(mqtt & (kind.isin(word, n) if cfg.message_numbers else kind == word), 1).otherwise(0)).over(fr(w))
    out = {
        "flow_duration": lambda: duration,
        "total_packets": lambda: F.count(F.lit(1)).over(fr(w)),
        "total_bytes": lambda: F.sum("packet_size").over(fr(w)),
        "packet_rate": lambda: F.when(duration > 0, w / duration).otherwise(0.0),
        "byte_rate": lambda: F.when(duration > 0, F.sum("packet_size").over(fr(w)) / duration).otherwise(0.0),
        "burst_count": lambda: F.sum(F.when(F.col("d") < cfg.burst, 1).otherwise(0)).over(fr(w - 1)),
        "silence_count": lambda: F.sum(F.when(F.col("d") > cfg.silence, 1).otherwise(0)).over(fr(w - 1)),
        "packet_size_entropy": lambda: C.histogram_entropy(F.col("_a_packet_size"), F.col("_lo_packet_size"), F.col("_hi_packet_size"), cfg.flow_bins),
        "moving_linear_regression_slope": lambda: F.coalesce(F.regr_slope(size.cast("double"), F.col("t")).over(fr(w)), F.lit(0.0)),
        "exponential_moving_average": lambda: C.ema(F.col("_a_packet_size"), cfg.ema_alpha),
        "rolling_variance_inter_arrival_times": lambda: F.coalesce(F.sum("_rv").over(fr(w - cfg.inner)) / (w - 1), F.lit(0.0)),
        "peak_to_average_ratio": lambda: F.sum("_par").over(fr(w - cfg.inner + 1)) / w,
        "packet_arrival_rate_mean": lambda: F.sum("_rate").over(fr(w - cfg.inner + 1)) / w,
        "packet_arrival_rate_max": lambda: F.greatest(F.lit(0.0), F.max("_peak").over(fr(w - cfg.inner + 1))),
        "time_gaps_between_events": lambda: F.sum("_gaps").over(fr(w - cfg.inner + 1)) / w,
        "tcp_syn_to_fin_ratio": lambda: C.safe_ratio(F.sum("tcp_syn_flag").over(fr(w)), F.sum("tcp_fin_flag").over(fr(w))),
        "mqtt_publish_subscribe_ratio": lambda: C.safe_ratio(named("PUBLISH", "3"), named("SUBSCRIBE", "8")),
        "qos_level_frequency": lambda: F.avg(F.when(F.col("mqtt_qos_level").between(0, 2), 1.0).otherwise(0.0)).over(fr(w)),
    }
    for name, c, k in (("packet_size", "packet_size", w), ("inter_arrival_time", "d", w - 1)):
        out |= {
            "average_packet_size" if c == "packet_size" else "mean_inter_arrival_time": lambda c=c, k=k: F.avg(c).over(fr(k)),
            f"{name}_variance": lambda c=c, k=k: F.var_pop(c).over(fr(k)), f"{name}_std_dev": lambda c=c, k=k: F.stddev_pop(c).over(fr(k)),
            f"{name}_range": lambda c=c, k=k: (F.max(c).over(fr(k)) - F.min(c).over(fr(k))).cast("double"),
            f"{name}_z_score": lambda c=c, k=k: F.when(F.stddev_pop(c).over(fr(k)) > 0, 0.0),
        }
        out |= {f"{name}_{q}th_percentile": lambda c=c, q=q: C.index_percentile(F.col(f"_s_{c}"), q / 100).cast("double") for q in (25, 50, 75)}
    for kind_, c, k, step in (("", "packet_size", w, "_dv"), ("iat_", "d", w - 1, "_dd"), ("payload_", "tcp_payload_size", w, "_dp")):
        out |= {
            f"{kind_}coefficient_of_variation": lambda c=c, k=k: C.safe_ratio(F.stddev_pop(c).over(fr(k)), F.avg(c).over(fr(k))),
            f"{kind_}moving_range": lambda step=step, k=k: F.avg(step).over(fr(k - 1)),
            f"{kind_}interquartile_range": lambda c=c: (C.index_percentile(F.col(f"_s_{c}"), 0.75) - C.index_percentile(F.col(f"_s_{c}"), 0.25)).cast("double"),
            f"{kind_}skewness": lambda c=c, k=k: F.coalesce(F.skewness(c).over(fr(k)), F.lit(0.0)), f"{kind_}kurtosis": lambda c=c, k=k: F.coalesce(F.kurtosis(c).over(fr(k)), F.lit(0.0)),
            f"{kind_}rolling_entropy": lambda c=c: C.histogram_entropy(F.col(f"_a_{c}"), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), cfg.entropy_bins),
        }
    return out
