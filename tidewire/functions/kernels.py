"""Numpy kernels of the window features: all windows of a block at once.

A block is a run of consecutive packets of one capture.  ``features`` returns one
value for each packet whose window of ``w`` packets lies inside the block.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import cached_property

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view as view

FLOW = [
    "flow_duration", "total_packets", "total_bytes", "packet_rate", "byte_rate", "average_packet_size", "packet_size_variance", "packet_size_std_dev", "packet_size_range",
    "packet_size_25th_percentile", "packet_size_50th_percentile", "packet_size_75th_percentile", "mean_inter_arrival_time", "inter_arrival_time_variance", "inter_arrival_time_std_dev", "inter_arrival_time_range",
    "inter_arrival_time_25th_percentile", "inter_arrival_time_50th_percentile", "inter_arrival_time_75th_percentile", "burst_count", "silence_count", "packet_size_entropy", "packet_size_z_score", "inter_arrival_time_z_score",
]
TEMPORAL = ["moving_linear_regression_slope", "exponential_moving_average", "rolling_variance_inter_arrival_times", "peak_to_average_ratio", "packet_arrival_rate_mean", "packet_arrival_rate_max", "time_gaps_between_events"]
PROTOCOL = ["tcp_syn_to_fin_ratio", "mqtt_publish_subscribe_ratio", "qos_level_frequency"]
_STATS = ["coefficient_of_variation", "moving_range", "interquartile_range", "skewness", "kurtosis", "rolling_entropy"]
STATISTICAL = [f"{kind}{name}" for kind in ("", "iat_", "payload_") for name in _STATS]
FEATURES = FLOW + TEMPORAL + PROTOCOL + STATISTICAL
#: The shares of packets at each level that add up to ``qos_level_frequency``: given on demand only.
QOS_LEVELS = ["qos_0_frequency", "qos_1_frequency", "qos_2_frequency"]
COUNTS = {"total_packets", "total_bytes", "burst_count", "silence_count"}


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)


def index_percentiles(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Values at places floor(p * (n - 1)) of each sorted row, p = 1/4, 1/2, 3/4."""
    places = [int(p * (x.shape[1] - 1)) for p in (0.25, 0.5, 0.75)]
    part = np.partition(x, places, axis=1)
    return tuple(part[:, k] for k in places)


def entropy(x: np.ndarray, bins: int) -> np.ndarray:
    """Shannon entropy in bits of each row's histogram over its own range; 0 if it is constant."""
    lo, hi = x.min(1), x.max(1)
    span = np.where(hi > lo, hi - lo, 1.0)
    place = np.minimum(np.floor((x - lo[:, None]) * (bins / span)[:, None]), bins - 1).astype(np.int64)
    counts = np.bincount((place + bins * np.arange(len(x))[:, None]).ravel(), minlength=bins * len(x)).reshape(len(x), bins)
    p = counts / x.shape[1]
    h = -(p * np.log2(np.where(p > 0, p, 1.0))).sum(1)
    return np.where(hi > lo, h, 0.0)


def _moments(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Mean, population variance, skewness and excess kurtosis of each row."""
    mean = x.mean(1)
    c = x - mean[:, None]
    c2 = c * c
    m2 = c2.mean(1)
    flat = m2 <= 1e-24 * np.maximum(mean * mean, 1e-300)
    if x.shape[1] < 3:
        return mean, m2, np.zeros(len(x)), np.zeros(len(x))
    return mean, m2, np.where(flat, 0.0, _ratio((c2 * c).mean(1), m2**1.5)), np.where(flat, 0.0, _ratio((c2 * c2).mean(1), m2 * m2) - 3)


class _Windows:
    """All windows of one measure, with statistics worked out once, when first asked for."""

    def __init__(self, x: np.ndarray, w: int) -> None:
        self.x = view(x, w)

    @cached_property
    def moments(self) -> tuple[np.ndarray, ...]:
        return _moments(self.x)

    @cached_property
    def quarters(self) -> tuple[np.ndarray, ...]:
        return index_percentiles(self.x)

    def statistic(self, name: str, bins: int) -> np.ndarray:
        x, n, zero = self.x, self.x.shape[1], np.zeros(len(self.x))
        if name == "coefficient_of_variation":
            return _ratio(np.sqrt(self.moments[1]), self.moments[0]) if n >= 2 else zero
        if name == "moving_range":
            return np.abs(np.diff(x, axis=1)).mean(1) if n >= 2 else zero
        if name == "interquartile_range":
            return self.quarters[2] - self.quarters[0] if n >= 4 else zero
        if name == "rolling_entropy":
            return entropy(x, bins) if n >= 10 else zero
        return self.moments[2 if name == "skewness" else 3]


def features(a: dict[str, np.ndarray], w: int, inner: int = 20, burst: float = 0.01, silence: float = 0.1, alpha: float = 0.1, flow_bins: int = 50, bins: int = 10, want: Collection[str] | None = None) -> dict[str, np.ndarray]:
    """``a``: size, us (time in microseconds), payload, syn, fin, publish, subscribe, qos.  See the lists above for the names returned.

    With ``want``, other features are left out where they would cost work.
    """
    wanted = lambda *names: want is None or not set(want).isdisjoint(names)
    us = a["us"].astype(np.int64)
    t, gap = (us - us[:1]) / 1e6, np.diff(us) / 1e6
    size, load, gaps = _Windows(a["size"].astype(float), w), _Windows(a["payload"].astype(float), w), _Windows(gap, w - 1)
    v, d = size.x, gaps.x
    out: dict[str, np.ndarray] = {}
    m = len(v)
    duration = (us[w - 1 :] - us[:m]) / 1e6
    out["flow_duration"], out["total_packets"] = duration, np.full(m, w)
    if wanted("total_bytes", "byte_rate", "packet_rate"):
        out["total_bytes"] = total = v.sum(1)
        pos = np.maximum(duration, 0)
        out["packet_rate"], out["byte_rate"] = _ratio(np.full(m, float(w)), pos), _ratio(total, pos)
    for name, mean, x in (("packet_size", "average_packet_size", size), ("inter_arrival_time", "mean_inter_arrival_time", gaps)):
        if wanted(mean, f"{name}_variance", f"{name}_std_dev", f"{name}_z_score"):
            out[mean], out[f"{name}_variance"] = x.moments[:2]
            out[f"{name}_std_dev"], out[f"{name}_z_score"] = np.sqrt(x.moments[1]), np.where(x.moments[1] > 0, 0.0, np.nan)
        if wanted(f"{name}_range"):
            out[f"{name}_range"] = x.x.max(1) - x.x.min(1)
        for k, share in enumerate((25, 50, 75)):
            if wanted(f"{name}_{share}th_percentile"):
                out[f"{name}_{share}th_percentile"] = x.quarters[k]
    if wanted("burst_count", "silence_count"):
        out["burst_count"], out["silence_count"] = (d < burst).sum(1), (d > silence).sum(1)
    if wanted("packet_size_entropy"):
        out["packet_size_entropy"] = entropy(v, flow_bins)
    if wanted("moving_linear_regression_slope"):
        at = view(t, w)
        c = at - at.mean(1, keepdims=True)
        spread = (c * c).sum(1)
        out["moving_linear_regression_slope"] = np.where(spread > 0, _ratio((c * (v - v.mean(1, keepdims=True))).sum(1), spread), 0.0)
    if wanted("exponential_moving_average"):
        weight = alpha * (1 - alpha) ** np.arange(w - 1, -1, -1.0)
        weight[0] = (1 - alpha) ** (w - 1)
        out["exponential_moving_average"] = v @ weight
    if wanted(*TEMPORAL[2:]):
        out |= _nested(a["size"].astype(float), gap, w, inner, m)
    if wanted(*PROTOCOL):
        sums = {k: view(a[k].astype(float), w).sum(1) for k in ("syn", "fin", "publish", "subscribe")}
        out["tcp_syn_to_fin_ratio"], out["mqtt_publish_subscribe_ratio"] = _ratio(sums["syn"], sums["fin"]), _ratio(sums["publish"], sums["subscribe"])
        out["qos_level_frequency"] = view(((a["qos"] >= 0) & (a["qos"] <= 2)).astype(float), w).mean(1)
    if want is not None and wanted(*QOS_LEVELS):
        out |= {name: view((a["qos"] == level).astype(float), w).mean(1) for level, name in enumerate(QOS_LEVELS)}
    for kind, x in (("", size), ("iat_", gaps), ("payload_", load)):
        out |= {f"{kind}{n}": x.statistic(n, bins) for n in _STATS if wanted(f"{kind}{n}")}
    return out


def _nested(v: np.ndarray, gap: np.ndarray, w: int, inner: int, m: int) -> dict[str, np.ndarray]:
    """Inner rolling statistics averaged over the inner windows wholly inside the outer one."""
    zero = np.zeros(m)
    if w < inner:
        return {n: zero for n in TEMPORAL[2:]}
    g, s = view(gap, inner - 1), view(v, inner)
    mean_s, mean_g = s.mean(1), g.mean(1)
    peak = np.where(mean_s > 0, _ratio(s.max(1), mean_s), 0.0)
    rate = np.where(g > 0, _ratio(np.ones(g.shape), g), 0.0)
    some = g.sum(1) > 0
    rate_mean, rate_max = np.where(some, _ratio(rate.sum(1), (g > 0).sum(1).astype(float)), 0.0), np.where(some, rate.max(1), 0.0)
    uneven = np.where(mean_g > 0, _ratio(g.std(1), mean_g), 0.0)
    k = w - inner + 1
    out = {"peak_to_average_ratio": view(peak, k).sum(1) / w, "packet_arrival_rate_mean": view(rate_mean, k).sum(1) / w, "packet_arrival_rate_max": view(rate_max, k).max(1), "time_gaps_between_events": view(uneven, k).sum(1) / w}
    out["rolling_variance_inter_arrival_times"] = view(view(gap, inner).var(1, ddof=1), w - inner).sum(1) / (w - 1) if w > inner else zero
    return out
