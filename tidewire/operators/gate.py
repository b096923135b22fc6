"""Validity gates: which feature rows are whole enough to be written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.kernels import PROTOCOL, STATISTICAL, TEMPORAL

#: Flow features that a row must have.
FLOW_GATED = ["flow_duration", "total_packets", "total_bytes", "packet_rate", "byte_rate", "average_packet_size", "packet_size_variance", "mean_inter_arrival_time", "burst_count", "silence_count"]

GROUPS = {"flow": FLOW_GATED, "temporal": TEMPORAL, "protocol": PROTOCOL, "statistical": STATISTICAL}


def valid(windows: tuple[int, ...] = (100, 500), groups: tuple[str, ...] = tuple(GROUPS)) -> Column:
    """True where every gated feature of ``groups`` is a finite number, for all windows."""
    return reduce(lambda a, b: a & b, [finite(F.col(f"{n}_{w}").cast("double")) for g in groups for n in GROUPS[g] for w in windows])


def passing(rows: DataFrame, windows: tuple[int, ...] = (100, 500)) -> DataFrame:
    out = rows.where(valid(windows))
    ids = [f"flow_id_{w}" for w in windows if f"flow_id_{w}" in rows.columns]
    return reduce(lambda d, c: d.where(F.col(c).isNotNull()), ids, out)
