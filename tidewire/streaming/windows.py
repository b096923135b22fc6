"""The window features over streams: a count window has no event time, so it is state.

The state of a capture is a list of its last packets, at least ``large - 1``, and a value: the number of the last packet, its time
and how many packets the list holds.  A batch adds its packets to the list; only when that is three windows long it
is cut.  A row's features are those of the batch operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import ExtractConfig
from ..functions.kernels import COUNTS, FEATURES, features

MEASURES = ["us", "size", "payload", "syn", "fin", "publish", "subscribe", "qos"]


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class WindowState(StatefulProcessor):
    """Keeps the last packets of a capture and gives the features of new ones with a full large window."""

    def __init__(self, cfg: ExtractConfig, windows: tuple[int, ...], idle_ms: int | None) -> None:
        self.cfg, self.windows, self.large, self.idle = cfg, windows, max(windows), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", ", ".join(f"{m} long" for m in MEASURES), self.idle)
        self.last = handle.getValueState("last", "packet_count long, us long, held long", self.idle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, _, size = (self.last.get() if self.last.exists() else None) or (0, 0, 0)
        new = pd.concat(list(rows)).sort_values("packet_count", kind="stable")
        new = new[new["packet_count"] > number]  # others have been seen
        if not len(new):
            return
        before = np.array(list(self.held.get()) if self.held.exists() else [], np.int64).reshape(-1, len(MEASURES))[-(self.large - 1) :]
        fresh = new[MEASURES].to_numpy(np.int64)
        both = np.concatenate([before, fresh])
        tail = both[-(self.large - 1) :] if self.large > 1 else both[:0]
        size += len(fresh)
        if self.idle is not None or size > 3 * self.large:  # with an end, all packets of the list end together
            self.held.put([tuple(map(int, r)) for r in tail])
            size = len(tail)
        else:
            self.held.appendList([tuple(map(int, r)) for r in fresh])
        self.last.update((int(new["packet_count"].iloc[-1]), int(both[-1][0]), size))
        first = max(self.large - 1, len(before))  # place of the first new row with a full window
        if first >= len(both):
            return
        measured = {m: both[:, k] for k, m in enumerate(MEASURES)}
        out = {"key": key[0], "packet_count": new["packet_count"].to_numpy()[first - len(before) :], "ts_us": measured["us"][first:]}
        c = self.cfg
        for w in self.windows:
            x = features({k: v[first - w + 1 :] for k, v in measured.items()}, w, c.inner, c.burst, c.silence, c.ema_alpha, c.flow_bins, c.entropy_bins)
            out |= {f"{n}_{w}": x[n].astype(np.int64) if n in COUNTS else x[n] for n in FEATURES}
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def stream_features(packets: DataFrame, key: str = "file_no", cfg: ExtractConfig = ExtractConfig(), windows: tuple[int, ...] | None = None, idle_seconds: float | None = None) -> DataFrame:
    """Features of packets with a full large window before them, on a streaming ``packets``.

    Packets whose number isn't above the last one seen of their capture have been seen, and are left out.  With ``idle_seconds``, the state of
    a capture that brings no packet for so long is gone, and a later packet begins a new window.
    State of this kind needs the RocksDB store, which is set for the session.
    """
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    windows = tuple(windows or (cfg.small, cfg.large))
    mqtt = F.col("is_mqtt") > 0
    kind = F.col("mqtt_message_type")
    named = lambda word, n: F.when(mqtt & (kind.isin(word, n) if cfg.message_numbers else kind == word), 1).otherwise(0)
    lean = packets.select(
        F.col(key).cast("string").alias("key"), "packet_count", F.col("ts_us").alias("us"), F.col("packet_size").cast("long").alias("size"), F.col("tcp_payload_size").cast("long").alias("payload"),
        F.col("tcp_syn_flag").cast("long").alias("syn"), F.col("tcp_fin_flag").cast("long").alias("fin"), named("PUBLISH", "3").cast("long").alias("publish"), named("SUBSCRIBE", "8").cast("long").alias("subscribe"), F.col("mqtt_qos_level").cast("long").alias("qos"),
    )
    names = [f"{n}_{w}" for w in windows for n in FEATURES]
    kinds = ["long" if n in COUNTS else "double" for _ in windows for n in FEATURES]
    schema = ", ".join(["key string", "packet_count long", "ts_us long", *(f"{n} {k}" for n, k in zip(names, kinds, strict=True))])

    idle = None if idle_seconds is None else int(idle_seconds * 1000)
    return lean.groupBy("key").transformWithStateInPandas(WindowState(cfg, windows, idle), schema, "Append", "none" if idle is None else "processingTime")
