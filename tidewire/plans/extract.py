"""Extraction: captures to labelled feature rows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import ExtractConfig
from ..functions.columns import flow_id
from ..functions.kernels import FEATURES
from ..operators.gate import passing
from ..operators.labels import LABELS, has_label, with_labels
from ..operators.windows import extract
from ..sources.capture import PACKET_FIELDS, read_captures


def feature_rows(packets: DataFrame, cfg: ExtractConfig = ExtractConfig(), key: str = "file_name") -> DataFrame:
    """Labels, packet fields, features of both windows, flow ids, packet_count and timestamp of valid rows.

    ``packets``: rows of the capture source.  Captures without valid labels are left out.
    Captures are decoded once: labels come from each packet's file name, and the packet's own
    columns go through the window kernel with its features.
    """
    known = with_labels(packets, key)
    known = known.withColumn("_file", F.col("path") if "path" in packets.columns else F.col(key))
    places = [c for c in ("category", "process") if c in packets.columns]
    rows = extract(known, ("_file",), cfg, carry=[*LABELS, *PACKET_FIELDS.names, *places])
    flow = flow_id(F.col("source_ip_address"), F.col("source_port"), F.col("destination_ip_address"), F.col("destination_port"), F.col("is_mqtt"))
    rows = rows.withColumns({f"flow_id_{w}": flow for w in (cfg.small, cfg.large)})
    rows = passing(rows, (cfg.small, cfg.large))
    made = [f"{n}_{w}" for w in (cfg.small, cfg.large) for n in FEATURES]
    return rows.select(*LABELS, *PACKET_FIELDS.names, *[f"flow_id_{w}" for w in (cfg.small, cfg.large)], *made, "packet_count", (F.col("ts_us") / 1e6).alias("timestamp"), *places)


def run(spark: SparkSession, source: str, target: str, cfg: ExtractConfig = ExtractConfig(), most: int = -1) -> dict:
    """Read captures under ``source``, write Parquet by category and process to ``target``; returns counts, seconds and rate.

    packets, undecodable (packets that could not be decoded to their end), unlabelled (packets of captures without a valid name) and rows
    are observed by the job itself; the captures are read once.
    """
    began = time.perf_counter()
    seen, made = Observation(), Observation()
    packets = read_captures(spark, source, most)
    packets = packets.observe(seen, F.count(F.lit(1)).alias("packets"), F.coalesce(F.sum("decode_error"), F.lit(0)).alias("undecodable"), F.count_if(~has_label(F.col("file_name"))).alias("unlabelled"))
    rows = feature_rows(packets, cfg).observe(made, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("category", "process").parquet(target)
    took = time.perf_counter() - began
    return {**seen.get, **made.get, "seconds": took, "packets_per_second": seen.get["packets"] / took}
