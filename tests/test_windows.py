"""Window features: a worked example, edges, blocks, native frames and streams."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.config import ExtractConfig
from tidewire.functions.kernels import FEATURES, features
from tidewire.operators import gate, windows
from tidewire.streaming.windows import stream_features


def arrays(size, us):
    zero = np.zeros(len(size), np.int64)
    return {"size": np.asarray(size, np.int64), "us": np.asarray(us, np.int64), **{k: zero for k in ("payload", "syn", "fin", "publish", "subscribe", "qos")}}


RAMP = {
    "flow_duration": 0.495, "total_packets": 100, "total_bytes": 5050, "packet_rate": 202.0202020202, "byte_rate": 10202.0202020202, "average_packet_size": 50.5, "packet_size_variance": 833.25,
    "packet_size_std_dev": 28.8660700477, "packet_size_range": 99, "packet_size_25th_percentile": 25, "packet_size_50th_percentile": 50, "packet_size_75th_percentile": 75, "interquartile_range": 50,
    "burst_count": 99, "silence_count": 0, "packet_size_entropy": 5.6438561898, "rolling_entropy": 3.3219280949, "coefficient_of_variation": 0.5716053475, "moving_range": 1.0, "skewness": 0.0,
    "kurtosis": -1.2002400240, "moving_linear_regression_slope": 200.0, "exponential_moving_average": 91.0002656140, "peak_to_average_ratio": 1.0197470329, "packet_arrival_rate_mean": 162.0, "packet_arrival_rate_max": 200.0,
}


def test_worked_example():
    got = features(arrays(range(1, 101), np.arange(100) * 5000), 100)
    for name, want in RAMP.items():
        assert got[name][0] == pytest.approx(want, rel=1e-9, abs=1e-9), name
    assert abs(got["rolling_variance_inter_arrival_times"][0]) < 1e-9 and abs(got["time_gaps_between_events"][0]) < 1e-9


def test_constant_lengths_and_equal_times():
    got = features(arrays([7] * 60, [5] * 60), 50)
    for name in ("packet_size_variance", "coefficient_of_variation", "interquartile_range", "skewness", "kurtosis", "packet_size_entropy", "flow_duration", "packet_rate", "byte_rate", "moving_linear_regression_slope", "packet_arrival_rate_mean", "time_gaps_between_events", "tcp_syn_to_fin_ratio"):
        assert (got[name] == 0).all(), name
    assert (got["burst_count"] == 49).all() and len(got["burst_count"]) == 11


def test_bursts_and_silences_are_strict():
    got = features(arrays([1] * 5, [0, 10_000, 110_000, 210_001, 205_000]), 5)
    assert got["burst_count"][0] == 1 and got["silence_count"][0] == 1


def stream_of_packets(spark, counts, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for f, n in enumerate(counts):
        t = np.cumsum(rng.integers(-200, 300_000, n))
        for k in range(n):
            rows.append((f, k + 1, int(t[k]), int(rng.integers(40, 1500)), int(rng.integers(0, 900)), int(rng.random() < 0.1), int(rng.random() < 0.1), int(rng.random() < 0.7), str(rng.choice(["3", "8", "1"])), int(rng.integers(0, 4))))
    return spark.createDataFrame(rows, "file_no int, packet_count long, ts_us long, packet_size int, tcp_payload_size int, tcp_syn_flag int, tcp_fin_flag int, is_mqtt int, mqtt_message_type string, mqtt_qos_level int").repartition(4)


CFG = ExtractConfig(small=20, large=60)


def as_dict(df):
    names = [f"{n}_{w}" for w in (20, 60) for n in FEATURES]
    key = "file_no" if "file_no" in df.columns else "key"
    return {(int(r[key]), r["packet_count"]): np.array([np.nan if r[n] is None else float(r[n]) for n in names]) for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys() and a
    for k in a:
        assert np.allclose(a[k], b[k], rtol=1e-9, atol=1e-9, equal_nan=True), k


def test_blocks_do_not_change_results_and_files_do_not_mix(spark):
    packets = stream_of_packets(spark, [150, 59, 60, 97])
    whole = as_dict(windows.extract(packets, ("file_no",), CFG))
    assert sorted(whole) == [(0, k) for k in range(60, 151)] + [(2, 60)] + [(3, k) for k in range(60, 98)]
    small = ExtractConfig(small=20, large=60, block=13)
    same(whole, as_dict(windows.extract(packets, ("file_no",), small)))


def test_native_frames_agree_with_the_kernel(spark):
    packets = stream_of_packets(spark, [90, 70], seed=3)
    names = ["average_packet_size", "packet_size_50th_percentile", "packet_size_entropy", "exponential_moving_average", "moving_linear_regression_slope", "rolling_variance_inter_arrival_times", "packet_arrival_rate_max", "kurtosis", "burst_count", "mqtt_publish_subscribe_ratio"]
    a = {(r[0], r[1]): list(r)[2:] for r in windows.native(packets, 20, names, cfg=CFG, full=60).select("file_no", "packet_count", *[f"{n}_20" for n in names]).collect()}
    b = {(r[0], r[1]): list(r)[2:] for r in windows.extract(packets, ("file_no",), CFG).select("file_no", "packet_count", *[f"{n}_20" for n in names]).collect()}
    assert a.keys() == b.keys() and a
    for k in a:
        assert np.allclose(a[k], b[k], rtol=1e-8, atol=1e-8), k


def started(spark, packets, folder, **options):
    read = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    return stream_features(read, cfg=CFG, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def give(packets, folder, part, lo, hi):
    packets.where((F.col("packet_count") > lo) & (F.col("packet_count") <= hi)).coalesce(1).write.parquet(f"{folder}/in/{part}")


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    """The second start goes on from the checkpoint; lists of state are cut on the way, and a batch is given twice."""
    packets = stream_of_packets(spark, [330, 80])
    for part in range(3):
        give(packets, tmp_path, part, part * 50, (part + 1) * 50)
    assert started(spark, packets, tmp_path).awaitTermination(240)
    give(packets, tmp_path, "again", 100, 150)
    give(packets, tmp_path, 3, 150, 300)
    give(packets, tmp_path, 4, 300, 330)
    assert started(spark, packets, tmp_path).awaitTermination(240)
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.count() == found.select("key", "packet_count").distinct().count()
    same(as_dict(found), as_dict(windows.extract(packets, ("file_no",), CFG)))
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/state")
    assert held.where("key.key = '0'").count() <= 3 * CFG.large and held.count()


def test_state_of_an_idle_capture_is_gone(spark, tmp_path):
    """A query whose state can end runs until it is stopped."""
    packets = stream_of_packets(spark, [150])
    (tmp_path / "out").mkdir()
    found = lambda: spark.read.schema("key string, packet_count long").parquet(f"{tmp_path}/out")

    def until(n):
        end = time.time() + 90
        while found().count() < n and time.time() < end:
            time.sleep(0.5)

    give(packets, tmp_path, 0, 0, 70)
    read = spark.readStream.schema(packets.schema).parquet(f"{tmp_path}/in/*")
    q = stream_features(read, cfg=CFG, idle_seconds=2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        until(11)
        time.sleep(3)
        give(packets, tmp_path, 1, 70, 150)
        until(32)
    finally:
        q.stop()
    got = as_dict(spark.read.parquet(f"{tmp_path}/out"))
    assert sorted(k for _, k in got) == [*range(60, 71), *range(130, 151)]
    whole = as_dict(windows.extract(packets, ("file_no",), CFG))
    same(got, {k: whole[k] for k in got})


def test_gate_drops_rows_that_are_not_finite(spark):
    rows = windows.extract(stream_of_packets(spark, [80]), ("file_no",), CFG)
    assert gate.passing(rows, (20, 60)).count() == rows.count() == 21
    odd = rows.withColumn("packet_rate_20", F.when(F.col("packet_count") == 60, F.lit(float("nan"))).when(F.col("packet_count") == 61, F.lit(float("inf"))).otherwise(F.col("packet_rate_20")))
    assert gate.passing(odd, (20, 60)).count() == 19


def test_small_window_must_not_be_longer():
    with pytest.raises(ValueError):
        ExtractConfig(small=10, large=5)
