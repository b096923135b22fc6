"""Captures, labels and feature files."""

import io
import struct

import pytest

from tidewire.errors import LoadingError
from tidewire.operators.labels import file_labels
from tidewire.sources import feature_files
from tidewire.sources.capture import count_packets, read_captures
from tidewire.sources.decode import decode, packets

NAMES = {
    "Anomalous_Order_Blue-009.pcapng": (1, 1, 2, 2, 609), "Anomalous_Stock_White-060.pcapng": (1, 0, 1, 14, 960), "Normal_Stock_Red-007.pcapng": (0, 0, 0, 0, 407),
    "Anomalous_Order_Red-034.pcapng": (1, 1, 0, 8, 694), "Anomalous_Order2_Blue-009.pcapng": None, "badname.pcapng": None, "Normal_Order_Blue-000.pcapng": None,
}


def test_file_labels(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "file_name string")
    got = {r["file_name"]: (r["label_1"], r["label_2"], r["label_3"], r["label_4"], r["file_id"]) for r in file_labels(df).collect()}
    assert got == {k: v for k, v in NAMES.items() if v}


def tcp(payload, sport=50_000, dport=1883, flags=0x18):
    head = struct.pack(">HHIIBBHHH", sport, dport, 7, 9, 5 << 4, flags, 512, 0, 0)
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 40 + len(payload), 1, 0, 64, 6, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
    return b"\xaa" * 6 + b"\xbb" * 6 + b"\x08\x00" + ip + head + payload


PUBLISH = bytes([0x3B, 2 + 3 + 2 + 5]) + struct.pack(">H", 3) + b"a/b" + struct.pack(">H", 1) + b"hello"


def test_decode_fields():
    got = decode(tcp(PUBLISH), 1.5)
    assert (got["source_ip_address"], got["destination_ip_address"], got["source_port"], got["destination_port"]) == ("10.0.0.1", "10.0.0.2", 50_000, 1883)
    assert (got["tcp_psh_flag"], got["tcp_ack_flag"], got["tcp_syn_flag"]) == (1, 1, 0)
    assert (got["is_mqtt"], got["mqtt_qos_level"], got["mqtt_dup_flag"], got["mqtt_retain_flag"], got["mqtt_topic"], got["mqtt_payload_size"]) == (1, 1, 1, 1, "a/b", 5)
    assert got["tcp_payload_size"] == len(PUBLISH)
    assert decode(tcp(PUBLISH, dport=80))["is_mqtt"] == 0
    assert decode(b"")["is_mqtt"] == 0 and decode(b"\x00" * 30)["source_port"] == 0


def pcap(rows):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    return out + b"".join(struct.pack("<IIII", us // 10**6, us % 10**6, len(raw), len(raw)) + raw for us, raw in rows)


def pcapng(rows):
    def block(kind, body):
        body += b"\x00" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    return out + b"".join(block(6, struct.pack("<IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(raw), len(raw)) + raw) for us, raw in rows)


ROWS = [(1_700_000_000_000_000 + k * 1500, tcp(PUBLISH, sport=40_000 + k)) for k in range(5)]


@pytest.mark.parametrize("build", [pcap, pcapng])
def test_both_capture_formats(build):
    assert list(packets(io.BytesIO(build(ROWS)))) == ROWS


def test_capture_source(spark, tmp_path):
    for kind, process, name in (("Normal", "Order", "Normal_Order_Blue-001.pcapng"), ("Anomalous", "Stock", "Anomalous_Stock_Red-002.pcapng")):
        folder = tmp_path / kind / process
        folder.mkdir(parents=True)
        (folder / name).write_bytes(pcapng(ROWS))
    df = read_captures(spark, str(tmp_path))
    rows = df.orderBy("file_name", "packet_count").collect()
    assert len(rows) == 10 and [r["packet_count"] for r in rows] == [1, 2, 3, 4, 5] * 2
    assert rows[0]["inter_arrival_time"] == 0 and rows[1]["inter_arrival_time"] == pytest.approx(0.0015)
    (tmp_path / "Normal" / "Order" / "Normal_Order_Blue-002.pcapng").write_bytes(pcapng(ROWS))
    assert read_captures(spark, str(tmp_path)).count() == 15
    assert read_captures(spark, str(tmp_path), 1).count() == 10
    assert sorted(r["packets"] for r in count_packets(spark, str(tmp_path)).collect()) == [5, 5, 5]


def test_json_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "Normal"), (2, None, "Normal"), (3, 2.5, "Odd")], "file_id int, x double, category string")
    made = feature_files.write_json(df, str(tmp_path / "out"), ("category",))
    assert sum(r["rows"] for r in made.collect()) == 3
    back = feature_files.read_json(spark, str(tmp_path / "out"), df.schema)
    assert sorted((r["file_id"], r["x"]) for r in back.collect()) == [(1, 0.5), (2, None), (3, 2.5)]


def test_feature_schema_has_145_columns():
    assert len(feature_files.feature_schema().names) == len(set(feature_files.feature_schema().names)) == 145


def test_missing_paths_are_refused(spark, tmp_path):
    with pytest.raises(LoadingError):
        feature_files.validate(spark, [str(tmp_path / "nothing")])


def test_packets_of_over_960_captures_keep_their_labels(spark):
    from tidewire.operators.labels import label_packets

    names = [f"Normal_Order_Blue-{k:03d}{end}" for k in range(1, 101) for end in (".pcap", ".pcapng", *[f"_{x}.pcapng" for x in range(10)])]
    packets = spark.createDataFrame([(n, k) for n in names for k in range(2)], "file_name string, seq int")
    got = label_packets(packets, file_labels(packets.select("file_name").distinct())).collect()
    assert len(names) == 1200 and len(got) == 2400
    assert {(r["file_name"], r["seq"]): r["file_id"] for r in got} == {(n, k): int(n[18:21]) for n in names for k in range(2)}


def test_fields_found_before_an_error_stay():
    whole = tcp(PUBLISH)
    cut = decode(whole[:40])
    assert (cut["source_ip_address"], cut["source_mac_address"], cut["source_port"]) == ("10.0.0.1", "bb:bb:bb:bb:bb:bb", 0)
    broken = decode(tcp(bytes([0x82, 3]) + b"\x00\x01\x00"))
    assert broken["is_mqtt"] == 1 and broken["source_port"] == 50_000


CONNECT = bytes([0x10, 12]) + struct.pack(">H", 4) + b"MQTT" + bytes([4, 0b00110110]) + struct.pack(">HH", 60, 0)
SUBSCRIBE = bytes([0x82, 8]) + struct.pack(">HH", 9, 3) + b"x/y" + bytes([2])
UNSUBSCRIBE = bytes([0xA2, 7]) + struct.pack(">HH", 9, 3) + b"p/q"


def test_decode_of_other_messages():
    got = decode(tcp(CONNECT), 2.0)
    assert (got["mqtt_message_type"], got["mqtt_clean_session_flag"], got["mqtt_will_flag"], got["mqtt_will_qos"], got["mqtt_will_retain"], got["mqtt_message_timestamp"]) == ("1", 1, 1, 2, 1, 2.0)
    got = decode(tcp(SUBSCRIBE))
    assert (got["mqtt_message_type"], got["mqtt_topic"], got["mqtt_qos_level"]) == ("8", "x/y", 2)
    assert decode(tcp(UNSUBSCRIBE))["mqtt_topic"] == "p/q"


def test_extraction_from_captures_to_145_columns(spark, tmp_path):
    """Whole captures against a loop over single windows."""
    import numpy as np

    from tidewire.config import ExtractConfig
    from tidewire.functions.kernels import FEATURES, features
    from tidewire.plans import extract

    rng = np.random.default_rng(3)
    cfg = ExtractConfig(small=20, large=30, block=17)
    kept = {}
    for kind, process, name, n in (("Normal", "Order", "Normal_Order_Blue-001.pcapng", 75), ("Anomalous", "Stock", "Anomalous_Stock_Red-002.pcap", 31), ("Normal", "Order", "badname.pcap", 40), ("Normal", "Stock", "Normal_Stock_Red-003.pcap", 29)):
        folder = tmp_path / "in" / kind / process
        folder.mkdir(parents=True, exist_ok=True)
        us = 1_700_000_000_000_000 + np.cumsum(rng.integers(500, 150_000, n))
        rows = [(int(t), tcp([PUBLISH, SUBSCRIBE, CONNECT, b"x" * int(rng.integers(0, 200))][int(rng.integers(0, 4))], sport=40_000 + k, flags=int(rng.integers(0, 256)))) for k, t in enumerate(us)]
        (folder / name).write_bytes((pcapng if name.endswith("ng") else pcap)(rows))
        if n >= 30 and name[0] != "b":
            kept[name[:5]] = [(t, decode(raw, t / 1e6)) for t, raw in rows]
    made = extract.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), cfg)
    assert made["packets"] == 175 and made["rows"] == 46 + 2 and made["seconds"] > 0
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got[0]) == 145 + 2  # and the two folders
    for r in got:
        packets_ = kept["Norma" if r["label_1"] == 0 else "Anoma"]
        k = r["packet_count"]
        t, own = packets_[k - 1]
        assert all(r[f] == v for f, v in own.items() if f != "inter_arrival_time")
        assert r["inter_arrival_time"] == pytest.approx((t - packets_[k - 2][0]) / 1e6) and r["timestamp"] == pytest.approx(t / 1e6)
        assert (r["file_id"], r["category"]) == ((1, "Normal") if r["label_1"] == 0 else (842, "Anomalous"))
        for w in (20, 30):
            part = packets_[k - w : k]
            named = lambda n: np.array([p["mqtt_message_type"] == n and p["is_mqtt"] for _, p in part], int)  # noqa: E731, B023
            a = {"size": np.array([p["packet_size"] for _, p in part]), "us": np.array([x for x, _ in part]), "payload": np.array([p["tcp_payload_size"] for _, p in part]), "syn": np.array([p["tcp_syn_flag"] for _, p in part]), "fin": np.array([p["tcp_fin_flag"] for _, p in part]), "publish": named("3"), "subscribe": named("8"), "qos": np.array([p["mqtt_qos_level"] for _, p in part])}
            one = features(a, w)
            for f in FEATURES:
                assert (r[f"{f}_{w}"] is None and np.isnan(one[f][0])) or r[f"{f}_{w}"] == pytest.approx(one[f][0], rel=1e-9, abs=1e-9), f


def test_a_capture_in_many_parts_gives_the_rows_of_one(spark, tmp_path):
    from tidewire.sources.capture import CaptureSource, index_captures

    rng = __import__("random").Random(2)
    rows = [(1_700_000_000_000_000 + k * 700 + rng.randrange(500), tcp(PUBLISH + b"x" * rng.randrange(50), sport=40_000 + k)) for k in range(97)]
    (tmp_path / "a.pcapng").write_bytes(pcapng(rows))
    (tmp_path / "b.pcap").write_bytes(pcap(rows[:40]))
    (tmp_path / "c.pcap").write_bytes(pcap([]))
    spark.dataSource.register(CaptureSource)
    whole = spark.read.format("capture").load(str(tmp_path)).orderBy("path", "packet_count").collect()
    assert len(whole) == 137
    for every in (1, 10, 97, 1_000):
        index = index_captures(spark, str(tmp_path), every).collect()
        assert sum(r["packets"] for r in index) == 137 and len(index) == -(-97 // every) + -(-40 // every)
        parts = read_captures(spark, str(tmp_path), every=every).drop("category", "process").orderBy("path", "packet_count").collect()
        assert parts == whole


def test_a_packet_cut_off_at_the_end_is_left_out(spark, tmp_path):
    for build in (pcap, pcapng):
        for cut in (3, 9, 60):
            assert [us for us, _ in packets(io.BytesIO(build(ROWS)[:-cut]))] == [us for us, _ in ROWS[: 4 if build is pcap or cut > 4 else 5]]
    (tmp_path / "a.pcap").write_bytes(pcap(ROWS)[:-3])
    assert read_captures(spark, str(tmp_path), every=2).count() == count_packets(spark, str(tmp_path)).first()["packets"] == 4


def test_new_captures_are_streamed_once(spark, tmp_path):
    import os

    from tidewire.sources.capture import stream_captures

    (tmp_path / "in").mkdir()

    def arrive(name, n, at):
        (tmp_path / "in" / name).write_bytes(pcapng(ROWS[:n]))
        os.utime(tmp_path / "in" / name, (at, at))

    def run():
        q = stream_captures(spark, str(tmp_path / "in")).select("file_name", "packet_count").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted((r[0], r[1]) for r in spark.read.schema("file_name string, packet_count long").parquet(str(tmp_path / "out")).collect())

    arrive("b.pcapng", 3, 1_000)
    arrive("a.pcapng", 2, 1_001)
    first = run()
    assert first == [("a.pcapng", 1), ("a.pcapng", 2), ("b.pcapng", 1), ("b.pcapng", 2), ("b.pcapng", 3)]
    assert run() == first  # nothing new after a restart
    arrive("0.pcapng", 1, 1_002)
    arrive("c.pcapng", 2, 1_002)
    assert run() == sorted([*first, ("0.pcapng", 1), ("c.pcapng", 1), ("c.pcapng", 2)])


def test_bad_lines_are_counted(spark, tmp_path):
    from pyspark.sql import Observation

    df = spark.createDataFrame([(k, k / 2) for k in range(6)], "file_id int, x double")
    feature_files.write_json(df, str(tmp_path / "out"))
    (tmp_path / "out" / "more.jsonl").write_text('{"file_id": 9, "x": 1.5}\n{"file_id": 10, "x"\nno json\n')
    seen = Observation()
    back = feature_files.read_json(spark, str(tmp_path / "out"), df.schema, seen)
    assert sorted(r["file_id"] for r in back.collect()) == [0, 1, 2, 3, 4, 5, 9]
    assert seen.get == {"lines": 9, "bad_lines": 2}


def test_a_place_is_written_by_many_tasks_and_a_failure_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(400).select(F.col("id").cast("int").alias("file_id"), F.lit("all").alias("category"))
    made = feature_files.write_json(rows, str(tmp_path / "out"), ("category",)).collect()
    assert len(made) > 2 and sum(r["rows"] for r in made) == 400
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["_manifest", "all"]
    broken = rows.withColumn("x", F.when(F.col("file_id") == 399, F.raise_error(F.lit("broken"))).otherwise(F.lit(1)))
    with pytest.raises(Exception, match="broken"):
        feature_files.write_json(broken, str(tmp_path / "out"), ("category",))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["_manifest", "all"]
    assert feature_files.read_json(spark, str(tmp_path / "out"), rows.select("file_id").schema).count() == 400


def test_extraction_counts_what_it_leaves_out(spark, tmp_path):
    from tidewire.config import ExtractConfig
    from tidewire.plans import extract

    folder = tmp_path / "in" / "Normal" / "Order"
    folder.mkdir(parents=True)
    rows = [(1_700_000_000_000_000 + k * 1500, tcp(PUBLISH, sport=40_000 + k)) for k in range(40)]
    rows[3], rows[30] = (rows[3][0], rows[3][1][:40]), (rows[30][0], rows[30][1][:36])
    (folder / "Normal_Order_Blue-001.pcapng").write_bytes(pcapng(rows))
    (folder / "odd.pcapng").write_bytes(pcapng(rows[:7]))
    got = extract.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), ExtractConfig(small=5, large=20))
    assert (got["packets"], got["undecodable"], got["unlabelled"]) == (47, 3, 7)
    assert got["rows"] == spark.read.parquet(str(tmp_path / "out")).count() == 21 and got["packets_per_second"] > 0
