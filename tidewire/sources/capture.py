"""Spark data source ``capture``: packet captures as rows, in batches and as a stream.

    spark.dataSource.register(CaptureSource)
    spark.read.format("capture").load("/data/raw/normal/order/*.pcapng")
    spark.readStream.format("capture").load("/data/raw")

The source reads a file in one task.  ``read_captures`` cuts long captures: a pass over the headers finds
where every so many packets begin, and each part is decoded by a task of its own.
"""

from __future__ import annotations

import itertools
import time
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

from ..errors import LoadingError
from ..functions.ordering import numbered
from .decode import DEFAULTS, Layout, decode_checked, packets, records

_KIND = {int: T.IntegerType(), float: T.DoubleType(), str: T.StringType()}
_LONG = {"tcp_sequence_number", "tcp_acknowledgment_number"}

PACKET_FIELDS = T.StructType([T.StructField(name, T.LongType() if name in _LONG else _KIND[type(v)]) for name, v in DEFAULTS.items()])
CAPTURE_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("packet_count", T.LongType()), T.StructField("ts_us", T.LongType()), *PACKET_FIELDS.fields, T.StructField("decode_error", T.IntegerType())])
INDEX_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("number", T.LongType()), T.StructField("packets", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("before_us", T.LongType()), T.StructField("layout", T.StringType())])

COUNT_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("packets", T.LongType())])
_BATCH = 4096
_ARROW = pa.schema([(f.name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[f.dataType.simpleString()]) for f in CAPTURE_SCHEMA])


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), path.removeprefix("file://")) if path.startswith(("/", "file://")) else pafs.FileSystem.from_uri(path)


def _decoded(path: str, found: Iterator[tuple[int, bytes]], number: int = 0, before: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of packets (time, bytes), the first of them ``number`` + 1."""
    while some := list(itertools.islice(found, _BATCH)):
        rows, whole = zip(*[decode_checked(raw, us / 1e6) for us, raw in some], strict=True)
        us = np.array([x for x, _ in some], np.int64)
        gaps = np.diff(us, prepend=us[0] if before is None else before) / 1e6
        columns = {k: [r[k] for r in rows] for k in DEFAULTS} | {"inter_arrival_time": gaps, "decode_error": [int(not ok) for ok in whole]}
        own = {"path": [path] * len(some), "file_name": [path.rpartition("/")[2]] * len(some), "packet_count": np.arange(number + 1, number + len(some) + 1), "ts_us": us}
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((own | columns).values(), _ARROW, strict=True)], schema=_ARROW)
        before, number = int(us[-1]), number + len(some)


def list_files(paths: list[str], most: int = -1) -> list[tuple[str, int]]:
    """Path and time of the last change, in microseconds, of the captures of files, folders and patterns, by path."""
    import fnmatch

    found = {}
    for pattern in paths:
        fs, path = _open(pattern)
        fixed = path.split("*")[0].rpartition("/")[0] if "*" in path else path
        info = fs.get_file_info(fixed)
        if info.type == pafs.FileType.File:
            found[pattern] = (info.mtime_ns or 0) // 1000
        elif info.type == pafs.FileType.Directory:
            scheme = pattern[: pattern.index(path)] if path in pattern else ""
            glob = path if "*" in path else f"{path}/*.pcap*"
            found |= {scheme + f.path: (f.mtime_ns or 0) // 1000 for f in fs.get_file_info(pafs.FileSelector(fixed, recursive=True)) if f.type == pafs.FileType.File and fnmatch.fnmatch(f.path, glob)}
        else:
            raise LoadingError(f"no such path: {pattern}")
    out, place = [], Counter()
    for p in sorted(found):
        place[folder := p.rpartition("/")[0]] += 1
        if most < 0 or place[folder] <= most:
            out.append((p, found[p]))
    return out


def _whole(path: str) -> Iterator[pa.RecordBatch]:
    fs, name = _open(path)
    with fs.open_input_stream(name) as stream:
        yield from _decoded(path, packets(stream))


class CaptureReader(DataSourceReader):
    """Reads the files of one path or pattern in arrival order."""

    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.most = int(options.get("maxfiles", -1))
        self.count_only = options.get("countonly", "false").lower() == "true"
        self.index_every = int(options.get("indexevery", 0))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p, _ in list_files(self.paths, self.most)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path = partition.value
        if not (self.count_only or self.index_every):
            yield from _whole(path)
            return
        fs, name = _open(path)
        with fs.open_input_file(name) as stream:
            n, starts, before = 0, [], None
            for offset, us, _, layout in records(stream, headers=True):
                if self.index_every and n % self.index_every == 0:
                    starts.append((n, offset, before, layout.text()))
                n, before = n + 1, us
        if self.count_only:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "packets"])
        else:
            number, offset, before_us, layouts = (list(x) for x in zip(*starts, strict=True)) if starts else ([], [], [], [])
            size = np.diff([*number, n])
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(([path] * len(number), number, size, offset, before_us, layouts), kinds, strict=True)], INDEX_SCHEMA.names)


class CaptureStream(DataSourceStreamReader):
    """New captures of a folder, each exactly once.

    The offset is the (time of the last change, path) of the last file taken, so it doesn't grow with the files.  Captures must
    arrive whole, by a move, and with rising times; those younger than ``settleSeconds`` wait,
    so that files of one moment are not parted by a batch.
    """

    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.settle = float(options.get("settleseconds", 0))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = [(t, p) for p, t in list_files(self.paths) if t <= (time.time() - self.settle) * 1e6]
        last, path = max(found, default=(-1, ""))
        return {"time": last, "path": path}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        lo, hi = ((x["time"], x["path"]) for x in (start, end))
        return [InputPartition(p) for p, t in list_files(self.paths) if lo < (t, p) <= hi]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from _whole(partition.value)


class CaptureSource(DataSource):
    """``path``: a file, a folder or a pattern; ``maxFiles``: the first so many of each folder by name, -1 for all.

    With ``countOnly``, a row for each file with the number of its packets; with ``indexEvery``, a row for
    every so many packets with where they begin.  Neither decodes packets.
    """

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> T.StructType:
        options = {k.lower(): v for k, v in self.options.items()}
        if int(options.get("indexevery", 0)):
            return INDEX_SCHEMA
        return COUNT_SCHEMA if options.get("countonly", "false").lower() == "true" else CAPTURE_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return CaptureReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return CaptureStream({k.lower(): v for k, v in self.options.items()})


def _placed(rows: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return rows.withColumns({"category": F.element_at(parts, -3), "process": F.element_at(parts, -2)})


def index_captures(spark: SparkSession, path: str, every: int, most: int = -1) -> DataFrame:
    """path, number (packets before), packets, offset, before_us and layout of each part of ``every`` packets."""
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").option("maxFiles", str(most)).option("indexEvery", str(every)).load(path)


def read_captures(spark: SparkSession, path: str, most: int = -1, every: int = 200_000) -> DataFrame:
    """Packets of all captures under ``path``, with category and process taken from the folders.

    A capture of over ``every`` packets is read by several tasks, after a pass over its headers; packet numbers and
    distances are those of the whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, name = _open(r["path"])
                with fs.open_input_file(name) as stream:
                    stream.seek(r["offset"])
                    found = records(stream, Layout.of(r["layout"]), r["offset"])
                    yield from _decoded(r["path"], ((us, raw) for _, us, raw, _ in itertools.islice(found, r["packets"])), r["number"], r["before_us"])

    index = index_captures(spark, path, every, most)
    return _placed(index.repartition("path", "number").mapInArrow(run, CAPTURE_SCHEMA))


def stream_captures(spark: SparkSession, path: str, settle_seconds: float = 0) -> DataFrame:
    """The packets of captures as they arrive under ``path``, as a stream."""
    spark.dataSource.register(CaptureSource)
    return _placed(spark.readStream.format("capture").option("settleSeconds", str(settle_seconds)).load(path))


def count_packets(spark: SparkSession, path: str, most: int = -1) -> DataFrame:
    """path and packets of all captures under ``path``."""
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").option("maxFiles", str(most)).option("countOnly", "true").load(path)


def micros(rows: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone counts as UTC, whatever the session's zone."""
    if dict(rows.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"CAST(CAST(CAST(`{column}` - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(18, 6)) * 1000000 AS BIGINT)")
    return F.unix_micros(column)


def packet_view(events: DataFrame, files: int = 4) -> DataFrame:
    """``events`` read as packets: users are dealt to ``files`` captures, in the order of time.

    packet_count is the row's number in its capture.  A long capture is numbered in pieces of
    time, so no task sees it whole; captures read from files bring their numbers.
    """
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = events.select(
        (F.col("user_id") % files).cast("int").alias("file_no"), "event_id", micros(events, "ts").alias("ts_us"),
        F.round(F.col("value") * 100).cast("long").alias("packet_size"), F.coalesce(k, F.lit(0)).alias("tcp_payload_size"),
        kind.isin("click", "view", "purchase").cast("int").alias("is_mqtt"),
        F.coalesce(F.when(kind == "click", "3").when(kind == "view", "8").when(kind == "purchase", "1"), F.lit("")).alias("mqtt_message_type"),
        (F.coalesce(k, F.lit(0)) % 4).alias("mqtt_qos_level"), (kind == "signup").cast("int").alias("tcp_syn_flag"), (kind == "error").cast("int").alias("tcp_fin_flag"),
    )
    return numbered(rows, ["file_no"], ["ts_us", "event_id"]).withColumn("packet_count", F.col("_n") + 1).drop("_n")


def gap_seconds(partition: list[str]) -> Column:
    """Seconds since the packet before; null for the first one."""
    w = Window.partitionBy(*partition).orderBy("packet_count")
    return (F.col("ts_us") - F.lag("ts_us").over(w)) / 1e6
