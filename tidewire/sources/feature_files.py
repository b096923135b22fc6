"""Feature rows on disk: JSON lines under Zstandard for exchange, Parquet inside."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..errors import LoadingError
from ..functions.kernels import COUNTS, FEATURES
from .capture import PACKET_FIELDS


def feature_schema(windows: tuple[int, ...] = (100, 500)) -> T.StructType:
    """The 145 columns: labels, packet fields, window features and row data."""
    fields = [T.StructField(n, T.IntegerType()) for n in ("label_1", "label_2", "label_3", "label_4", "file_id")] + list(PACKET_FIELDS.fields)
    for w in windows:
        fields.append(T.StructField(f"flow_id_{w}", T.StringType()))
        fields += [T.StructField(f"{n}_{w}", T.LongType() if n in COUNTS else T.DoubleType()) for n in FEATURES]
    return T.StructType([*fields, T.StructField("packet_count", T.LongType()), T.StructField("timestamp", T.DoubleType())])


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, observed: Observation | None = None) -> DataFrame:
    """JSON lines, compressed or not; lines that can't be parsed are left out.

    ``observed`` gets ``lines`` and ``bad_lines`` from the job that reads the rows.
    """
    schema = schema or feature_schema()
    lines = spark.read.option("pathGlobFilter", "*.jsonl*").option("recursiveFileLookup", "true").text(path)
    bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = lines.select(F.from_json("value", bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    wrong = F.col("r").isNull() | F.col("r._bad").isNotNull()
    if observed is not None:
        rows = rows.observe(observed, F.count(F.lit(1)).alias("lines"), F.count_if(wrong).alias("bad_lines"))
    return rows.where(~wrong).select(*[F.col(f"r.`{c}`").alias(c) for c in schema.names])


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: where they wait, where they belong, and their rows."""

    files: list[tuple[str, str, int]]


class LinesWriter(DataSourceArrowWriter):
    """Writes (place, line) rows to a staging folder; a commit moves the files of the tasks that count into their places.

    Staging folders begin with ``_``, which readers pass over; an abort, and a commit in the end, removes its own.
    """

    def __init__(self, folder: str, level: int, run: str) -> None:
        self.folder, self.level, self.run = folder, level, run

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return _filesystem(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import zstandard

        fs, base = self._fs()
        staging = f"{base}/_staging-{self.run}"
        fs.create_dir(staging, recursive=True)
        done: list[tuple[str, str, int]] = []
        out, here, count, name = None, None, 0, ""

        def close() -> None:
            if out is not None:
                out.close()
                done.append((f"{staging}/{name}", f"{base}/{here}/{name}".replace("//", "/"), count))

        for batch in iterator:
            for place, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if place != here or out is None:
                    close()
                    name, here, count = f"{uuid.uuid4().hex}.jsonl.zst", place, 0
                    out = zstandard.ZstdCompressor(level=self.level).stream_writer(fs.open_output_stream(f"{staging}/{name}", compression=None))
                out.write(line.encode() + b"\n")
                count += 1
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = self._fs()
        files = [f for m in messages if m is not None for f in m.files]
        for place in {to.rpartition("/")[0] for _, to, _ in files}:
            fs.create_dir(place, recursive=True)
        for at, to, _ in files:
            fs.move(at, to)
        fs.create_dir(f"{base}/_manifest", recursive=True)
        with fs.open_output_stream(f"{base}/_manifest/{self.run}.json") as out:
            out.write("".join(json.dumps({"path": to, "rows": n}) + "\n" for _, to, n in files).encode())
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = self._fs()
        if fs.get_file_info(f"{base}/_staging-{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/_staging-{self.run}")


class LinesSink(DataSource):
    """Spark data source ``jsonl_zst``: a sink for rows of place and line."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_zst"

    def schema(self) -> str:
        return "place string, line string"

    def writer(self, schema: T.StructType, overwrite: bool) -> LinesWriter:
        return LinesWriter(self.options["path"], int(self.options.get("level", 3)), self.options["run"])


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), path.removeprefix("file://")) if path.startswith(("/", "file://")) else pafs.FileSystem.from_uri(path)


def write_json(rows: DataFrame, folder: str, by: tuple[str, ...] = (), level: int = 3, files: int = 8) -> DataFrame:
    """Write JSON lines under Zstandard, one tree level for each column in ``by``; returns path and rows of every file.

    A place is written by up to ``files`` tasks.  Nothing is in its place before all tasks have ended: a
    write that fails, or a task that runs twice, leaves no row behind.
    """
    names = [c for c in rows.columns if c not in by]
    lines = rows.select(F.concat_ws("/", *by).alias("place") if by else F.lit("").alias("place"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("line"))
    if by:
        tasks = max(files, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a number, so that small places aren't put together
        lines = lines.repartition(tasks, "place", F.pmod(F.xxhash64("line"), F.lit(files))).sortWithinPartitions("place")
    run = uuid.uuid4().hex[:12]
    spark = rows.sparkSession
    spark.dataSource.register(LinesSink)
    lines.write.format("jsonl_zst").mode("append").option("level", str(level)).option("run", run).save(folder)
    return spark.read.schema("path string, rows long").json(f"{folder}/_manifest/{run}.json")


def write_parquet(rows: DataFrame, folder: str, by: tuple[str, ...] = ()) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(folder)


def list_captures(spark: SparkSession, root: str, pattern: str = "*.pcapng") -> DataFrame:
    """path, category, process and kind (category_process in lower case) of the captures under ``root``/category/process."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "length")
    parts = F.split("path", "/")
    return files.withColumns({"category": F.element_at(parts, -3), "process": F.element_at(parts, -2)}).withColumn("kind", F.lower(F.concat_ws("_", "category", "process")))


def validate(spark: SparkSession, paths: list[str]) -> None:
    """Every path exists and holds something, or ``LoadingError``."""
    for path in paths:
        fs, name = _filesystem(path)
        info = fs.get_file_info(name)
        if info.type == pafs.FileType.NotFound:
            raise LoadingError(f"no such path: {path}")
        if info.type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(name)):
            raise LoadingError(f"nothing in {path}")


def write_report(spark: SparkSession, what: dict, path: str) -> None:
    """A small report as one JSON document, through Spark's writer."""
    spark.createDataFrame([(json.dumps(what, default=float),)], "value string").coalesce(1).write.mode("overwrite").text(path)
