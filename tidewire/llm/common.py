"""Shared helpers: storage for intermediate tables and small column expressions."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word definition shared by the operators: maximal runs of other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share.

    It is what the cluster names in ``spark.checkpoint.dir``.  Only where that
    is unset in a single-machine session, as in tests, a folder of this process
    is made and set; elsewhere a folder of one machine would lose rows, so that is
    an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="tidewire-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, so that
    later stages survive lost executors without computing it anew."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Lower the session's bound on bytes in one Arrow batch to ``size``: Spark's 64 MB would be held
    by the JVM and by the Python worker of every task at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(name)).rstrip("bB")) > size:
        spark.conf.set(name, str(size))


def join_hot(left: DataFrame, right: DataFrame, on: Sequence[str], n: str, how: str = "left", share: int | None = None, total: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``on``, where a few keys may hold most rows of ``left``.

    ``right`` has one row for each key and is cheap to read (a written table); its
    column ``n`` tells how many rows of ``left`` have the key.  Keys with at least a
    ``share``-th of all those rows are ``share`` at most, whatever the data: these
    are broadcast and their rows are not shuffled.  All other rows meet in a
    shuffled join in which no key is hot.  ``how`` is ``left`` or ``inner``.  ``share`` follows
    the session's shuffle partitions, from 1,000 to 100,000, so that no key outgrows a task.
    ``total`` is a known upper bound of the sum of ``n``, which is counted otherwise.
    """
    if share is None:
        share = min(max(1_000, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 100_000)
    total = (right.agg(F.sum(n)).first()[0] or 0) if total is None else total
    hot = right.where(F.col(n) * share >= total)
    met = left.join(F.broadcast(hot), list(on), "inner")
    rest = left.join(F.broadcast(hot.select(*on)), list(on), "left_anti")
    return met.unionByName(rest.join(right.where(F.col(n) * share < total), list(on), how))


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's content, the same wherever and however often it is computed."""
    return F.xxhash64(*[F.col(c) for c in columns])


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo ``n`` (null for null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def local_path(uri: str) -> str:
    """The path part of a ``file:`` URI, else the URI."""
    return os.path.normpath(uri.split(":", 1)[1]) if uri.startswith("file:") else uri
