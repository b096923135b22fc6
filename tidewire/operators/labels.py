"""Labels of captures from their file names: class, process, colour, anomaly and file id."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import base_name

# The code of each name.
CLASSES = {"Normal": 0, "Anomalous": 1}
PROCESSES = {"Stock": 0, "Order": 1}
COLOURS = {"Red": 0, "White": 1, "Blue": 2}

# Anomalies in the order of their codes, from 1, with the first and
# last of the 60 numbered captures of a kind that show them.
ANOMALIES = [
    ("inject-bme", 1, 5),
    ("inject-ldr", 6, 10),
    ("move-camera", 11, 15),
    ("stock-how", 16, 20),
    ("change-state-dsi", 21, 25),
    ("change-state-dso", 26, 30),
    ("change-state-mpo-2", 31, 33),
    ("change-state-mpo-4", 34, 36),
    ("change-state-hbw-2", 37, 39),
    ("change-state-hbw-4", 40, 42),
    ("change-state-sld-2", 43, 45),
    ("change-state-sld-4", 46, 48),
    ("change-state-vgr-2", 49, 54),
    ("change-state-vgr-4", 55, 60),
]
NO_ANOMALY = "No-Anomaly"

#: Kinds of captures in the order of their ids: 100 ids for each normal kind, then 60 for each anomalous one.
KINDS = [(c, p, colour) for c in CLASSES for p in ("Order", "Stock") for colour in ("Blue", "Red", "White")]
IDS_EACH = {"Normal": 100, "Anomalous": 60}

PATTERN = r"^(\w+)_(\w+)_(\w+)-(\d{3})"


def _first_ids() -> dict[str, int]:
    out, at = {}, 0
    for kind in KINDS:
        out["_".join(kind)] = at
        at += IDS_EACH[kind[0]]
    return out


def _get(values: Mapping[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


LABELS = ("label_1", "label_2", "label_3", "label_4", "file_id")


def _part(name: Column, k: int) -> Column:
    """Part ``k`` of a capture's name by the pattern."""
    return F.regexp_extract(F.regexp_replace(base_name(name), r"\.[^.]*$", ""), PATTERN, k)


def has_label(name: Column) -> Column:
    """Whether a capture's name gives labels: pattern, class, process, colour and id are known."""
    number = _part(name, 4).try_cast("int")
    first = F.coalesce(_get(_first_ids(), F.concat_ws("_", *[_part(name, k) for k in (1, 2, 3)])), F.lit(None).cast("int"))
    return F.coalesce((first + number).between(1, 960), F.lit(False))


def with_labels(rows: DataFrame, name: str = "file_name") -> DataFrame:
    """``rows`` of captures whose names are valid, with label_1 .. label_4 and file_id worked out from the name.

    Names that do not fit the pattern, or have an unknown class, process or
    colour, or an id outside 1 to 960, have no row.  A known class, process and colour
    always have a first id.  Case matters; the extension does not.
    """
    part = lambda k: _part(F.col(name), k)
    keep = [c for c in rows.columns if c not in LABELS]
    rows = rows.select(*keep, F.struct(part(1).alias("c"), part(2).alias("p"), part(3).alias("o"), part(4).try_cast("int").alias("n")).alias("_name")).where("_name.n IS NOT NULL")
    first = F.coalesce(_get(_first_ids(), F.concat_ws("_", "_name.c", "_name.p", "_name.o")), F.lit(0))
    rows = rows.withColumn("file_id", first + F.col("_name.n"))
    place = (F.col("file_id") - 1) % 60 + 1
    anomaly = F.lit(0)
    for code, (_, lo, hi) in enumerate(ANOMALIES, 1):
        anomaly = F.when(place.between(lo, hi), code).otherwise(anomaly)
    out = rows.select(*keep, _get(CLASSES, F.col("_name.c")).alias("label_1"), _get(PROCESSES, F.col("_name.p")).alias("label_2"), _get(COLOURS, F.col("_name.o")).alias("label_3"), F.when(F.col("_name.c") == "Normal", 0).otherwise(anomaly).alias("label_4"), "file_id")
    return out.where(in_range())


def file_labels(files: DataFrame, name: str = "file_name") -> DataFrame:
    """file_name and labels of the captures whose names are valid."""
    return with_labels(files.select(name), name)


def in_range() -> Column:
    """The range check of the five labels."""
    bounds = {"label_1": (0, 1), "label_2": (0, 1), "label_3": (0, 2), "label_4": (0, 14), "file_id": (1, 960)}
    out = F.lit(True)
    for c, (lo, hi) in bounds.items():
        out = out & F.coalesce(F.col(c).between(lo, hi), F.lit(False))
    return out


def anomaly_ranges(spark: SparkSession) -> DataFrame:
    """code, anomaly, lo, hi: the ranges as a table, for a range join."""
    return spark.createDataFrame([(k, n, lo, hi) for k, (n, lo, hi) in enumerate(ANOMALIES, 1)], "code int, anomaly string, lo int, hi int")


def label_packets(packets: DataFrame, labels: DataFrame, name: str = "file_name") -> DataFrame:
    """Packets of labelled captures with their labels: one row for each file name, and several names may share an id."""
    return packets.join(labels, name)


def dense_ids(rows: DataFrame, name: str = "file_name") -> DataFrame:
    """name and ``file_no``: captures numbered from 0 in the order of their names."""
    from pyspark.sql.window import Window

    return rows.select(name).distinct().withColumn("file_no", F.row_number().over(Window.orderBy(name)) - 1)
