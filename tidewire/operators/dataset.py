"""From feature rows to a training matrix: sampling, encoding, scaling and splitting."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import LoadingError
from ..functions.columns import safe_ratio
from ..functions.ordering import numbered

#: Columns that are never features.
NOT_FEATURES = {"packet_count", "timestamp", "ts_us", "file_id", "file_no", "file_name", "path", "seq", "label", "split", "fold"}


def hash_order(*keys: str, seed: int = 42) -> Column:
    """A shuffled order that every run and every engine agrees on."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def feature_names(columns: Sequence[str]) -> list[str]:
    """Feature columns, sorted: all but the excluded and the labels."""
    return sorted(c for c in columns if c not in NOT_FEATURES and not c.startswith("label_"))


def conform(rows: DataFrame, names: Sequence[str], fill: float = 0.0) -> DataFrame:
    """``names`` in this order; missing columns and nulls become ``fill``."""
    have = set(rows.columns)
    keep = [c for c in rows.columns if c in NOT_FEATURES or c.startswith("label_")]
    return rows.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(fill)).alias(c) if c in have else F.lit(fill).alias(c) for c in names])


def reconciled(rows: DataFrame, names: Sequence[str], extra: bool = False) -> DataFrame:
    """``rows`` with the features ``names`` in this order, next to the columns that are never features.

    Raises ``LoadingError`` where a feature is missing, stands twice, is no number, or, unless ``extra``, where there are features besides ``names``
    (these are left out otherwise).
    """
    kinds = dict(rows.dtypes)
    own = [c for c in rows.columns if c in NOT_FEATURES or c.startswith("label_")]
    found = Counter(c for c in rows.columns if c not in set(own))
    wrong = {
        "missing": [c for c in names if c not in found], "twice": sorted({c for c, n in [*Counter(names).items(), *found.items()] if n > 1}),
        "no numbers": [c for c in names if c in found and not kinds[c].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))],
        "unknown": [] if extra else sorted(set(found) - set(names)),
    }
    if any(wrong.values()):
        raise LoadingError(f"{len(found)} features for {len(names)}: " + "; ".join(f"{k}: {', '.join(v)}" for k, v in wrong.items() if v))
    return rows.select(*own, *names)


def mqtt_only(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.col("is_mqtt"), F.lit(0)) == 1)


def encode_category(rows: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Codes from 0 in alphabetical order over the whole table; null is -1.

    The distinct values are joined, not broadcast by hint: Spark decides by their size.
    """
    codes = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    codes = codes.select(F.col(column).alias("_value"), (F.row_number().over(Window.orderBy(column)) - 1).alias("_code"))
    return rows.join(codes, F.col(column) == F.col("_value"), "left").withColumn(out or column, F.coalesce("_code", F.lit(-1))).drop("_value", "_code")


def sample_files(files: DataFrame, stratum: str, name: str, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """At most ``quotas[stratum]`` files of each stratum, in hash order."""
    quota = F.coalesce(*[F.when(F.col(stratum) == k, n) for k, n in quotas.items()], F.lit(0))
    order = Window.partitionBy(stratum).orderBy(hash_order(name, seed=seed), name)
    return files.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= quota).drop("_rank")


def sample_rows(rows: DataFrame, group: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """floor(share * n) rows of every group, in hash order.

    Counts by the first four digits of the hash tell in which 65,536th of a group the last row lies: rows before it are in, and
    only rows of that part are put in order.  A null group is a group.
    """
    hashed = rows.withColumn("_h", hash_order(group, key, seed=seed)).withColumn("_p", F.substring("_h", 1, 4))
    counts = hashed.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_c"))
    of = Window.partitionBy(group)
    upto = F.sum("_c").over(of.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    cut = counts.withColumns({"_upto": upto, "_want": F.floor(F.lit(share) * F.sum("_c").over(of))}).where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_c") < F.col("_want")))
    cut = cut.select(F.col(group).alias("_g"), F.col("_p").alias("_last"), (F.col("_want") - F.col("_upto") + F.col("_c")).alias("_more"))
    cut = F.broadcast(cut) if cut.count() <= 100_000 else cut
    near = hashed.join(cut, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") <= F.col("_last")))
    order = Window.partitionBy(group).orderBy("_h", key)
    edge = near.where("_p = _last").withColumn("_rank", F.row_number().over(order)).where("_rank <= _more")
    return near.where("_p < _last").select(rows.columns).unionByName(edge.select(rows.columns))


def split_groups(rows: DataFrame, group: str, test: float = 0.2, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """``group`` and ``split``: ceil(test) of the groups, then ceil(validation) of the rest, whole groups only."""
    # the first 13 digits of the hash as a number, which a double holds exactly, say in which piece a group is ranked
    groups = rows.select(group).distinct().withColumn("_h", hash_order(group, seed=seed)).withColumn("_at", F.conv(F.substring("_h", 1, 13), 16, 10).cast("double"))
    n = groups.count()
    n_test = F.ceil(F.lit(test) * F.lit(n))
    n_val = F.ceil(F.lit(validation) * (F.lit(n) - n_test))
    kind = F.when(F.col("_rank") <= n_test, "test").when(F.col("_rank") <= n_test + n_val, "validation").otherwise("train")
    return numbered(groups, [], ["_at", "_h", group]).withColumn("_rank", F.col("_n") + 1).select(group, kind.alias("split"))


def group_folds(rows: DataFrame, group: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """``group`` and ``fold``: groups dealt so that every fold has about the same share of each class.

    One row for each group comes to the driver, which takes the most uneven groups
    first and gives each to the fold where the classes end up most even.
    """
    counts = rows.groupBy(group).agg(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n0"), F.sum(F.when(F.col(label) != 0, 1).otherwise(0)).alias("n1"), F.min(hash_order(group, seed=seed)).alias("h"))
    table = sorted(counts.collect(), key=lambda r: (-abs(r["n1"] - r["n0"]), r["h"]))
    totals = [sum(r["n0"] for r in table) or 1, sum(r["n1"] for r in table) or 1]
    held = [[0, 0] for _ in range(folds)]
    size = [0] * folds
    out = []

    def spread(k: int, r) -> tuple[float, int]:
        worst = 0.0
        for c, n in enumerate((r["n0"], r["n1"])):
            shares = [(held[f][c] + (n if f == k else 0)) / totals[c] for f in range(folds)]
            mean = sum(shares) / folds
            worst += (sum((x - mean) ** 2 for x in shares) / folds) ** 0.5
        return round(worst, 12), size[k]

    for r in table:
        k = min(range(folds), key=lambda f: spread(f, r))
        held[k][0] += r["n0"]
        held[k][1] += r["n1"]
        size[k] += r["n0"] + r["n1"]
        out.append((r[group], k))
    kind = dict(rows.dtypes)[group]
    return rows.sparkSession.createDataFrame(out, f"`{group}` {kind}, fold int")


def leaking(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups found in more than one split; must be empty."""
    return rows.groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def extremes(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: the least and greatest value of every feature."""
    return rows.agg(*[f(c).alias(f"{p}_{c}") for c in names for p, f in (("lo", F.min), ("hi", F.max))])


def min_max(rows: DataFrame, fitted: DataFrame, names: Sequence[str]) -> DataFrame:
    """Scaled by the extremes of ``fitted``, not clipped.  A constant feature becomes its distance to the constant."""
    return rows.crossJoin(F.broadcast(fitted.limit(1))).select(*[c for c in rows.columns if c not in names], *[((F.col(c) - F.col(f"lo_{c}")) / F.when(F.col(f"hi_{c}") != F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")).otherwise(1.0)).alias(c) for c in names])


def moments(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return rows.agg(*[f(c).alias(f"{p}_{c}") for c in names for p, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def standardise(rows: DataFrame, fitted: DataFrame, names: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation of ``fitted``; 0 for a constant feature."""
    return rows.crossJoin(F.broadcast(fitted.limit(1))).select(*[c for c in rows.columns if c not in names], *[safe_ratio(F.col(c) - F.col(f"mean_{c}"), F.col(f"sd_{c}")).alias(c) for c in names])


def class_weights(rows: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """n / (classes * n of the class) for every row.  One row a class comes to the driver."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for k, n in counts.items():
        weight = F.when(F.col(label) == k, total / (len(counts) * n)).otherwise(weight)
    return rows.withColumn(out, weight)


def stack(rows: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long form: ids, feature, value."""
    return rows.select(*ids, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(list(ids), list(names), "feature", "value")
