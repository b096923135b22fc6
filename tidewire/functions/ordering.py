"""Numbers and running sums in the order of a column, without all rows in one task.

The column's range is cut at quantiles; sums by piece give each piece its start, and rows are
ordered inside their piece only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one piece at least.  From 10^8 rows on a piece has 10 times the root of their number: 10^7 of 10^12.
PIECE_ROWS = 100_000


def cuts(rows: DataFrame, order: str, n: int) -> list[float]:
    """Quantiles that cut ``n`` rows into pieces; none where one piece will do."""
    pieces = -(-n // max(PIECE_ROWS, 10 * math.isqrt(n) if n > 10**8 else 0))
    if pieces < 2:
        return []
    found = rows.select(F.col(order).cast("double").alias("_v")).approxQuantile("_v", [k / pieces for k in range(1, pieces)], 0.2 / pieces)
    return sorted({float(x) for x in found if math.isfinite(x)})


def with_piece(rows: DataFrame, order: str, at: Sequence[float]) -> DataFrame:
    """Adds ``_piece``: how many of the cuts lie at or below the value, by binary search; null is in piece 0, NaN in the last."""
    if not at:
        return rows.withColumn("_piece", F.lit(0))
    found = Bucketizer(splits=[-math.inf, *at, math.inf], inputCol="_value", outputCol="_piece", handleInvalid="keep").transform(rows.withColumn("_value", F.col(order).cast("double")))
    return found.withColumn("_piece", F.coalesce(F.when(F.isnan("_value"), len(at)).when(F.col("_value").isNull(), 0).otherwise(F.least(F.col("_piece"), F.lit(len(at)))), F.lit(0)).cast("int")).drop("_value")


def running(rows: DataFrame, order: str, sums: dict[str, Column], keys: Sequence[str] = (), tie: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Adds each of ``sums``, added up over the rows of the same ``keys`` from the first up to this one.

    Rows equal in ``order`` (a number) and ``tie`` come in any order.  ``rows`` is read
    several times.
    """
    at = cuts(rows, order, rows.count())
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(*keys, "_piece").orderBy(way(order), *tie).rowsBetween(Window.unboundedPreceding, 0)
    cut = with_piece(rows, order, at)
    if not at:
        return cut.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).drop("_piece")
    before = Window.partitionBy(*keys).orderBy(way("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_piece").agg(*[F.sum(c).alias(f"_of_{n}") for n, c in sums.items()])
    starts = totals.select(*keys, "_piece", *[F.coalesce(F.sum(f"_of_{n}").over(before), F.lit(0)).alias(f"_of_{n}") for n in sums])
    out = cut.join(starts, [*keys, "_piece"])
    return out.withColumns({n: F.col(f"_of_{n}") + F.sum(c).over(inside) for n, c in sums.items()}).drop("_piece", *[f"_of_{n}" for n in sums])


def neighbouring(rows: DataFrame, order: str, k: int, keys: Sequence[str]) -> DataFrame:
    """Adds ``_b1`` .. ``_bk``, the k values of ``order`` before the row's own among rows of its ``keys``, and ``_a1`` .. ``_ak``, those after it.

    Rows are put in order inside pieces only.  A piece also gets the k values on either side of it: these are among the
    k first and k last of the other pieces, which alone are put in order over all pieces.
    """
    at = cuts(rows, order, rows.count())
    steps = range(1, k + 1)
    near = lambda w: {f"_b{j}": F.lag(order, j).over(w) for j in steps} | {f"_a{j}": F.lead(order, j).over(w) for j in steps}
    if not at:
        return rows.withColumns(near(Window.partitionBy(*keys).orderBy(order)))
    cut = with_piece(rows, order, at).withColumn("_own", F.lit(True))
    inside = Window.partitionBy(*keys, "_piece").orderBy(order)
    back = Window.partitionBy(*keys, "_piece").orderBy(F.col(order).desc())
    ranked = cut.select(*keys, "_piece", order).withColumns({"_first": F.row_number().over(inside), "_last": F.row_number().over(back)})
    ends = ranked.where((F.col("_first") <= k) | (F.col("_last") <= k))
    outer = ends.withColumns(near(Window.partitionBy(*keys).orderBy(order, "_piece", "_first")))
    halo = outer.where("_first = 1").select(*keys, "_piece", F.explode(F.array(*[f"_b{j}" for j in steps])).alias(order))
    halo = halo.unionByName(outer.where("_last = 1").select(*keys, "_piece", F.explode(F.array(*[f"_a{j}" for j in steps])).alias(order)))
    both = cut.unionByName(halo.where(F.col(order).isNotNull()).withColumn("_own", F.lit(False)), allowMissingColumns=True)
    return both.withColumns(near(inside)).where("_own").drop("_piece", "_own")


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``_n``: the row's number among those of its keys, from 0, in the order of the columns ``order``."""
    return running(rows, order[0], {"_n": F.lit(1).cast("long")}, keys, order[1:]).withColumn("_n", F.col("_n") - 1)
