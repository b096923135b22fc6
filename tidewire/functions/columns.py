"""Column functions of the packet engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(num: Column, den: Column, otherwise: float = 0.0) -> Column:
    """``num / den``, and ``otherwise`` where ``den`` is zero or null (ANSI mode raises on zero)."""
    return F.coalesce(F.when(den != 0, num / den), F.lit(otherwise))


def finite(x: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def near_zero(x: Column, tolerance: float = 1e-8) -> Column:
    return F.abs(x) <= tolerance


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def index_percentile(ordered: Column, p: float) -> Column:
    """The value at 0-based place floor(p * (n - 1)) of a sorted array; no interpolation."""
    return F.element_at(ordered, (F.floor(F.lit(p) * (F.size(ordered) - 1)) + 1).cast("int"))


def histogram_entropy(values: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Shannon entropy, in bits, of ``bins`` equal bins over [lo, hi]; 0 if lo = hi.

    ``lo`` and ``hi`` are columns, so that they are not found again for every element.
    """
    place = lambda x: F.least(F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))), F.lit(bins - 1)).cast("int")
    ids = F.transform(values, place)
    share = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.size(F.filter(ids, lambda b: b == i)) / F.size(values))
    return F.when(hi > lo, F.aggregate(share, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def ema(values: Column, alpha: float) -> Column:
    """Exponential moving average seeded with the first value; the last one."""
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, F.element_at(values, 1).cast("double"), lambda acc, x: F.lit(alpha) * x + F.lit(1 - alpha) * acc)


def flow_id(src: Column, sport: Column, dst: Column, dport: Column, is_mqtt: Column) -> Column:
    """The same for both directions: endpoints in string order of ``ip:port``."""
    a, b = F.concat_ws(":", src, sport.cast("string")), F.concat_ws(":", dst, dport.cast("string"))
    return F.concat(F.lit("flow_"), F.xxhash64(F.least(a, b), F.greatest(a, b), is_mqtt).cast("string"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def trailing_id(name: Column) -> Column:
    """Digits of the part after the last ``-``; a stable hash below 10**6 if there are none."""
    digits = F.regexp_replace(F.element_at(F.split(name, "-"), -1), r"\D", "")
    return F.coalesce(digits.try_cast("int"), F.pmod(F.xxhash64(name), F.lit(1_000_000)).cast("int"))


def log2_share(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


#: ln 2, the largest mutual information with a binary target.
MOST_BINARY_INFORMATION = math.log(2)
