"""URL filter: host and path rules, and gradient-boosted trees where no rule decides.

DataFrame functions only.  Rules are a short parameter list, compiled into one
expression.  The trees read lexical features of the URL and are trained on the
URLs that a rule decides, so the list of rules is the source of labels.  How often a
suffix or section is blocked is a feature too; a training row's rate leaves out all
rows of its own fold, so its label never reaches its features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, written

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Most rules in one list: they are compiled into an expression of that length.
MAX_RULES = 500
#: Folds of the suffix statistics, by a hash of the URL.
FOLDS = 5

FEATURES = ["n_chars", "host_chars", "path_chars", "host_labels", "depth", "digit_ratio", "host_digit_ratio", "punct_ratio", "entropy", "n_params", "query_chars", "has_fragment", "is_https", "last_segment_chars", "suffix_rate", "suffix_seen", "section_rate"]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path.  Null, or without ``://``: both empty."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), _UPPER, _LOWER), F.regexp_extract(text, pattern, 2)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits.

    A rule ``host/path`` fits that host and its subdomains where the URL's path
    starts with ``/path``.  Ties in length go to the earlier rule.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are compiled into one expression")
    rule = verdict = F.lit(None).cast("string")
    ordered = sorted(enumerate(rules), key=lambda x: (len(x[1][1]), -x[0]))
    for _, (said, text) in ordered:
        name, _, rest = text.partition("/")
        name = name.lower()
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame) -> DataFrame:
    """Adds numeric features of ``url`` (already with ``host`` and ``path``) and its suffix and section."""
    url = F.coalesce(F.col("url"), F.lit(""))
    chars = F.greatest(F.length(url), F.lit(1))
    count = lambda text, pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    letters = F.array_distinct(F.split(url, ""))
    entropy = F.aggregate(
        letters, F.lit(0.0),
        lambda acc, c: F.when(F.length(c) == 0, acc).otherwise(acc - _plogp((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / F.greatest(F.length(c), F.lit(1)) / chars)),
    )
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    labels = F.split(F.col("host"), r"\.")
    return df.select(
        "*",
        F.length(url).cast("double").alias("n_chars"),
        F.length("host").cast("double").alias("host_chars"),
        F.length("path").cast("double").alias("path_chars"),
        F.when(F.col("host") == "", 0.0).otherwise(F.size(labels).cast("double")).alias("host_labels"),
        count(F.col("path"), "/").cast("double").alias("depth"),
        (count(url, "[0-9]") / chars).alias("digit_ratio"),
        (count(F.col("host"), "[0-9]") / F.greatest(F.length("host"), F.lit(1))).alias("host_digit_ratio"),
        (count(url, r"[^\p{L}\p{N}]") / chars).alias("punct_ratio"),
        entropy.alias("entropy"),
        F.when(query == "", 0.0).otherwise((count(query, "&") + 1).cast("double")).alias("n_params"),
        F.length(query).cast("double").alias("query_chars"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        url.startswith("https://").cast("double").alias("is_https"),
        F.length(F.regexp_extract(F.col("path"), r"([^/]*)/?\z", 1)).cast("double").alias("last_segment_chars"),
        F.element_at(labels, -1).alias("suffix"),
        F.regexp_extract(F.col("path"), r"\A/([^/]*)", 1).alias("section"),
    )


def _plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def rates(rows: DataFrame, column: str) -> DataFrame:
    """Blocked and labelled URLs for each value of ``column``, in all and by fold, and how many rows have it."""
    of = lambda f: F.col("_fold") == f
    return rows.groupBy(column).agg(
        F.coalesce(F.sum("label"), F.lit(0.0)).alias("_pos"), F.count("label").cast("double").alias("_n"), F.count(F.lit(1)).alias("_rows"),
        F.array(*[F.coalesce(F.sum(F.when(of(f), F.col("label"))), F.lit(0.0)) for f in range(FOLDS)]).alias("_pos_of"),
        F.array(*[F.count(F.when(of(f), F.col("label"))).cast("double") for f in range(FOLDS)]).alias("_n_of"),
    )


def with_rate(df: DataFrame, found: DataFrame, column: str, smoothing: float = 10.0) -> DataFrame:
    """Adds the smoothed share of blocked URLs of ``column`` and the logarithm of their number.

    Rows with a label see the other folds only.
    """
    own = lambda c: F.when(F.col("label").isNotNull(), F.col(f"{c}_of")[F.col("_fold")]).otherwise(0.0)
    pos, n = F.col("_pos") - own("_pos"), F.col("_n") - own("_n")
    out = join_hot(df, found, [column], "_rows", "inner")
    out = out.withColumns({f"{column}_rate": (pos + 0.5 * smoothing) / (n + smoothing), f"{column}_seen": F.log1p(n)})
    return out.drop("_pos", "_n", "_pos_of", "_n_of", "_rows")


def fit(labelled: DataFrame, max_rows: int = 20_000, trees: int = 12, depth: int = 4, seed: int = 7) -> GBTClassificationModel | None:
    """Trees on at most ``max_rows`` different labelled URLs, those with the least hashes, each weighing as often as it stands.

    The sample is as large for 10^12 URLs as for 10^6, and a URL that stands very often is one row of it.  None if
    the labels do not hold both classes.
    """
    n = labelled.agg(F.approx_count_distinct("_hash", 0.02).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if not n["n"] or n["lo"] == n["hi"]:
        return None
    # a little more than is wanted passes the threshold; the least of them are taken
    least = F.pmod(F.col("_hash"), F.lit(1 << 62)) / float(1 << 62) <= min(1.0, 1.2 * max_rows / n["n"] + 1e-18)
    sample = labelled.where(least).groupBy("_hash").agg(F.first("label").alias("label"), *[F.first(c).alias(c) for c in FEATURES], F.count(F.lit(1)).cast("double").alias("_times"))
    sample = sample.orderBy(F.pmod(F.col("_hash"), F.lit(1 << 62)), "_hash").limit(max_rows)
    train = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample.fillna(0.0, FEATURES)).select("features", "label", "_times").repartition(4).persist()
    try:
        if train.agg(F.countDistinct("label")).first()[0] < 2:
            return None
        return GBTClassifier(weightCol="_times", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=32).fit(train)
    finally:
        train.unpersist()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", default: str = ALLOW, **fitting) -> DataFrame:
    """Judge every row's ``url``: ``host``, ``path``, ``rule``, ``verdict`` and ``block_score``.

    Null or odd URLs have an empty host and path, no rule, and the trees'
    verdict on an all-zero-like feature row.  Repeated rows and ids are judged
    alike, an empty table gives no rows, other columns are ignored, and URLs are read whole,
    however long.  With
    rules of one verdict only, or with none, there is nothing to learn from:
    URLs without a rule then get ``default`` and a null score.
    """
    host, path = split_url(F.col("url"))
    base = pages.select(id_col, "url").withColumns({"host": host, "path": path})
    rule, said = matched_rule(F.col("host"), F.col("path"), rules)
    hashed = F.xxhash64(F.lit(7), F.col("url"))
    known = lexical(base.withColumns({"rule": rule, "said": said})).withColumns({"label": (F.col("said") == BLOCK).cast("double"), "_hash": hashed, "_fold": F.pmod(F.shiftright(hashed, 20), F.lit(FOLDS)).cast("int")})
    # strings and features of every URL are worked out once
    known = written(known.drop("url").fillna("", ["suffix", "section"]), "url-features")
    for column in ("suffix", "section"):
        known = with_rate(known, written(rates(known, column), "url-rates"), column)
    model = fit(known.where("label IS NOT NULL"), **fitting)
    keep = [id_col, "host", "path", "rule"]
    if model is None:
        return known.select(*keep, F.coalesce("said", F.lit(default)).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(known)
    scored = model.transform(ready).withColumn("block_score", vector_to_array("probability")[1])
    return scored.select(*keep, F.coalesce("said", F.when(F.col("block_score") >= 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"), "block_score")
