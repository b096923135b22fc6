"""Mixing sources to target weights.  DataFrame functions only.

Each source gets a target number of words: its weight's share of all words,
at most ``max_repeat`` times what it has, the excess reshared by weight.  The
source's documents are laid out on a line in a permuted order, pass after pass,
and the line is cut into blocks of a fixed number of words; the target is a quota of
blocks, the last of which ends at the target.

A splitting tree partitions the quotas of all sources among the output shards: at
each node the blocks of each source that go left are one
multivariate-hypergeometric draw, and the leaves say how many blocks of each
source a shard draws.  A permutation of the source's blocks gives every shard its
own disjoint draws.  A document's copy is taken by the shard that draws the block
in which it begins; what no shard draws is not taken.  Shards are shuffled on
their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, join_hot, written

#: Documents in one piece of a source's line: running sums are local to a piece.
PIECE_ROWS = 20_000

#: The hypergeometric law is summed this many standard deviations around its mode.
TAIL = 8.0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_repeat: float = 3.0, cycle: int = 3) -> DataFrame:
    """Targets of sources by water-filling.  ``sizes``: source, source_size, n_docs, a row for each source.

    Also returns ``place``, the source's number in code-point order.  Sources in code-point order, null last, weigh 1, 2, .. ``cycle``, repeating.
    With ``level`` L, a source gets min(weight * L, max_repeat * size); L is found
    in closed form from sums over the sources ordered by the level that caps them.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    by_cap = Window.orderBy("cap_level", F.col("source").isNull(), F.encode("source", "UTF-8"))
    every = Window.partitionBy()
    first = by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = sizes.withColumn("place", F.row_number().over(by_name).cast("long")).withColumn("weight", ((F.col("place") - 1) % cycle + 1).cast("double"))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat))).withColumn("cap_level", F.col("cap") / F.col("weight"))
    w = w.withColumns({"total": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every), "caps": F.sum("cap").over(first), "weights": F.sum("weight").over(first)})
    # if this source and those before it are capped, the others share what is left
    w = w.withColumn("level_after", F.when(F.col("all_weight") > F.col("weights"), (F.col("total") - F.col("caps")) / (F.col("all_weight") - F.col("weights"))).otherwise(F.lit(float("inf"))))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("level", F.coalesce(F.last("level_after").over(before), F.col("total") / F.col("all_weight")))
    # in that order sources are capped up to the first that is not; its level holds for all others
    w = w.withColumn("open", F.max(F.col("cap_level") > F.col("level")).over(first))
    share = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct("cap_level", F.col("source").isNull(), F.encode("source", "UTF-8")))).over(every)
    return w.withColumn("target", F.when(F.col("open"), F.col("weight") * share).otherwise(F.col("cap"))).select("source", "place", "source_size", "n_docs", "weight", "target")


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1), the same on every run for the same parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def hypergeometric(u: Column, good: Column, total: Column, draws: Column) -> Column:
    """Inverse of the hypergeometric law at ``u``: of ``draws`` from ``total`` blocks, how many of the ``good`` ones.

    Probabilities relative to the mode's come from the ratio of neighbours, so
    no factorials are needed; beyond ``TAIL`` deviations they are below 1e-14.
    """
    k, n, m = good.cast("double"), draws.cast("double"), total.cast("double")
    lo = F.greatest(F.lit(0.0), n - (m - k))
    hi = F.least(n, k)
    mode = F.least(F.greatest(F.floor((n + 1) * (k + 1) / (m + 2)).cast("double"), lo), hi)
    spread = F.ceil(TAIL * F.sqrt(F.greatest(n * k / F.greatest(m, F.lit(1.0)) * (1 - k / F.greatest(m, F.lit(1.0))) * (m - n) / F.greatest(m - 1, F.lit(1.0)), F.lit(0.0))) + 4)
    a, b = F.greatest(lo, mode - spread), F.least(hi, mode + spread)
    state = "struct<x:double,p:double,sum:double>"
    start = lambda x, p: F.struct(x.alias("x"), p.alias("p"), p.alias("sum")).cast(state)
    down = lambda x: x * (m - k - n + x) / ((k - x + 1) * (n - x + 1))  # noqa: E731  p(x - 1) / p(x)
    up = lambda x: (k - x) * (n - x) / ((x + 1) * (m - k - n + x + 1))  # noqa: E731  p(x + 1) / p(x)
    steps = lambda width: F.when(width >= 1, F.sequence(F.lit(1), F.greatest(width, F.lit(1.0)).cast("int"))).otherwise(F.array().cast("array<int>"))
    below = F.aggregate(steps(mode - a), start(mode, F.lit(1.0)), lambda s, _: F.struct((s.x - 1).alias("x"), (s.p * down(s.x)).alias("p"), (s["sum"] + s.p * down(s.x)).alias("sum")))
    above = F.aggregate(steps(b - mode), start(mode, F.lit(1.0)), lambda s, _: F.struct((s.x + 1).alias("x"), (s.p * up(s.x)).alias("p"), (s["sum"] + s.p * up(s.x)).alias("sum")))
    return F.struct(below.x.alias("x"), below.p.alias("p"), (below["sum"] + above["sum"] - 1).alias("sum"), b.alias("b"), k.alias("k"), n.alias("n"), m.alias("m"), u.alias("u"))


def draw(law: Column) -> Column:
    """The smallest x whose cumulative probability reaches u."""
    up = lambda x: (law.k - x) * (law.n - x) / ((x + 1) * (law.m - law.k - law.n + x + 1))
    goal = law.u * law["sum"]
    state = "struct<x:double,p:double,cum:double>"
    begin = F.struct(law.x.alias("x"), law.p.alias("p"), law.p.alias("cum")).cast(state)
    walk = F.aggregate(
        F.sequence(F.lit(0), F.greatest(law.b - law.x, F.lit(0.0)).cast("int")), begin,
        lambda s, _: F.when((s.cum >= goal) | (s.x >= law.b), s).otherwise(F.struct((s.x + 1).alias("x"), (s.p * up(s.x)).alias("p"), (s.cum + s.p * up(s.x)).alias("cum")).cast(state)),
    )
    return walk.x.cast("long")


_BLOCKS = "struct<source:bigint,blocks:bigint>"
_STATE = f"struct<rest:bigint,want:bigint,out:array<{_BLOCKS}>>"

#: Levels of the tree between two tables written to the shared folder.
LEVELS = 5


def _take(acc: Column, x: Column) -> Column:
    """One source's draw at a node, given what the sources before it took."""
    law = hypergeometric(_uniform(F.col("seed"), F.col("depth"), F.col("node"), x["source"]), x["blocks"], acc["rest"], acc["want"])
    got = F.when(acc["rest"] > 0, F.element_at(F.transform(F.array(law), draw), 1)).otherwise(F.lit(0).cast("long"))
    after = lambda g: F.struct((acc["rest"] - x["blocks"]).alias("rest"), (acc["want"] - g).alias("want"), F.concat(acc["out"], F.array(F.struct(x["source"].alias("source"), g.alias("blocks")))).alias("out")).cast(_STATE)
    return F.element_at(F.transform(F.array(got), after), 1)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Deal block quotas to shards.  ``quotas``: source (its number), blocks.  Returns source, shard, blocks.

    ``shards`` is a power of two.  Level by level every node halves: its left
    child draws ceil(half) of the node's blocks without replacement, one source
    after another, each given what the ones before it took.  A node is one row with a
    number for each source; the nodes of a level are dealt to tasks and drawn side by side.
    """
    if shards & (shards - 1) or shards < 1:
        raise ValueError("shards must be a power of two")
    level = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("source").cast("long").alias("source"), F.col("blocks").cast("long").alias("blocks")))).alias("s"))
    level = level.select(F.lit(seed).alias("seed"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("node"), "s")
    total = F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: acc + x.blocks)
    begin = F.struct(total.alias("rest"), F.ceil(total / 2).cast("long").alias("want"), F.array().cast(f"array<{_BLOCKS}>").alias("out")).cast(_STATE)
    # the same columns serve every level: they name depth and node, not their values
    left = F.aggregate("s", begin, _take).out
    right = F.zip_with("s", "left", lambda a, b: F.struct(a["source"].alias("source"), (a["blocks"] - b["blocks"]).alias("blocks")))
    child = lambda k, side: F.struct(F.col("seed"), (F.col("depth") + 1).alias("depth"), (F.col("node") * 2 + k).alias("node"), side.alias("s"))
    children = F.explode(F.array(child(0, F.col("left")), child(1, right))).alias("x")
    for depth in range(int(math.log2(shards))):
        if depth and depth % LEVELS == 0:
            level = written(level.repartition("node"), "mix-tree")
        level = level.withColumn("left", left).select(children).select("x.*")
    return level.select(F.col("node").alias("shard"), F.explode("s").alias("x")).select("x.source", "shard", "x.blocks")


def lean_rows(docs: DataFrame, key: Column) -> DataFrame:
    """A number for every row, its doc_id, source, size and ``key``: the text is read once, here."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def shuffled_draw(draw: Column, blocks: Column, *key: Column, rounds: int = 40) -> Column:
    """The block that a draw takes: a permutation of 0 .. ``blocks`` - 1 (fewer than 2**62) that follows ``key``.

    Swap or not: each round pairs the numbers that add up to a keyed constant, modulo ``blocks``, and swaps
    a pair or leaves it by a keyed bit of the pair.  It is one-to-one for every ``blocks``.
    """

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(1), r, *key), blocks) - x, blocks)
        return F.when(F.xxhash64(F.lit(2), r, F.greatest(x, other), *key).bitwiseAND(1) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), draw.cast("long"), swap)


def plan(docs: DataFrame, shards: int | None = None, block_words: int | None = None, shard_words: int = 1 << 22, max_repeat: float = 3.0, seed: int = 11, key: Column | None = None) -> DataFrame:
    """What the mix takes of every row of ``docs`` (doc_id, text, source).

    Returns doc_id, source, size, key, source_size, target, taken (words,
    repeats counted) and ``copies``: an array of (pass, words, shard, place), one
    for each time a shard takes the row; its words are all of the row's but for the
    copy at which its source's target ends.  ``shards`` (a power of two) defaults
    to one for each ``shard_words`` words, 64 at least; ``block_words`` to 4,096, more
    where a source would have over 2**30 blocks.  ``key`` orders documents and
    defaults to a hash of doc_id and text.

    Rows with null or empty text have size 0 and no copies.  A null source is a
    source of its own.  Repeated rows are rows of their own; the running sum goes
    over equal rows in any order, which changes only which of them is cut.  A text
    longer than a block, however long, belongs to the block it begins in.  Other
    columns are ignored, whatever their names.  An empty table gives no rows.
    """
    own = lean_rows(docs, F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")) if key is None else key)
    words = own.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(64, 1 << math.ceil(math.log2(max(1, words / shard_words))))
    block_words = block_words or max(4096, math.ceil(max_repeat * words / (1 << 30)))
    sizes = own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goal = targets(sizes, max_repeat).withColumn("pieces", F.greatest(F.ceil(F.col("n_docs") / PIECE_ROWS * 4), F.lit(1)).cast("long"))
    goal = goal.withColumn("want", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("want") / block_words).cast("long"))
    # a null source can't meet itself in a join, so its name is told apart by a flag
    named = lambda: [F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_name")]
    goal = written(goal.select(*named(), "place", "source_size", "n_docs", "target", "pieces", "want", "blocks"), "mix-targets")
    # what the leaves of the tree say: the draws of every shard, one row a block
    upto, of = F.sum("blocks").over(Window.partitionBy("source").orderBy("shard")), F.sum("blocks").over(Window.partitionBy("source"))
    leaves = split_quotas(goal.select(F.col("place").alias("source"), "blocks"), shards, seed).where("blocks > 0").withColumns({"to": upto, "of": of})
    draws = leaves.select("source", "shard", "of", F.explode(F.sequence(F.col("to") - F.col("blocks"), F.col("to") - 1)).alias("draw"))
    block = shuffled_draw(F.col("draw"), F.col("of"), F.lit(seed), F.col("source"))
    draws = written(draws.select(F.col("source").alias("place"), block.alias("block"), F.col("shard").cast("long").alias("shard")), "mix-draws")
    rows = join_hot(own.select("row", "doc_id", "source", "size", "key", *named()), goal, ["_none", "_name"], "n_docs", "inner").drop("_none", "_name", "n_docs")
    rows = rows.withColumn("piece", F.pmod(F.shiftright("key", 8), F.col("pieces")))
    # words before each piece of a source's line
    pieces = rows.groupBy("place", "piece").agg(F.sum("size").alias("words"))
    starts = pieces.select("place", "piece", (F.sum("words").over(Window.partitionBy("place").orderBy("piece")) - F.col("words")).alias("start"))
    inside = Window.partitionBy("place", "piece").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(starts, ["place", "piece"]).withColumn("begin", F.col("start") + F.sum("size").over(inside) - F.col("size"))
    rows = written(rows.drop("piece", "pieces", "start"), "mix-line")
    at = lambda p: p * F.col("source_size") + F.col("begin")
    copies = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(math.ceil(max_repeat))), lambda p: F.struct(
            p.alias("pass"),
            F.greatest(F.least(F.col("size"), F.col("want") - at(p)), F.lit(0)).cast("long").alias("words"),
            F.floor(at(p) / block_words).cast("long").alias("block"),
            F.xxhash64(F.lit(seed + 1), p, F.col("key")).alias("place"))),
        lambda c: c.words > 0,
    )
    offered = rows.select("row", "place", F.explode(copies).alias("c")).select("row", "place", F.col("c.block").alias("block"), "c")
    drawn = offered.join(draws, ["place", "block"]).select("row", F.struct("c.pass", "c.words", "shard", F.col("c.place").alias("place")).alias("copy"))
    taken = drawn.groupBy("row").agg(F.sum("copy.words").alias("taken"), F.sort_array(F.collect_list("copy")).alias("copies"))
    none = F.array().cast("array<struct<pass:int,words:bigint,shard:bigint,place:bigint>>")
    out = rows.join(taken, "row", "left")
    return out.select("doc_id", "source", "size", "key", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("copies", none).alias("copies"))


def content_key(docs: DataFrame, seed: int) -> Column:
    """A 64-bit hash of all columns of a row; maps go in as JSON."""
    return F.xxhash64(F.lit(seed), *[F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema])


def mixed(docs: DataFrame, seed: int = 11, **options) -> DataFrame:
    """The mix itself: every taken copy as a row with the columns of ``docs``,
    dealt to shards and in shuffled order inside each.

    The one copy of a source at which its target ends keeps its leading words,
    joined by single spaces.  Rows are told apart by all their columns, so rows that
    share doc_id and text keep their own source; wholly equal rows are one content,
    taken as often as each of them is.  An empty table gives no rows.
    """
    key = content_key(docs, seed)
    copies = plan(docs, seed=seed, key=key, **options).select("key", "size", F.explode("copies").alias("c"))
    copies = copies.select(F.col("key").alias("_key"), F.col("size").alias("_size"), F.col("c.words").alias("_words"), F.col("c.shard").alias("_shard"), F.col("c.place").alias("_place"))
    own = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), key.alias("_key")).dropDuplicates(["_key"])
    got = own.join(copies, "_key").repartition("_shard").sortWithinPartitions("_shard", "_place")
    text = F.col("_row.text")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), 1, F.col("_words").cast("int")), " ")
    return got.select(*[F.when(F.col("_words") < F.col("_size"), cut).otherwise(text).alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
