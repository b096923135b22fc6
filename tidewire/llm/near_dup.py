"""Near-duplicate classes by b-bit MinHash.

A document's set holds its distinct five-word shingles (words lower-cased in
A-Z).  Signatures keep the low bits of each minimum: 16 bits of those that form
the bands, 8 of the others.  The steps:

1. Documents with equal sets become one node.
2. Nodes that share a band are candidates.  In every bucket each node is paired
   with the bucket's first node only; pairs whose similarity, estimated by
   counting equal b-bit values and corrected for chance, is far too low are
   dropped, the others are confirmed on the full sets.
3. Confirmed pairs give components.  Buckets that still hold several components
   are gone through in blocks of bounded size: every pair of nodes of different
   components is estimated, and the nodes of pairs that are near enough bring their
   full sets to the block, where all pairs are compared.
4. Components again; each is named by its smallest doc_id.

No pair inside a bucket stays unexamined, so a link is lost only if no band
meets (below 1e-7 at the threshold) or the estimate is 4.5 deviations off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, small_batches, written
from .textgrid import buffers, grid, mix, shingles, slices


@dataclass(frozen=True)
class Settings:
    width: int = 5
    #: Two sets are linked if 100 * intersection >= percent * union.
    percent: int = 85
    bands: int = 24
    rows: int = 4
    more: int = 96
    deviations: float = 4.5
    #: Nodes in one block of a bucket; pairs in one block of a node's partners.
    block: int = 512
    partners: int = 128
    #: Text that a block of a bucket has on average; a longer text stands nearly alone.
    block_bytes: int = 8 << 20
    #: Blocks that one row of a node makes copies of its text for.
    copies: int = 64

    @property
    def least(self) -> float:
        p = self.percent / 100
        return p - self.deviations * math.sqrt(p * (1 - p) / (self.bands * self.rows + self.more))


#: Documents in one slice: their number fits into the bits of a hash that are given up for it.
_DOCS = 1 << 12
#: Text of one cell whose shingles are held at a time.
_CELL_BYTES = 4 << 20


def sets(column: pa.Array, s: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges ``lo:hi`` of texts: text and 52-bit hash of every distinct shingle, sorted by text."""
    data, bounds = buffers(column)
    for first, last in slices(bounds):
        for lo in range(first, last, _DOCS):
            hi = min(lo + _DOCS, last)
            g = grid(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], lower=True)
            doc, h = shingles(g, s.width)
            both = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)))
            both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
            yield lo, hi, (both >> np.uint64(52)).astype(np.int64), both & np.uint64((1 << 52) - 1)


def signatures(column: pa.Array, s: Settings) -> dict[str, np.ndarray]:
    """Set sizes, two hashes of each whole set, bands (64 bits each) and further 8-bit values."""
    n = len(column)
    rng = np.random.Generator(np.random.PCG64(41))
    k = s.bands * s.rows + s.more
    xor = rng.integers(0, 1 << 32, k, np.uint64).astype(np.uint32)
    odd = rng.integers(0, 1 << 32, (2, k), np.uint64).astype(np.uint32) | np.uint32(1)
    out = {"n": np.zeros(n, np.int64), "s1": np.zeros(n, np.uint64), "s2": np.zeros(n, np.uint64), "bands": np.zeros((n, s.bands), np.uint64), "more": np.zeros((n, s.more), np.uint8)}
    for lo, hi, doc, h in sets(column, s):
        if not len(h):
            continue
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        at = lo + doc[first]
        out["n"][at] = np.diff(np.append(first, len(doc)))
        mixed = mix(h)
        out["s1"][at] = np.add.reduceat(mixed, first)
        out["s2"][at] = np.bitwise_xor.reduceat(mix(mixed + np.uint64(77)), first)
        least = np.empty((len(first), k), np.uint32)
        for a in range(0, len(h), 1 << 15):  # pieces that stay in cache, cut between texts
            i, j = np.searchsorted(first, [a, a + (1 << 15)])
            if i == j:
                continue
            begin, stop = first[i], first[j] if j < len(first) else len(h)
            small, cut = (mixed[begin:stop] >> np.uint64(32)).astype(np.uint32), first[i:j] - begin
            for p in range(k):
                v = (small ^ xor[p]) * odd[0, p]
                v ^= v >> np.uint32(15)
                v *= odd[1, p]
                least[i:j, p] = np.minimum.reduceat(v, cut)
        banded = (least[:, : s.bands * s.rows] & np.uint32(0xFFFF)).astype(np.uint16)
        out["bands"][at] = np.ascontiguousarray(banded).view(np.uint64) if s.rows == 4 else mix(np.add.reduce(mix(banded.reshape(len(first), s.bands, s.rows).astype(np.uint64) + np.arange(s.rows, dtype=np.uint64) * np.uint64(1 << 20)), 2))
        out["more"][at] = (least[:, s.bands * s.rows :] & np.uint32(0xFF)).astype(np.uint8)
    return out


def estimate(bands_a: np.ndarray, more_a: np.ndarray, bands_b: np.ndarray, more_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from b-bit values, corrected for values that are equal by chance.  Broadcasts."""
    wide = (bands_a.view(np.uint16) == bands_b.view(np.uint16)).mean(-1)
    narrow = (more_a == more_b).mean(-1)
    fix = lambda share, bits: (share - 2.0**-bits) / (1 - 2.0**-bits)
    a, b = bands_a.shape[-1] * 4, more_a.shape[-1]
    return (fix(wide, 16) * a + fix(narrow, 8) * b) / (a + b)


def _list_array(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel().view(np.int64)))


def _rows(column: pa.Array, width: int, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False) if kind is np.uint64 else np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return np.ascontiguousarray(flat).view(kind).reshape(len(column), width)


def signed(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, uid, n, bytes of the text, s1, s2, bands, more of every row (written to the shared folder)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = signatures(batch.column(2), s)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(x["n"]), pa.array(np.diff(buffers(batch.column(2))[1]).astype(np.int64)), pa.array(x["s1"].view(np.int64)), pa.array(x["s2"].view(np.int64)), _list_array(x["bands"]), pa.array([m.tobytes() for m in x["more"]], pa.binary())], ["doc_id", "uid", "n", "bytes", "s1", "s2", "bands", "more"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("uid"), "text")
    return written(own.mapInArrow(run, "doc_id long, uid long, n long, bytes long, s1 long, s2 long, bands array<long>, more binary"), "near-signatures")


def likely(pairs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """Of ``pairs`` (a, b) those that may be linked by set sizes and estimate.

    One a may have most pairs; a b has one a in each band at most.
    """
    side = lambda x: nodes.select(F.col("rid").alias(x), F.col("n").alias(f"n_{x}"), F.col("bands").alias(f"bands_{x}"), F.col("more").alias(f"more_{x}"))
    heads = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("times")).join(side("a"), "a"), "near-heads")
    near = join_hot(pairs, heads, ["a"], "times", "inner").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= s.percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                est = estimate(_rows(batch.column(2), s.bands, np.uint64), _rows(batch.column(3), s.more, np.uint8), _rows(batch.column(4), s.bands, np.uint64), _rows(batch.column(5), s.more, np.uint8))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(est >= s.least))

    return near.select("a", "b", "bands_a", "more_a", "bands_b", "more_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Of ``pairs`` (a, b) those whose full sets are similar enough.  ``texts``: rid, text.

    A node's partners are dealt to blocks of about ``partners``, each block with
    a copy of the node's own text; a block is one run of rows in a sorted task,
    and a task works on about half a megabyte of texts, or one longer text, at a time.
    """
    blocks = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("times"), F.ceil(F.count(F.lit(1)) / s.partners).alias("blocks")), "near-blocks")
    dealt = written(join_hot(pairs, blocks, ["a"], "times", "inner").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block")), "near-dealt")
    partner = dealt.join(texts, dealt["b"] == texts["rid"]).select("a", "block", "b", "text")
    # a node is one row here, and its text is copied from there; where that is often, first to rows in other tasks
    part = lambda first: F.explode(F.sequence(first * s.copies, F.least((first + 1) * s.copies, "blocks") - 1)).alias("block")
    few = blocks.where(F.col("blocks") <= s.copies).join(texts, F.col("a") == texts["rid"]).select("a", part(F.lit(0)), "text")
    many = blocks.where(F.col("blocks") > s.copies).join(texts, F.col("a") == texts["rid"]).select("a", "blocks", "text", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / s.copies))).alias("first"))
    many = many.repartition("a", "first").select("a", part(F.col("first")), "text")
    head = few.unionByName(many).select("a", "block", F.lit(None).cast("long").alias("b"), "text")
    rows = head.unionByName(partner).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.RecordBatch | None = None  # the last head seen
        for batch in batches:
            for lo, hi in slices(buffers(batch.column(3))[1]):
                part = batch.slice(lo, hi - lo)
                if carry is not None:
                    part = pa.Table.from_batches([carry, part]).combine_chunks().to_batches()[0]
                is_head = np.asarray(part.column(2).is_null())
                owner = np.maximum.accumulate(np.where(is_head, np.arange(part.num_rows), 0))
                carry = part.slice(int(owner[-1]), 1)
                doc, h = (np.concatenate(x) for x in zip(*[(lo + d, h) for lo, _, d, h in sets(part.column(3), s)], strict=True))
                size = np.bincount(doc, minlength=part.num_rows)
                key = mix(h ^ mix(owner[doc].astype(np.uint64)))  # equal for equal shingles under one head
                known = np.sort(key[is_head[doc]])
                where = np.minimum(np.searchsorted(known, key), len(known) - 1)
                both = np.bincount(doc, known[where] == key, part.num_rows)
                linked = ~is_head & (100 * both >= s.percent * (size + size[owner] - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2)], ["a", "b"]).filter(pa.array(linked))

    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and root (the smallest node it reaches) of all nodes on ``edges`` (a, b).

    Alternates large-star and small-star steps: every node is linked to the least
    of its neighbourhood until nothing changes, in a logarithmic number of rounds.
    One node may be on most edges.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first())
    was = mark(e)
    for _ in range(most):
        if not was[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("times")), "lowest")
        large = join_hot(both.where(F.col("v") > F.col("u")), low, ["u"], "times", "inner", total=2 * was[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large-star")
        low = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("times")), "lowest")
        small = join_hot(large, low, ["u"], "times", "inner", total=2 * was[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
        now = mark(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


_CELL = ("band", "key", "i", "j")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of one cell, from rows sorted by cell."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        if not len(t):
            continue
        sign = np.stack([t[c].to_numpy() for c in _CELL])
        cut = np.concatenate([[0], np.flatnonzero((sign[:, 1:] != sign[:, :-1]).any(0)) + 1])
        yield from (t.slice(lo, hi - lo) for lo, hi in zip(cut[:-1], cut[1:], strict=True))
        held = t.slice(cut[-1])
    if held is not None and len(held):
        yield held


def _sides(t: pa.Table, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a cell whose blocks meet and whose components and set sizes let them be linked, a tile at a time."""
    i, j = t["i"][0].as_py(), t["j"][0].as_py()
    own, root, n = (t[c].to_numpy() for c in ("own", "root", "n"))
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for a in range(0, len(left), 32):
        x, y = left[a : a + 32][:, None], right[None, :]
        good = (root[x] != root[y]) & (100 * np.minimum(n[x], n[y]) >= s.percent * np.maximum(n[x], n[y]))
        if i == j:
            good &= x < y
        x, y = np.broadcast_arrays(x, y)
        if good.any():
            yield x[good], y[good]


def across(rows: DataFrame, s: Settings) -> DataFrame:
    """Of ``rows``, those that take part in a pair which may be linked.

    ``rows``: the cell (band, key, and the blocks i and j that meet), own (the row's
    block), rid, root, n, bands, more.  Pairs of one component do not count, and a pair
    counts in its first common band only.
    """
    names = [*_CELL, "own", "rid", "root", "n"]
    ordered = rows.select(*names, "bands", "more").repartition(*_CELL).sortWithinPartitions(*_CELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches):
            if len(t) < 2:
                continue
            bands, more = _rows(t["bands"].combine_chunks(), s.bands, np.uint64), _rows(t["more"].combine_chunks(), s.more, np.uint8)
            active = np.zeros(len(t), bool)
            for x, y in _sides(t, s):
                keep = (bands[x] == bands[y]).argmax(1) == t["band"][0].as_py()
                x, y = x[keep], y[keep]
                keep = estimate(bands[x], more[x], bands[y], more[y]) >= s.least
                active[x[keep]] = active[y[keep]] = True
            if active.any():
                yield t.select(names).filter(pa.array(active)).combine_chunks().to_batches()[0]

    return ordered.mapInArrow(run, "band int, key long, i int, j int, own int, rid long, root long, n long")


def _count(texts: pa.Array, part: int, parts: int, both: np.ndarray, s: Settings) -> None:
    """Add to ``both`` how many shingles with a hash of ``part`` each two texts share."""
    found = [(lo + d[own], h[own]) for lo, _, d, h in sets(texts, s) for own in [h % np.uint64(parts) == part]]
    doc, h = (np.concatenate(x) for x in zip(*found, strict=True))
    _, column, carriers = np.unique(h, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(carriers[column] > 1)
    _, column = np.unique(column[keep], return_inverse=True)
    doc = doc[keep]
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    for a in range(0, int(column.max(initial=-1)) + 1, 2048):
        lo, hi = np.searchsorted(column, [a, a + 2048])
        m = np.zeros((len(texts), 2048), np.float32)
        m[doc[lo:hi], column[lo:hi] - a] = 1
        both += m @ m.T


def linked(rows: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) between different components inside cells, found on full sets.

    Every pair of a cell is compared: shared shingles are counted as products of the
    incidence matrix, some columns at a time.  Links that join what others of
    the cell have joined already are left out.
    """
    ordered = rows.join(texts, "rid").select(*_CELL, "own", "rid", "root", "n", "text").repartition(*_CELL).sortWithinPartitions(*_CELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches):
            texts = t["text"].combine_chunks()
            both = np.zeros((len(t), len(t)), np.float32)
            parts = -(-int(buffers(texts)[1][-1]) // _CELL_BYTES)
            for part in range(parts):  # shingles of one range of hashes at a time
                _count(texts, part, parts, both, s)
            n, root, rid = (t[c].to_numpy() for c in ("n", "root", "rid"))
            parent = {r: r for r in root.tolist()}

            def top(r: int, parent: dict = parent) -> int:
                while parent[r] != r:
                    parent[r] = r = parent[parent[r]]
                return r

            links = []
            for x, y in _sides(t, s):
                shared = both[x, y].astype(np.int64)
                for k in np.flatnonzero(100 * shared >= s.percent * (n[x] + n[y] - shared)):
                    p, q = top(int(root[x[k]])), top(int(root[y[k]]))
                    if p != q:
                        parent[p] = q
                        links.append((int(rid[x[k]]), int(rid[y[k]])))
            if links:
                yield pa.record_batch([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def _named(docs: DataFrame, rows: DataFrame, s: Settings, first: tuple[Column, ...] = ()) -> DataFrame:
    """s1, s2, n, copies, rid, doc_id and root of every distinct set in ``rows`` (signed ``docs``).

    rid and doc_id are those of the set's least row by ``first``, doc_id and uid.
    """
    least = F.min(F.struct(*first, "doc_id", "uid", "bytes", "bands", "more"))
    nodes = rows.groupBy("s1", "s2", "n").agg(least.alias("x"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes.select(F.col("x.uid").alias("rid"), F.col("x.doc_id").alias("doc_id"), "n", "s1", "s2", "copies", F.col("x.bytes").alias("bytes"), F.col("x.bands").alias("bands"), F.col("x.more").alias("more")), "near-nodes")
    buckets = nodes.select("rid", "doc_id", "bytes", F.posexplode("bands").alias("band", "key"))
    heads = written(buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"), F.min(F.struct("doc_id", "rid")).alias("x")).where("size > 1").select("band", "key", "size", "bytes", F.col("x.rid").alias("head")), "near-buckets")
    shared = written(join_hot(buckets.select("band", "key", "rid"), heads, ["band", "key"], "size", "inner"), "near-members")
    involved = shared.select("rid").distinct()
    own = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "text")
    texts = written(own.join(involved, "rid", "left_semi").dropDuplicates(["rid"]), "near-texts")
    stars = shared.where("rid <> head").select(F.col("head").alias("a"), F.col("rid").alias("b")).distinct()
    links = written(confirmed(written(likely(stars, nodes, s), "near-pairs"), texts, s), "near-links")
    root = components(links)
    with_root = shared.join(root, shared["rid"] == root["node"], "left").select("band", "key", "size", "bytes", "head", "rid", F.coalesce("root", "rid").alias("root"))
    with_root = written(with_root, "near-roots")
    still = with_root.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo <> hi").select("band", "key", "rows")
    opened = join_hot(with_root, written(still, "near-open"), ["band", "key"], "rows", "inner").drop("rows").where("rid <> head")
    opened = opened.withColumn("blocks", F.ceil(F.greatest(F.col("size") / s.block, F.col("bytes") / s.block_bytes)).cast("int")).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    opened = opened.join(nodes.select("rid", "n", "bands", "more"), "rid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    opened = opened.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    more = written(linked(written(across(opened, s), "near-cells"), texts, s), "near-links")
    if more.limit(1).count():
        known = root.select(F.col("node").alias("a"), F.col("root").alias("b"))  # stars already: fewer rounds than with all links
        root = components(known.unionByName(more.select("a", "b")))
    return written(nodes.join(root, nodes["rid"] == root["node"], "left").select("s1", "s2", "n", "copies", "rid", "doc_id", F.coalesce("root", "rid").alias("root")), "near-named")


def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Null text, and text without words, is an empty set: linked with nothing, its
    own component.  Fewer than five words are one shingle.  A row with a
    null doc_id cannot name a component: it links with nothing, its component is
    null and it is kept.  Rows that share a doc_id share what the
    smallest doc_id decides; an empty table gives no rows; other columns are ignored.
    Texts are taken whole, however long: a text longer than a slice is worked on alone.
    """
    small_batches(docs.sparkSession)
    rows = signed(docs, s)
    linkable = F.col("n").isNotNull() & (F.col("n") > 0) & F.col("doc_id").isNotNull()
    named = _named(docs, rows.where(linkable), s)
    names = written(named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("sets")), "near-names")
    named = written(join_hot(named.select("s1", "s2", "n", "copies", "root"), names, ["root"], "sets", "inner").select("s1", "s2", "n", "copies", "component_id"), "near-named")
    rows = rows.select("doc_id", "n", "s1", "s2")
    out = join_hot(rows.where(linkable), named, ["s1", "s2", "n"], "copies", "inner").select("doc_id", "n", "component_id")
    out = out.unionByName(rows.where(~linkable).select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """uid, the key of doc_id and text, of one row of every near-duplicate class.

    It is the row with the smallest doc_id; rows with a null doc_id link like others
    and come last.  A text without words is a class of its own.
    """
    small_batches(docs.sparkSession)
    rows = signed(docs, s)
    named = _named(docs, rows.where("n > 0"), s, (F.col("doc_id").isNull().alias("unnamed"),))
    least = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")).alias("x"))
    return least.select(F.col("x.rid").alias("uid")).unionByName(rows.where("n = 0").select("uid").distinct())
