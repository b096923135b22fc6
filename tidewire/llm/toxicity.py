"""Toxicity by weak supervision.

1. A lexicon is gathered from labelled rows: terms (words, and word beginnings as stem
   patterns) that go with toxic labels become voters, beside voters on patterns of
   the text.
2. Every voter votes on every document, labelled or not, and a generative label model is
   fitted to the votes alone by EM over all documents.  A voter fires with a probability that
   depends on the hidden class and on the vote of at most one other voter, its parent; the
   parents form a forest of the strongest correlations that the class leaves over.
   So accuracies and correlations are both estimated parameters.  Labels serve as
   the starting point, which says which class is the toxic one, and never vote.
3. A linear classifier over the terms is trained on the model's posterior labels
   and scores every text.

The votes of all documents are kept as distinct patterns with counts in the shared
folder, and every EM round is a Spark job that returns sums by voter.  The lexicon and the
classifier read at most ``Settings.max_rows`` labelled and as many other rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import small_batches, written
from .textgrid import NOT_LETTER, buffers, grid, mix, slices, span_hash


@dataclass(frozen=True)
class Settings:
    #: Bound on labelled rows that the lexicon is gathered from, taken in the order of a hash of their
    #: id, and on other rows that join them to train the classifier.
    max_rows: int = 16_000
    voters: int = 300
    features: int = 3_000
    #: A term counts from this many labelled rows on.
    min_rows: int = 4
    #: Least log-likelihood ratio of a term; 15 is chance in about 1 of 10,000 terms.
    least_gain: float = 15.0
    stems: tuple[int, ...] = (4, 5, 6)
    #: Rounds of EM, and those after which parents are chosen anew.
    rounds: int = 20
    parents_after: tuple[int, ...] = (0, 2, 5, 9)
    steps: int = 300
    ridge: float = 0.1


PATTERNS = ["mostly capitals", "many exclamation marks", "many symbols"]
_MASK = (1 << 20) - 1


def terms(column: pa.Array, s: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges ``lo:hi`` of texts: text and 64-bit hash of every word and word beginning."""
    data, bounds = buffers(column)
    for lo, hi in slices(bounds, 512 << 10):
        g = grid(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], lower=True, breaks=NOT_LETTER)
        docs, found = [g.doc], [g.hash]
        for k in s.stems:
            at = np.flatnonzero(g.end - g.start > k)
            docs.append(g.doc[at])
            found.append(mix(span_hash(g.prefix, g.start[at], g.start[at] + k) + np.uint64(k)))
        yield lo, hi, np.concatenate(docs), np.concatenate(found)


def patterns(column: pa.Array) -> np.ndarray:
    """A row for each text with the votes of ``PATTERNS``."""
    data, bounds = buffers(column)
    n = np.maximum(np.diff(bounds), 1)

    def share(which: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(which, out=sums[1:])
        return (sums[bounds[1:]] - sums[bounds[:-1]]) / n

    capital = share((data >= 65) & (data <= 90))
    bang = share(data == ord("!"))
    symbol = share((data > 32) & (data < 48) & (data != 44) & (data != 46) & (data != 33) | (data == 64) | (data == 94))
    return np.stack([capital > 0.3, bang > 0.02, symbol > 0.05], 1)


@dataclass
class Model:
    feature: np.ndarray  # sorted term hashes
    weight: np.ndarray
    pattern_weight: np.ndarray
    bias: float

    def score(self, column: pa.Array, s: Settings) -> np.ndarray:
        logit = self.bias + patterns(column) @ self.pattern_weight
        for lo, hi, doc, ids in hits(column, self.feature, s):
            logit[lo:hi] += np.bincount(doc, self.weight[ids], hi - lo)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def hits(column: pa.Array, known: np.ndarray, s: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Distinct (text, index into ``known``) of the terms that occur."""
    sieve = np.zeros(_MASK + 1, bool)
    sieve[(known & np.uint64(_MASK)).astype(np.int64)] = True
    for lo, hi, doc, found in terms(column, s):
        at = np.flatnonzero(sieve[(found & np.uint64(_MASK)).astype(np.int64)])
        where = np.minimum(np.searchsorted(known, found[at]), max(len(known) - 1, 0))
        good = known[where] == found[at] if len(known) else np.zeros(0, bool)
        pair = np.unique(doc[at][good] * np.int64(len(known) or 1) + where[good])
        yield lo, hi, pair // (len(known) or 1), pair % (len(known) or 1)


@dataclass
class LabelModel:
    """Share of toxic texts; each voter's parent (-1: none) and its rate of firing by parent's vote and class."""

    prior: float
    parent: np.ndarray
    rate: np.ndarray  # voters x 2 x 2

    @classmethod
    def start(cls, votes: np.ndarray, post: np.ndarray) -> LabelModel:
        """Voters on their own, with the rates that ``votes`` (rows x voters) show under the given class probabilities."""
        v, n = votes.astype(np.float64), len(votes)
        hit, false = (v.T @ post + 0.1) / (post.sum() + 1), (v.T @ (1 - post) + 0.01) / (n - post.sum() + 1)
        one = np.clip(np.stack([false, hit], 1), 1e-5, 1 - 1e-4)
        return cls(float(np.clip(post.mean(), 1e-3, 1 - 1e-3)), np.full(votes.shape[1], -1), np.repeat(one[:, None, :], 2, 1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic for every row of ``votes`` (bool)."""
        of_parent = np.where(self.parent < 0, False, votes[:, np.maximum(self.parent, 0)]).astype(np.int64)
        fired = np.log(self.rate[:, :, 1] / self.rate[:, :, 0])
        silent = np.log((1 - self.rate[:, :, 1]) / (1 - self.rate[:, :, 0]))
        each = np.arange(votes.shape[1])
        odds = np.log(self.prior / (1 - self.prior)) + np.where(votes, fired[each, of_parent], silent[each, of_parent]).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def fires(self) -> np.ndarray:
        """How often each voter fires on clean and on toxic texts (voters x 2), whatever its parent does."""
        out = np.full((len(self.parent), 2), -1.0)

        def of(i: int) -> np.ndarray:
            if out[i, 0] < 0:
                up = of(int(self.parent[i])) if self.parent[i] >= 0 else np.zeros(2)
                out[i] = up * self.rate[i, 1] + (1 - up) * self.rate[i, 0]
            return out[i]

        for i in range(len(out)):
            of(i)
        return out


def pair_sums(votes: np.ndarray, n: np.ndarray, model: LabelModel) -> np.ndarray:
    """For class 0 and 1: how often two voters fire together (2 x voters + 1 x voters + 1); the last voter always fires."""
    v = np.concatenate([votes, np.ones((len(votes), 1), bool)], 1).astype(np.float32)
    post = model.posterior(votes)
    return np.stack([(v * (n * w)[:, None].astype(np.float32)).T @ v for w in (1 - post, post)]).astype(np.float64)


def forest(sums: np.ndarray, least: float = 0.5, gain: float = 20.0) -> np.ndarray:
    """Parents by the strongest correlations within the classes: a maximum spanning forest of conditional information.

    Correlations below ``least`` are left to the class: a word and its stem are tied, two words of
    one vocabulary are not.
    """
    k = sums.shape[1] - 1
    info, strong = np.zeros((k, k)), np.zeros((k, k))
    for s in sums:
        total, one = s[-1, -1] + 1e-9, np.diag(s)[:k]
        p, q = np.clip(one / total, 1e-9, 1 - 1e-9), s[:k, :k] / total
        for both, a, b in ((q, p[:, None], p[None, :]), (p[:, None] - q, p[:, None], 1 - p[None, :]), (p[None, :] - q, 1 - p[:, None], p[None, :]), (1 - p[:, None] - p[None, :] + q, 1 - p[:, None], 1 - p[None, :])):
            both = np.maximum(both, 0)
            info += total * np.where(both > 1e-12, both * np.log(np.maximum(both, 1e-12) / (a * b)), 0)
        strong = np.maximum(strong, np.abs(q - p[:, None] * p[None, :]) / np.sqrt((p * (1 - p))[:, None] * (p * (1 - p))[None, :]))
    info[(strong < least) | (2 * info < gain)] = 0
    np.fill_diagonal(info, 0)
    parent = np.full(k, -1)
    reached = np.zeros(k, bool)
    for root in np.argsort(-info.sum(1), kind="stable"):
        if reached[root]:
            continue
        reached[root] = True
        best, by = info[root].copy(), np.full(k, root)
        while True:  # Prim's algorithm within what is tied to the root
            best[reached] = 0
            i = int(best.argmax())
            if best[i] <= 0:
                break
            parent[i], reached[i] = by[i], True
            closer = info[i] > best
            best[closer], by[closer] = info[i][closer], i
    return parent


def refit(sums: np.ndarray, parent: np.ndarray, trust: float = 2.0) -> LabelModel:
    """The model that the sums ask for, rates with few cases drawn towards the voter's own rate in the class."""
    k = sums.shape[1] - 1
    each, up = np.arange(k), np.where(parent < 0, k, parent)
    rate = np.empty((k, 2, 2))
    for y, s in enumerate(sums):
        total, one = s[-1, -1], np.diag(s)[:k]
        own = (one + (0.1 if y else 0.01)) / (total + 1)
        together, parents = s[each, up], s[up, up]
        with_, without = (together + trust * own) / (parents + trust), (one - together + trust * own) / (total - parents + trust)
        rate[:, 1, y], rate[:, 0, y] = np.where(parent < 0, own, with_), np.where(parent < 0, own, without)
    share = sums[1][-1, -1] / sums[:, -1, -1].sum()
    return LabelModel(float(np.clip(share, 1e-4, 1 - 1e-4)), parent, np.clip(rate, 1e-5, 1 - 1e-4))


def _dense(lists: pa.Array, k: int) -> np.ndarray:
    votes = np.zeros((len(lists), k), bool)
    votes[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
    return votes


def label_model(patterns_: DataFrame, start: LabelModel, s: Settings) -> LabelModel:
    """Accuracies and correlations by EM.  ``patterns_``: votes (voters that fired), n (how many documents).

    A round sums up in every task and in Spark; what comes to the driver is a row for each two voters.
    """
    model, k = start, len(start.parent)

    for step in range(s.rounds):
        def gather(batches: Iterator[pa.RecordBatch], model: LabelModel = model) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, k + 1, k + 1))
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    sums += pair_sums(_dense(pa.concat_arrays([part.column(0)]), k), part.column(1).to_numpy(), model)
            i, j = np.nonzero(np.triu(sums.sum(0)))
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[0, i, j]), pa.array(sums[1, i, j])], ["i", "j", "clean", "toxic"])

        found = patterns_.mapInArrow(gather, "i int, j int, clean double, toxic double").groupBy("i", "j").agg(F.sum("clean"), F.sum("toxic")).toArrow()
        i, j = found.column(0).to_numpy(), found.column(1).to_numpy()
        sums = np.zeros((2, k + 1, k + 1))
        for y in (0, 1):
            sums[y, i, j] = sums[y, j, i] = found.column(2 + y).to_numpy()
        model = refit(sums, forest(sums) if step in s.parents_after else model.parent)
    return model


def linear(doc: np.ndarray, ids: np.ndarray, extra: np.ndarray, goal: np.ndarray, n_features: int, s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge logistic regression on soft labels by adaptive gradient steps."""
    n, k = len(goal), extra.shape[1]
    x = extra.astype(np.float64)
    w = np.zeros(n_features + k + 1)
    w[-1] = np.log((goal.mean() + 1e-3) / (1 - goal.mean() + 1e-3))
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    ridge = np.concatenate([np.full(n_features + k, s.ridge), [0.0]])
    for t in range(1, s.steps + 1):
        z = np.bincount(doc, w[:n_features][ids], n) + x @ w[n_features:-1] + w[-1]
        err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - goal
        grad = np.concatenate([np.bincount(ids, err[doc], n_features), x.T @ err, [err.sum()]]) + ridge * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        w -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-6) * min(1.0, 3 * (1 - t / (s.steps + 1)) + 0.02)
    return w[:n_features], w[n_features:-1], float(w[-1])


def fit(docs: DataFrame, labelled: DataFrame, s: Settings = Settings()) -> Model:
    """``docs``: the texts the label model learns from, labels or not; ``labelled``: text, toxic (0 or 1), at most about ``max_rows`` rows."""
    small_batches(docs.sparkSession)
    labelled = written(labelled, "toxic-labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, doc, found in terms(batch.column(0), s):
                kinds, which = np.unique(found, return_inverse=True)
                pair = np.unique(which * np.int64(hi - lo) + doc)
                own = toxic[lo:hi][pair % (hi - lo)]
                all_of, of_toxic = np.bincount(pair // (hi - lo), minlength=len(kinds)), np.bincount(pair // (hi - lo), own, len(kinds))
                yield pa.record_batch([pa.array(kinds.view(np.int64)), pa.array(of_toxic.astype(np.int64)), pa.array(all_of.astype(np.int64))], ["term", "pos", "n"])

    size = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("pos")).first()
    n, pos = size["n"], size["pos"] or 0
    if not pos or pos == n:  # nothing to tell apart
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(len(PATTERNS)), 10.0 if pos else -10.0)
    counted = labelled.mapInArrow(count, "term long, pos long, n long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).where(F.col("n") >= s.min_rows)
    p, q = (F.col("pos") + 0.5) / (pos + 1), (F.col("n") - F.col("pos") + 0.5) / (n - pos + 1)
    lift = F.log(p / q)
    expected = F.col("n") * (pos / n)
    part = lambda seen, due: F.when(seen > 0, 2 * seen * F.log(seen / due)).otherwise(0.0)
    gain = part(F.col("pos"), expected) + part(F.col("n") - F.col("pos"), F.col("n") - expected)  # log-likelihood ratio
    strong = counted.select("term", gain.alias("z"), lift.alias("lift")).where(F.col("z") >= s.least_gain).orderBy(F.col("z").desc(), "term").limit(s.features).toArrow()
    term = strong.column(0).to_numpy().view(np.uint64)
    order = np.argsort(term)
    term, strength, lifts = term[order], strong.column(1).to_numpy()[order], strong.column(2).to_numpy()[order]
    voters = np.argsort(-np.where(lifts > 1.5, strength, -np.inf))[: s.voters]
    voters = voters[lifts[voters] > 1.5]

    column = np.full(len(term), -1)
    column[voters] = np.arange(len(voters))
    k = len(voters) + len(PATTERNS)

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """toxic, known terms and votes of every text."""
        for batch in batches:
            lists: list[np.ndarray] = []
            for lo, hi, doc, ids in hits(batch.column(1), term, s):
                lists += np.split(ids, np.searchsorted(doc, np.arange(1, hi - lo)))
            odd = patterns(batch.column(1))
            votes = [np.sort(np.concatenate([column[x][column[x] >= 0], len(voters) + np.flatnonzero(o)])) for x, o in zip(lists, odd, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(lists, pa.list_(pa.int64())), pa.array(votes, pa.list_(pa.int64()))], ["toxic", "ids", "votes"])

    shape = "toxic int, ids array<long>, votes array<long>"
    others = docs.where(F.col("text").isNotNull()).select(F.lit(None).cast("int").alias("toxic"), "text")
    seen = written(others.mapInArrow(cast, shape).groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "toxic-votes")
    total = seen.agg(F.sum("n")).first()[0] or 0
    chosen = others.where(F.pmod(F.xxhash64(F.lit(9), "text"), F.lit(1 << 30)) < int(min(1.0, s.max_rows / max(total, 1)) * (1 << 30))).limit(s.max_rows)
    rows = labelled.select("toxic", "text").unionByName(chosen).mapInArrow(cast, shape).toArrow()
    toxic = rows.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
    lists, votes = rows.column(1).combine_chunks(), _dense(rows.column(2).combine_chunks(), k)
    doc = np.repeat(np.arange(len(toxic)), np.diff(lists.offsets.to_numpy()))
    known = ~np.isnan(toxic)
    found = label_model(seen, LabelModel.start(votes[known], np.where(toxic[known] > 0, 0.95, 0.05)), s)
    posterior = found.posterior(votes)
    if posterior[known & (toxic > 0)].mean() < posterior[known & (toxic == 0)].mean():  # labels say which class is which
        posterior = 1 - posterior
    weight, pattern_weight, bias = linear(doc, lists.flatten().to_numpy(), votes[:, len(voters) :], posterior, len(term), s)
    return Model(term, weight, pattern_weight, bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """text and toxic of at most ``max_rows`` labelled rows, in the order of a hash of doc_id.

    Several labels of one document: toxic if any says so.  The chosen ids are
    at most ``max_rows`` small rows, so they are broadcast.
    """
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_rows)
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def score(docs: DataFrame, model: Model, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (score >= 0.5).

    Null and empty texts get the score of a text without any known term.  Other
    columns pass through (``score`` and ``predicted`` are replaced); an empty
    table gives no rows; equal texts get equal scores.  A model fitted without
    both classes gives every text the same score.  Texts are read whole, however long; one longer
    than a slice is worked on alone.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.score(batch.column(at), s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
