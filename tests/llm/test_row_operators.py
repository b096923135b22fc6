"""Neighbours, toxicity, archives, language ID, URL rules and mixing."""

import base64
import hashlib
import io
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from tidewire.llm import langid, mixing, neighbours, queries, toxicity, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(i):
    return zlib.crc32(str(i).encode())


# ---------------------------------------------------------------- neighbours


def exact_nearest(ids, x, asks, k=20):
    out = {}
    for i, v in zip(ids, x, strict=True):
        if asks(i):
            scores = (x * v).sum(1)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found_nearest(df):
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


@pytest.mark.parametrize("at", ["sf0.01", "sf0.1"])
def test_neighbours_recall_and_scores(spark, at):
    folder = f"/root/testdata/{at}"
    t = pq.read_table(f"{folder}/embeddings.parquet")
    rows = [(i, v) for i, v in zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True) if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    want = exact_nearest(ids, x, lambda i: i % 20 == 0)
    got = found_nearest(queries.op2_neighbours(spark, folder))
    assert set(got) == set(want)
    place = {int(i): k for k, i in enumerate(ids)}
    for q, near in got.items():
        assert len(near) == min(20, len(ids) - 1) and q not in [v for v, _ in near]
        assert near == sorted(near, key=lambda p: (-p[1], p[0]))
        assert np.allclose([s for _, s in near], [x[place[q]] @ x[place[v]] for v, _ in near], rtol=1e-12, atol=1e-12)
    recall = np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / max(1, len(want[q])) for q in want])
    assert recall >= 0.95


def test_neighbours_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (20, [-1.0, 2.0]), (None, [1.0, 1.0]), (8, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, code string, rb int")
    got = found_nearest(neighbours.search(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(1, 0.5), (2, 0.5), (20, -1.0)], 20: [(1, 0.5), (2, 0.5), (0, -1.0)]}
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.search(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_repeated_ids_and_other_lengths(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [3.0, 0.0]), (1, [0.5, 0.0]), (1, [0.9, 0.0]), (1, [0.9, 0.0]), (2, [0.4, 1.0]), (20, [1.0, 2.0, 3.0]), (21, [1.0, 1.0, 1.0]), (40, [7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found_nearest(neighbours.search(df, F.col("vec_id") % 20 == 0)) == {0: [(1, 0.5), (2, 0.4)], 20: [(21, 6.0)]}


def test_pigeonhole_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 16, (3000, 8)).astype(np.uint16)
    codes[:400] = codes[0]
    for _ in range(3):  # codes a few bits from one another
        codes[np.arange(400), rng.integers(0, 8, 400)] ^= (1 << rng.integers(0, 16, 400)).astype(np.uint16)
    for flips in (0, 1, 2, 3):
        seen = neighbours.Block(np.arange(3000), np.zeros((3000, 2)), codes, flips).probe(codes[:40])
        apart = np.bitwise_count(codes[:40, None] ^ codes)
        assert (seen == (apart <= flips).any(2)).all()
        within = apart.sum(2) <= 8 * (flips + 1) - 1
        assert seen[within].all() and within.sum() > 40


def vectors(at):
    """Those of a table, or 10,000 made in 100 loose groups."""
    if at == "made":
        rng = np.random.default_rng(12)
        return rng.permutation(np.repeat(rng.normal(size=(100, 64)), 100, 0) + 0.7 * rng.normal(size=(10_000, 64)))
    t = pq.read_table(f"/root/testdata/{at}/embeddings.parquet", columns=["embedding"])
    return np.array([v for v in t["embedding"].to_pylist() if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)], np.float64)


@pytest.mark.parametrize(("at", "most"), [("sf0.1", 0.30), ("made", 0.22)])
def test_probing_touches_a_bounded_share_of_rows(at, most):
    x = vectors(at)
    s = neighbours.Settings()
    coder = neighbours.calibrate(neighbours.learn(x[:8192], np.sqrt((x**2).sum(1)).max(), s.substrings), x[:8192], len(x), s)
    ids, asks = np.arange(len(x)), np.arange(0, len(x), 40)
    block = neighbours.Block(ids, x, coder.encode(x), coder.flips)
    hit = 0
    for q, (near, _) in zip(asks, block.nearest(asks, x[asks], coder.encode(x[asks], query=True), 20), strict=True):
        scores = x @ x[q]
        scores[q] = -np.inf
        hit += len(set(near) & set(np.argsort(-scores)[:20]))
    assert hit / (20 * len(asks)) >= 0.9
    assert block.touched / (len(asks) * len(x)) <= most
    print(at, coder.rotation.shape, coder.flips, coder.predicted, hit / (20 * len(asks)), block.touched / (len(asks) * len(x)))


def tight(groups, each, width=64, seed=7):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(groups, width)), each, 0) + 0.15 * rng.normal(size=(groups * each, width))
    return rng.permutation(x / np.linalg.norm(x, axis=1, keepdims=True))


def test_blocks_touch_what_one_block_touches():
    x = tight(100, 40)
    s = neighbours.Settings()
    coder = neighbours.calibrate(neighbours.learn(x, 1.0, s.substrings), x, len(x), s)
    codes, ids, asks = coder.encode(x), np.arange(len(x)), np.arange(0, len(x), 20)

    def touched(parts):
        blocks = [neighbours.Block(ids[p::parts], x[p::parts], codes[p::parts], coder.flips, 1.0) for p in range(parts)]
        for b in blocks:
            list(b.nearest(asks, x[asks], coder.encode(x[asks], query=True), 20))
        return sum(b.touched for b in blocks)

    assert touched(8) == touched(1) < 0.1 * len(x) * len(asks)


def test_a_few_long_vectors_leave_codes_of_others_alone(spark):
    x = tight(50, 40)

    def fit(rows):
        seen = []
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
        was, neighbours.fitted = neighbours.fitted, lambda *a, keep=neighbours.fitted: seen.append(keep(*a)) or seen[0]
        try:
            got = found_nearest(neighbours.search(df, F.col("vec_id") % 20 == 0))
        finally:
            neighbours.fitted = was
        for q, near in got.items():
            scores = rows @ rows[q]
            scores[q] = -np.inf
            assert len(near) == 20 and len({v for v, _ in near} & set(np.argsort(-scores)[:20].tolist())) >= 16
        return seen[0].predicted["touched"]

    plain = fit(x)
    x[7] *= 1000
    assert abs(fit(x) - plain) < 0.1 * plain + 1e-3


def test_queries_that_find_too_few_meet_every_row(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([tight(30, 40, 16), rng.normal(size=(40, 16))])
    x[1200:] /= np.linalg.norm(x[1200:], axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    thin = neighbours.Settings(substrings=1, flips=(0,), row_block=256)
    with pytest.warns(UserWarning, match="of the nearest rows in the sample"):
        got = found_nearest(neighbours.search(df, F.col("vec_id") >= 1200, thin))
    lone = [q for q in got if q >= 1200]
    assert len(lone) == 40 and all(len(got[q]) == 20 for q in lone)
    exact = 0
    for q in lone:
        scores = x @ x[q]
        scores[q] = -np.inf
        exact += {v for v, _ in got[q]} == set(np.argsort(-scores)[:20].tolist())
    assert exact >= 10  # most lone queries share a key with fewer than 20 rows


# ---------------------------------------------------------------- toxicity


def auc(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    _, which, n = np.unique(p, return_inverse=True, return_counts=True)
    rank[order] = np.arange(1, len(p) + 1)
    mean = np.bincount(which, rank) / n
    pos = y == 1
    return (mean[which][pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op3_toxicity(spark, folder).collect()}
    labels = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    assert len(got) == pq.read_metadata(f"{folder}/documents.parquet").num_rows
    assert all(r["held_out"] == (crc(i) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())
    held = [(r["toxic"], got[r["doc_id"]]["score"]) for r in labels if r["toxic"] is not None and crc(r["doc_id"]) % 5 == 0]
    y, p = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    assert auc(y, p) > 0.9
    assert (p[y == 0] >= 0.5).mean() < 0.05


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a", 1), (2, "", "b", 2), (3, "you " * 40_000, "c", 3), (4, "fine words", "d", 4), (4, "fine words", "d", 4)], "doc_id long, text string, score string, toxic int")
    plain = toxicity.fit(docs.select("text"), toxicity.labelled_sample(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    out = toxicity.score(docs, plain).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out) and out[0]["toxic"] == 1
    assert toxicity.score(docs.limit(0), plain).count() == 0


def vote_table(spark, votes):
    seen = Counter(tuple(int(j) for j in np.flatnonzero(v)) for v in votes)
    return spark.createDataFrame([(list(k), n) for k, n in seen.items()], "votes array<long>, n long").repartition(3)


def test_label_model_estimates_planted_accuracies_and_correlations(spark):
    rng = np.random.default_rng(5)
    n = 20_000
    y = rng.random(n) < 0.15
    hit, false = np.array([0.7, 0.6, 0.5, 0.55, 0.4, 0.65]), np.array([0.05, 0.03, 0.06, 0.02, 0.04, 0.05])
    votes = rng.random((n, 6)) < np.where(y[:, None], hit, false)
    copies = [votes[:, :1] ^ (rng.random((n, 1)) < 0.01) for _ in range(4)]  # a family that nearly always agrees
    votes = np.concatenate([votes, *copies], 1)
    wrong = np.where(rng.random(n) < 0.25, ~y, y)[:800]  # a quarter of the labels is wrong
    start = toxicity.LabelModel.start(votes[:800], np.where(wrong, 0.95, 0.05))
    found = toxicity.label_model(vote_table(spark, votes), start, toxicity.Settings())
    fires = found.fires()
    assert np.abs(fires[:6, 1] - hit).max() < 0.05 and np.abs(fires[:6, 0] - false).max() < 0.05
    assert abs(found.prior - 0.15) < 0.03
    family = {0, 6, 7, 8, 9}
    tied = {i for i in range(10) if found.parent[i] >= 0}
    assert len(tied & family) == 4 and all(int(found.parent[i]) in family for i in tied & family) and not tied - family
    post = found.posterior(votes[:800]) > 0.5
    assert (post == y[:800]).mean() > 0.93 > 0.8 > (wrong == y[:800]).mean()


def test_label_model_equals_a_plain_em(spark):
    rng = np.random.default_rng(8)
    y = rng.random(4_000) < 0.2
    votes = rng.random((4_000, 5)) < np.where(y[:, None], [0.7, 0.6, 0.5, 0.6, 0.4], [0.05, 0.1, 0.04, 0.08, 0.05])
    start = toxicity.LabelModel.start(votes[:500], np.where(y[:500], 0.95, 0.05))
    s = toxicity.Settings()
    found = toxicity.label_model(vote_table(spark, votes), start, s)
    # row by row, without patterns, counts or matrices: voters are independent here, so no voter has a parent
    prior, fires = start.prior, start.fires()
    for _ in range(s.rounds):
        hit, false, total = [0.0] * 5, [0.0] * 5, [0.0, 0.0]
        for pattern, n in Counter(map(tuple, votes.tolist())).items():
            like = [1 - prior, prior]
            for j, v in enumerate(pattern):
                for c in (0, 1):
                    like[c] *= fires[j][c] if v else 1 - fires[j][c]
            p = like[1] / (like[0] + like[1])
            total[0], total[1] = total[0] + n * (1 - p), total[1] + n * p
            for j, v in enumerate(pattern):
                hit[j], false[j] = hit[j] + n * p * v, false[j] + n * (1 - p) * v
        prior = total[1] / sum(total)
        fires = [((f + 0.01) / (total[0] + 1), (h + 0.1) / (total[1] + 1)) for h, f in zip(hit, false, strict=True)]
    assert (found.parent < 0).all()
    assert abs(found.prior - prior) < 1e-3 and np.abs(found.fires() - np.array(fires)).max() < 2e-3


def test_wrong_labels_do_not_reach_the_classifier(spark):
    rng = random.Random(11)
    plain, bad = [f"plain{chr(97 + k)}x" for k in range(26)], ["dreckwort", "fieswort", "schundwort", "ekelwort"]
    rows = []
    for i in range(3000):
        y = rng.random() < 0.2
        words = rng.choices(plain, k=40) + (rng.sample(bad, 3) if y else ([rng.choice(bad)] if rng.random() < 0.03 else []))
        rows.append((i, " ".join(rng.sample(words, len(words))), int(y)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    given = [(i, 1 - y if rng.random() < 0.15 else y) for i, _, y in rows[:1200]]
    model = toxicity.fit(docs.select("text"), toxicity.labelled_sample(docs, spark.createDataFrame(given, "doc_id long, toxic int")))
    said = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    right = sum(said[i] == y for i, _, y in rows) / len(rows)
    assert right > 0.96 and sum(t == rows[i][2] for i, t in given) / len(given) < 0.9


# ---------------------------------------------------------------- archives


def test_warc_query(spark, sf):
    pages = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    most = {}
    for p in pages:
        h = p["html"] or ""
        most[h] = max(most.get(h, -1), p["page_id"])
    want = []
    for p in pages:
        h = p["html"] or ""
        again = most[h] != p["page_id"]
        want.append((p["page_id"], len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if again else "response", most[h] if again else None))
    assert sorted(tuple(r) for r in queries.op4_warc(spark, sf).collect()) == sorted(want)


def test_warc_round_trip_of_odd_pages(spark):
    rows = [(1, "http://a\r\n/x", None), (2, None, ""), (3, "u", "x\r\n\r\ny"), (4, "u", "é" * 200_000), (5, "u", "x\r\n\r\ny"), (5, "u", "x\r\n\r\ny"), (None, "u", "no id"), (None, "u", "x\r\n\r\ny")]
    rows += [(100 + k, "http://h/é", f"<p>page {k} of many pages</p>" * 30) for k in range(40)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "page_id long, url string, html string, keeper string, path int")
    manifest = warc.write_archives(df)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    for m in manifest.collect():  # on disk: the dictionary in a leading skippable frame, then a frame for each record
        raw = open(m["path"], "rb").read()
        assert len(raw) == m["bytes"] and raw[:4] in (warc.FRAME_MAGIC, warc.DICTIONARY_MAGIC.to_bytes(4, "little"))
        assert len(list(warc.frames(io.BytesIO(raw)))) == m["records"]
    out = warc.read_archives(manifest).collect()
    assert len(out) == len(rows) and all(r["problem"] is None for r in out)
    html = {r[0]: (r[2] or "") for r in rows if r[0] is not None}
    for r in out:
        if r["record_type"] == "response" and r["page_id"] is not None:
            assert bytes(r["payload"]).decode() == html[r["page_id"]]
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in out if r["page_id"] is None or r["page_id"] < 100)
    assert kinds == {(1, "revisit", 2): 1, (2, "response", None): 1, (3, "revisit", 5): 1, (4, "response", None): 1, (5, "response", None): 2, (None, "response", None): 1, (None, "revisit", 5): 1}
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_refuses_broken_archives():
    record = warc.build_record("response", 7, "http://x/", b"hello", None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(record)["payload"] == b"hello"
    broken = [record[:-1], record.replace(b"hello", b"hullo"), record.replace(b"WARC-Date: 2024-01-01T00:00:00Z\r\n", b""), b"HTTP/1.1 200\r\n\r\n", re.sub(rb"(\r\nContent-Length: )\d+(\r\n\r\nHTTP)", rb"\g<1>many\2", record)]
    for bad in broken:
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    # a plain and a compressed dictionary, other skippable frames, and a frame cut short
    samples = [warc.build_record("response", k, f"http://h/{k}", b"<html>some body text</html>" * (k % 7 + 1), None, "2024-01-01T00:00:00Z") for k in range(200)]
    trained = zstandard.train_dictionary(2048, samples)
    packer = zstandard.ZstdCompressor(dict_data=trained)
    for held in (trained.as_bytes(), zstandard.compress(trained.as_bytes())):
        archive = warc.dictionary_frame(held) + packer.compress(samples[0]) + b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc" + packer.compress(samples[1])
        assert list(warc.frames(io.BytesIO(archive))) == samples[:2]
        with pytest.raises(warc.WarcError):
            list(warc.frames(io.BytesIO(archive[:-3])))
        with pytest.raises(warc.WarcError):
            list(warc.frames(io.BytesIO(archive + b"junk")))


def test_lenient_reading_goes_on_behind_a_broken_frame(spark, tmp_path):
    records = [warc.build_record("response", k, f"http://h/{k}", b"<p>page %d</p>" % k * (k + 1), None, "2024-01-01T00:00:00Z") for k in range(6)]
    packed = [zstandard.compress(r) for r in records]
    bad = packed[2][:6] + bytes(b ^ 0x5A for b in packed[2][6:])
    for at, data in (("bad", [*packed[:2], bad, *packed[3:]]), ("junk", [*packed[:2], b"some junk", *packed[3:]]), ("cut", [*packed[:2], packed[2][:-4], *packed[3:]]), ("end", [*packed[:2], *packed[3:], packed[2][:-3]])):
        (tmp_path / at).write_bytes(b"".join(data))
        got = warc.read_archives(spark.createDataFrame([(str(tmp_path / at),)], "path string"), strict=False).collect()
        assert sorted(r["page_id"] for r in got if r["problem"] is None) == [0, 1, 3, 4, 5], at
        assert sum(r["problem"] is not None for r in got) == 1
        with pytest.raises(Exception, match="WarcError"):
            warc.read_archives(spark.createDataFrame([(str(tmp_path / at),)], "path string")).collect()


# ---------------------------------------------------------------- language ID


def test_langid_on_held_out_rows(spark, sf):
    got = {r["doc_id"]: r for r in queries.op5_langid(spark, sf).collect()}
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    assert set(got) == {r["doc_id"] for r in rows}
    letters = lambda t: any(c.isalpha() for c in t or "")
    right = []
    for r in rows:
        g = got[r["doc_id"]]
        assert g["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= g["score"] <= 1
        assert (g["lang_pred"] == "und") == (not letters(r["text"]))
        if g["held_out"] and r["lang"] is not None and letters(r["text"]):
            right.append(g["lang_pred"] == r["lang"])
    assert np.mean(right) > 0.9


def test_langid_equals_a_plain_naive_bayes(spark):
    s = langid.Settings(orders=(1, 2), buckets=64)
    rows = [(1, "aaab", "x"), (2, "aba", "x"), (3, "ccd", "y"), (4, None, "y"), (5, "zz", None)]
    names, logp = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), s)
    counts = np.zeros((2, 64))
    for _, text, lang in rows[:3]:
        import pyarrow as pa

        for _, _, _, ids, _ in langid.ngrams(pa.array([text]), s):
            np.add.at(counts["xy".index(lang)], ids, 1)
    want = np.log((counts + s.smoothing) / (counts + s.smoothing).sum(1, keepdims=True))
    assert names == ["x", "y"] and np.allclose(logp[:, :-1], want)
    assert np.allclose(logp[:, -1], np.log([3 / 5, 2 / 5]))


def test_langid_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "q", 1.0), (2, "", "q", 1.0), (3, "123 !", "q", 1.0), (4, "der Hund " * 30_000, "q", 1.0), (4, "der Hund", "q", 1.0)], "doc_id long, text string, lang_pred string, score double")
    model = langid.train(spark.createDataFrame([("der die das Hund", "de"), ("the dog and cat", "en")], "text string, lang string"))
    out = sorted((r["doc_id"], r["lang_pred"]) for r in langid.predict(df, model).collect())
    assert out == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de")]
    nothing = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in langid.predict(df, nothing).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


# ---------------------------------------------------------------- URL filter


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    best = None
    for said, rule in queries.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = said, rule
    return best or (None, None)


def test_url_query_against_plain_rules(spark):
    folder = "/root/testdata/sf0.1"
    pages = {r["page_id"]: r["url"] for r in pq.read_table(f"{folder}/pages.parquet", columns=["page_id", "url"]).to_pylist()}
    out = queries.op9_url_filter(spark, folder).collect()
    assert len(out) == len(pages)
    for r in out:
        host, path = plain_split(pages[r["page_id"]])
        said, rule = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (said is None or r["verdict"] == said)
    ruled = [r for r in out if r["rule"]]
    assert np.mean([(r["block_score"] >= 0.5) == (r["verdict"] == "block") for r in ruled]) > 0.9  # the trees learn the lists


def test_url_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x?y#z", "http://a.com?x=/fr/", "http://a.com/fr/", "http://É.com/de/1", "x://y://z/w", "http://org", "http://org/" + "a" * 20_000, "http://a.com/\n/fr/"] * 2
    df = spark.createDataFrame([(i, u, "h", 1, "l") for i, u in enumerate(urls)], "page_id long, url string, host string, label int, rule string")
    for r in url_filter.judge(df, queries.RULES).collect():
        assert (r["host"], r["path"]) == plain_split(urls[r["page_id"]])
        assert r["rule"] == plain_rule(r["host"], r["path"])[1]
    assert {r["verdict"] for r in url_filter.judge(df, []).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0), queries.RULES).count() == 0


def test_rates_leave_out_the_rows_of_their_own_fold(spark):
    rng = random.Random(3)
    rows = [(k, f"s{min(rng.randrange(40), rng.randrange(40))}", rng.choice([0.0, 1.0, None]), rng.randrange(url_filter.FOLDS)) for k in range(2000)]
    rows += [(5000 + k, "common", float(k % 3 == 0), k % url_filter.FOLDS) for k in range(1500)] + [(9000, "alone", 1.0, 2)]
    df = spark.createDataFrame(rows, "page_id long, section string, label double, _fold int")
    got = {r["page_id"]: r for r in url_filter.with_rate(df, url_filter.rates(df, "section"), "section").collect()}
    assert len(got) == len(rows)
    for k, section, label, fold in rows[::17] + rows[-1:]:
        other = [y for _, c, y, f in rows if c == section and y is not None and (label is None or f != fold)]
        assert got[k]["section_rate"] == pytest.approx((sum(other) + 5) / (len(other) + 10))
    assert got[9000]["section_rate"] == 0.5  # its own label is not in it


def test_urls_without_a_rule_get_the_verdict_of_urls_like_them(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    rows = []
    for k in range(1600):
        bad = k % 2 == 0
        path = "/".join(word(4) for _ in range(2)) + (f"/{rng.randrange(10**9)}{rng.randrange(10**9)}?a=1&b=2&c=3" if bad else "")
        host = ("bad.net" if bad else "good.org") if k < 1200 else f"{word(6)}.com"
        rows.append((k, f"https://{host}/{path}", bad))
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(df, [("block", "bad.net/"), ("allow", "good.org/")]).collect()}
    assert all((got[k]["verdict"] == "block") == bad for k, _, bad in rows[:1200])
    free = rows[1200:]
    assert sum((got[k]["verdict"] == "block") == bad for k, _, bad in free) / len(free) > 0.95
    assert all((got[k]["block_score"] >= 0.5) == (got[k]["verdict"] == "block") for k, _, _ in free)


# ---------------------------------------------------------------- mixing


def plain_targets(sizes, most=3.0):
    """Shares by weight; what is above its limit is cut and the excess reshared until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: float(k % 3 + 1) for k, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_mixing_query(spark, sf):
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text", "source"]).to_pylist()
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}
    of = {r["doc_id"]: r["source"] for r in rows}
    by = Counter()
    for i, n in size.items():
        by[of[i]] += n
    want = plain_targets(by)
    out = queries.op10_mixing(spark, sf).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(size)
    taken = Counter()
    for r in out:
        i = r["doc_id"]
        assert r["size"] == size[i] and r["source_size"] == by[of[i]]
        assert r["target"] == pytest.approx(want[of[i]])
        assert 0 <= r["taken"] <= 3 * size[i]
        taken[of[i]] += r["taken"]
    for s in by:
        assert abs(taken[s] - want[s]) <= 1
    again = sorted(tuple(r) for r in queries.op10_mixing(spark, sf).collect())
    assert again == sorted(tuple(r) for r in out)


@pytest.mark.parametrize("n", [{"a": 1000, "b": 1, "c": 10, None: 5}, {"a": 1}, {"b": 0, "a": 50}, {k: ord(k) ** 2 for k in "abcdefgh"}])
def test_mixing_targets(spark, n):
    df = spark.createDataFrame([(s, k, 1) for s, k in n.items()], "source string, source_size long, n_docs long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(n))


def test_splitting_tree_keeps_quotas_and_fills_shards(spark):
    quotas = {1: 700, 2: 33, 3: 1, 4: 0, 5: 90}
    df = spark.createDataFrame(list(quotas.items()), "source long, blocks long")
    out = mixing.split_quotas(df, 8, 3).collect()
    by_source, by_shard = Counter(), Counter()
    for r in out:
        by_source[r["source"]] += r["blocks"]
        by_shard[r["shard"]] += r["blocks"]
    assert {s: by_source[s] for s in quotas} == quotas
    assert max(by_shard.values()) - min(by_shard.values()) <= 3 and len(by_shard) == 8


def test_taken_words_come_from_the_blocks_that_shards_draw(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), rng.choice("aab")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = {}
    real = mixing.split_quotas

    def listed(quotas, shards, seed):
        told["quotas"] = {r["source"]: r["blocks"] for r in quotas.collect()}
        told["leaves"] = real(quotas, shards, seed).collect()
        return spark.createDataFrame(told["leaves"], "source long, shard long, blocks long")

    monkeypatch.setattr(mixing, "split_quotas", listed)
    full = mixing.plan(df, shards=8, block_words=100).collect()
    drawn = {(r["source"], r["shard"]): r["blocks"] for r in told["leaves"] if r["blocks"]}
    place = {"a": 1, "b": 2}
    for source, k in place.items():  # the shards' words: whole blocks, each as often as the leaf says
        of = [c for r in full if r["source"] == source for c in r["copies"]]
        words = Counter()
        for c in of:
            words[c["shard"]] += c["words"]
        assert set(words) <= {shard for s, shard in drawn if s == k}
        assert sum(n for (s, _), n in drawn.items() if s == k) == told["quotas"][k] == -(-round(next(r["target"] for r in full if r["source"] == source)) // 100)
        for shard, n in words.items():
            assert abs(n - 100 * drawn[k, shard]) <= 80 * drawn[k, shard]  # documents begin in a block and may end in the next
    # a shard that draws nothing takes nothing: what the tree says decides
    gone = max((r for r in told["leaves"] if r["source"] == 1), key=lambda r: r["blocks"])["shard"]
    monkeypatch.setattr(mixing, "split_quotas", lambda q, n, seed: listed(q, n, seed).where(f"NOT (source = 1 AND shard > {gone - 1})"))
    less = mixing.plan(df, shards=8, block_words=100).collect()
    assert sum(r["taken"] for r in less) < sum(r["taken"] for r in full)
    monkeypatch.setattr(mixing, "split_quotas", lambda q, n, seed: listed(q, n, seed).limit(0))
    assert sum(r["taken"] for r in mixing.plan(df, shards=8, block_words=100).collect()) == 0


def test_every_block_has_its_own_draw(spark):
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        got = spark.range(n).select(mixing.shuffled_draw(F.col("id"), F.lit(n)).alias("d")).collect()
        assert sorted(r["d"] for r in got) == list(range(n))


def test_draws_of_a_shard_are_spread_over_the_source_and_follow_the_key(spark):
    counts = [30, 31, 32, 33, 61, 66, 75, 90, 150, 175, 1000]
    rows = spark.range(1000).crossJoin(spark.createDataFrame([(n, k) for n in counts for k in (1, 2)], "n long, k long").hint("broadcast")).where("id < n")
    got = defaultdict(dict)
    for r in rows.select("id", "n", "k", mixing.shuffled_draw(F.col("id"), F.col("n"), F.col("k")).alias("block")).collect():
        got[r["n"], r["k"]][r["id"]] = r["block"]
    for n in counts:
        one, two = (np.array([got[n, k][i] for i in range(n)]) for k in (1, 2))
        assert sorted(one) == sorted(two) == list(range(n)) and (one == two).mean() < 0.2
        assert (np.abs(np.diff(one)) == 1).mean() < 0.2  # neighbouring draws are not neighbouring blocks
        assert abs(np.corrcoef(one, np.arange(n))[0, 1]) < 0.5


def test_rows_that_differ_in_source_only_keep_it(spark):
    text = " ".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (2, "other " * 20, "b")], "doc_id long, text string, source string")
    want = Counter()
    for r in mixing.plan(df, key=mixing.content_key(df, 11)).collect():
        want[r["source"]] += r["taken"]
    got = Counter()
    for r in mixing.mixed(df).collect():
        got[r["source"]] += len(r["text"].split())
    assert +got == +want and got["a"] and got["b"]


def test_draws_follow_the_hypergeometric_law(spark):
    from math import comb

    good, total, draws, n = 6, 20, 9, 20_000
    u = spark.range(n).select(mixing._uniform(F.lit(1), F.col("id")).alias("u"))
    law = u.select(mixing.hypergeometric(F.col("u"), F.lit(good), F.lit(total), F.lit(draws)).alias("law"))
    seen = Counter(r[0] for r in law.select(F.element_at(F.transform(F.array("law"), mixing.draw), 1)).collect())
    for x in range(good + 1):
        p = comb(good, x) * comb(total - good, draws - x) / comb(total, draws)
        assert abs(seen[x] / n - p) < 0.02


def test_mixed_rows_match_the_plan(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(60))), rng.choice(["a", "b", None])) for i in range(200)]
    rows += [(500, None, "a"), (501, "", "b"), (502, "long " * 9000, "c"), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, size int, copies string")
    plan = mixing.plan(df, shards=4, block_words=64, key=mixing.content_key(df, 11)).collect()
    assert len(plan) == len(rows)
    want = Counter()
    for r in plan:
        assert r["taken"] == sum(c["words"] for c in r["copies"]) <= 3 * r["size"]
        want[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in mixing.mixed(df, shards=4, block_words=64).collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert +got == +want
    assert mixing.plan(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    assert len(list(itertools.chain.from_iterable(r["copies"] for r in plan))) > 0


# ---------------------------------------------------------------- bytes that are no text


def test_bytes_that_are_no_utf8_pass_every_text_operator(spark):
    from tidewire.llm import collocations, fingerprint, lexical, line_dedup, near_dup, pieces, queries, substring_dedup

    words = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(k, words, "en", k % 2, "a") for k in range(6)], "doc_id long, text string, lang string, toxic int, source string")
    odd = docs.withColumn("text", F.when(F.col("doc_id") < 3, F.expr("CAST(concat(X'C328FF', encode(text, 'UTF-8'), X'E2') AS STRING)")).otherwise(F.col("text")))
    assert odd.where("NOT is_valid_utf8(text)").count() == 3
    assert [r["lossless"] for r in pieces.summary(odd, pieces.Settings(queries.VOCABULARY)).collect()] == [True] * 6
    assert pieces.encode(odd, pieces.Settings(queries.VOCABULARY)).count() == 6
    found = {r["doc_id"]: r for r in fingerprint.compare_with_edits(odd).collect()}
    assert found[0]["fingerprint"] == found[1]["fingerprint"] != found[4]["fingerprint"] and found[0]["n_chars"] == found[4]["n_chars"] + 4
    assert {r["n_removed"] for r in substring_dedup.cut(odd).collect()} <= {60, 61, 59, 58}
    assert {r["doc_id"]: r["component_id"] for r in near_dup.classes(odd).collect()}[2] == 0
    assert line_dedup.drop(odd).count() == lexical.search(odd, odd.select(F.col("doc_id").alias("item_id"), "text")).where("rank = 1").count() == 6
    assert collocations.mine(odd, collocations.Settings(least=2)).count() > 0
    assert langid.predict(odd.drop("lang"), langid.train(odd)).count() == 6
    assert mixing.plan(odd).count() == 6


def test_url_sample_is_of_different_urls(spark):
    rows = [(k, "http://hot.org/a") for k in range(3_000)] + [(k, f"http://h{k % 50}.com/{'de' if k % 2 else 'fr'}/{k}") for k in range(4_000, 5_000)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), [("allow", "org/"), ("allow", "com/fr/"), ("block", "com/de/")], max_rows=200)
    assert got.count() == 4_000 and got.where("verdict = 'block'").count() == 500 and got.where("block_score IS NULL").count() == 0
