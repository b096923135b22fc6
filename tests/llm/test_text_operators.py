"""Substring dedup, near-duplicates, fingerprints and pieces against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewire.llm import fingerprint, near_dup, pieces, queries, substring_dedup
from tidewire.llm.fm_index import FMIndex, repeated_windows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, key long, n int, score double"
VOCABULARY = queries.VOCABULARY


def words(text):
    return WORD.findall((text or "").encode())


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, 0.5) for i, t in rows], DOCS).repartition(3)


def odd_texts():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "naïve", "日本", " "]
    fresh = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, other = fresh(60), fresh(50)
    texts = [None, "", " \t\n", "one", "one two", fresh(34), fresh(35), "a " * 300, passage, f"{fresh(50)} {passage} {fresh(20)}"]
    texts += [f"{fresh(40)}\n{passage}\t{other}", f"{other}  {fresh(80)} {other}", fresh(6_000) + " " + passage]
    texts += [texts[9], texts[9], f"x {passage.upper()}", passage + " tail"] + [f"{fresh(30)} {other} {fresh(30)}" for _ in range(30)]
    return list(enumerate(texts))


# ---------------------------------------------------------------- substring dedup


def brute_cut(rows, width=35):
    split = [(i, words(t)) for i, t in rows]
    seen = Counter(b" ".join(w[k : k + width]) for _, w in split for k in range(len(w) - width + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[b" ".join(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def found_cut(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_substring_query_equals_brute_force(spark, sf, documents):
    got = found_cut(queries.op1_substring_dedup(spark, sf))
    want = brute_cut(documents)
    assert got == want
    assert sum(r[2] for r in want) > 0


@pytest.mark.parametrize("settings", [substring_dedup.Settings(), substring_dedup.Settings(hot=3, segment=7, shard_words=1 << 9), substring_dedup.Settings(window=9, gram=3, segment=64)])
def test_substring_odd_texts(spark, settings):
    rows = odd_texts()
    assert found_cut(substring_dedup.cut(frame(spark, rows), settings)) == brute_cut(rows, settings.window)


def test_substring_texts_and_empty_table(spark):
    rows = odd_texts()
    cut = {r["doc_id"]: r for r in substring_dedup.cut(frame(spark, rows), texts=True).collect()}
    for i, text in rows:
        if cut[i]["n_removed"] == 0:
            assert cut[i]["kept_text"] == text
        assert hashlib.sha256(b" ".join(words(cut[i]["kept_text"]))).hexdigest() == cut[i]["kept_sha256"]
    assert substring_dedup.cut(frame(spark, [])).count() == 0


def test_fm_index_counts_patterns():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(1, 4, 300), [0]])
    index = FMIndex(text, np.ones(len(text), np.int64), 12)
    for _ in range(200):
        at, n = int(rng.integers(0, 288)), int(rng.integers(1, 12))
        pattern = text[at : at + n]
        lo, hi = np.array([0]), np.array([index.n])
        for s in pattern[::-1]:
            lo, hi = index.extend(np.array([s]), lo, hi)
        want = sum((text[k : k + n] == pattern).all() for k in range(len(text) - n + 1))
        assert index.count(lo, hi)[0] == want


def test_matching_statistics_of_windows():
    rng = np.random.default_rng(2)
    for width in (2, 5, 9):
        parts = [rng.integers(1, 5, int(rng.integers(width, 40))) for _ in range(12)]
        symbols = np.concatenate([np.append(p, 0) for p in parts])
        first = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
        n = np.array([len(p) - width + 1 for p in parts])
        seen = Counter(tuple(p[k : k + width]) for p in parts for k in range(len(p) - width + 1))
        mask = repeated_windows(FMIndex(symbols, np.ones(len(symbols), np.int64), 64), symbols, first, n, width)
        for p, m in zip(parts, mask, strict=True):
            for k in range(len(p) - width + 1):
                assert bool(int(m) >> k & 1) == (seen[tuple(p[k : k + width])] > 1)


# ---------------------------------------------------------------- near-duplicates


def shingle_set(text, width=5):
    w = [bytes(x).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_classes(rows, percent=85):
    own = {i: shingle_set(t) for i, t in rows}
    carriers = defaultdict(list)
    for i, s in own.items():
        for x in s:
            carriers[x].append(i)
    shared = Counter(p for c in carriers.values() for p in itertools.combinations(c, 2))
    parent = {i: i for i in own}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(own[a]) + len(own[b]) - both):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    return sorted((i, len(own[i]), top(i), top(i) == i) for i in own)


def found_classes(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_near_dup_query_equals_brute_force(spark, sf, documents):
    want = brute_classes(documents)
    assert found_classes(queries.op7_near_dup(spark, sf)) == want
    assert sum(not r[3] for r in want) > 10


def test_near_dup_chains_and_odd_texts(spark):
    rng = random.Random(9)
    base = [f"v{rng.randrange(5000)}" for _ in range(300)]
    chain, rows = list(base), []
    for k in range(40):  # each text is near its neighbours only
        rows.append((1000 - k, " ".join(chain)))
        chain[k * 7 % 300] = f"new{k}"
    rows += [(1, None), (2, ""), (3, "   "), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, " ".join(base[:200])), (8, " ".join(base[:200]).upper())]
    rows += [(2000 + k, " ".join(f"z{rng.randrange(9000)}" for _ in range(50))) for k in range(20)] + [(3000, "q " * 20_000)]
    assert found_classes(near_dup.classes(frame(spark, rows))) == brute_classes(rows)


def test_near_dup_buckets_in_many_blocks(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for family in range(6):  # families share two thirds of their words: bands collide without links
        stem = [f"c{k}" for k in range(200)] + [f"f{family}_{k}" for k in range(60)]
        for _ in range(25):
            own = list(stem)
            own[rng.randrange(len(own))] = f"u{rng.randrange(10**6)}"
            rows.append((n := n + 1, " ".join(own)))
    small = near_dup.Settings(block=8, partners=3)
    assert found_classes(near_dup.classes(frame(spark, rows), small)) == brute_classes(rows)


def test_near_dup_hub_and_cells_of_few_bytes(spark):
    rng = random.Random(4)
    stem = [f"h{k}" for k in range(150)]
    rows = [(1, " ".join(stem))]
    for n in range(120):  # near the first text, many of them not near one another
        own = list(stem)
        for at in rng.sample(range(0, 150, 6), 2):
            own[at] = f"o{rng.randrange(10**6)}"
        rows.append((n + 2, " ".join(own)))
    for n in range(30):  # long, and they share bands without links
        rows.append((n + 500, " ".join([f"s{k}" for k in range(900)] + [f"e{n % 6}_{k}" for k in range(200)] + [f"i{n}"])))
    small = near_dup.Settings(block_bytes=20_000, partners=3, copies=2)
    want = brute_classes(rows)
    assert found_classes(near_dup.classes(frame(spark, rows), small)) == want
    assert found_classes(near_dup.classes(frame(spark, rows))) == want


def test_near_dup_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"t{k}" for k in range(30))
    out = near_dup.classes(frame(spark, [(5, text), (5, text), (None, text), (2, text + " more")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in out) == [(0, 0, True), (2, 2, True), (5, 2, False), (5, 2, False)]
    assert near_dup.classes(frame(spark, [])).count() == 0


def test_b_bit_estimate_follows_similarity():
    s = near_dup.Settings()
    for shared in (40, 80, 95):
        a = " ".join(f"w{k}" for k in range(404))
        b = " ".join(f"w{k}" if k < 404 * shared // 100 else f"y{k}" for k in range(404))
        x = near_dup.signatures(pa.array([a, b]), s)
        sa, sb = shingle_set(a), shingle_set(b)
        est = near_dup.estimate(x["bands"][0], x["more"][0], x["bands"][1], x["more"][1])
        assert abs(est - len(sa & sb) / len(sa | sb)) < 0.12


# ---------------------------------------------------------------- fingerprints


def test_fingerprint_query(spark, sf, documents):
    got = {r["doc_id"]: r for r in queries.op6_fingerprint(spark, sf).collect()}
    assert len(got) == len(documents)
    by_print = defaultdict(set)
    for (i, text), (_, after) in zip(documents, documents[1:] + documents[:1], strict=True):
        text, after = text or "", after or ""
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        by_print[r["fingerprint"]].add(text)
        error = []
        for near, other in ((r["near_edited"], changed), (r["near_next"], after)):
            a, b = Counter(words(text)), Counter(words(other))
            both, every = sum((a & b).values()), sum((a | b).values())
            if every:
                error.append(abs(near - both / every))
        assert not error or max(error) < 0.25
    equal = defaultdict(set)
    for i, text in documents:
        equal[text or ""].add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in equal.values())


def test_fingerprint_edge_cases(spark):
    rows = [(3, None), (1, ""), (2, "a b c d"), (9, "é" * 5000), (4, "a b c d")]
    out = {r["doc_id"]: r for r in fingerprint.compare_with_edits(frame(spark, rows)).collect()}
    assert len(out) == 5 and out[2]["fingerprint"] == out[4]["fingerprint"] and out[1]["fingerprint"] == out[3]["fingerprint"]
    assert out[1]["near_edited"] == 1.0 and out[9]["n_chars"] == 5000
    assert fingerprint.compare_with_edits(frame(spark, [])).count() == 0
    single = fingerprint.compare_with_edits(frame(spark, [(1, "alone here")])).collect()
    assert single[0]["near_next"] == 1.0


def test_fingerprint_collisions_estimate_weighted_jaccard():
    rng = random.Random(8)
    errors = []
    for _ in range(60):
        a = [f"w{rng.randrange(40)}" for _ in range(200)]
        b = a[: rng.randrange(200)] + [f"w{rng.randrange(80)}" for _ in range(100)]
        x, y = Counter(a), Counter(b)
        sig = fingerprint.signatures(pa.array([" ".join(a), " ".join(b)]))
        errors.append(fingerprint.likeness(sig[:1], sig[1:])[0] - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_fingerprints_of_long_unrelated_texts_differ():
    words = lambda lo, n: [f"w{k}" for k in range(lo, lo + n)]
    texts = [words(0, 30_000), words(50_000, 30_000), words(15_000, 30_000), words(0, 30_000) + words(0, 10_000) * 2]
    sig = fingerprint.signatures(pa.array([" ".join(t) for t in texts]))
    x = [Counter(t) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        want = sum((x[i] & x[j]).values()) / sum((x[i] | x[j]).values())
        got = fingerprint.likeness(sig[i : i + 1], sig[j : j + 1])[0]
        assert abs(got - want) < (0.02 if want == 0 else 0.15), (i, j, got, want)
    alone = [fingerprint.signatures(pa.array([" ".join(t)])) for t in texts]
    assert (np.concatenate(alone) == sig).all()  # whatever stands beside a text


# ---------------------------------------------------------------- pieces


def test_pieces_query_is_lossless_and_repeatable(spark, sf, documents):
    first = sorted(tuple(r) for r in queries.op8_pieces(spark, sf).collect())
    again = sorted(tuple(r) for r in queries.op8_pieces(spark, sf).collect())
    assert first == again and len(first) == len(documents)
    assert all(r[3] for r in first)


def test_pieces_of_odd_texts_decode_to_themselves(spark):
    texts = [None, "", " ", "  two  spaces ", "▁sign", "tab\tand\r\nline", "日本語 текст é", "\U0001f600\u0000x", "a" * 30_000, " lead", "x\n\n y", "﻿ "]
    rows = list(enumerate(texts))
    s = pieces.Settings(VOCABULARY)
    encoded = pieces.encode(frame(spark, rows), s)
    back = dict(tuple(r) for r in pieces.decoded(encoded, s).collect())
    assert back == {i: t or "" for i, t in rows}
    assert pieces.encode(frame(spark, []), s).count() == 0


def test_pieces_depend_on_the_row_key():
    s = pieces.Settings(VOCABULARY)
    text = pa.array(["international understanding of segmentation"] * 50)
    keys = pieces.row_keys(pa.array(range(50)), s.seed)
    ids, offsets = pieces.encode_column(text, keys, s)
    some = {tuple(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)}
    assert len(some) > 2
    again, _ = pieces.encode_column(text, keys, s)
    assert (ids == again).all()


def test_sampled_segmentations_follow_the_lattice():
    """Frequencies of all segmentations of a short unit against their exact probabilities."""
    s = pieces.Settings(VOCABULARY)
    v = pieces.vocabulary(VOCABULARY, s.theta)
    code = np.array([pieces.SPACE, *map(ord, "hello")], np.uint32)
    start, end, piece, weight = v.matches(code, np.zeros(len(code), int))
    arcs = defaultdict(list)
    for a, b, p, w in zip(start, end, piece, weight, strict=True):
        arcs[int(a)].append((int(b), int(p), float(w)))
    paths = {}

    def walk(at, taken, w):
        if at == len(code):
            paths[tuple(taken)] = w
            return
        for b, p, x in arcs[at]:
            walk(b, [*taken, p], w * x)

    walk(0, [], 1.0)
    n = 40_000
    ids, offsets = pieces.encode_column(pa.array(["hello"] * n), pieces.row_keys(pa.array(range(n)), 3), s)
    seen = Counter(tuple(int(x) for x in ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True))
    total = sum(paths.values())
    assert set(seen) <= set(paths)
    for path, w in paths.items():
        p = w / total
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
