"""Line dedup, collocations and ranked search against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewire.llm import bloom, collocations, lexical, line_dedup
from tidewire.llm.suffix_automaton import build

LONG = "a line that is long enough to count as one, number"


# --- Bloom filters -----------------------------------------------------------


def test_filters_have_no_false_negatives_however_the_input_is_split():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    again = h[:3_000]
    both = rng.permutation(np.concatenate([h, again]))
    whole = bloom.Pair(bloom.SEGMENT)
    for part in np.array_split(both, 7):
        own = bloom.Pair(bloom.SEGMENT)
        for batch in np.array_split(part, 3):
            own.add(batch)
        at = np.flatnonzero(own.once)
        whole.merge(at, own.once[at], own.twice[at])
    assert bloom.contains(whole.once, h).all() and bloom.contains(whole.twice, again).all()
    assert bloom.contains(whole.twice, h[3_000:]).mean() < 0.2


def test_filters_merge_in_tasks(spark):
    h = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 5_000)
    rows = spark.createDataFrame([(int(x),) for x in np.concatenate([h, h[:500]])], "hash long").repartition(5)
    words = 2 * bloom.SEGMENT
    found = bloom.filled(rows, words).persist()
    once, twice = (bloom.collected(found, k, words) for k in ("once", "twice"))
    assert bloom.contains(once, h.view(np.uint64)).all() and bloom.contains(twice, h[:500].view(np.uint64)).all()
    assert bloom.contains(twice, h[500:].view(np.uint64)).mean() < 0.02


def test_size_of_a_filter_is_bounded():
    assert bloom.words_for(10, 16, 1 << 28) == bloom.SEGMENT
    assert bloom.words_for(10**12, 16, 1 << 28) == 1 << 22
    assert bloom.words_for(10**6, 16, 1 << 28) == 1 << 18


# --- suffix automaton --------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_states_are_the_classes_of_equal_ends(seed):
    rng = random.Random(seed)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(0, 12))] for _ in range(12)]
    symbols = np.array([x for t in texts for x in t], np.int64)
    room = np.array([k for t in texts for k in range(len(t))], np.int64)
    ends, at = defaultdict(set), 0
    for t in texts:
        for j in range(len(t)):
            for n in range(1, min(j + 1, 4) + 1):
                ends[tuple(t[j - n + 1 : j + 1])].add(at + j)
        at += len(t)
    a = build(symbols, room, 4)
    state, n = a.substrings()
    said = {tuple(symbols[a.end[s] - k + 1 : a.end[s] + 1].tolist()): s for s, k in zip(state.tolist(), n.tolist(), strict=True)}
    assert len(said) == len(state) and said.keys() == ends.keys()
    assert all(a.count[s] == len(ends[x]) for x, s in said.items())
    classes = {frozenset(e) for e in ends.values()}
    assert len(classes) == len(a.count)  # one state for each class
    for x, s in said.items():
        shorter = [x[k:] for k in range(1, len(x)) if ends[x[k:]] != ends[x]]
        assert a.link[s] == (said[shorter[0]] if shorter else -1)


# --- line dedup --------------------------------------------------------------


def kept_lines(rows, least=40, documents=5):
    key = lambda line: line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    gone = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(k) >= least and len(v) >= documents}
    out = []
    for doc, text in rows:
        every = (text or "").split("\n")
        stay = [x for x in every if key(x) not in gone or gone[key(x)] == doc]
        out.append((doc, len(every), len(every) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_lines():
    rng = random.Random(3)
    many = [f"{LONG} {k}" for k in range(30)]
    rows = []
    for doc in range(60):
        some = [rng.choice(["  {} \t", "{}", "\v{}\r"]).format(rng.choice(many).upper() if rng.random() < 0.3 else rng.choice(many)) for _ in range(rng.randrange(0, 6))]
        rows.append((doc, "\n".join([*some, f"own line of document {doc}", "", "short"])))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, many[0] + "\n" + many[0]), (None, many[0] + "\n" + many[1]), (None, many[2]), (5, many[3]), (5, many[3])]
    rows += [(200 + k, "é" * 40 + "\n" + "é" * 39) for k in range(6)]
    rows += [(300 + k, ("x" * 700_000 + "\n") * 2 + str(k)) for k in range(5)]
    return rows


@pytest.mark.parametrize("bits", [1 << 28, 1 << 12])
def test_lines_against_brute_force(spark, bits):
    """Also with several filters, each of them full."""
    rows = odd_lines()
    docs = spark.createDataFrame([(d, t, "en", 1) for d, t in rows], "doc_id long, text string, uid string, low int").repartition(7)
    got = line_dedup.drop(docs, line_dedup.Settings(most_bits=bits)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == kept_lines(rows)


def test_lines_of_several_parts_are_probed_apart(spark):
    rows = [(d, "\n".join(f"{LONG} {d * 200 + k} {'x' * 30}" for k in range(200)) + f"\n{LONG} shared by all") for d in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s = line_dedup.Settings(most_bits=1 << 15)
    got = line_dedup.drop(docs, s).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == kept_lines(rows) and sum(r[2] for r in got) == 29


def test_kept_text_and_bytes_that_are_no_text(spark):
    rows = [(k, f"{LONG} one\nrest {k}") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r["kept_text"] for r in line_dedup.drop(docs, texts=True).collect()}
    assert kept == {k: f"rest {k}" for k in range(4)} | {4: f"{LONG} one\nrest 4"}
    odd = docs.selectExpr("doc_id", "CAST(concat(X'FFFE', encode(text, 'UTF-8')) AS STRING) AS text")
    assert {r["n_dropped"] for r in line_dedup.drop(odd).collect()} == {0, 1}


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert line_dedup.drop(none).count() == 0
    assert collocations.mine(none).count() == 0
    assert lexical.search(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# --- collocations ------------------------------------------------------------


def brute_phrases(rows, s):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            total[lang] += len(w)
            for n in range(1, s.longest + 1):
                for k in range(len(w) - n + 1):
                    f[lang][tuple(w[k : k + n])] += 1
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= s.least}
        good = []
        for p, a in found.items():
            if any(100 * b >= s.percent * a and len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            good.append((-score, -a, " ".join(p).encode(), p[:k], p[k:]))
        for rank, (score, a, phrase, x, y) in enumerate(sorted(good)[: s.top], 1):
            out.append((lang, rank, phrase.decode(), -a, c[x], c[y], total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("s", [collocations.Settings(least=3), collocations.Settings(longest=4, least=4, shard_bytes=300, top=25), collocations.Settings(longest=2, least=2, percent=30, most_bits=1 << 10)])
def test_phrases_against_brute_force(spark, s):
    rng = random.Random(7)
    words = ["Aa", "bb", "cc", "dd", "é", "ü x", "ee", "f"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", ".", " \n", " "]) for _ in range(rng.randrange(0, 40))), rng.choice(["en", "fr", None, "und"])) for _ in range(150)]
    rows += [(None, "en"), ("", None), (" \t.,", "de"), (rows[0][0], "en"), (rows[0][0], "en"), ("new york city " * 400, "en")]
    docs = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, n int, phrase string").repartition(5)
    assert sorted(map(tuple, collocations.mine(docs, s).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == brute_phrases(rows, s)


def test_a_long_text_is_cut_where_no_phrase_crosses(spark):
    rng = random.Random(11)
    text = " ".join(rng.choice(["aa", "bb", "cc.", "dd", "ee"]) for _ in range(500_000))
    s = collocations.Settings(top=50)
    docs = spark.createDataFrame([(text, "en")], "text string, lang string")
    assert sorted(map(tuple, collocations.mine(docs, s).collect())) == brute_phrases([(text, "en")], s)


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_019, 3_000_000_037, 3_000_000_061  # noqa: E741
    known = spark.createDataFrame([("en", 2, "x y", a), ("en", 1, "x", l), ("en", 1, "y", r), ("en", 0, "", 10**12)], "lang string, words int, phrase string, n long")
    was, collocations.counts = collocations.counts, lambda docs, s: known
    try:
        got = collocations.mine(known).collect()
    finally:
        collocations.counts = was
    assert [tuple(x) for x in got] == [("en", 1, "x y", a, l, r, 10**12, 1_000_000 * a * a // (l * r))]


# --- ranked search -----------------------------------------------------------


def brute_ranks(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    terms = [(d, Counter(split(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in terms if c), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, c in terms:
            m = 75 + (25 * sum(c.values()) * n_docs) // max(total, 1)
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in Counter(split(text)).items() if c[t])
            if score > 0:
                scores.append((-score, d is not None, d))
        out += [(item, r, d, -x) for r, (x, _, d) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("s", [lexical.Settings(), lexical.Settings(k=3, pairs=40, postings=16, documents=8, chunk_bytes=2_000), lexical.Settings(k=7, most_bits=1 << 10)])
def test_ranks_against_brute_force(spark, s):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Ünter", "été", "THE", "x1"]
    draw = lambda n: " ".join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] + rng.choice(["", ",", "-", "\n"]) for _ in range(n))
    docs = [(k, draw(rng.randrange(0, 60))) for k in range(300)]
    docs += [(400, None), (401, ""), (402, "..."), (None, docs[3][1]), (403, docs[3][1]), (404, docs[3][1]), (404, docs[3][1]), (405, draw(3_000))]
    items = [(k, draw(rng.randrange(1, 25))) for k in range(25)] + [(50, None), (51, ""), (52, "nowhere to be found"), (53, "w1 w1 w1 W1 w2"), (53, "w1 w1 w1 W1 w2"), (54, docs[3][1])]
    got = lexical.search(
        spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, row int, score int").repartition(6),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, term int"), s,
    )
    assert sorted(map(tuple, got.collect()), key=repr) == brute_ranks(docs, items, s.k)


def test_a_long_document_is_searched_whole(spark):
    docs = [(1, "filler words " * 200_000 + "needle"), (2, "needle in hay"), (3, "nothing here")]
    items = [(1, "needle filler"), (2, "hay")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_ranks(docs, items, 20)
