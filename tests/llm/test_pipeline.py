"""The corpus pipeline stage by stage, and the SQL twins."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import langid, near_dup, pieces, queries, substring_dedup

TABLES = ["documents", "pages", "benchmark"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twins(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    twin = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(twin.columns)
    assert sorted(map(tuple, df.select(*twin.columns).collect()), key=str) == sorted(twin.fetchall(), key=str)


def test_each_stage_follows_its_operator(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit("mine")).withColumn("uid", F.lit(4))
    passed = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        passed.append(docs)
    source = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    judged = langid.predict(source, langid.train(source)).where(f"lang_pred <> 'und' AND score >= {corpus_pipeline.SURE}")
    assert ids(passed[0]) == ids(judged)
    assert {r[0] for r in passed[0].select("score").distinct().collect()} == {"mine"}
    assert ids(passed[1]) == ids(near_dup.classes(passed[0], corpus_pipeline.NEAR).where("kept"))
    cut = substring_dedup.cut(passed[1]).where("n_removed = 0 OR n_removed < n_words")
    assert sorted(r[0] for r in passed[2].select("doc_id").collect()) == sorted(ids(cut))
    sha = {r["doc_id"]: r["kept_sha256"] for r in cut.collect()}
    import hashlib

    for r in passed[2].collect():
        assert hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest() == sha[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    assert ids(passed[3]) <= ids(passed[2])
    back = pieces.decoded(passed[4], pieces.Settings(queries.VOCABULARY))
    assert sorted(r[1] for r in back.collect()) == sorted(r["text"] or "" for r in passed[3].collect())


def test_stages_take_empty_tables(spark, sf):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_stages_take_nulls_everywhere(spark, sf):
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, 0), (3, "good words in a row", "en", None, 19), (3, "good words in a row", "en", None, 19), (4, "autre chose ici", "fr", "b", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).collect()


def test_repeated_and_null_id_rows_leave_one_each(spark, sf):
    rng = random.Random(5)
    base = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' AND doc_id IS NOT NULL").orderBy("doc_id").select("doc_id", "text", "lang", "source", "n_chars").limit(300).collect()
    words = [w for r in base for w in (r["text"] or "").split()]
    twice, unnamed, both = (" ".join(rng.sample(words, 80)) for _ in range(3))
    source = base[0]["source"]
    planted = [(10**9, twice), (10**9, twice), (None, unnamed), (None, unnamed), (None, unnamed), (None, both), (10**9 + 1, both), (10**9 + 2, twice + " end"), (10**9, unnamed + " end")]
    rows = [tuple(r) for r in base] + [(i, t, "en", source, len(t)) for i, t in planted]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    passed = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, sf), f"stage-{k}")
        passed.append(docs)
    of = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect() if any(t[:60] in r["text"] for t in (twice, unnamed, both)))
    assert len(of_all := [r for r in passed[0].collect() if any(t[:60] in r["text"] for t in (twice, unnamed, both))]) == len(planted), of_all
    want = sorted([(10**9, twice), (10**9, unnamed + " end"), (10**9 + 1, both)])
    assert of(passed[1]) == want
    assert of(passed[2]) == want
    assert passed[4].count() == passed[3].count() > 0


def test_rows_of_one_text_keep_their_own_columns(spark, sf):
    text = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, text, "en", "a", 99), (1, text, "en", "b", 99), (2, "other words", "en", "b", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_repeated_passages(spark, docs, sf)
    assert sorted((r["doc_id"], r["source"], r["text"]) for r in out.collect()) == [(1, "a", text), (1, "b", text), (2, "b", "other words")]
    mixed = {r["source"] for r in corpus_pipeline.mix_sources(spark, out, sf).where("doc_id = 1").collect()}
    assert mixed == {"a", "b"}


def test_a_long_text_and_ties_pass_every_stage(spark, sf):
    rng = random.Random(8)
    words = [w for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(60).collect() for w in (r["text"] or "").split()]
    long = " ".join(rng.choices(words, k=150_000))
    rows = [(k, " ".join(rng.sample(words, 60)), "en", "a", 1) for k in range(20)] + [(30, long, "en", "b", 1), (31, long, "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "long-stage")
    assert [r[0] for r in docs.where("doc_id >= 30").select("doc_id").collect()] == [30]
    assert docs.where("doc_id = 30").first()["text"] == long
    pieces_of = corpus_pipeline.encode_pieces(spark, corpus_pipeline.mix_sources(spark, docs, sf), sf)
    assert pieces_of.count() >= 1


def test_null_id_copies_alone_leave_one(spark, sf):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(None, text)] * 3 + [(None, text + " more")], "doc_id long, text string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()
    assert len(out) == 1 and out[0]["text"] in (text, text + " more")


def test_near_dedup_links_from_80_percent(spark, sf):
    rng = random.Random(6)
    rows = []
    for k, n in enumerate(list(range(44, 70)) * 3):  # one changed word of n: (n - 9) / (n + 1) of the shingles are common
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join([*a[: n // 2], "changed", *a[n // 2 + 1 :]]))]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    likeness = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(0.8 <= x < 0.85 for x in likeness) > 30 and sum(x < 0.8 for x in likeness) > 10
    want = [i for i, _ in rows if i % 2 == 0 or likeness[i // 2] < 0.8]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(r["doc_id"] for r in out.collect()) == want
