"""Named queries of the operators, with the parameters used in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, fingerprint, langid, lexical, line_dedup, mixing, near_dup, neighbours, pieces, substring_dedup, toxicity, url_filter, warc
from .common import crc_mod

#: (verdict, host/path), the rules of the registered query.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: Public vocabulary file on every machine; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.cut(_table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    learned = docs.where(~F.col("held_out"))
    model = toxicity.fit(learned.select("text"), toxicity.labelled_sample(learned, _table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(_table(spark, sf_dir, "documents"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.summary(_table(spark, sf_dir, "documents"), pieces.Settings(VOCABULARY))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), RULES)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan(docs).select("doc_id", "size", "source_size", "target", "taken")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop(_table(spark, sf_dir, "documents"))


def fingerprint_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can express: lengths and edited texts."""
    return op6_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can express: host, path, rule, and the verdict where a rule decides."""
    return op9_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can express: sizes and targets."""
    return op10_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_neighbours": op2_neighbours,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_langid": op5_langid,
    "op6_fingerprint": op6_fingerprint,
    "op7_near_dup": op7_near_dup,
    "op8_pieces": op8_pieces,
    "op9_url_filter": op9_url_filter,
    "op10_mixing": op10_mixing,
    "op11_collocations": op11_collocations,
    "op12_lexical_search": op12_lexical_search,
    "op13_line_dedup": op13_line_dedup,
    "fingerprint_texts": fingerprint_texts,
    "url_rules": url_rules,
    "mixing_targets": mixing_targets,
}

#: The operators, or columns of operators, that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM docs)),
        rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win SEMI JOIN rep USING (k), range(0, 35) AS steps(j)),
        tok AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM docs),
        kept AS (
            SELECT doc_id, count(*) FILTER (gone.p IS NOT NULL) AS n_removed, string_agg(w, ' ' ORDER BY tok.p) FILTER (gone.p IS NULL) AS t
            FROM tok LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (doc_id)""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
            CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM d""",
    "op7_near_dup": r"""
        WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        sh AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM docs WHERE len(ws) > 0)),
        size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (
            SELECT common.a, common.b FROM common JOIN size x ON x.doc_id = common.a JOIN size y ON y.doc_id = common.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        sides AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id, doc_id AS root FROM docs UNION SELECT sides.b, reach.root FROM reach JOIN sides ON sides.a = reach.doc_id),
        named AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM named LEFT JOIN size USING (doc_id)""",
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM ws),
        f AS (
            SELECT lang, s.k AS words, array_to_string(w[i:i + s.k - 1], ' ') AS phrase, count(*) AS f FROM spots, (VALUES (1), (2), (3)) s(k) WHERE i + s.k - 1 <= len(w) GROUP BY ALL),
        total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY 1),
        c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 10),
        cut AS (
            SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
            FROM (SELECT *, unnest(range(1, words)) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
        best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inner_ AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE words = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE words = 3),
        longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY 1, 2),
        ranked AS (
            SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best b LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op12_lexical_search": r"""
        WITH words(kind, id, t) AS (
            SELECT 'd', doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM documents
            UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM benchmark),
        tf AS (SELECT id, t, count(*) AS tf FROM words WHERE kind = 'd' GROUP BY 1, 2),
        len AS (SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
        tot AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM len),
        df AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, tot GROUP BY t, nn),
        q AS (SELECT id AS item_id, t, count(*) AS q FROM words WHERE kind = 'q' GROUP BY 1, 2),
        m AS (SELECT id, 75 + (25 * n * nn) // ll AS m FROM len, tot),
        s AS (SELECT item_id, tf.id AS doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN tf USING (t) JOIN df USING (t) JOIN m USING (id) GROUP BY 1, 2)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20""",
    "op13_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
        keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        often AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        said AS (SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN often USING (key))
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM said GROUP BY doc_id""",
    "fingerprint_texts": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
        n AS (SELECT doc_id, x, length(x) AS n, coalesce(lead(x) OVER (ORDER BY doc_id), first(x) OVER (ORDER BY doc_id)) AS y FROM t)
        SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substr(x, 1, n - n // 4) || substr(y, 1, n // 4)) AS edited_sha256 FROM n""",
    "url_rules": r"""
        WITH s AS (SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS i FROM pages),
        r AS (SELECT page_id, CASE WHEN i > 0 THEN substr(u, i + 3) ELSE '' END AS rest FROM s),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM r),
        p AS (SELECT page_id, host, regexp_extract(tail, '^[^?#]*') AS path FROM h),
        rules(said, name, start) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        fit AS (SELECT page_id, name || start AS rule, said, row_number() OVER (PARTITION BY page_id ORDER BY length(name || start) DESC) AS k FROM p JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start))
        SELECT page_id, host, path, rule, said AS verdict FROM p LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (page_id)""",
    "mixing_targets": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, sum(size) AS n, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS w FROM d GROUP BY source),
        c AS (SELECT *, 3.0::DOUBLE * n AS cap, 3.0::DOUBLE * n / w AS reach FROM s),
        k AS (SELECT source, ((SELECT sum(n) FROM s) - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER b, 0)) AS level, reach
              FROM c WINDOW b AS (ORDER BY reach, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT level FROM k WHERE level < reach ORDER BY reach LIMIT 1),
        t AS (SELECT source, n, least(cap, w * (SELECT level FROM l)) AS target FROM c)
        SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, round(target, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
}
