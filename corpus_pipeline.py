"""A corpus pipeline: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import langid, mixing, near_dup, pieces, substring_dedup
from tidewire.llm.common import written
from tidewire.llm.queries import VOCABULARY

#: Documents stay whose language the model is at least this sure of.
SURE = 0.5
#: Near copies share at least 80 percent of their five-word shingles; op7 on its own asks for 85.
NEAR = near_dup.Settings(percent=80)


def _row(docs: DataFrame) -> Column:
    """All columns in one, so that none of them clashes with a stage's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def _columns(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of ``docs`` again, out of ``_row`` or as given."""
    return [new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language stays unclear.

    Null and empty texts have no letter and go.  Repeated rows and equal texts are judged
    alike, texts are read whole however long, and every column passes through, whatever
    its name.  Where nothing can be learned (no language known, empty table) no row stays.
    """
    model = langid.train(docs)
    judged = langid.predict(docs.select("text", _row(docs)), model)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE)).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every near-duplicate class, the one with the smallest doc_id; null doc_ids come last.

    Rows equal in doc_id and text leave one of them (any, where other columns
    differ).  Null and empty texts link with nothing: each doc_id keeps one such
    row.  An empty table gives no rows; long texts are compared whole; columns of any name pass through.
    """
    kept = near_dup.one_of_each(docs, NEAR).withColumnRenamed("uid", "_kept")
    once = docs.select(F.xxhash64("doc_id", "text").alias("_uid"), _row(docs)).dropDuplicates(["_uid"])
    return once.join(kept, F.col("_uid") == F.col("_kept"), "left_semi").select(*_columns(docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; documents of which no word is left go.

    Windows are judged on the stage's input, so all copies of a repeated row lose
    theirs.  Null and empty texts stay as they are; a text that loses nothing keeps its white
    space.  Every row keeps its own other columns (n_chars is counted anew), also where
    several rows share doc_id and text.  An empty table gives no rows.
    """
    cut = substring_dedup.cut(docs, texts=True).where("n_removed = 0 OR n_removed < n_words")
    cut = cut.select(F.col("uid").alias("_uid"), F.col("kept_text").alias("_text")).dropDuplicates(["_uid"])
    rest = docs.select(F.xxhash64("doc_id", "text").alias("_uid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]).alias("_row"))
    return rest.join(cut, "_uid").select(*_columns(docs, text=F.col("_text"), n_chars=F.length("_text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source's documents as often as its target weight asks.

    Null and empty texts have no words and are not taken; a null source is a source; repeated rows
    are taken as rows of their own; a long text counts by its words.  An empty table
    gives no rows; columns of any name pass through.
    """
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the pieces of a sampled segmentation of each whole text.

    Null and empty texts have no pieces; rows equal in doc_id and text get equal
    pieces; null doc_ids share a seed; other columns are left out; an empty table gives no rows.
    """
    return pieces.encode(docs, pieces.Settings(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: Language models, MinHash and sampled segmentations have no SQL form; tests compare stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
