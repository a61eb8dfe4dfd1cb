"""Corpus pipeline: quality rules, language ID, exact dedup, n-gram Jaccard join, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; between stages the
documents are written as Parquet and read again.  All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surmise.llm import exact_dedup, lang_id, ngram_join, packing, quality_rules
from surmise.llm._shared import written
from surmise.llm.registry import byte_bpe_path, id_remainder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_rules.apply_rules(docs).where("kept").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised well enough."""
    model = lang_id.train(docs, id_remainder("doc_id", 4) != 2)
    return lang_id.predict(docs, model).where(~F.col("rejected")).select(*docs.columns)


def _kept_rows(docs: DataFrame, digest: Column, keep: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and digest are in ``keep`` (doc_id, digest); of rows with the same id and digest,
    the one whose columns come first as JSON.  The columns travel in a struct, so no name can clash."""
    found = docs.select(F.col("doc_id").alias("id"), digest.alias("digest"), F.struct("*").alias("row"))
    keys = keep.select(F.col("doc_id").alias("keep_id"), F.col("digest").alias("key"))
    found = found.join(keys, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("key")), "left_semi")
    return found.groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id."""
    kept = exact_dedup.dedup(docs.select("doc_id", "text")).where("kept")
    return _kept_rows(docs, exact_dedup.digest(exact_dedup.normalised(F.col("text"))), kept)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, one document: that with the smallest doc_id, of equal ids with the smallest digest."""
    classes = ngram_join.classes(docs.select("doc_id", "text"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("m")
    keep = classes.groupBy("root").agg(least).select("m.doc_id", "m.digest")
    return _kept_rows(docs, ngram_join.digest(ngram_join.joined_words(F.col("text"))), keep)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed windows over all documents' tokens."""
    return packing.pack(docs, byte_bpe_path())


STAGES = [("quality_rules", quality), ("language_id", language), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("packing", pack)]

#: The language model, Jaccard classes and tokens can't be expressed in SQL; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
