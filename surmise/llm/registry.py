"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surmise.llm import bpe, chat, exact_dedup, lang_id, licenses, ngram_join, packing, quality_fm, quality_rules, url_filter, url_labels
from surmise.llm._shared import documents, id_remainder

URL_RULES = (
    url_filter.Rule("com/en/", "block"),
    url_filter.Rule("example.com/en/7", "allow"),
    url_filter.Rule("net/de/", "allow"),
    url_filter.Rule("example.net/de/8", "block"),
    url_filter.Rule("org/es/", "block"),
)


@cache
def url_model() -> url_filter.UrlModel:
    return url_filter.fit(url_labels.labelled_urls())


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, url_model(), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality_fm.train(docs, labels, id_remainder("doc_id", 3) != 1)
    out = quality_fm.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def byte_bpe_path() -> str:
    """The default vocabulary file; every operator that tokenizes takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(documents(spark, sf_dir), byte_bpe_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    emit = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = quality_rules.apply_rules(docs, emit=emit)
    m = {name: F.col(name) for name in emit}
    failed = quality_rules.BASE_RULES[0].reject(m) | quality_rules.BASE_RULES[1].reject(m)
    return out.select("doc_id", *emit, failed.alias("base_failed"), "kept")


#: The phrases of op6's base columns; the operator's own ones only label.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan(documents(spark, sf_dir), phrases=licenses.PHRASES | BASE_PHRASES, keep=["doc_id"])
    sums = licenses.summary(scanned, BASE_PHRASES)
    return scanned.select("doc_id", "n_words", *(c.alias(name) for name, c in sums.items()))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = lang_id.train(docs, id_remainder("doc_id", 4) != 2)
    out = lang_id.predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.dedup(documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.windows(turns.unionByName(own), byte_bpe_path()))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(documents(spark, sf_dir), byte_bpe_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = (op1_url_filter, op2_quality_classifier, op3_bpe, op4_ngram_join, op5_quality_rules, op6_license_scan, op7_language_id, op8_exact_dedup, op9_chat_format, op10_packing)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return {"op1_url_filter": url_filter.judge_sql(url_model(), URL_RULES), "op5_quality_rules": quality_rules.ORACLE_SQL, "op8_exact_dedup": exact_dedup.ORACLE_SQL}
