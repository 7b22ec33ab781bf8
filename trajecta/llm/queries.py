"""Registered queries of this subpackage: thin contracts over the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm import lm, negatives, oracles, pages, partenum, pieces, quality, rules, setsketch, spans, spelling, urls, winnow

PIECES = "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = pieces.count_tokens(docs, public_tokenizers.path(PIECES))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = lm.remainder(F.col("doc_id"), 5) == 0
    docs = docs.withColumn("held_out", held_out)
    scored = quality.ranked(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out, keep=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = winnow.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), winnow.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pieces.encode_decode(docs, public_tokenizers.path(PIECES), ids=False, decoded=False, digests=True)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), closed=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    return judged.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("char_distance", "word_distance")})


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return partenum.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


#: Given rules of op9: action, and host with path.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the row of labels with its number: quality 0 is a block."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("block"))
    return urls.judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), labels, URL_RULES)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("held_out", lm.remainder(F.col("doc_id"), 7) == 2)
    scored = lm.score(docs, ~F.col("held_out"), keep=("doc_id", "held_out"))
    return scored.withColumn("perplexity", lm.perplexity(F.col("score"), F.col("n_tokens")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 is an anchor; the labels of ids divisible by 7 are wrong by one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", wrong), F.col("vec_id") % 50 == 0)


def op12_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return setsketch.near_duplicates(docs, size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling.spelling_variants(docs, altered=31)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_decontamination": op3_decontamination,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_extraction": op7_html_extraction,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_url_filters": op9_url_filters,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_near_duplicates": op12_near_duplicates,
    "op13_spelling_variants": op13_spelling_variants,
}

#: The others rest on vocabulary files, on models, or on mining.
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": oracles.DECONTAMINATION,
    "op6_quality_rules": oracles.QUALITY_RULES,
    "op8_jaccard_join": oracles.JACCARD,
    "op11_hard_negatives": oracles.HARD_NEGATIVES,
    "op12_near_duplicates": oracles.NEAR_DUPLICATES,
}
