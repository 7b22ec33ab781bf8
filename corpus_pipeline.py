"""From a table of documents to encoded training text: quality, near duplicates, repeated spans, benchmark, pieces.

Each stage takes (spark, docs, sf_dir), with docs the rows that the stage before it kept, and returns a DataFrame; all
but the last return the columns of docs. A run writes the result of each stage and reads it as the next one's docs.
Rows are not ordered. Null and empty texts pass every stage but the first, which judges them by their features; a null
doc_id is a document like others; columns beyond doc_id and text are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm import lm, partenum, pieces, quality, spans, winnow
from trajecta.llm.scratch import Scratch

PIECES = "piece_bpe_32k.model"


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with columns c0, c1, ..., so that no name of theirs meets one that an operator adds; those of doc_id and text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking learned from labels (rows whose crc32(doc_id) mod 5 is not 0) does not reject."""
    f, doc_id, text = _numbered(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias(doc_id), "quality")
    learn = lm.remainder(F.col(doc_id), 5) != 0
    kept = quality.ranked(f, labels, learn, doc_id, text, keep=tuple(f.columns)).where("predicted = 1")
    return kept.select(*f.columns).toDF(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (runs of five words, similarity 0.8 or more), the document whose doc_id names it."""
    found = partenum.jaccard_components(docs.select("doc_id", "text"), size=5, percent=80)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__stay")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__stay")), "left_semi").dropDuplicates(["doc_id", "text"])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences of runs that stand earlier in the table; n_chars is counted anew."""
    f, doc_id, text = _numbered(docs)
    cut = spans.repeated_spans(f, doc_id, text, keep=tuple(f.columns), closed=True)
    if "n_chars" in docs.columns:
        n = f.columns[docs.columns.index("n_chars")]
        cut = cut.withColumn(n, F.when(F.col("n_removed") > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return cut.select(*f.columns).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark."""
    found = winnow.contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.where(winnow.contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("row_key").alias("__gone")).distinct()
    return docs.join(gone, winnow.row_key(docs["doc_id"], docs["text"]) == F.col("__gone"), "left_anti")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids with the end id, and digests of the ids and of what they decode to."""
    return pieces.encode_decode(docs, public_tokenizers.path(PIECES), decoded=False, digests=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The classifier and the components are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
