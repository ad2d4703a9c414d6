"""The corpus pipeline: quality scores, quality rules, shared lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns of `documents`; the last returns the
pieces of the packed sequences. What a stage decides takes effect on the rows it returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from listing_lake.llm import line_dedup, ngram_join, packing, quality_classifier, quality_rules
from listing_lake.llm.queries import residue, table
from listing_lake.session import configure, materialize

LEAST_SCORE = 0.3


def _content(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({"doc_id": "content_id", "text": "summary"})


def _documents(content: DataFrame, docs: DataFrame) -> DataFrame:
    return content.withColumnsRenamed({"content_id": "doc_id", "summary": "text"}).select(docs.columns)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score `LEAST_SCORE` or more; learnt from the labelled documents outside the held-out fold."""
    content = _content(docs)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("content_id"), "quality").where(residue("content_id", 5) != 0)
    model = quality_classifier.fit(quality_classifier.text_statistics(quality_classifier.labelled_sample(content, labels)), labels)
    scored = quality_classifier.score_quality(quality_classifier.text_statistics(content), model)
    return _documents(scored.where(F.col("quality_score") >= LEAST_SCORE), docs)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the newest policy."""
    ledger = quality_rules.rule_ledger(_content(docs))
    newest = quality_rules.POLICIES[max(quality_rules.POLICIES)]
    return _documents(ledger.where(quality_rules.passes(newest)), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes shared lines out of all documents but one; every document stays, if with fewer lines."""
    left = _documents(line_dedup.drop_shared_lines(_content(docs)), docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group, one with the smallest id; documents without an id or without words all stay."""
    keyed = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    # Id and row name a row, so that rows of one id are told apart.
    rows = keyed.select(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "_row")).alias("content_id"), F.col("text").alias("summary"))
    groups = ngram_join.near_duplicates(rows)
    first = groups.where(F.col("content_id") == F.col("component_id")).select(F.col("content_id._row").alias("_row"))
    return keyed.join(first, "_row", "left_semi").select(docs.columns).unionByName(keyed.where(F.col("doc_id").isNull()).select(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training sequences of 4,096 tokens."""
    packed = packing.pack_content(docs.select(F.col("doc_id").alias("content_id"), F.col("text").alias("summary")), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumnRenamed("content_id", "doc_id")


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("packing", pack),
]

# The classifier and the packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to all documents; each stage's rows are written before the next one reads them."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
