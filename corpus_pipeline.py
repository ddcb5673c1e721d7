"""A corpus pipeline: quality filter, near-duplicates, personal data, mixing, packing.

Each stage works on all that the one before kept, is written as Parquet to the shared scratch
folder and read again as the next one's input. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movelines.llm import mixing, neardup, packing, pii, quality
from movelines.llm.common import documents, materialise
from movelines.llm.queries import quality_model


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives less than 0.3 go."""
    return quality.filter_quality(docs, quality_model(spark, sf_dir), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id. Two
    are near-duplicates if their sets of five-word shingles have a Jaccard similarity of 0.8 or
    more: SimHash fingerprints in the Gray-order index find them, the whole sets decide, and MinHash bands
    catch what the fingerprints leave apart. Of rows that repeat both id and text one stays; rows without a doc_id come after all
    others."""
    row = "_row_of_stage"
    nulls, named = docs.filter("doc_id is null"), docs.withColumn(row, F.col("doc_id"))
    if not nulls.isEmpty():  # ids of their own, above any other, stored so that they stay the same
        nulls = materialise(nulls.withColumn(row, F.monotonically_increasing_id() + F.lit(1 << 62)))
        named = named.filter("doc_id is not null").unionByName(nulls)
    rows = materialise(neardup.near_components(named, row, shingle=5, threshold=0.8))
    first = rows.groupBy("component").agg(F.min(F.struct("row", "text_hash")).alias("r"))
    keep = first.select(F.col("r.row").alias(row), F.col("r.text_hash").alias("_text_of_stage"))
    kept = named.withColumn("_text_of_stage", F.xxhash64("text")).join(keep, [row, "_text_of_stage"], "left_semi")
    return kept.dropDuplicates([row, "_text_of_stage"]).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to placeholders; no document goes."""
    return pii.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, by repeated and partly taken documents."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4,096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL has neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
