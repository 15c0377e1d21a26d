"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents, and of those whatever columns came in, of
any name. A stage decides about rows, not about doc_ids, which may repeat or be
null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.bpe import bpe_encode
from gridmill.llm.common import bound_batches, numbered, stored
from gridmill.llm.decontaminate import find_benchmark, index_documents
from gridmill.llm.quality import quality_sample
from gridmill.llm.secrets import found_secrets
from gridmill.llm.simhash import near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample keeps.

    Null and empty texts go, for there is nothing to weigh; long texts count in
    whole. Rows with equal doc_id and text stay or go together, and rows whose
    key ties with the last one kept stay. No rows give no rows.
    """
    return quality_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: Jaccard similarity of 5-word shingles of 0.8 or more, over chains.

    The row with the least doc_id stays (null last), of several the one with the
    least hash of all its columns, of equal rows any one. Null texts and texts
    without words are one group. No rows give no rows.
    """
    rows = numbered(docs)
    groups = near_copies(rows.select("rid", "row.text"))
    order = F.struct(F.col("row.doc_id").isNull(), "row.doc_id", F.xxhash64("row"), "rid")
    first = rows.select("rid", order.alias("place")).join(groups, "rid").groupBy("component").agg(F.min("place").alias("place"))
    return rows.join(first.select("place.rid"), "rid", "left_semi").select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs. Null and empty texts hold none and stay; every row is judged by itself. No rows give no rows."""
    rows = numbered(docs)
    found = find_benchmark(index_documents(rows.select(F.col("rid").alias("doc_id"), "row.text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.where(F.size("hits") > 0).select(F.col("doc_id").alias("rid")), "rid", "left_anti").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets blanked out and n_chars counted anew. A null text stays null, with n_chars null. No rows give no rows."""
    bound_batches(spark)
    clean = docs.withColumn("text", found_secrets("text")["redacted"])
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids: a row for each document; null and empty texts have no tokens. No rows give no rows."""
    return bpe_encode(docs, str(public_tokenizers.path("word_bpe_49k.json")), decode=False)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("encode", encode)]

#: The stages are models and bit codes that SQL can't express; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
