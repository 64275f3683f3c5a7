"""Corpus pipeline: toxic documents, copies, near copies and benchmark passages go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of ``documents``.
``run`` writes each stage's rows as Parquet to the shared folder and reads them for the next; what a stage wrote
on its way is dropped when its rows are there, and its rows when the next stage has used them.
The classifier of the first stage and the fingerprints of the third can't be said in SQL, so there is no
ORACLE_SQL; ``tests/llm/test_queries.py`` holds every stage against brute force on its own input.

Every stage: doc_id is an integer or null, text may be null, empty or very long; further columns of any name pass through (but
for the last stage); an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import bpe, decontaminate, exact_dedup, queries, simhash, toxicity
from wayline.llm.common import drop, shared_dir, stored, workspace

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below their language's threshold stay; null and empty texts score by the bias alone; repeated rows fare alike."""
    queries.for_long_texts(spark)
    return toxicity.drop_toxic(docs, queries.toxic_labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (white space folded, null as empty) the one with the least id stays, a null id only without any other; of repeated rows one."""
    queries.for_long_texts(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the row with the least id stays, ties by text; texts without words are one group; of repeated rows one."""
    queries.for_long_texts(spark)
    return simhash.drop_near_copies(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; passages of the benchmark go from their texts, and n_chars follows; null and empty texts stay as they are."""
    queries.for_long_texts(spark)
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row: doc_id, n_tokens, and digests of ids and of their text; null counts as empty, which has no tokens."""
    queries.for_long_texts(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    found = bpe.round_trip(docs.select("doc_id", "text"), path, keep=("doc_id",))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        at = shared_dir(spark, name.replace(" ", "_"))
        with workspace(spark, "stage") as folder:
            docs = stored(stage(spark, docs, sf_dir), at)
        drop(spark, folder)
        if before:
            drop(spark, before)
        before = at
    return docs
