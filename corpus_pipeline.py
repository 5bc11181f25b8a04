"""A training corpus from raw documents: five stages, each on all that the one before kept.

1. quality classifier: documents with a score under 0.7 go;
2. MinHash near-duplicates on five-word shingles at 0.8: the row with the least doc_id of each group stays, once;
3. secret scans: findings are replaced in the texts;
4. mixing: sources are brought to their target weights, by whole documents, some more than once;
5. packing: the pieces of 2048-id sequences.

Each stage decides row by row: null and repeated doc_ids neither lose nor multiply other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinescribe.llm import mixing, neardup, packing, quality, secrets
from kinescribe.llm.common import shared_table, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs, shingle=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("secrets", without_secrets),
    ("mix", mixed),
    ("pack", packed),
]

#: Scores, signatures and tokens have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
