"""The corpus pipeline: toxicity filter, exact and near-duplicates, benchmark decontamination, encoding.

Every stage takes the stored table that the one before it left and returns what it keeps; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan.llm import bpe, decontam, exact_dedup, near_dedup, queries, toxicity
from fieldscan.llm.common import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't predicted toxic. A null text is an empty one; repeated rows are judged each, and an empty table stays empty."""
    return toxicity.drop_toxic(docs, queries.table(spark, sf_dir, "labels"))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, without regard to A-Z case; null is the empty text. The greatest doc_id stays, one of its rows if it is repeated."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that with the least doc_id. Texts without words, null ones too, all stay; shorter texts are one shingle."""
    return near_dedup.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no item of the benchmark. Null and empty texts leak nothing, and an empty benchmark drops nothing."""
    return decontam.drop_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the decoded text's hash of every row. A null text is an empty one: no tokens."""
    coded = bpe.encode(docs, **queries.vocabulary())
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_duplicates),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("encoding", encode),
]

#: Toxicity scores and sketches can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage-{k}")
    return docs
