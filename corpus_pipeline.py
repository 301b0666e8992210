"""From raw documents to token ids: quality, near duplicates, mix, encoding.

Every stage is written as Parquet to the shared folder and read back as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashwave.llm import bpe, jaccard, mixing, quality
from hashwave.llm.common import local_shared_dir, read_table, tokenizer_path, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep."""
    local_shared_dir(spark)
    features = written(quality.with_features(docs.select("text")).drop("text"), "features")
    return quality.keep_good(docs, features)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    local_shared_dir(spark)
    return jaccard.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    local_shared_dir(spark)
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document of the mix, with digests of the ids and of the text decoded from them."""
    path = tokenizer_path()
    texts = docs.select("doc_id", "lang", "source", "text")
    return bpe.round_trip(texts, path).select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good_quality),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources", mixed),
    ("BPE encoding", encoded),
]

#: The estimated rule weights, the verified join and the token ids are beyond SQL. The tests compare the
#: Jaccard stage with brute force and the decoded texts with the documents; the operators have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    local_shared_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
