"""Corpus pipeline: quality rules, SimHash near-dedup, benchmark
decontamination, mixing to target weights, token-ID output.

Each stage works on all rows that its predecessor kept and returns the columns
of ``documents``; the last returns one row per document of the token files.
Decisions that fall on a row (keep or drop) are made where the row is read;
only near-dedup and mixing compare rows, and both shuffle short keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpanel.llm.common import shared_folder, table
from signalpanel.llm.decontam import decontaminate
from signalpanel.llm.mixing import mixed_rows
from signalpanel.llm.quality import quality_filter
from signalpanel.llm.simhash import keep_one
from signalpanel.llm.tokenbin import VOCABULARY, read_shards, write_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at the target weights; a document is repeated once per epoch,
    and the one at each source's cut is shortened to the exact budget."""
    return mixed_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending id order; per document, as read back: doc_id,
    start, n_tokens, ids_crc32 and the shard that holds it."""
    import public_tokenizers

    path = shared_folder(spark, "tokens")
    write_shards(docs, path, public_tokenizers.path(VOCABULARY))
    return read_shards(spark, path).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "shard")


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_output),
]

#: Fingerprint links and edit distances are not expressible in SQL; the rows
#: are tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the
    shared folder and read again as the next stage's input."""
    docs = table(spark, sf_dir, "documents")
    root = shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
