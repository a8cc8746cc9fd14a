"""The training-corpus pipeline: toxicity, near-dedup, secret scans, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents; the
last returns token digests. run() applies the stages to documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import bpe, minhash, mixing, secrets, toxicity
from factweave.llm.common import cut, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; null and empty texts stay.

    The lexicon is learned from labelled rows of the unfiltered documents, as the labels describe those.
    """
    small_batches(spark)
    model = toxicity.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.scorer(model)("text") < toxicity.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each near-duplicate group; rows without doc_id or words stay.

    Ids to drop are broadcast if few enough (counted first), else joined.
    """
    gone = cut(minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct())
    gone = F.broadcast(gone) if gone.count() <= minhash.BROADCAST_IDS else gone
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mask."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in training order."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    return bpe.digest_documents(docs, bpe.default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the learned lexicon, nor the tokenizer; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
