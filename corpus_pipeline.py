"""From documents to tokens in five stages: toxicity, exact and near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and gets all that the one before kept. Documents are told apart by doc_id; rows
without one are kept by every stage that filters. Extra columns of docs stay until the last stage.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaquad.llm.bpe import bpe_decode, bpe_encode, public_vocabulary, shared_vocabulary
from vistaquad.llm.common import settle, table
from vistaquad.llm.decontaminate import contamination
from vistaquad.llm.exact import exact_duplicates
from vistaquad.llm.minhash import near_duplicates
from vistaquad.llm.toxicity import fit_toxicity, without_toxic


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the model learns from the labels of sf_dir."""
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays (rows that repeat it whole stay with it)."""
    return _without(docs, exact_duplicates(docs).where("not kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8), the smallest doc_id stays."""
    return _without(docs, near_duplicates(docs, k=5, percent=80).where("id <> component"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return _without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where("size(spans) > 0"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, tokens (little-endian unsigned 32-bit ids), decoded_sha256 (of the bytes they decode to)."""
    path, pattern = public_vocabulary()
    vocabulary = shared_vocabulary(docs, path)
    both = bpe_decode(bpe_encode(docs, vocabulary, pattern), vocabulary)
    return both.select(F.col("id").alias("doc_id"), "n_tokens", "tokens", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL expresses neither the learned model nor the near duplicates; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
