"""From raw documents to token files: each stage keeps, drops or repeats rows, and the next works on what is left.

Null and empty texts are scored, deduplicated, checked and mixed as texts without words: the classifier's rates decide
whether they stay, near-dedup keeps one of each id, no benchmark window is in them, and with size 0 the mix takes them
as often as their source's passes and threshold say. Rows with the same id and text stay or go together until
near-dedup, which keeps one. Empty tables give empty results; columns beside doc_id, text and source are carried along
under any name, and are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bondsight.llm import decontaminate, minhash, mixing, quality, queries, shared, tokenbin


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.5 or more)."""
    labels = shared.table(spark, sf_dir, "labels").where(shared.crc_rest(F.col("doc_id"), queries.QUALITY_FOLDS) != queries.QUALITY_HELD)
    model = quality.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    return quality.score(docs, model, row).where("score >= 0.5").select("_row.*")  # only texts go to Python and only scores come back


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.one_of_each(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, shared.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: one row for each document in them."""
    out = shared.shared_dir(spark)
    tokenbin.write_tokens(docs, queries.byte_bpe(), out)
    return tokenbin.read_tokens(spark, out)


STAGES = [("quality", good), ("near-duplicates", distinct), ("decontamination", unseen), ("mixing", mixed), ("token files", tokens)]

#: SQL can't express learned scores, consistent samples or token ids; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared.settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
