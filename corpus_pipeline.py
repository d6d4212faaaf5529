"""The corpus pipeline: quality rules, SimHash near-dedup, mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which is written as Parquet and read again as the next
stage's `docs`. All but the last return the columns of `documents`.

Defined cases, in every stage: a null or empty text fails the quality rules, so
it goes in the first stage; given to a later one it has fingerprint zero, gives the
mixture no words, and is packed as its end id. Null ids are kept like others:
of a near-duplicate component one row stays, chosen by id (nulls last), then text.
Repeated rows are one component. A null source is a source of its own. Very long
texts are handled whole. An empty table gives an empty result. Further columns ride
along to the mixing stage and may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing, packing, rules, simhash
from quarry.llm.common import materialise, table, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go."""
    return rules.keep_good(docs, rules.learn_rules(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    return simhash.keep_one(docs, shingle=4, max_distance=4)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's pieces as documents: a document's row per piece that a shard takes of it, with the piece's part of the text."""
    pieces = mixing.mixture(docs).select("row.*")
    return pieces.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place there."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("mixing sources to target weights", mix), ("best-fit packing", pack)]

#: SQL can't express learned rules, fingerprints or packing; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{i}")
    return docs
