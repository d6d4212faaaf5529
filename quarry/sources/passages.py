"""Passage store jobs (A4-A8): a Parquet table keyed by passage id replaces the KV store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.checks import guard
from quarry.sources.files import last_wins, read_passage_tsv, with_line_numbers


def build_passage_store(spark: SparkSession, tsv_path: str, store_path: str) -> int:
    """Passage TSV -> Parquet store (id, title, text, dataset); refuses an existing target.

    Duplicate ids keep the last row of the file. Returns the number of passages (A6)."""
    passages = last_wins(read_passage_tsv(spark, tsv_path)).drop("file_no", "src_file", "line_no")
    passages.write.mode("errorifexists").parquet(store_path)
    return spark.read.parquet(store_path).count()


def scan_store(spark: SparkSession, store_path: str, key_order: bool = False) -> DataFrame:
    """A5: full scan; ``key_order`` sorts by the id's decimal string, as a byte-keyed store iterates."""
    df = spark.read.parquet(store_path)
    return df.orderBy(F.col("id").cast("string")) if key_order else df


def key_order_positions(store: DataFrame, col: str = "pos") -> DataFrame:
    """A5: (id, place in key order) from the ids alone; texts stay where they are."""
    keys = store.select("id", F.col("id").cast("string").alias("_key")).orderBy("_key", "id")
    return with_line_numbers(keys, col).drop("_key")


def store_size(store: DataFrame) -> DataFrame:
    """Number of passages."""
    return store.agg(F.count(F.lit(1)).cast("bigint").alias("n_passages"))


def lookup(ids: DataFrame, store: DataFrame, *, id_col: str = "id", strict: bool = True) -> DataFrame:
    """Fetch passages for a table of ids. Strict mode fails on an unknown id
    (the batch form of a KeyError); otherwise missing ids come back with nulls."""
    # The ids are what a task holds; the texts stream past them and are not sorted.
    joined = ids.hint("shuffle_hash").join(store.withColumn("_found", F.lit(True)), id_col, "left")
    if strict:
        joined = joined.withColumn("title", guard("title", F.col("_found").isNotNull(),
                                                  F.concat(F.lit("invalid passage id: "), F.col(id_col).cast("string"))))
    return joined.drop("_found")


def passage_table(spark: SparkSession, tsv_path: str) -> DataFrame:
    """Passages straight from a TSV, id as integer, last duplicate wins (title
    and text in their right places)."""
    return last_wins(read_passage_tsv(spark, tsv_path)).drop("file_no", "src_file", "line_no")
