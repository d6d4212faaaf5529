"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path

#: A word: a run of characters other than the space and U+0009 to U+000D. The
#: same class splits UTF-8 bytes with ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The default place of a public vocabulary file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def n_words(text: Column) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table below the shared checkpoint folder and read it back.

    It cuts the lineage at a place that every executor can read, so a lost
    executor costs the tasks it ran and not the steps before this table.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
