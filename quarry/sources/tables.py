"""The driver's fixture tables and how they stand in for the QA data model.

* passages   = documents: id = doc_id, title = first line of text, text = the
  whole text, dataset = source.
* vectors    = embeddings: id = vec_id, embedding (64-d float), label. Every
  vector is also a question ("each vector queries the whole table");
  labelled positives of a question are the *other* vectors with its label.
* questions  = benchmark items: qid = item_id, question = text; answers =
  the first word and the span of words 3..6 of the text.
* stream     = conversations: user turns are incoming questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        F.col("text"),
        F.col("source").alias("dataset"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding"), F.col("label"))


def answers_of(text_col) -> "F.Column":
    """Fixture answers: first word, and words 3..6 joined by one blank."""
    words = F.regexp_extract_all(text_col, F.lit("\\S+"), 0)
    first = F.get(words, 0)
    mid = F.array_join(F.slice(words, 3, 4), " ")
    return F.filter(F.array(first, mid), lambda a: F.length(a) > 0)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("qid"), F.col("text").alias("question"),
                    answers_of(F.col("text")).alias("answers"))
