"""K1: incoming questions as a Structured Streaming job.

Questions arrive as files (any format the file source reads); each micro-batch
is answered by the batch QA job (P6) against static passage and code tables
inside ``foreachBatch``. A per-question top-k is not expressible directly on a
stream (non-time windows are rejected there), which is why the work happens
per micro-batch. The sink is keyed by micro-batch id: a replayed batch
overwrites its own folder, so restarts are idempotent; progress lives in the
checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.reading import answer_questions


def start_answer_stream(spark: SparkSession, source_dir: str, schema: str, passages: DataFrame,
                        codes: DataFrame, sink_dir: str, checkpoint_dir: str, *, file_format: str = "parquet",
                        max_files_per_trigger: int = 1, available_now: bool = True, **qa_params):
    """Start the stream; returns the StreamingQuery.

    source rows: qid, question. codes: (id, code) of the passages (P2 output). Further
    arguments go to `answer_questions`, models (``encoder``, ``reader``) among them."""
    stream = (spark.readStream.schema(schema).format(file_format)
              .option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir))

    def answer_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        answers = answer_questions(batch.select("qid", "question"), passages, codes=codes, **qa_params)
        answers.write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(answer_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_answers(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The sink as a table (batch_id comes from the folder names)."""
    return spark.read.parquet(sink_dir).withColumn("batch_id", F.col("batch_id").cast("bigint"))
