"""Sharding by global byte prefix sums.

Documents are laid end to end in the order (doc_id, text checksum, size), nulls
first. A range partitioning gives contiguous runs, the runs' byte and row
totals give each run its global start, and a running sum inside a run gives
every document its place on the global byte line. The line is cut at equal
targets: a document belongs to the shard that holds its middle byte, so shards
are contiguous, and each differs from the target by less than one document.

Only DataFrame functions are used. What is shuffled is a narrow row (plus the
columns the caller asks to carry). The offsets table has one row per run.

Defined cases: a null text has no bytes (its size is the per-document overhead);
a null id sorts first; repeated rows are documents of their own, in any order
among themselves since they are equal; an empty table gives no rows; one
document larger than a shard's target takes the shards it covers, which then
have no other rows, so some shards may be empty. Columns other than id, text
and `carry` are not looked at, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialise, utf8_bytes

ROW_OVERHEAD = 8
_ORDER = ("doc_id", "text_crc32", "size")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, *carry): the shard of every document and its place there.

    `carry` names further columns of `docs` (such as the text) that ride along
    to be written with their shard; they come back as ``carried.<name>``.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    columns = [F.col(id_col).alias("doc_id"), (utf8_bytes(F.col(text_col)) + F.lit(ROW_OVERHEAD)).alias("size"),
               F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32")]
    if carry:
        columns.append(F.struct(*[F.col(c) for c in carry]).alias("carried"))
    narrow = docs.select(*columns)
    if not carry:
        narrow = materialise(narrow, "shard-sizes")  # the range partitioning samples its input: texts are read once
    runs = materialise(narrow.repartitionByRange(*_ORDER).withColumn("run", F.spark_partition_id()), "shard-runs")

    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (runs.groupBy("run").agg(F.sum("size").alias("run_bytes"), F.count(F.lit(1)).alias("run_rows"))
               .select("run", F.coalesce(F.sum("run_bytes").over(before), F.lit(0)).alias("bytes_before"),
                       F.coalesce(F.sum("run_rows").over(before), F.lit(0)).alias("rows_before"),
                       F.sum("run_bytes").over(everything).alias("all_bytes")))

    inside = Window.partitionBy("run").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("bytes_before") + F.sum("size").over(inside)
    # 2 * bytes * shards stays within a long up to petabytes.
    shard = F.least(F.expr("(2 * byte_end - size) * {0} div greatest(2 * all_bytes, 1)".format(int(shards))),
                    F.lit(shards - 1)).cast("int")
    placed = (runs.join(offsets, "run")
              .withColumn("byte_end", end)
              .withColumn("place", F.col("rows_before") + F.row_number().over(
                  Window.partitionBy("run").orderBy(*_ORDER)) - 1)
              .withColumn("shard", shard))
    # One row per shard: a proven bound for the broadcast.
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("place") - F.col("first_place")).cast("long").alias("slot"),
                    *([F.col("carried")] if carry else [])))


def write_shards(docs: DataFrame, path: str, shards: int = 24, text_col: str = "text") -> None:
    """Write the texts as Parquet folders ``shard=<n>``, each file in slot order."""
    (shard_documents(docs, shards, text_col=text_col, carry=(text_col,))
     .select("shard", "slot", "doc_id", "size", F.col(f"carried.{text_col}").alias("text"))
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
