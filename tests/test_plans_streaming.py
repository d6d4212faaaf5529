import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import knn


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_binary_retrieve_plan_shape(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(32).tolist()) for i in range(50)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    codes = v.select("id", V.sign_code("embedding").alias("code"))
    hits = knn.binary_retrieve(v.select(F.col("id").alias("qid"), "embedding"), codes, k=5, binary_k=10, dim=32)
    plan = _plan(hits)
    assert plan.count("Exchange hashpartitioning") == 1          # the merge of the tiles' top-k
    assert plan.count("REPARTITION") == 1                          # both sides dealt to tiles in one exchange
    assert "WindowGroupLimit" in plan and "Partial" in plan         # per-task top-k before the exchange
    assert "MapInArrow" in plan
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "SortMergeJoin"):
        assert bad not in plan


def test_dense_knn_plan_shape(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, embedding array<double>")
    plan = _plan(knn.dense_knn(v.select(F.col("id").alias("qid"), "embedding"), v, k=3, dim=2))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_question_stream_restart_is_idempotent(spark):
    from quarry.plans.retrieval import code_table, encode_passages
    from quarry.streaming.questions import read_answers, start_answer_stream

    base = tempfile.mkdtemp()
    src, sink, ckpt = (os.path.join(base, d) for d in ("src", "sink", "ckpt"))
    passages = spark.createDataFrame(
        [(i, f"title {i}", f"text about topic {i % 5} and more words {i}", "d") for i in range(30)],
        "id long, title string, text string, dataset string")
    codes = code_table(encode_passages(passages, 64)).cache()
    q = spark.createDataFrame([(1, "topic 1 words"), (2, "topic 3")], "qid long, question string")
    q.coalesce(1).write.mode("append").parquet(src)

    def run():
        start_answer_stream(spark, src, "qid bigint, question string", passages, codes, sink, ckpt,
                            num_retrieval_passages=3, num_passages_to_read=1).awaitTermination()
        return sorted((r["batch_id"], r["qid"], r["rank"]) for r in read_answers(spark, sink).collect())

    first = run()
    assert {b for b, _, _ in first} == {0} and {qq for _, qq, _ in first} == {1, 2}
    assert run() == first                                   # restart: nothing new, sink unchanged
    spark.createDataFrame([(3, "topic 4")], "qid long, question string").coalesce(1) \
        .write.mode("append").parquet(src)
    third = run()
    assert [x for x in third if x[0] == 0] == first         # earlier batch untouched
    assert {qq for b, qq, _ in third if b == 1} == {3}      # one new micro-batch


def test_hits_broadcast_into_passage_scan(spark):
    from quarry.plans.retrieval import attach_passages
    d = tempfile.mkdtemp()
    path = os.path.join(d, "passages.parquet")
    spark.range(0, 2000).repartition(8).select(
        "id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"),
        F.lit("text").alias("text"), F.lit("d").alias("dataset")).write.parquet(path)
    passages = spark.read.parquet(path)
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, rng.standard_normal(16).tolist()) for i in range(2000)],
                              "id long, embedding array<double>")
    q = v.limit(5).select(F.col("id").alias("qid"), "embedding")
    hits = knn.dense_knn(q, v, k=4, dim=16)
    joined = attach_passages(hits, passages)
    plan = _plan(joined)
    assert "BroadcastHashJoin" in plan and "BroadcastExchange" in plan
    # the passage side is scanned where it lies: no hash exchange above its scan
    assert plan.count("Exchange hashpartitioning") == 0
    assert joined.count() == 20
