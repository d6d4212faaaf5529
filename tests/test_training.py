import pytest
from pyspark.sql import functions as F

from quarry.operators import training as TR


def _examples(spark, sizes):
    rows = [(k, i) for k, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, key_idx long")


@pytest.mark.parametrize("weights", [None, {"a": 2.5, "b": 0.5, "c": 0.29}])
def test_multi_key_batches_are_full_single_key_and_counted(spark, weights):
    sizes = {"a": 23, "b": 40, "c": 100}
    b = TR.multi_key_batches(_examples(spark, sizes), batch_size=3, weights=weights, seed=1, epoch=0,
                             num_replicas=2, rank=0).collect()
    by_batch = {}
    for r in b:
        by_batch.setdefault(r["batch_no"], []).append(r)
    assert len(by_batch) == TR.multi_key_batch_count(sizes, weights, 3, 2)
    for rows in by_batch.values():
        assert len(rows) == 3
        assert len({r["dataset"] for r in rows}) == 1
        assert sorted(r["batch_pos"] for r in rows) == [0, 1, 2]
    assert sorted(by_batch) == list(range(len(by_batch)))


def test_multi_key_without_shuffle_repeats_in_order(spark):
    # w = 2.5 needs three passes over the key: 0..9, 0..9, 0..4
    b = TR.multi_key_batches(_examples(spark, {"a": 10}), batch_size=5, weights={"a": 2.5}, shuffle=False)
    rows = sorted((r["batch_no"], r["batch_pos"], r["key_idx"]) for r in b.collect())
    assert [k for _, _, k in rows] == list(range(10)) * 2 + list(range(5))


def test_multi_key_hot_key(spark):
    # one key holds a third of all rows: still exact counts and full batches
    sizes = {"hot": 300, **{f"k{i}": 30 for i in range(20)}}
    b = TR.multi_key_batches(_examples(spark, sizes), batch_size=8, seed=4)
    counts = b.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dataset").alias("d"))
    assert counts.where("n != 8 or d != 1").count() == 0
    assert counts.count() == TR.multi_key_batch_count(sizes, None, 8)


def test_rank_bounds_checked(spark):
    with pytest.raises(ValueError):
        TR.multi_key_batches(_examples(spark, {"a": 4}), batch_size=2, num_replicas=2, rank=2)
    with pytest.raises(ValueError):
        TR.plain_batches(spark.range(4).withColumnRenamed("id", "index"), 2, shuffle=False, num_replicas=2, rank=-1)


def test_plain_batches_in_order(spark):
    b = TR.plain_batches(spark.range(10).withColumnRenamed("id", "index"), 4, shuffle=False).collect()
    assert sorted((r["batch_id"], r["batch_pos"], r["index"]) for r in b)[:5] == \
        [(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 0, 4)]


CTX = "array<struct<passage_id:string,title:string,text:string>>"


def _items(spark):
    rows = [
        ("q0", ["a"], None, [("1", "t", "x")], [("2", "t", "x")], [], 0, "f", 0),
        ("q1", ["a"], "d", [], [("2", "t", "x")], [("3", "t", "x")], 0, "f", 1),        # no positive
        ("q2", ["a"], "d", [("1", "t", "x")], [], [], 0, "f", 2),                        # no negative
        ("q3", ["a"], "d", [("4", "t", "x")], None, [("5", None, None)], 0, "f", 3),     # null list
    ]
    df = spark.createDataFrame(rows, f"question string, answers array<string>, dataset string, "
                                       f"positive_ctxs {CTX}, hard_negative_ctxs {CTX}, negative_ctxs {CTX}, "
                                       f"file_no int, src_file string, line_no long")
    fields = F.struct("question", "answers", "dataset", "positive_ctxs", "hard_negative_ctxs", "negative_ctxs",
                      F.struct(F.array(F.lit(1), F.lit(2)).alias("list"), F.lit(None).cast("string").alias("none")).alias("own"), F.lit(2.5).alias("weight"))
    return df.select(F.parse_json(F.to_json(fields, {"ignoreNullFields": "false"})).alias("item"), "file_no", "src_file", "line_no")


def test_retriever_examples_filters_and_renumbers(spark):
    ex = TR.number_examples(TR.retriever_examples(_items(spark))).orderBy("index").collect()
    assert [(r["question"], r["index"], r["dataset"]) for r in ex] == [("q0", 0, ""), ("q3", 1, "d")]
    capped = TR.retriever_examples(_items(spark), max_hard_negatives=0, max_normal_negatives=0).collect()
    assert capped == []


def test_pick_pairs_and_backfill(spark):
    ex = TR.number_examples(TR.retriever_examples(_items(spark)))
    picked = TR.pick_pairs(ex, num_negatives=1, training=False)
    pairs = TR.flatten_pairs(picked)
    store = spark.createDataFrame([(5, "T5", "X5")], "id long, title string, text string")
    got = sorted((r["index"], r["slot"], r["passage_id"], r["title"]) for r in
                 TR.backfill_from_store(pairs, store).collect())
    assert got == [(0, 0, "1", "t"), (0, 1, "2", "t"), (1, 0, "4", "t"), (1, 1, "5", "T5")]
    with pytest.raises(Exception):
        TR.pick_pairs(ex, num_negatives=2, training=False).collect()


def test_shuffles_are_reproducible(spark):
    ex = TR.number_examples(TR.retriever_examples(_items(spark)))
    a = TR.pick_pairs(ex, num_negatives=1, training=True, seed=3, epoch=1).collect()
    b = TR.pick_pairs(ex, num_negatives=1, training=True, seed=3, epoch=1).collect()
    assert [r["negatives"] for r in a] == [r["negatives"] for r in b]


def test_dataset_keys_filter(spark):
    ex = TR.retriever_examples(_items(spark), dataset_keys=["d"]).collect()
    assert [r["question"] for r in ex] == ["q3"]


def test_append_gold_passage(spark):
    sch = ("ctxs array<struct<id:bigint,title:string>>, pos array<int>, "
           "gold struct<id:bigint,title:string>, span boolean")
    rows = [([(1, "a"), (2, "b")], [0], (9, "g"), True),    # appended as index 2
            ([(1, "a"), (9, "g")], [1], (9, "g"), True),    # already a positive
            ([(1, "a")], [0], (9, "g"), False),             # no answer span in it
            ([(1, "a")], [0], None, True)]                  # no gold passage
    df = spark.createDataFrame(rows, sch)
    got = df.select(TR.append_gold_passage(F.col("ctxs"), F.col("pos"), F.col("gold"), F.col("span")).alias("r")) \
        .collect()
    assert [(len(r["r"]["ctxs"]), r["r"]["positive_idxs"]) for r in got] == [(3, [0, 2]), (2, [1]), (1, [0]), (1, [0])]


def test_metadata_keeps_fields_that_no_schema_names(spark):
    import json
    ex = TR.retriever_examples(_items(spark)).collect()
    assert [json.loads(r["metadata"]) for r in ex] == [{"own": {"list": [1, 2], "none": None}, "weight": 2.5}] * 2


def test_complete_pairs_never_meet_the_store(spark, tmp_path):
    pairs = spark.createDataFrame([(0, "1", "t", "x"), (1, "5", None, None), (2, "6", "own", None), (3, "007", "t", "x")],
                                  "index long, passage_id string, title string, text string")
    store_path, pairs_path = str(tmp_path / "store"), str(tmp_path / "pairs")
    spark.createDataFrame([(i, f"T{i}", f"X{i}") for i in range(10)], "id long, title string, text string").write.parquet(store_path)
    pairs.write.parquet(pairs_path)
    pairs = spark.read.parquet(pairs_path)
    out = TR.backfill_from_store(pairs, spark.read.parquet(store_path))
    assert sorted((r["index"], r["title"], r["text"]) for r in out.collect()) == [(0, "t", "x"), (1, "T5", "X5"), (2, "own", "X6"), (3, "t", "x")]
    plan = TR.backfill_from_store(pairs, spark.read.parquet(store_path))._jdf.queryExecution().executedPlan().toString()
    whole, joined = plan.split("Union")[1].split("Join", 1)[0], plan
    assert "isnotnull(title" in whole and "BroadcastHashJoin" in joined
    assert "Exchange hashpartitioning" not in joined          # neither the pairs nor the store's texts are shuffled
    with pytest.raises(Exception, match="store lacks it"):
        TR.backfill_from_store(pairs.withColumn("passage_id", F.lit("77")), spark.read.parquet(store_path)).collect()
