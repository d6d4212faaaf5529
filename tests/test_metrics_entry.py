import numpy as np
from pyspark.sql import functions as F

from quarry.operators import metrics as M


def test_recall_monotone_and_miss_is_null(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 3), (3, None), (4, 10)], "qid long, positive_rank long")
    r = {x["k"]: x["recall"] for x in M.recall_at_k(ranks, [10, 1, 5]).collect()}
    assert r == {1: 0.25, 5: 0.5, 10: 0.75}


def test_first_positive_rank(spark):
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    hits = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)],
                                 "qid long, rank int, is_positive boolean")
    got = {r["qid"]: r["positive_rank"] for r in M.first_positive_rank(q, hits).collect()}
    assert got == {1: 2, 2: None}


def test_in_batch_metrics_against_numpy(spark):
    rng = np.random.default_rng(2)
    b, p, dim = 3, 2, 8
    q = rng.standard_normal((b, dim))
    pv = rng.standard_normal((b * p, dim))
    rows = [(0, i, s, q[i].tolist(), pv[i * p + s].tolist()) for i in range(b) for s in range(p)]
    df = spark.createDataFrame(rows, "batch_id long, batch_pos int, slot int, q_vec array<double>, p_vec array<double>")
    got = M.in_batch_metrics(df, n_passages=p).first()
    s = q @ pv.T
    labels = np.arange(b) * p
    pos = s[np.arange(b), labels]
    assert got["rank_sum"] == float(((s > pos[:, None]).sum(1) + 1).sum())
    lse = np.log(np.exp(s).sum(1))
    assert np.isclose(got["dpr_loss"], np.mean(lse - pos))


def test_entry_contract(spark):
    import __spark_entry__ as E
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 7 and set(df.columns) == {"k", "n_correct", "n_questions", "recall"}
    recall = [r["recall"] for r in sorted(rows, key=lambda r: r["k"])]
    assert recall == sorted(recall)


def test_restrict_to_dataset_renumbers_and_requires_dataset(spark):
    from quarry.plans.retrieval import restrict_to_dataset
    hits = spark.createDataFrame([(1, 1, 10, "a", "a"), (1, 2, 11, "b", "a"), (1, 3, 12, "a", "a")],
                                 "qid long, rank int, id long, dataset string, q_dataset string")
    got = sorted((r["rank"], r["id"]) for r in restrict_to_dataset(hits).collect())
    assert got == [(1, 10), (2, 12)]
    bad = spark.createDataFrame([(1, 1, 10, "a", None)],
                                "qid long, rank int, id long, dataset string, q_dataset string")
    try:
        restrict_to_dataset(bad).collect()
    except Exception as exc:  # noqa: BLE001
        assert "dataset" in str(exc)
    else:
        raise AssertionError("missing question dataset accepted")


def test_model_encoder_hook_matches_hash_encoder(spark):
    from quarry.functions import inference as INF
    df = spark.createDataFrame([("Héllo wörld, héllo!",), ("",), ("a b c d e f g",)], "t string")
    enc = INF.model_encoder(INF.hash_predict_fn(16), batch_size=2)
    got = df.select(enc("t").alias("a"), INF.hash_encoder(F.col("t"), 16).alias("b")).collect()
    for r in got:
        assert list(r["a"]) == list(r["b"])
    assert all(x == 0 for x in got[1]["b"])              # no tokens -> zero vector
    assert 0 < sum(abs(x) for x in got[0]["b"]) <= 5       # five tokens, signed counts


def test_merged_shards_must_be_whole(spark):
    import pytest

    from quarry.operators import metrics as M
    from quarry.operators import reader as RD
    shards = spark.createDataFrame([(0, True), (1, False), (2, True), (0, True)], "example_idx long, correct boolean")
    assert RD.mean_metric(M.merge_shards(shards), "x").first()["n_questions"] == 3
    with pytest.raises(Exception, match="a shard is missing"):
        RD.mean_metric(M.merge_shards(shards.where("example_idx <> 1")), "x").collect()
    assert M.merge_shards(shards.limit(0)).count() == 0


def test_average_rank_before_its_start_epoch(spark):
    from quarry.operators import metrics as M
    per_batch = spark.createDataFrame([(0, 2, 3.0, 0.1, 0.2, 0.3)], M.IN_BATCH_SCHEMA)
    assert M.epoch_summary(per_batch, epoch=1, rank_start_epoch=2).first()["avg_rank"] == 1e7
    assert M.epoch_summary(per_batch, epoch=2, rank_start_epoch=2).first()["avg_rank"] == 1.5
