import numpy as np
import pytest

from quarry.functions import vectors as V
from quarry.operators import knn


def _tables(spark, n=60, nq=7, dim=16, integer=True, seed=1):
    rng = np.random.default_rng(seed)
    p = rng.integers(-3, 4, size=(n, dim)).astype(float) if integer else rng.standard_normal((n, dim))
    q = rng.integers(-3, 4, size=(nq, dim)).astype(float) if integer else rng.standard_normal((nq, dim))
    pdf = spark.createDataFrame([(i * 3 + 1, p[i].tolist()) for i in range(n)], "id long, embedding array<double>")
    qdf = spark.createDataFrame([(100 + j, q[j].tolist()) for j in range(nq)], "qid long, embedding array<double>")
    return p, q, pdf, qdf


def _brute_dense(p, q, ids, k):
    out = {}
    for j in range(len(q)):
        s = p @ q[j]
        order = sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[:k]
        out[100 + j] = [(ids[i], s[i]) for i in order]
    return out


@pytest.mark.parametrize("k", [1, 5, 80])
def test_dense_knn_matches_brute_force_with_ties(spark, k):
    p, q, pdf, qdf = _tables(spark)
    ids = [i * 3 + 1 for i in range(len(p))]
    got = knn.dense_knn(qdf, pdf, k=k, dim=16).collect()
    exp = _brute_dense(p, q, ids, k)
    by_q = {}
    for r in got:
        by_q.setdefault(r["qid"], []).append((r["rank"], r["id"], r["score"]))
    for qid, lst in exp.items():
        lst_got = [(i, s) for _, i, s in sorted(by_q[qid])]
        assert [i for i, _ in lst_got] == [i for i, _ in lst]
        assert np.allclose([s for _, s in lst_got], [s for _, s in lst])


def test_fewer_vectors_than_k_returns_what_exists(spark):
    p, q, pdf, qdf = _tables(spark, n=4)
    got = knn.dense_knn(qdf, pdf, k=10, dim=16).collect()
    assert len(got) == 4 * len(q)


def test_question_blocks_give_same_result(spark):
    p, q, pdf, qdf = _tables(spark, n=50, nq=9, integer=False)
    one = sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9))
                 for r in knn.dense_knn(qdf, pdf, k=5, dim=16).collect())
    many = sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9))
                  for r in knn.dense_knn(qdf, pdf, k=5, dim=16, block_rows=2).collect())
    assert one == many


def test_hamming_matches_brute_force(spark):
    p, q, pdf, qdf = _tables(spark, n=70, dim=64, integer=False, seed=3)
    codes = pdf.select("id", V.sign_code("embedding").alias("code"))
    qc = qdf.select("qid", V.sign_code("embedding").alias("code"))
    got = knn.hamming_knn(qc, codes, k=6, dim=64).collect()
    ids = [i * 3 + 1 for i in range(len(p))]
    pb, qb = p >= 0, q >= 0
    for j in range(len(q)):
        d = (pb != qb[j]).sum(axis=1)
        exp = sorted(range(len(ids)), key=lambda i: (d[i], ids[i]))[:6]
        rows = sorted((r["rank"], r["id"], r["distance"]) for r in got if r["qid"] == 100 + j)
        assert [x[1] for x in rows] == [ids[i] for i in exp]
        assert [x[2] for x in rows] == [int(d[i]) for i in exp]


def test_binary_k_at_least_n_is_pure_rerank(spark):
    p, q, pdf, qdf = _tables(spark, n=40, dim=32, integer=False, seed=5)
    codes = pdf.select("id", V.sign_code("embedding").alias("code"))
    got = knn.binary_retrieve(qdf, codes, k=5, binary_k=1000, dim=32).collect()
    ids = [i * 3 + 1 for i in range(len(p))]
    ps = np.where(p < 0, -1.0, 1.0)
    for j in range(len(q)):
        s = ps @ q[j]
        d = ((p >= 0) != (q[j] >= 0)).sum(axis=1)
        exp = sorted(range(len(ids)), key=lambda i: (-s[i], d[i], ids[i]))[:5]
        rows = sorted((r["rank"], r["id"]) for r in got if r["qid"] == 100 + j)
        assert [x[1] for x in rows] == [ids[i] for i in exp]


def test_null_vectors_are_skipped(spark):
    pdf = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, embedding array<double>")
    qdf = spark.createDataFrame([(7, [1.0, 0.5]), (8, None)], "qid long, embedding array<double>")
    got = knn.dense_knn(qdf, pdf, k=5, dim=2).collect()
    assert sorted((r["qid"], r["id"]) for r in got) == [(7, 1), (7, 3)]


def test_select_topk_exact_ties():
    rows = np.array([0, 0, 0, 1, 1])
    keys = [np.array([1.0, 1.0, 0.5, 2.0, 2.0]), np.array([9, 3, 5, 2, 1])]
    keep = knn.select_topk(rows, keys, 2)
    assert sorted(keep.tolist()) == [1, 2, 3, 4]


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in ("qid", "rank", *cols)) for r in df.collect())


@pytest.mark.parametrize("block_rows", [1, 3, 5])
def test_many_tiles_equal_one(spark, block_rows):
    """13 to 3 blocks x up to 8 slabs against one block, ties included."""
    p, q, pdf, qdf = _tables(spark, n=90, nq=13, dim=32)
    codes = pdf.select("id", V.sign_code("embedding").alias("code"))
    qc = qdf.select("qid", V.sign_code("embedding").alias("code"))
    for one, many, cols in (
            (knn.dense_knn(qdf, pdf, k=8, dim=32), knn.dense_knn(qdf, pdf, k=8, dim=32, block_rows=block_rows), ("id", "score")),
            (knn.hamming_knn(qc, codes, k=8, dim=32), knn.hamming_knn(qc, codes, k=8, dim=32, block_rows=block_rows), ("id", "distance")),
            (knn.hamming_knn(qc, codes, k=8, dim=32), knn.hamming_knn(qdf, codes, k=8, dim=32, q_col="embedding", q_kind="float",
                                                                      block_rows=block_rows), ("id", "distance")),
            (knn.binary_retrieve(qdf, codes, k=5, binary_k=20, dim=32),
             knn.binary_retrieve(qdf, codes, k=5, binary_k=20, dim=32, block_rows=block_rows), ("id", "distance", "score"))):
        assert _rows(one, *cols) == _rows(many, *cols)


def test_many_questions_with_large_k_are_blocked(spark, monkeypatch):
    p, q, pdf, qdf = _tables(spark, n=30, nq=12, integer=False, seed=9)
    ref = _rows(knn.dense_knn(qdf, pdf, k=8, dim=16), "id")
    monkeypatch.setattr(knn, "BLOCK_BYTES", (8 * 16 + 40 * 8) * 5)     # room for 5 questions x k=8 per task
    assert knn._block_rows(8 * 16, 8) == 5
    assert _rows(knn.dense_knn(qdf, pdf, k=8, dim=16), "id") == ref and len(ref) == 12 * 8


@pytest.mark.parametrize("n", [4, 30, 300])
def test_nan_is_no_hit_for_any_number_of_vectors(spark, n):
    nan = float("nan")
    rows = [(i, [nan, 1.0] + [0.0] * 30 if i % 3 == 0 else [float(i), 1.0] + [0.0] * 30) for i in range(n)]
    pdf = spark.createDataFrame(rows, "id long, embedding array<double>")
    qdf = spark.createDataFrame([(1, [1.0, 0.0] + [0.0] * 30), (2, [nan] * 32)], "qid long, embedding array<double>")
    want = [(1, r + 1, i) for r, i in enumerate(sorted((i for i in range(n) if i % 3), reverse=True)[:5])]
    assert _rows(knn.dense_knn(qdf, pdf, k=5, dim=32), "id") == want
    codes = pdf.select("id", V.sign_code("embedding").alias("code"))
    found = knn.binary_retrieve(qdf, codes, k=2, binary_k=3, dim=32).collect()
    # A NaN component has sign +1, so it has a distance; its rerank score is NaN and comes last.
    assert sorted(r["qid"] for r in found) == [1, 1, 2, 2]


def test_null_vectors_of_either_side_and_empty_tables(spark):
    some = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id long, embedding array<double>")
    asked = some.withColumnRenamed("id", "qid")
    assert _rows(knn.dense_knn(asked, some, k=3, dim=2), "id") == [(1, 1, 1)]
    assert knn.dense_knn(asked, some.limit(0), k=3, dim=2).count() == 0
    assert knn.dense_knn(asked.limit(0), some, k=3, dim=2).count() == 0


def test_no_job_runs_when_the_plan_is_built(spark):
    p, q, pdf, qdf = _tables(spark, n=20, nq=4, dim=32)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("knn-plan", "plan only")
    try:
        knn.dense_knn(qdf, pdf, k=3, dim=32)
        knn.binary_retrieve(qdf, pdf.select("id", V.sign_code("embedding").alias("code")), k=3, binary_k=5, dim=32)
        assert list(tracker.getJobIdsForGroup("knn-plan")) == []
    finally:
        spark.sparkContext._jsc.clearJobGroup()
