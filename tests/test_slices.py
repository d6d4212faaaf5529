"""What a Python worker holds: slices of batches, and bounds that keep later vectors out."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.functions import inference as INF
from quarry.functions import spans as S
from quarry.functions import text as X
from quarry.functions.slices import list_slices, text_slices
from quarry.operators import knn


def _peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_slices_cover_the_batch():
    texts = pa.array(["a" * n for n in (3, 0, 9, 40, 1)] + [None, "é"])
    assert [x for part in text_slices(texts, 10) for x in part.to_pylist()] == texts.to_pylist()
    assert [len(part) for part in text_slices(texts, 10)] == [2, 1, 1, 3]
    lists = pa.array([[1] * n for n in (2, 3, 50, 1)] + [None, []])
    assert list(list_slices(lists, 6)) == [(0, 2), (2, 3), (3, 6)]
    assert list(text_slices(pa.array([], pa.string()))) == [] and list(list_slices(pa.array([], pa.list_(pa.int64())), 6)) == []


def test_encoder_holds_the_tokens_of_a_slice_only():
    texts = pa.array([" ".join(f"w{(i * 7 + j) % 997}" for j in range(3000)) for i in range(200)] + [None, ""])
    assert _peak_mb(lambda: INF._encode_batch(texts, 64)) < 40      # the tokens of all texts take some 60 MB
    whole = INF._encode_batch(texts, 64)
    assert whole.shape == (202, 64) and not whole[200:].any()
    assert np.array_equal(whole[7], INF._encode_batch(texts.slice(7, 1), 64)[0])


def test_normaliser_holds_the_strings_of_a_slice_only():
    texts = pa.array(["é" * 20_000] * 500)
    assert _peak_mb(lambda: X._NFD.func(texts)) < 30                # the decomposed strings of all texts take 40 MB
    assert X._NFD.func(pa.array(["é", None, ""])).to_pylist() == ["é", None, ""]
    assert len(X._NFD.func(pa.array([], pa.string()))) == 0


def test_copies_of_a_near_vector_are_kept_out_by_id():
    """After a first batch, neither far vectors nor equal ones with higher ids are candidates."""
    state = knn._Running(["row", "id", "distance"], ["distance", "id"], 2, 2)
    first = np.array([[1, 5, 9], [7, 7, 7]], np.float32)
    rows, cols = state.cells(first, np.array([10, 11, 12]))
    state.add(row=rows, id=np.array([10, 11, 12])[cols], distance=first[rows, cols].astype(np.int64))
    later = np.array([[5, 6, 1, 5], [7, 7, 8, 7]], np.float32)
    rows, cols = state.cells(later, np.array([30, 31, 32, 9]))
    assert sorted(zip(rows.tolist(), cols.tolist(), strict=True)) == [(0, 2), (0, 3), (1, 3)]


def test_many_small_batches_equal_one(spark):
    rng = np.random.default_rng(4)
    q, p = rng.integers(-2, 3, (9, 16)).astype(float), rng.integers(-2, 3, (400, 16)).astype(float)
    p[100:300] = p[0]
    p[5, 0] = np.nan
    ids = rng.permutation(400).astype(np.int64)

    def top(size):
        tile = knn._DenseTile(np.arange(9), q, 7, 16)
        for a in range(0, 400, size):
            tile.batch(ids[a:a + size], pa.array(list(p[a:a + size]), pa.list_(pa.float64())))
        return [np.concatenate(x).tolist() for x in zip(*tile.result(), strict=True)]

    assert top(400) == top(3) == top(50)


def test_reader_and_windows_by_the_definition(spark):
    rows = [(5, ["a", "b"], ["[CLS]", "a", "x", "b", "a"]), (40, [], ["x"]), (-1, ["x", "x"], []), (3, ["a"], None), (None, ["a"], ["a", "z"])]
    df = spark.createDataFrame(rows, "pid long, q array<string>, t array<string>")
    got = df.select(INF.lexical_reader(F.col("pid"), F.col("t"), F.col("q")).alias("r")).select("r.*").collect()
    for (pid, q, t), r in zip(rows, got, strict=True):
        if pid is None or t is None:
            assert r["classifier_logit"] is None
            continue
        assert r["classifier_logit"] == pid % 23 + len(set(q) & set(t))
        assert r["start_logits"] == [(pid * 7 + i * 13) % 17 + 5 * (x in q) for i, x in enumerate(t)]
        assert r["end_logits"] == [(pid * 11 + i * 5) % 19 + 5 * (x in q) for i, x in enumerate(t)]
    parts = spark.createDataFrame([(i, ["q"] * (i % 4), [f"t{j}" for j in range(n)]) for i, n in enumerate((0, 1, 9, 40, 41, 200))], "i long, q array<string>, p array<string>")
    whole = parts.select("i", F.explode(S.reader_windows("q", "p", 20, 4)).alias("w")).select("i", "w.*")
    assert sorted(map(tuple, S.with_windows(parts, "q", "p", 20, 4).select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_spans_are_searched_by_batch(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.0, 1.0])], "s array<double>, e array<double>")
    best = df.select(S.top_spans("s", "e", 5, 1).alias("b"))
    assert "ArrowEvalPython" in best._jdf.queryExecution().executedPlan().toString()
    assert [(x["start"], x["end"]) for x in best.first()["b"]] == [(1, 1)]
