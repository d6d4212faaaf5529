import math

import numpy as np

from quarry.functions import vectors as V
from quarry.operators.knn import sign_matrix, unpack_sign_matrix


def test_binarize_zero_negzero_nan_are_one(spark):
    df = spark.createDataFrame([([0.0, -0.0, float("nan"), -1.5, 2.0, -1e-30, 1e-30, 0.0],)], "v array<float>")
    bits = df.select(V.binarize("v").alias("b")).first()["b"]
    assert bits == [1, 1, 1, 0, 1, 0, 1, 1]


def test_pack_unpack_roundtrip_partial_word(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(40).astype(float).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    out = df.select("id", "v", V.sign_code("v").alias("c")).withColumn("u", V.unpack_signs("c", 40)) \
        .withColumn("pm", V.plus_minus_one("v")).collect()
    for r in out:
        assert len(r["c"]) == 2
        assert r["u"] == r["pm"]
        # numpy twin of the unpacking agrees
        m = unpack_sign_matrix(np.array([r["c"]], dtype=np.int64), 40)[0]
        assert m.tolist() == r["pm"]
        assert sign_matrix(np.array([r["v"]]))[0].tolist() == r["pm"]


def test_pack_is_msb_first(spark):
    bits = [1] + [0] * 31 + [0] * 31 + [1]
    df = spark.createDataFrame([(bits,)], "b array<int>")
    assert df.select(V.pack_bits("b").alias("c")).first()["c"] == [2 ** 31, 1]


def test_hamming_and_inner_product(spark):
    a, b = [5, 0], [3, 2 ** 32 - 1]
    df = spark.createDataFrame([(a, b, [1.0, 2.0, 3.0], [4.0, -5.0, 6.0])],
                               "a array<long>, b array<long>, x array<double>, y array<double>")
    r = df.select(V.hamming("a", "b").alias("h"), V.inner_product("x", "y").alias("ip")).first()
    assert r["h"] == 2 + 32
    assert math.isclose(r["ip"], 4 - 10 + 18)


def test_code_words_validates_dim():
    assert V.code_words(64) == 2
    assert V.code_words(40) == 2
    for bad in (0, 12, -8):
        try:
            V.code_words(bad)
        except ValueError:
            continue
        raise AssertionError(f"dim {bad} accepted")
