"""What the question stream's time grows with: the search of codes, the reading of hits, the encoder."""

import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quarry.functions import inference as INF
from quarry.functions import spans as S
from quarry.functions import vectors as V
from quarry.functions.text import TOKEN_PATTERN
from quarry.operators import knn
from quarry.plans.reading import hits_by_passage


def _words(bits):
    """+-1 rows -> 32-bit words as `vectors.pack_bits` has them."""
    out = []
    for row in bits > 0:
        out.append([int("".join("1" if b else "0" for b in row[i:i + 32]), 2) for i in range(0, len(row), 32)])
    return np.array(out, dtype=np.int64)


@pytest.mark.parametrize("dim, n", [(8, 3000), (40, 3000), (64, 5000), (72, 700), (264, 300), (64, 3)])
def test_binary_tile_equals_brute_force(monkeypatch, dim, n):
    monkeypatch.setattr(knn, "_GATHERED_CODES", 500)
    monkeypatch.setattr(knn, "_RUN_CODES", 64)
    rng = np.random.default_rng(dim + n)
    q = rng.standard_normal((45, dim))
    signs = rng.choice([-1, 1], (n, dim))
    signs[rng.random(n) < 0.3] = signs[0]                           # many ties
    ids = rng.permutation(n * 3)[:n] - n
    tile = knn._BinaryTile(np.arange(45) + 100, q, 7, dim, True)
    words = _words(signs)
    for at in range(0, n, 130):
        tile.batch(ids[at:at + 130], words[at:at + 130])
    got = {}
    for qid, i, d, score in (r for part in tile.result() for r in zip(*part, strict=True)):
        got.setdefault(int(qid) - 100, []).append((int(d), int(i), score))
    for j in range(45):
        distance = (np.where(q[j] < 0, -1, 1) != signs).sum(axis=1)
        order = np.lexsort((ids, distance))[:7]
        assert [x[:2] for x in sorted(got[j])] == [(distance[o], ids[o]) for o in order]
        assert np.allclose([x[2] for x in sorted(got[j])], signs[order] @ q[j])


def test_true_cells():
    rng = np.random.default_rng(0)
    for shape, share in (((3, 50), 0.5), ((32, 1000), 0.001), ((1, 1), 1.0), ((4, 64), 0.0), ((2, 129), 1.0)):
        mask = rng.random(shape) < share
        assert np.array_equal(knn.true_cells(mask), np.flatnonzero(mask))


def test_candidates_do_not_grow_with_shuffle_partitions(spark):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, rng.standard_normal(32).tolist()) for i in range(600)], "id long, embedding array<double>")
    codes = v.select("id", F.when(F.col("id") < 590, V.sign_code("embedding")).alias("code"))
    q = v.limit(10).select(F.col("id").alias("qid"), "embedding")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    args = (2, 32, "qid", "embedding", "float", "id", "code", None, True)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        tiles = knn._tiles(q.select("qid", F.col("embedding").alias("q")), codes.select("id", F.col("code").alias("v")), 4096, pack=True)
        sides = {r["side"]: r["n"] for r in tiles.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
        held = tiles.where("side = 1").select(F.explode("v.ids").alias("id")).agg(F.count("id"), F.countDistinct("id")).first()
        assert knn._binary_partial(q, codes, *args).count() <= 10 * 2 * knn.TILES_PER_CORE * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tuple(held) == (590, 590) and sides[1] < 590              # packed, each code once, null codes left out


def test_hits_by_passage(spark):
    rows = [(q, p, q % 3 + 1, [f"w{q}"]) for p in range(4) for q in range(p * 5)] + [(1, 3, 2, ["w1"])]
    hits = spark.createDataFrame(rows, "qid long, id long, rank int, q_tokens array<string>")
    groups = hits_by_passage(hits, most=4).collect()
    assert all(1 <= len(g["hits"]) <= 4 for g in groups)
    got = sorted((h["qid"], g["id"], h["rank"], h["q_tokens"]) for g in groups for h in g["hits"])
    assert got == sorted(rows)
    assert [sum(g["id"] == p for g in groups) for p in range(4)] == [0, 2, 3, 4]


def test_spans_grow_only_over_subwords(spark):
    rows = [(["a", "b", "##c", "d"], [0.0, 1.0, 5.0, 0.0], [0.0, 0.0, 4.0, 0.0]),
            (["a", "b", "c#", "#d"], [0.0, 1.0, 5.0, 0.0], [0.0, 0.0, 4.0, 0.0]),
            (["##a", "b", "c", "d"], [5.0, 0.0, 0.0, 0.0], [5.0, 0.0, 0.0, 0.0]),
            (["a", None, "c", "d"], [0.0, 5.0, 0.0, 0.0], [0.0, 5.0, 0.0, 0.0]),
            (["a", "b"], [0.0, 0.0, 5.0], [0.0, 0.0, 5.0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t array<string>, s array<double>, e array<double>")
    best = S.best_spans("t", "s", "e")
    plain = S.best_spans("t", "s", "e", expand_subwords=False)
    got = {r["i"]: r for r in df.select("i", best.alias("b"), plain.alias("p"), S._may_grow(F.col("t"), F.col("s")).alias("m"),
                                        S.grow_start("t", plain[0]["start"]).alias("gs"), S.grow_end("t", plain[0]["end"]).alias("ge")).collect()}
    assert [got[i]["m"] for i in range(5)] == [True, False, True, True, True]
    assert [(r["b"][0]["start"], r["b"][0]["end"]) for r in got.values()] == [(r["gs"], r["ge"]) for r in got.values()]
    assert (got[0]["b"][0]["start"], got[0]["p"][0]["start"]) == (1, 2)


def test_latin_tokens_are_h2_tokens():
    import pyarrow as pa
    whole, latin, rng = regex.compile(TOKEN_PATTERN), INF._latin_pattern(TOKEN_PATTERN), random.Random(1)
    texts = ["".join(chr(rng.randrange(256)) for _ in range(40)) for _ in range(3000)]
    assert all(latin.findall(t) == whole.findall(t) for t in texts)
    assert INF._is_latin("na\u00efve \u00bd") and not INF._is_latin("e\u0301") and not INF._is_latin("\u65e5\u672c")
    mixed = pa.array(["naïve éclair", "naïve", None, "日本 語", ""])
    assert np.array_equal(INF._encode_batch(mixed, 64), np.concatenate([INF._encode_batch(mixed.slice(i, 1), 64) for i in range(5)]))
