"""The splitting tree, the pieces it hands out, and the mixed texts."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import mixing
from quarry.llm.queries import ORACLE_SQL

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, bucket int, draw string, shard int, carried string, row string, p string"


@pytest.mark.parametrize("shards", [1, 2, 7, 64])
def test_tree_has_exact_margins(spark, shards):
    counts = [(0, 1000), (1, 37), (2, 0), (3, 1), (4, 250)]
    leaves = mixing.splitting_tree(spark.createDataFrame(counts, "pos long, n_blocks long"), shards, 5).collect()
    per_source, per_shard = Counter(), Counter()
    for r in leaves:
        assert r.n_blocks >= 0
        per_source[r.pos] += r.n_blocks
        per_shard[r.shard] += r.n_blocks
    assert [per_source[p] for p, _ in counts] == [n for _, n in counts]
    assert len(per_shard) == shards and max(per_shard.values()) - min(per_shard.values()) <= math.ceil(math.log2(shards)) if shards > 1 else True
    again = mixing.splitting_tree(spark.createDataFrame(counts, "pos long, n_blocks long"), shards, 5).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, leaves))
    if shards > 1:
        other = mixing.splitting_tree(spark.createDataFrame(counts, "pos long, n_blocks long"), shards, 6).collect()
        assert sorted(map(tuple, other)) != sorted(map(tuple, leaves))


def test_draws_follow_the_hypergeometric_distribution(spark):
    """How many of 6 blocks of the first source (of 16 in all) go left of two shards, over 3000 seeds."""
    expr = mixing._hypergeometric("total", "good", "drawn", mixing._uniform("CAST(seed AS STRING)"))
    df = spark.range(3000).select(F.col("id").alias("seed"), F.lit(16).cast("long").alias("total"), F.lit(6).cast("long").alias("good"),
                                  F.lit(8).cast("long").alias("drawn"))
    found = Counter(r[0] for r in df.select(F.expr(expr)).collect())
    chi2 = 0.0
    for x in range(7):
        want = 3000 * math.comb(6, x) * math.comb(10, 8 - x) / math.comb(16, 8)
        chi2 += (found[x] - want) ** 2 / want
    assert set(found) <= set(range(7)) and chi2 < 22.5  # 6 degrees of freedom, p of 0.001


def test_pieces_follow_the_tree_and_are_disjoint(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shards, block = 5, 64
    mixed = mixing.mix_documents(docs, shards=shards, block_words=block)
    rows = mixed.collect()
    quota = {r.source: min(math.floor(r.target + 0.5), 2 * r.source_size) for r in rows}
    taken, words = Counter(), defaultdict(Counter)
    for r in rows:
        seen = set()
        for p in r.pieces:
            taken[r.source] += p.n_words
            words[p.shard][r.source] += p.n_words
            own = {(p.epoch, w) for w in range(p.start, p.start + p.n_words)}
            assert not own & seen and p.start + p.n_words <= r["size"]
            seen |= own
    assert taken == quota
    sizes = {r.source: r.source_size for r in rows}
    order = sorted(sizes, key=lambda s: (s is None, s))
    blocks = spark.createDataFrame([(i, math.ceil(quota[s] / block)) for i, s in enumerate(order)], "pos long, n_blocks long")
    for leaf in mixing.splitting_tree(blocks, shards, 17).collect():
        assert 0 <= leaf.n_blocks * block - words[leaf.shard][order[leaf.pos]] < block  # the last block ends at the quota
    other = mixing.mix_documents(docs, shards=shards, block_words=block, seed=18).collect()
    assert sorted((r.doc_id, str(r.pieces)) for r in rows) != sorted((r.doc_id, str(r.pieces)) for r in other)


def test_pieces_end_to_end_are_the_text(spark):
    texts = ["", " \n", "a", "  a b\tc \n d  ", "one two three four five six\n", "\u3000x y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("n", mixing.n_words(F.col("t")))
    for cut in (0, 1, 2, 3):
        first = mixing.piece_text(F.col("t"), F.col("n"), F.lit(0).cast("long"), F.least(F.lit(cut).cast("long"), "n"))
        rest = mixing.piece_text(F.col("t"), F.col("n"), F.least(F.lit(cut).cast("long"), "n"), F.greatest(F.lit(0).cast("long"), F.col("n") - cut))
        for r in df.select("t", "n", first.alias("a"), rest.alias("b")).collect():
            if 0 < cut < r.n:
                assert r.a + r.b == r.t and len(WORD.findall(r.a)) == cut


def test_pipeline_stage_takes_the_words_of_the_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.mix(spark, docs, SF)
    assert out.columns == docs.columns
    got = Counter()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {d: t for d, t in con.sql(f"SELECT doc_id, taken FROM ({ORACLE_SQL['op2_mix_sources']})").fetchall() if t}
    assert {d: n for d, n in got.items() if n} == want


def test_odd_rows_keep_their_columns(spark):
    long = "  " + " ".join(f"w{i % 977}" for i in range(30000)) + "\n"
    rows = [(1, "a b c d e", "s"), (1, "a b c d e", "s"), (1, "other text", "s"), (2, None, None), (3, "", "s"), (4, " \n\t", None), (None, "x y", None),
            (None, "z", "s"), (5, long, "t")]
    docs = spark.createDataFrame([(i, t, None, s, None, 1, 2, "d", 3, "c", "r", "p") for i, t, s in rows], SCHEMA)
    out = mixing.mixture(docs, shards=4, block_words=16).select("row.*")
    assert out.columns == docs.columns
    found = out.collect()
    assert {(r.doc_id, r.source) for r in found} <= {(i, s) for i, _, s in rows} and all(r.draw == "d" for r in found)
    plan = {(r.doc_id, r.source, r["size"]): r for r in mixing.mix_documents(docs, shards=4, block_words=16).collect()}
    want = Counter()
    for (i, s, _), r in plan.items():
        want[i, s] += sum(p.n_words for p in r.pieces) * sum(1 for x in rows if (x[0], x[2]) == (i, s) and len(WORD.findall(x[1] or "")) == r["size"])
    got = Counter()
    for r in found:
        got[r.doc_id, r.source] += len(WORD.findall(r.text or ""))
    assert sum(got.values()) == sum(sum(p.n_words for p in r.pieces) for r in mixing.mix_documents(docs, shards=4, block_words=16).collect())
    assert mixing.mixture(docs.limit(0)).count() == 0
