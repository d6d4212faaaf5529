"""Byte shards against a plain walk over the sorted table."""

import zlib

import duckdb
import pytest

from quarry.llm import rules, sharding
from quarry.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, run int, shard int, place long, bucket int, carried string, row_bytes long"


def plain(rows, shards):
    """(doc_id, size, crc, shard, slot): the shard of a document's middle byte on the line of all bytes."""
    sized = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    total, at, slots, out = sum(r[1] for r in sized), 0, {}, []
    for i, size, crc in sized:
        shard = min((2 * at + size) * shards // (2 * total), shards - 1)
        out.append((i, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        at += size
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_on_the_whole_table(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    found = QUERIES["op3_byte_shards"](spark, sf).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in found) == sorted(plain(rows, 24))
    assert {(r.law, r.grown_shard) for r in found} == {("bytes", None)}
    by_shard = {}
    for r in found:
        by_shard.setdefault(r.shard, []).append(r)
    assert all(sorted(x.slot for x in rs) == list(range(len(rs))) for rs in by_shard.values())


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_odd_rows(spark, shards):
    rows = [(1, "a b"), (1, "a b"), (1, "a c"), (2, None), (3, ""), (None, "x"), (None, None), (4, "\u00e9\U0001f600"), (5, "long " * 5000), (6, " \n")]
    table = spark.createDataFrame([(*r, 1, 2, 3, 4, "c", 5) for r in rows], SCHEMA)
    found = sharding.shard_documents(table, shards).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in found), key=str) == sorted(plain(rows, shards), key=str)
    assert sharding.shard_documents(table.limit(0), shards).count() == 0


def test_written_shards_are_in_slot_order(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 5)) for i in range(60)]
    sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "s"), shards=4)
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in back) == sorted((i, s, n) for i, _, _, s, n in plain(rows, 4))
    assert {r.doc_id: r.text for r in back} == dict(rows)


def test_labelled_rows_are_bounded_by_rows(spark):
    """One labelled id on many different rows brings no more than the bound to the driver."""
    docs = spark.createDataFrame([(7, " ".join(f"w{(i * j) % 101}" for j in range(80))) for i in range(300)] + [(i, "one two three " * 30) for i in range(50, 60)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] + [(i, 0) for i in range(50, 60)], "doc_id long, quality int")
    seen = []
    learn, rules.learn = rules.learn, lambda columns, bad: seen.append(len(bad)) or []
    try:
        rules.learn_rules(docs, labels, max_labelled=10)
    finally:
        rules.learn = learn
    assert all(n <= 10 for n in seen)
    assert rules.learn_rules(docs, labels.limit(0)) == []
