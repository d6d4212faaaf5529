"""Token files: round trips, random access, the grammar itself, and the whole table against whole-text encoding."""

import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import token_files as T
from quarry.llm.common import tokenizer
from quarry.llm.queries import QUERIES

WORDS = tokenizer("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, run int, block int, docs string, hash string, nth int, ids string, its_run int"


def expanded(symbol, base, rules):
    """The ids of one symbol, by recursion."""
    if symbol < base:
        return [symbol]
    return [i for s in rules[symbol - base] for i in expanded(int(s), base, rules)]


def check_block(ids):
    ids = np.array(ids, np.uint32)
    base, rules, spans, symbols = T.compress(ids)
    assert T.expand(symbols, base, rules, spans).tolist() == ids.tolist()
    assert all(int(s) < base + i for i, pair in enumerate(rules) for s in pair)  # a rule uses what was made before it
    assert [len(expanded(base + i, base, rules)) for i in range(len(rules))] == spans.tolist()
    return base, rules, spans, symbols


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=400), st.sampled_from([2, 3, 8]), st.data())
def test_round_trip_and_ranges(ids, least, data):
    before, T.LEAST = T.LEAST, least
    try:
        block = check_block(ids)
    finally:
        T.LEAST = before
    start = data.draw(st.integers(0, len(ids)))
    stop = data.draw(st.integers(start, len(ids)))
    assert T.decode_range(*block, start, stop).tolist() == ids[start:stop]


def test_frequent_pairs_are_replaced():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 40000, 12)
    ids = np.concatenate([np.concatenate([phrase, rng.integers(0, 40000, 3)]) for _ in range(3000)])
    base, rules, spans, symbols = check_block(ids)
    assert spans.max() >= 12 and len(symbols) < 0.35 * len(ids)
    pairs = np.unique(np.stack([symbols[:-1], symbols[1:]], 1), axis=0, return_counts=True)[1]
    assert pairs.max() < T.LEAST  # nothing frequent is left
    run = check_block([7] * 100_000)
    assert len(run[3]) < 100 and len(run[1]) < 20


@pytest.mark.parametrize("width", [2, 3, 4])
def test_numbers(width):
    numbers = np.array([0, 1, (1 << 8 * width) - 1, 12345], np.uint32)
    assert T.unpack_numbers(T.pack_numbers(numbers, width), width).tolist() == numbers.tolist()


def plain(rows):
    """(doc_id, start, n_tokens, ids_crc32) by whole-text encoding; rows of one id in any order, so their places aren't compared."""
    t, at, out = Tokenizer.from_file(WORDS), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [T.END_ID], dtype="<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_on_the_whole_table(spark, sf):
    found = QUERIES["op11_token_files"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, found)) == plain(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())


def test_odd_rows_small_blocks_and_random_access(spark, tmp_path):
    rows = [(1, "a b c"), (1, "a b c"), (1, "other words"), (None, None), (None, "x"), (2, ""), (3, " \n\t"), (-5, "first <|endoftext|> x"),
            (9, "long text, " * 60000)] + [(i, f"Document {i} says the same thing again.") for i in range(20, 400)]
    table = spark.createDataFrame([(*r, 1, 2, "d", "h", 3, "i", 4) for r in rows], SCHEMA)
    path = str(tmp_path / "ids")
    T.write_blocks(table, path, WORDS, block_ids=200)
    blocks = spark.read.parquet(path)
    assert blocks.count() > 10
    found = T.read_ids(spark, path, with_ids=True).collect()
    want = plain(rows)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=str) == sorted(((d, n, c) for d, _, n, c in want), key=str)
    places = sorted((r.start, r.n_tokens) for r in found)
    assert [s for s, _ in places] == np.cumsum([0] + [n for _, n in places])[:-1].tolist()
    by_place = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert by_place == sorted(by_place, key=lambda d: (d is not None, d or 0))
    ids = {r.start: r.ids for r in found}
    wanted = spark.createDataFrame([(1,), (9,), (33,), (34,), (399,), (1000,)], "doc_id long")
    some = T.read_documents(spark, path, wanted).collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in some) == sorted((r.doc_id, bytes(ids[r.start])) for r in found if r.doc_id in (1, 9, 33, 34, 399))


def test_empty_table(spark, tmp_path):
    T.write_blocks(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), WORDS)
    assert T.read_ids(spark, str(tmp_path / "none")).count() == 0
