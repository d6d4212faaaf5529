"""Ids by parts against the tokenizer on whole texts, and the items of the packing."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarry.llm import encoding, packing
from quarry.llm.common import tokenizer
from quarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = ["", " \n\t", "a", "<|endoftext|> x<|startoftext|>y", "<|STARTOFTEXT|> Up", "I'M sure it's O'Neil's", "café CAFÉ Straße İstanbul ΣΑΣ",
       "a b c​d", "x\x01y \x01 z", "日本語のテキスト 12345", "w" * 5000, "́ ́x", "A\x0bB\x0cC\x1cD\x85E", "😀👍🏽 ok"]


def whole(path, texts):
    t = Tokenizer.from_file(path)
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def split(ids, sizes):
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("remembered", [1_000_000, 40, 3])
def test_parts_give_the_ids_of_whole_texts(name, remembered, monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED", remembered)
    random.seed(5)
    texts = ODD + [r[0] or "" for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall()]
    texts += ["".join(random.choices("ab'S tßΣİ.,!\n\x01́<|>", k=40)) for _ in range(300)]
    encode = encoding.Encoder(tokenizer(name))
    for at in range(0, len(texts), 50):
        assert split(*encode.encode(pa.array(texts[at:at + 50]))) == whole(tokenizer(name), texts[at:at + 50])


def test_slices_cover_every_row(monkeypatch):
    monkeypatch.setattr(encoding, "SLICE_BYTES", 10)
    rows = pa.array(["aaaa", None, "b" * 50, "", "cc", "dddddddd", "e" * 11])
    got = [(at, s.to_pylist()) for at, s in encoding.slices(rows)]
    assert [x for _, s in got for x in s] == [x or "" for x in rows.to_pylist()]
    assert [at for at, _ in got] == np.cumsum([0] + [len(s) for _, s in got])[:-1].tolist()


def test_pack_items_against_whole_encoding(spark):
    docs = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall()
    want = {}
    for (doc_id, _), ids in zip(docs, whole(tokenizer("word_bpe_49k.json"), [t for _, t in docs]), strict=True):
        ids = np.array(ids + [packing.END_ID], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[start:start + packing.CAPACITY]
            want[doc_id, piece] = (start, len(part), zlib.crc32(part.tobytes()))
    rows = QUERIES["op9_pack"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    least = -(-sum(n for _, n, _ in want.values()) // packing.CAPACITY)
    assert len(by_sequence) <= least + 1
