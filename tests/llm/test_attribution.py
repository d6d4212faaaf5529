"""Attribution by pre-tokens against encoding whole documents."""

import random

import numpy as np
import pytest

from quarry.llm import attribution as A
from quarry.llm.common import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, field string, line long, start long, n_tokens long"


def plain(rows, path, fields, by_line, rule):
    """Whole strings, their offsets, and the rule spelt out token by token."""
    encode, out = A._encoder(path), []
    for doc_id, values in rows:
        text, where, bounds = A.sections(values, by_line)
        spans = encode.encode(text, add_special_tokens=False).offsets
        counts = [0] * len(where)
        for a, b in spans:
            shares = [min(b, bounds[i + 1]) - max(a, bounds[i]) for i in range(len(where))]
            holds = next(i for i in range(len(where)) if bounds[i] <= a < bounds[i + 1])
            counts[holds if rule == "first" or max(shares) <= 0 else int(np.argmax(shares))] += 1
        out += [(doc_id, fields[f], j, int(bounds[i]), int(bounds[i + 1] - bounds[i]), counts[i], len(spans)) for i, (f, j) in enumerate(where)]
    return out


TEXTS = ["", None, " \n\n\n  x\n\n", "It's 12 o'clock,  she'll\tgo\n\n\n--\n caf\u00e9 \u65e5\u672c\u8a9e\u3000\U0001f600\n \n", "<|endoftext|> a\r\nb\x1c\x85c\n\u2028\n", "a" * 300 + "\n" * 40 + "b"]


@pytest.mark.parametrize("rule", A.RULES)
@pytest.mark.parametrize("by_line", [True, False])
@pytest.mark.parametrize("remembered,chars", [(1_500_000, 4 << 20), (30, 50)])
def test_counts_equal_whole_encoding(spark, rule, by_line, remembered, chars):
    rng = random.Random(2)
    rows = [(i, t, "en", None) for i, t in enumerate(TEXTS)] + [(1, TEXTS[3], "en", None), (None, "x y", None, "s")]
    rows += [(100 + i, "".join(rng.choices(["a", "b ", "\n", " ", "\n\n", "'s", "1", ",", "\u00e9", "\t"], k=60)), "l\n", "s") for i in range(40)]
    table = spark.createDataFrame([(*r, "f", 1, 2, 3) for r in rows], SCHEMA)
    path = tokenizer("byte_bpe_50k.json")
    counter = A.Counter(path)
    assert counter.by_pre_token
    before = A.REMEMBERED
    A.REMEMBERED = remembered
    try:  # in this process, where the constant holds
        texts = [A.sections((s, lang, t), by_line) for _, t, lang, s in rows]
        found = [c for i in range(0, len(texts), 7) for c in counter.section_tokens([x[0] for x in texts[i:i + 7]], [x[2] for x in texts[i:i + 7]], rule)]
    finally:
        A.REMEMBERED = before
    want = plain([(i, (s, lang, t)) for i, t, lang, s in rows], path, ("source", "lang", "text"), by_line, rule)
    assert np.concatenate(found).tolist() == [w[5] for w in want]
    got = [tuple(r) for r in A.token_counts(table, path, by_line=by_line, rule=rule).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_another_tokenizer_encodes_whole_texts(spark):
    path = tokenizer("word_bpe_49k.json")
    assert not A.Counter(path).by_pre_token
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)]
    table = spark.createDataFrame([(*r, "f", 1, 2, 3) for r in rows], SCHEMA)
    got = A.token_counts(table, path, by_line=True).collect()
    assert all(sum(r["n_tokens"] for r in got if r["doc_id"] == i) == next(r["doc_tokens"] for r in got if r["doc_id"] == i) for i, *_ in rows)


def test_empty_table(spark):
    assert A.token_counts(spark.createDataFrame([], SCHEMA), tokenizer("byte_bpe_50k.json")).count() == 0
