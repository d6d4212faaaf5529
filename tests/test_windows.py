"""Reader windows: cover the passage, own every token once, keep H19 for short passages; jobs read whole passages."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import spans as S
from quarry.operators import reader as RD
from quarry.plans import reading as RG

WINDOWS = "i int, q array<string>, p array<string>"


def _windows(spark, rows, length, overlap):
    df = spark.createDataFrame(rows, WINDOWS)
    got = df.select("i", F.explode(S.reader_windows("q", "p", length, overlap)).alias("w")).select("i", "w.*").collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.i, r.win)):
        out.setdefault(r.i, []).append(r)
    return out


@pytest.mark.parametrize("length,overlap", [(12, 0), (12, 3), (20, 9), (350, 9), (7, 50)])
def test_windows_join_back_to_the_passage(spark, length, overlap):
    rng = random.Random(length + overlap)
    rows = [(i, [f"q{j}" for j in range(rng.randint(0, 3))], [f"t{j}" for j in range(n)])
            for i, n in enumerate([0, 1, 5, 8, 9, 10, 17, 40, 133, 900])]
    got = _windows(spark, rows, length, overlap)
    for i, q, p in rows:
        room = length - len(q) - 3
        joined = []
        for w in got[i]:
            assert w.tokens[:len(q) + 2] == ["[CLS]", *q, "[SEP]"]
            part = w.tokens[len(q) + 2:]
            part = part[:part.index("[SEP]")]
            assert part == p[w.offset:w.offset + room] and len(w.tokens) == length
            own = w.tokens[max(w.first, len(q) + 2):w.stop]
            joined += [t for t in own if t not in ("[SEP]", "[PAD]")]
        assert joined == p
        assert (len(got[i]) == 1) == (len(p) <= room)


def test_every_short_span_lies_whole_in_the_window_that_owns_its_start(spark):
    p = [f"t{j}" for j in range(200)]
    got = _windows(spark, [(0, ["q"], p)], 24, 4)[0]
    for size in range(1, 6):
        for at in range(len(p) - size + 1):
            owner = [w for w in got if max(w.first, 3) <= at - w.offset + 3 < w.stop]
            assert len(owner) == 1
            assert owner[0].tokens[at - owner[0].offset + 3:][:size] == p[at:at + size]


def test_short_passage_has_the_input_of_h19(spark):
    got = _windows(spark, [(0, ["q"], ["a", "[SEP]", "b"])], 12, 3)[0]
    df = spark.createDataFrame([(["q"], ["a"], ["b"])], "q array<string>, t array<string>, x array<string>")
    assert [got[0].tokens] == [r[0] for r in df.select(S.reader_input("q", "t", "x", 12)).collect()]


def test_a_question_without_room_has_one_empty_window(spark):
    got = _windows(spark, [(0, [f"q{j}" for j in range(30)], ["a", "b"])], 12, 3)[0]
    assert len(got) == 1 and got[0].tokens[-2:] == ["[SEP]", "[SEP]"]


CTX = RD.CTX_TYPE


def _example(spark, text, answers=("needle x",), has=True):
    return spark.createDataFrame([(1, "what?", list(answers), [(5, "title", text, "d", 1.0, has), (6, "other", "nothing here", "d", 0.5, False)])],
                                 f"qid long, question string, answers array<string>, ctxs array<{CTX}>")


def test_an_answer_far_behind_the_first_input_is_found(spark):
    text = " ".join(f"w{i}" for i in range(3000)) + " needle x tail"
    loaded = RD.ctx_slots(_example(spark, text), max_load_passages=None, max_input_length=350)
    rows = loaded.where("idx = 0").collect()
    assert len(rows) > 8 and sum(bool(r.spans) for r in rows) >= 1
    lists = RD.positive_negative_lists(loaded).collect()[0]
    assert (lists.positive_idxs, lists.negative_idxs) == ([0], [1])


def test_answers_longer_than_the_answer_limit_are_not_cut(spark):
    answer = " ".join(f"a{i}" for i in range(40))
    text = " ".join(["w"] * 330) + " " + answer + " " + " ".join(["z"] * 400)
    loaded = RD.ctx_slots(_example(spark, text, answers=[answer]), max_load_passages=None, max_input_length=350, max_answer_length=10)
    assert any(r.spans for r in loaded.where("idx = 0").collect())


def test_answer_questions_reads_the_end_of_long_passages(spark):
    """A reader that only likes the token `treasure` finds it behind thousands of tokens, with its place in the passage."""
    passages = spark.createDataFrame([(1, "t one", " ".join(["word"] * 2000) + " treasure end", "d"), (2, "t two", "word", "d")],
                                     "id long, title string, text string, dataset string")

    def reader(pid, tokens, q_tokens):
        mark = F.transform(tokens, lambda t: F.when(t == "treasure", 9.0).otherwise(0.0))
        return F.struct(F.array_max(mark).alias("classifier_logit"), mark.alias("start_logits"), mark.alias("end_logits"))

    questions = spark.createDataFrame([(7, "word?")], "qid long, question string")
    best = RG.answer_questions(questions, passages, num_retrieval_passages=2, reader=reader).collect()
    assert [(r.answer_text, r.passage_start) for r in best if r["rank"] == 1] == [("treasure", 2 + 1 + 2000)]


@pytest.mark.parametrize("n", [1, 2, 5, 400])
def test_top_spans_equal_the_sorted_list(spark, n):
    rng = random.Random(n)
    rows = [(i, [float(rng.randint(0, 4)) for _ in range(size)], [float(rng.randint(0, 4)) for _ in range(size)])
            for i, size in enumerate([0, 1, 3, 17, 60])]
    df = spark.createDataFrame(rows, "i int, s array<double>, e array<double>")
    for first, stop in ((0, None), (2, F.lit(11))):
        a = S.top_spans("s", "e", 5, n, first, stop)
        b = F.slice(S.all_spans("s", "e", 5, first, stop), 1, n)
        assert df.where(~a.eqNullSafe(b)).count() == 0
