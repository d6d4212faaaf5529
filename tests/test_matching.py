"""Corpus answer search by positional postings, against a scan of every passage."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import matching as MT


def _contains(tokens, answer):
    return any(tokens[i:i + len(answer)] == answer for i in range(len(tokens) - len(answer) + 1))


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_occurrences_equal_a_scan(spark, broadcast):
    rng = random.Random(8)
    words = ["a", "a", "a", "b", "c", "d", "rare"]
    passages = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(60)] + [(100, None), (101, ""), (102, "A, b! C")]
    answers = [(j, " ".join(rng.choices(words + ["absent"], k=rng.randint(1, 4)))) for j in range(40)] + [(90, ""), (91, "  "), (92, "a a a"), (93, "A b")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = MT.answer_occurrences(spark.createDataFrame(answers, "aid long, answer string"), spark.createDataFrame(passages, "id long, text string"))
        got = sorted(((r.aid, r.id) for r in got.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    split = {i: (t or "").lower().replace(",", " ,").replace("!", " !").split() for i, t in passages}
    want = [(j, i) for j, a in answers if a.split() for i, toks in split.items() if _contains(toks, a.lower().split())]
    assert got == sorted(want + [(90, None), (91, None)], key=str)


def test_struct_keys_empty_tables_and_nothing_persisted(spark):
    answers = spark.createDataFrame([(1, 12, "x y"), (11, 2, "x y")], "qid long, idx int, answer string").select(F.struct("qid", "idx").alias("aid"), "answer")
    passages = spark.createDataFrame([(5, "w x y z")], "id long, text string")
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    got = MT.answer_occurrences(answers, passages).select("aid.qid", "aid.idx", "id").collect()
    assert sorted(map(tuple, got)) == [(1, 12, 5), (11, 2, 5)]
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before
    assert MT.answer_occurrences(answers, passages.limit(0)).count() == 0
    assert MT.answer_occurrences(answers.limit(0), passages).count() == 0


def test_postings_are_cut_before_any_shuffle(spark):
    passages = spark.range(1000).select("id", F.lit("some words here").alias("text"))
    tokens = spark.createDataFrame([("words",)], "tok string")
    plan = MT.postings(passages, F.broadcast(tokens))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_pair_postings_hold_the_answers_pairs_only(spark):
    """Of common words only the places where some answer's pair stands are kept, and the texts' tokens are made once."""
    passages = spark.createDataFrame([(i, "the of and " * 50 + "the end.") for i in range(20)] + [(30, "the"), (31, None)], "id long, text string")
    pairs = spark.createDataFrame([("the", "end"), ("end", ".")], "tok string, nxt string")
    places = MT.pair_postings(passages, pairs)
    assert sorted(map(tuple, places.collect())) == sorted([("the", "end", i, 150) for i in range(20)] + [("end", ".", i, 151) for i in range(20)])
    plan = MT.pair_postings(passages, F.broadcast(pairs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "SortMergeJoin" not in plan
    both = spark.createDataFrame([("the", ""), ("the", "end")], "tok string, nxt string")
    got = MT.pair_postings(passages.where("id in (0, 30)"), both).collect()
    assert sorted((r.id, r.pos) for r in got if r.nxt == "") == [(0, 3 * i) for i in range(51)] + [(30, 0)]
    assert [(r.id, r.pos) for r in got if r.nxt == "end"] == [(0, 150)]


def test_two_and_more_tokens_against_a_scan(spark):
    rng = random.Random(3)
    passages = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 30)))) for i in range(80)]
    answers = [(j, " ".join(rng.choices("abc", k=1 + j % 6))) for j in range(60)] + [(70, "a a"), (71, "a a a a")]
    got = MT.answer_occurrences(spark.createDataFrame(answers, "aid long, answer string"), spark.createDataFrame(passages, "id long, text string"))
    want = [(j, i) for j, a in answers for i, t in passages if _contains(t.split(), a.split())]
    assert sorted(map(tuple, got.collect())) == sorted(want)
