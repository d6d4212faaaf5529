from pyspark.sql import functions as F

from quarry.functions import spans as S


def _row(spark, schema, values, col):
    return spark.createDataFrame([values], schema).select(col.alias("r")).first()["r"]


def test_sublist_positions(spark):
    sch = "s array<string>, l array<string>"
    assert _row(spark, sch, (["b", "c"], ["a", "b", "c", "b", "c"]), S.sublist_positions("s", "l")) == [1, 3]
    assert _row(spark, sch, (["b", "c"], ["a", "b", "c", "b", "c"]), S.sublist_positions("s", "l", 2)) == [3]
    # empty needle: a slice at every position
    assert _row(spark, sch, ([], ["a", "b"]), S.sublist_positions("s", "l")) == [0, 1, 2]
    # needle longer than the haystack: nothing (and no counting down)
    assert _row(spark, sch, (["a", "b", "c"], ["a"]), S.sublist_positions("s", "l")) == []


def test_reader_input_truncates_passage_only(spark):
    sch = "q array<string>, t array<string>, x array<string>"
    toks = _row(spark, sch, (["q1"], ["t"], [f"x{i}" for i in range(10)]), S.reader_input("q", "t", "x", 8))
    assert toks == ["[CLS]", "q1", "[SEP]", "t", "[SEP]", "x0", "x1", "[SEP]"]
    padded = _row(spark, sch, (["q1"], ["t"], ["x0"]), S.reader_input("q", "t", "x", 9))
    assert padded == ["[CLS]", "q1", "[SEP]", "t", "[SEP]", "x0", "[SEP]", "[PAD]", "[PAD]"]


def test_answer_spans_from_first_separator(spark):
    sch = "tok array<string>, a array<array<string>>"
    vals = (["[CLS]", "a", "[SEP]", "b", "a", "[SEP]"], [["a"], [], ["b", "a"]])
    got = _row(spark, sch, vals, S.answer_spans("tok", "a"))
    assert [(r["start"], r["end"]) for r in got] == [(4, 4), (3, 4)]
    got = _row(spark, sch, vals, S.answer_spans("tok", "a", from_start=True))
    assert [(r["start"], r["end"]) for r in got] == [(1, 1), (4, 4), (3, 4)]


def test_pad_spans(spark):
    sch = "sp array<struct<start:int,end:int>>"
    r = _row(spark, sch, ([(3, 4), (5, 5), (6, 7)],), S.pad_spans("sp", 2))
    assert (r["starts"], r["ends"], r["mask"]) == ([3, 5], [4, 5], [1, 1])
    r = _row(spark, sch, ([(3, 4)],), S.pad_spans("sp", 3))
    assert (r["starts"], r["ends"], r["mask"]) == ([3, 0, 0], [4, 0, 0], [1, 0, 0])


def test_best_spans_ties_and_nesting(spark):
    sch = "tok array<string>, st array<double>, en array<double>"
    tok = ["a", "b", "c", "d"]
    st = [1.0, 5.0, 5.0, 0.0]
    en = [0.0, 5.0, 5.0, 1.0]
    # scores: (1,1)=10 (1,2)=10 (2,2)=10 ... ties keep (start, end) order
    spans = _row(spark, sch, (tok, st, en), S.best_spans("tok", "st", "en", num_spans=3, max_answer_length=3))
    assert [(s["start"], s["end"]) for s in spans] == [(1, 1), (1, 2), (2, 2)]
    # overlap off: (1,2) contains (1,1) and (2,2) is inside (1,2) -> skipped
    spans = _row(spark, sch, (tok, st, en), S.best_spans("tok", "st", "en", num_spans=3, max_answer_length=3,
                                                          allow_overlap=False))
    assert [(s["start"], s["end"]) for s in spans][:2] == [(1, 1), (2, 2)]


def test_best_span_grows_over_subwords_keeping_edge_logits(spark):
    sch = "tok array<string>, st array<double>, en array<double>"
    tok = ["[CLS]", "un", "##believ", "##able", "[SEP]"]
    st = [0.0, 0.0, 9.0, 0.0, 0.0]
    en = [0.0, 0.0, 9.0, 0.0, 0.0]
    sp = _row(spark, sch, (tok, st, en), S.best_spans("tok", "st", "en", num_spans=1))[0]
    assert (sp["start"], sp["end"], sp["start_logit"], sp["end_logit"]) == (1, 3, 9.0, 9.0)


def test_answer_texts_and_highlight(spark):
    sch = "tok array<string>"
    tok = ["[CLS]", "the", "big", "##gest", "dog", "[SEP]", "[PAD]"]
    r = _row(spark, sch, (tok,), S.answer_texts("tok", F.lit(2), F.lit(3)))
    assert r["input_text"] == "[CLS] the biggest dog [SEP] [PAD]"
    assert (r["answer_text"], r["answer_start"], r["answer_end"]) == ("biggest", 10, 17)
    h = spark.createDataFrame([(r["input_text"], r["answer_text"], r["answer_start"], r["answer_end"])],
                              "i string, a string, s int, e int").select(S.highlight("i", "a", "s", "e")).first()[0]
    assert h == "`[CLS]` the **biggest** dog `[SEP]`"
