import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X


def _one(spark, col, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("r")).first()["r"]


def test_word_tokens(spark):
    assert _one(spark, X.word_tokens("t"), t="Héllo, wörld! 42x") == ["héllo", ",", "wörld", "!", "42x"]


@pytest.mark.parametrize("answer,passage,mtype,expected", [
    ("Wörld", "Héllo, wörld!", "dpr_string", True),
    ("wor", "Héllo, wörld!", "dpr_string", False),        # whole tokens only
    ("", "anything", "dpr_string", True),                  # empty answer matches everything
    ("", "anything", "simple_nfd", True),
    ("", "anything", "none", True),
    ("cafe", "un café au lait", "simple_nfd", True),       # NFD substring sees the base letter
    ("cafe", "un café au lait", "simple_nfkc", False),
    ("cafe", "un café au lait", "none", False),
    ("Café  au", "un café au lait", "simple_nfkc", True),   # blanks collapse, case folds
    ("(", "a ( b", "dpr_regex", False),                    # bad pattern is no match
    ("^au", "x\nau", "dpr_regex", True),                   # multiline
    ("CAF.", "un café", "dpr_regex", True),                # ignore case, NFD: '.' takes the base e
])
def test_has_answer(spark, answer, passage, mtype, expected):
    assert _one(spark, X.has_answer("a", "p", mtype), a=answer, p=passage) is expected


def test_unknown_match_type_raises(spark):
    with pytest.raises(ValueError):
        X.has_answer("a", "p", "fuzzy")


def test_any_answer_on_dataframe(spark):
    df = spark.createDataFrame([(["nope", "au lait"], "un café au lait"), ([], "x"), (["zz"], "x")],
                               "answers array<string>, p string")
    for m in X.MATCH_TYPES:
        got = [r["has_answer"] for r in X.with_any_answer(df, "answers", F.col("p"), m).collect()]
        assert got == [True, False, False], m


@pytest.mark.parametrize("kind,value,expected", [
    ("dpr", "The  Eiffel-Tower!", "eiffeltower"),
    ("dpr", "à la carte", "̀ la carte"),             # NFD then article removal strips the base letter
    ("dpr", "an Apple a day", "apple day"),
    ("simple_nfd", "A  B C", "a b c"),
    ("simple_nfkc", "Ｔｏｋｙｏ　Tower", "tokyotower"),
    ("none", " Keep  As Is ", " Keep  As Is "),
])
def test_normalize_answer(spark, kind, value, expected):
    assert _one(spark, X.normalize_answer("a", kind), a=value) == expected


def test_normalize_unknown_raises():
    with pytest.raises(ValueError):
        X.normalize_answer("a", "simple")


@pytest.mark.parametrize("q,expected", [("why???", "why"), ("what?? ", "what?? "), ("?", ""), ("a?b", "a?b")])
def test_clean_question(spark, q, expected):
    assert _one(spark, X.clean_question("q"), q=q) == expected


def test_collapse_blanks_python_split_semantics(spark):
    assert _one(spark, X.collapse_blanks("s"), s="\x1c a\x1fb  c\x85") == "a b c"
    assert _one(spark, X.collapse_blanks("s", ""), s=" a b\tc ") == "abc"


def test_nfd_nfkc(spark):
    assert _one(spark, X.nfd("s"), s="é") == "é"
    assert _one(spark, X.nfkc("s"), s="ﬁ") == "fi"
    assert _one(spark, X.nfd("s"), s="plain ascii") == "plain ascii"


def test_ascii_rows_do_not_reach_python(spark, monkeypatch):
    import pandas as pd
    from pyspark.sql.types import ArrayType, StringType

    def strict(kind):
        @F.pandas_udf(kind)
        def only_non_ascii(s: pd.Series) -> pd.Series:
            for x in s.dropna():
                if all(v.isascii() for v in ([x] if isinstance(x, str) else x)):
                    raise ValueError("an ASCII row reached Python")
            return s
        return only_non_ascii

    for name, kind in (("_NFD", StringType()), ("_NFKC", StringType()), ("_NFD_ARRAY", ArrayType(StringType())),
                       ("_NFKC_ARRAY", ArrayType(StringType()))):
        monkeypatch.setattr(X, name, strict(kind))
    rows = [("plain", ["a", "b"]), ("é", ["a", "é"]), (None, None), ("", [])]
    df = spark.createDataFrame(rows, "s string, a array<string>")
    got = df.select(X.nfd("s"), X.nfkc("s"), X.nfd_all("a"), X.nfkc_all("a")).collect()
    assert [tuple(r) for r in got] == [(s, s, a, a) for s, a in rows]


@pytest.mark.parametrize("raw,expected", [("ﬁ", "fi"), ("Ｔｏｋｙｏ", "Tokyo"), ("①", "1"), ("㎏", "kg"), ("e\u0301", "é")])
def test_nfkc_compatibility_characters(spark, raw, expected):
    assert _one(spark, X.nfkc("s"), s=raw) == expected


def test_corpus_answer_search_with_hot_token(spark):
    from quarry.operators.matching import answer_occurrences, empty_answers
    texts = [f"the common word {'alpha' if i % 3 == 0 else 'beta'} item{i}" for i in range(60)]
    passages = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    answers = spark.createDataFrame([(1, "the common"), (2, "Alpha"), (3, "item7"), (4, "beta item"),
                                     (5, "nowhere"), (6, "  ")], "aid long, answer string")
    found = answer_occurrences(answers, passages).collect()
    assert [r["aid"] for r in found if r["id"] is None] == [6]     # without tokens: contained in every passage
    got = sorted((r["aid"], r["id"]) for r in found if r["id"] is not None)

    def toks(s):
        return [t.lower() for t in re.findall(r"\w+|[^\w\s]", s)]

    exp = []
    for aid, a in [(1, "the common"), (2, "Alpha"), (3, "item7"), (4, "beta item"), (5, "nowhere")]:
        at = toks(a)
        for pid, t in enumerate(texts):
            pt = toks(t)
            if any(pt[i:i + len(at)] == at for i in range(len(pt) - len(at) + 1)):
                exp.append((aid, pid))
    assert got == sorted(exp)
    assert [r["aid"] for r in empty_answers(answers).collect()] == [6]
