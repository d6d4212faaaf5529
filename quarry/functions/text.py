"""Text column expressions: normalisation, word tokens, answer matching, answer normalisation.

Everything is JVM-side except Unicode normalisation (Spark has no
``normalize``) and Python-dialect regular expressions, which run as Arrow
pandas UDFs and skip pure-ASCII rows entirely.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from quarry.functions.slices import text_slices

# ---- fixed values that must equal the reference's behaviour -------------------
# Word tokens: a run of letters/numbers/marks, else one visible non-separator char.
TOKEN_PATTERN = "[\\p{L}\\p{N}\\p{M}]+|[^\\p{Z}\\p{C}]"
# Characters Python's str.split() treats as blanks.
BLANKS = "[\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}]+"
# ASCII punctuation removed by the "dpr" answer normaliser (Python string.punctuation).
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Articles removed by the "dpr" answer normaliser, as whole words.
ARTICLES_PATTERN = "(?<![\\p{L}\\p{N}_])(a|an|the)(?![\\p{L}\\p{N}_])"
MATCH_TYPES = ("dpr_string", "dpr_regex", "simple_nfd", "simple_nfkc", "none")
NORMALIZATION_TYPES = ("dpr", "simple_nfd", "simple_nfkc", "none")
# ---------------------------------------------------------------------------------

# Token separator used for contiguous sub-sequence tests; tokens never contain it
# because control characters (\p{C}) are not token characters.
_SEP = "\u0001"
_ASCII_ONLY = "^[\\x00-\\x7F]*$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _normalizer(form: str):
    """Normalised slice by slice: beside the batch and its result, a worker holds the strings of one slice."""
    @F.arrow_udf(StringType())
    def _norm(s: pa.Array) -> pa.Array:
        parts = [pa.array([None if x is None else unicodedata.normalize(form, x) for x in part.to_pylist()], pa.string())
                 for part in text_slices(s)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())
    return _norm


_NFD = _normalizer("NFD")
_NFKC = _normalizer("NFKC")


def _array_normalizer(form: str):
    @F.pandas_udf(ArrayType(StringType()))
    def _norm(s: pd.Series) -> pd.Series:
        return s.map(lambda xs: None if xs is None else
                     [None if x is None else unicodedata.normalize(form, x) for x in xs])
    return _norm


_NFD_ARRAY = _array_normalizer("NFD")
_NFKC_ARRAY = _array_normalizer("NFKC")


def _non_ascii(c: Column) -> Column:
    """`c` where it needs normalising, else null: Python UDFs are evaluated for every
    row whatever branch of a condition they stand in, so rows are spared by a null input."""
    return F.when(~c.rlike(_ASCII_ONLY), c)


def _non_ascii_array(c: Column) -> Column:
    return F.when(~F.forall(c, lambda x: F.coalesce(x.rlike(_ASCII_ONLY), F.lit(True))), c)


def nfd_all(col) -> Column:
    """H1 over an array<string>; arrays of pure-ASCII strings reach Python as nulls only."""
    c = _c(col)
    return F.coalesce(_NFD_ARRAY(_non_ascii_array(c)), c)


def nfkc_all(col) -> Column:
    c = _c(col)
    return F.coalesce(_NFKC_ARRAY(_non_ascii_array(c)), c)


def nfd(col) -> Column:
    """H1: Unicode NFD; ASCII rows reach Python as nulls only."""
    c = _c(col)
    return F.coalesce(_NFD(_non_ascii(c)), c)


def nfkc(col) -> Column:
    """H1: Unicode NFKC; ASCII rows reach Python as nulls only."""
    c = _c(col)
    return F.coalesce(_NFKC(_non_ascii(c)), c)


def word_tokens(col) -> Column:
    """H2: lower-cased word tokens."""
    return F.transform(F.regexp_extract_all(_c(col), F.lit(TOKEN_PATTERN), 0), lambda t: F.lower(t))


def collapse_blanks(col, sep: str = " ") -> Column:
    """" ".join(s.split()) (sep=" ") or "".join(s.split()) (sep="")."""
    c = F.regexp_replace(_c(col), F.lit(f"^{BLANKS}|{BLANKS}$"), F.lit(""))
    return F.regexp_replace(c, F.lit(BLANKS), F.lit(sep))


def _joined(tokens: Column) -> Column:
    return F.concat(F.lit(_SEP), F.array_join(tokens, _SEP), F.lit(_SEP))


def clean_question(col) -> Column:
    """B1: strip every trailing '?' (and nothing else)."""
    return F.rtrim(_c(col), F.lit("?"))


def match_text(title, text, include_title: bool) -> Column:
    """Text that answers are matched against."""
    return F.concat_ws(" ", _c(title), _c(text)) if include_title else _c(text)


def _regex_search(answer: str, passage: str) -> bool:
    """A pattern that Python cannot compile matches nothing."""
    try:
        pattern = re.compile(answer, re.IGNORECASE | re.UNICODE | re.MULTILINE)
    except (re.error, RecursionError, OverflowError):
        return False
    return bool(pattern.search(passage))


@F.pandas_udf(BooleanType())
def _regex_udf(answers: pd.Series, passages: pd.Series) -> pd.Series:
    return pd.Series([_regex_search(unicodedata.normalize("NFD", a), unicodedata.normalize("NFD", p))
                      for a, p in zip(answers, passages)], dtype=bool)


def has_answer(answer, passage, match_type: str = "dpr_string") -> Column:
    """H3: does `answer` occur in `passage` under one of five match types.

    One (answer, passage) pair per row; for an answer list per passage use
    ``with_any_answer``, which normalises each passage once."""
    a, p = _c(answer), _c(passage)
    if match_type == "dpr_string":
        at = word_tokens(nfd(a))
        return F.when(F.size(at) == 0, F.lit(True)).otherwise(F.contains(_joined(word_tokens(nfd(p))), _joined(at)))
    if match_type == "dpr_regex":
        return _regex_udf(a, p)
    if match_type in ("simple_nfd", "simple_nfkc"):
        norm = nfd if match_type == "simple_nfd" else nfkc
        return F.contains(collapse_blanks(F.lower(norm(p))), collapse_blanks(F.lower(norm(a))))
    if match_type == "none":
        return F.contains(p, a)
    raise ValueError(f"invalid match_type: {match_type!r}")


def _words(col) -> Column:
    return F.transform(F.regexp_extract_all(col, F.lit(TOKEN_PATTERN), 0), lambda t: F.lower(t))


@F.pandas_udf(BooleanType())
def _any_regex_udf(answers: pd.Series, passages: pd.Series) -> pd.Series:
    out = []
    for ans, p in zip(answers, passages):
        pn = unicodedata.normalize("NFD", p)
        out.append(any(_regex_search(unicodedata.normalize("NFD", a), pn) for a in (ans if ans is not None else [])))
    return pd.Series(out, dtype=bool)


def normalized_answers(answers, match_type: str) -> Column:
    """The answer side of ``with_any_answer`` for a match type, to compute once per
    question (before answers meet their hits) rather than once per hit."""
    a = _c(answers)
    if match_type in ("dpr_string", "simple_nfd"):
        return nfd_all(a)
    if match_type == "simple_nfkc":
        return nfkc_all(a)
    return a


def with_any_answer(df, answers: str, passage, match_type: str = "dpr_string", out: str = "has_answer",
                    *, prenormalized: bool = False):
    """D3 on a DataFrame: does any answer of the list match the passage.

    Unicode normalisation of both sides is materialised as columns first (one
    Arrow UDF call per row, ASCII rows skipped) so that the per-answer lambda
    body stays JVM-side. With ``prenormalized`` the answers column already holds
    ``normalized_answers(...)`` (dpr_regex and none always take raw answers)."""
    a, p = F.col(answers), _c(passage)
    if match_type == "dpr_regex":
        return df.withColumn(out, _any_regex_udf(a, p))
    if match_type == "none":
        return df.withColumn(out, F.exists(a, lambda x: F.contains(p, x)))
    aside = a if prenormalized else normalized_answers(a, match_type)
    if match_type == "dpr_string":
        staged = df.withColumn("_pside", _joined(word_tokens(nfd(p)))).withColumn("_aside", aside)
        test = F.exists(F.col("_aside"), lambda x: F.when(F.size(_words(x)) == 0, F.lit(True))
                        .otherwise(F.contains(F.col("_pside"), _joined(_words(x)))))
    elif match_type in ("simple_nfd", "simple_nfkc"):
        norm = nfd if match_type == "simple_nfd" else nfkc
        staged = df.withColumn("_pside", collapse_blanks(F.lower(norm(p)))).withColumn("_aside", aside)
        test = F.exists(F.col("_aside"), lambda x: F.contains(F.col("_pside"), collapse_blanks(F.lower(x))))
    else:
        raise ValueError(f"invalid match_type: {match_type!r}")
    return staged.withColumn(out, test).drop("_pside", "_aside")


def normalize_answer(col, kind: str = "dpr") -> Column:
    """H5: answer normalisation for exact-match accuracy."""
    c = _c(col)
    if kind == "dpr":
        t = F.lower(nfd(c))
        t = F.translate(t, ASCII_PUNCTUATION, "")
        t = F.regexp_replace(t, F.lit(ARTICLES_PATTERN), F.lit(" "))
        return collapse_blanks(t, " ")
    if kind == "simple_nfd":
        return collapse_blanks(F.lower(nfd(c)), " ")
    if kind == "simple_nfkc":
        return collapse_blanks(F.lower(nfkc(c)), "")
    if kind == "none":
        return c
    raise ValueError(f"invalid answer normalization type: {kind!r}")
