"""Token-array expressions for the reader: inputs, answer-span labels, span search, texts.

Token arrays are ``array<string>``; subword continuation pieces start with
``##``. Positions are 0-based in the API (as in the reference) and converted
to Spark's 1-based array functions internally. All of it is JVM-side but the search
of the best spans, which takes the logits of many inputs at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.slices import list_slices

# ---- fixed values: special tokens of a BERT-style vocabulary -------------------
CLS, SEP, PAD = "[CLS]", "[SEP]", "[PAD]"
SPECIAL_TOKENS = ("[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]")
SUBWORD_PREFIX = "##"
# ---------------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lit_int(x) -> Column:
    return x if isinstance(x, Column) else F.lit(int(x))


def _range(lo: Column, hi: Column) -> Column:
    """Inclusive integer range, empty when hi < lo (Spark's sequence counts down)."""
    return F.when(hi < lo, F.array().cast("array<int>")).otherwise(F.sequence(lo, hi))


def sublist_positions(small, large, start=0, end=None) -> Column:
    """H4: every 0-based i in [start, end - len(small)] with large[i:i+len(small)] == small."""
    s, big = _c(small), _c(large)
    stop = (F.size(big) if end is None else _lit_int(end)) - F.size(s)
    return F.filter(_range(_lit_int(start), stop),
                    lambda i: F.slice(big, i + 1, F.size(s)) == s)


def _room(q_size: Column, max_length: int) -> Column:
    """Passage tokens that fit behind a question: three special tokens go off."""
    return F.greatest(F.lit(0), F.lit(max_length) - q_size - 3)


def _input(q: Column, part: Column, max_length: int) -> Column:
    padding = F.lit(max_length - 3) - F.size(q) - F.size(part)
    return F.concat(F.array(F.lit(CLS)), q, F.array(F.lit(SEP)), part, F.array(F.lit(SEP)), F.array_repeat(F.lit(PAD), F.greatest(F.lit(0), padding)))


def passage_part(title_tokens, text_tokens) -> Column:
    """title [SEP] text: the second part of a reader input."""
    return F.concat(_c(title_tokens), F.array(F.lit(SEP)), _c(text_tokens))


def reader_input(q_tokens, title_tokens, text_tokens, max_length: int) -> Column:
    """[CLS] q [SEP] title [SEP] text [SEP] + [PAD]...; only the passage part is cut."""
    q = _c(q_tokens)
    return _input(q, F.slice(passage_part(title_tokens, text_tokens), 1, _room(F.size(q), max_length)), max_length)


def reader_windows(q_tokens, passage, max_length: int, overlap) -> Column:
    """H19 over a whole passage: array<struct<win, offset, first, stop, tokens>>.

    ``passage`` (a column of `passage_part`) is cut into runs of as many tokens as fit
    behind the question, neighbours sharing ``overlap`` tokens (an int or a column), so
    every span of up to overlap + 1 tokens lies whole in some window. Window 0 is the
    input of H19. ``offset`` is the place of the window's first passage token; spans that
    start in [first, stop) of the input belong to this window, each passage token to
    exactly one (window 0 also owns the question, the last one its padding). A question
    that leaves no room for passage tokens has one window without any."""
    q, p = _c(q_tokens), _c(passage)

    def whole(w):
        return F.struct(*[w[name] for name in ("win", "offset", "first", "stop")],
                        _input(q, F.slice(p, w["offset"] + 1, _room(F.size(q), max_length)), max_length).alias("tokens"))

    return F.transform(_window_places(q, p, max_length, overlap), whole)


def _window_places(q: Column, p: Column, max_length: int, overlap) -> Column:
    """`reader_windows` without the tokens."""
    room = _room(F.size(q), max_length)
    stride = F.greatest(F.lit(1), room - F.least(_lit_int(overlap), room - 1))
    last = F.when((F.size(p) <= room) | (room == 0), F.lit(0)).otherwise(F.ceil((F.size(p) - room) / stride).cast("int"))

    def window(w):
        offset = (w * stride).cast("int")
        return F.struct(w.cast("int").alias("win"), offset.alias("offset"),
                        F.when(w == 0, F.lit(0)).otherwise(F.size(q) + 2).alias("first"),
                        F.when(w == last, F.greatest(F.lit(max_length), F.size(q) + 3)).otherwise(F.size(q) + 2 + stride).cast("int").alias("stop"))

    return F.transform(F.sequence(F.lit(0), last), window)


def with_windows(df: DataFrame, q_tokens: str, passage: str, max_length: int, overlap) -> DataFrame:
    """A row per window of `reader_windows` with its win, offset, first, stop and tokens; the passage's column goes.

    The places of the windows are made first and each window's tokens in its own row, so a
    passage is not copied whole for every window of it."""
    q, p = F.col(q_tokens), F.col(passage)
    rows = df.select("*", F.explode(_window_places(q, p, max_length, overlap)).alias("_w")).select("*", "_w.*").drop("_w")
    tokens = _input(q, F.slice(p, F.col("offset") + 1, _room(F.size(q), max_length)), max_length)
    return rows.withColumn("tokens", tokens).drop(passage)


def question_input(q_tokens, max_length: int) -> Column:
    """H22, question form: [CLS] question [SEP], cut to max_length."""
    return F.concat(F.array(F.lit(CLS)), F.slice(_c(q_tokens), 1, max(0, max_length - 2)), F.array(F.lit(SEP)))


def encoder_input(title_tokens, text_tokens, max_length: int) -> Column:
    """Passage encoder input [CLS] title [SEP] text [SEP]; only the text is cut."""
    t = _c(title_tokens)
    budget = F.greatest(F.lit(0), F.lit(max_length) - F.size(t) - 3)
    return F.concat(F.array(F.lit(CLS)), t, F.array(F.lit(SEP)), F.slice(_c(text_tokens), 1, budget),
                    F.array(F.lit(SEP)))


def answer_spans(tokens, answers_tokens, *, from_start: bool = False) -> Column:
    """Inclusive (start, end) spans of every answer's token sequence in the input,
    answer by answer; search starts at the first [SEP] unless ``from_start``.
    Answers with no tokens are skipped."""
    tok = _c(tokens)
    first_sep = F.array_position(tok, SEP) - 1
    start = F.lit(0) if from_start else F.greatest(first_sep, F.lit(0))
    nonempty = F.filter(_c(answers_tokens), lambda a: F.size(a) > 0)
    return F.flatten(F.transform(
        nonempty,
        lambda a: F.transform(sublist_positions(a, tok, start),
                              lambda i: F.struct(i.cast("int").alias("start"),
                                                 (i + F.size(a) - 1).cast("int").alias("end")))))


def pad_spans(spans, max_spans: int) -> Column:
    """First max_spans spans, padded with (0, 0), plus a 0/1 mask."""
    s = F.slice(_c(spans), 1, max_spans)
    pad = F.greatest(F.lit(0), F.lit(max_spans) - F.size(s))
    return F.struct(
        F.concat(F.transform(s, lambda x: x["start"]), F.array_repeat(F.lit(0), pad)).alias("starts"),
        F.concat(F.transform(s, lambda x: x["end"]), F.array_repeat(F.lit(0), pad)).alias("ends"),
        F.concat(F.array_repeat(F.lit(1), F.size(s)), F.array_repeat(F.lit(0), pad)).alias("mask"))


def _is_sub(tok: Column) -> Column:
    return F.startswith(tok, F.lit(SUBWORD_PREFIX))


def grow_start(tokens, s) -> Column:
    """H17 left edge: move left while the start token is a ## piece (not past 0)."""
    tok = _c(tokens)
    return F.coalesce(F.array_max(F.filter(_range(F.lit(0), s),
                                           lambda p: (p == 0) | ~_is_sub(F.get(tok, p)))), F.lit(0))


def grow_end(tokens, e) -> Column:
    """H17 right edge: extend while the next token is a ## piece."""
    tok = _c(tokens)
    n = F.size(tok)
    nxt = F.array_min(F.filter(_range(e + 1, n - 1), lambda p: ~_is_sub(F.get(tok, p))))
    return F.coalesce(nxt, n) - 1


def _may_grow(tok: Column, logits: Column) -> Column:
    """Whether some token may be a ## piece, or is null or missing, so that an edge may move (no wrong "no")."""
    joined = F.concat(F.lit(" "), F.array_join(tok, " ", SUBWORD_PREFIX))
    return F.coalesce(F.contains(joined, F.lit(" " + SUBWORD_PREFIX)) | (F.size(logits) > F.size(tok)), F.lit(True))


def _span(st: Column, en: Column, s: Column, e: Column) -> Column:
    return F.struct((-(F.get(st, s) + F.get(en, e))).alias("neg_score"), s.alias("start"), e.alias("end"),
                    F.get(st, s).alias("start_logit"), F.get(en, e).alias("end_logit"))


def all_spans(start_logits, end_logits, max_answer_length: int, first=0, stop=None) -> Column:
    """Every (s, e) with s <= e < s + max_answer_length, clipped at the end, sorted
    by start+end logit descending; ties keep enumeration order (s, then e). Only starts
    in [first, stop) are looked at."""
    st, en = _c(start_logits), _c(end_logits)
    n = F.size(st)
    top = n if stop is None else F.least(n, _c(stop))
    spans = F.flatten(F.transform(
        _range(_c(first) if isinstance(first, str) else _lit_int(first), top - 1),
        lambda s: F.transform(_range(s, F.least(s + max_answer_length - 1, n - 1)), lambda e: _span(st, en, s, e))))
    return F.sort_array(spans)


SPAN_TYPE = "array<struct<neg_score:double,start:int,end:int,start_logit:double,end_logit:double>>"
# Logits of padded inputs that a worker searches together.
_SEARCH_LOGITS = 1 << 16


def _padded(lists: pa.Array, sizes: np.ndarray, width: int) -> np.ndarray:
    out = np.full((len(sizes), width), np.nan)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _search(start: pa.Array, end: pa.Array, first: np.ndarray, stop: np.ndarray, longest: int, n: int):
    """row, start, end, start logit and end logit of the n best spans of every input, best first."""
    sizes = pc.fill_null(pc.list_value_length(start), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    st, en = _padded(start, sizes, width), _padded(end, sizes, width)
    at = np.arange(width)
    mine = (at >= first[:, None]) & (at < np.minimum(sizes, stop)[:, None])
    # One plane per span length: a span that is none has the key infinity and is left out by its place.
    keys = np.full((min(longest, width), *st.shape), np.inf)
    for more in range(len(keys)):
        keys[more, :, :width - more] = -(st[:, :width - more] + en[:, more:])
    is_span = mine & (at + np.arange(len(keys))[:, None, None] < sizes[:, None])
    # Only starts whose best span is among the n best starts' can begin one of the n best spans; NaN comes last.
    bests = np.where(is_span & ~np.isnan(keys), keys, np.inf).min(axis=0, initial=np.inf)
    bound = np.partition(bests, n - 1, axis=1)[:, n - 1] if width > n else np.full(len(st), np.inf)
    more, row, s = np.nonzero(is_span & ((keys <= bound[:, None]) | (bound == np.inf)[:, None]))
    order = np.lexsort((more, s, keys[more, row, s], row))
    row, s, e = row[order], s[order], (s + more)[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, s, e = (x[rank < n] for x in (row, s, e))
    return row, s, e, st[row, s], en[row, e]


def top_spans(start_logits, end_logits, max_answer_length: int, num_spans: int, first=0, stop=None) -> Column:
    """The first ``num_spans`` of `all_spans`, without making them all.

    Inputs are searched together, as planes of (input, start) per span length; the
    num_spans-th best start of an input bounds the score from below, so only the spans that
    reach it are sorted."""
    st, en = _c(start_logits), _c(end_logits)

    @F.arrow_udf(SPAN_TYPE)
    def search(start: pa.Array, end: pa.Array, low: pa.Array, top: pa.Array) -> pa.Array:
        lows, tops = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (low, top))
        counts, found = np.zeros(len(start), dtype=np.int64), []
        for a, b in list_slices(start, _SEARCH_LOGITS // max(1, min(max_answer_length, 64)) * 8):
            row, *span = _search(start.slice(a, b - a), end.slice(a, b - a), lows[a:b], tops[a:b], max_answer_length, num_spans)
            counts[a:b] = np.bincount(row, minlength=b - a)
            found.append(span)
        s, e, sl, el = (np.concatenate([np.zeros(0), *x]) for x in (zip(*found, strict=True) if found else [[]] * 4))
        lost = pc.or_(pc.is_null(start), pc.is_null(end)).to_numpy(zero_copy_only=False)
        spans = pa.StructArray.from_arrays([pa.array(-(sl + el)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(sl), pa.array(el)],
                                           names=["neg_score", "start", "end", "start_logit", "end_logit"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32), mask=np.r_[lost, False]), spans)

    low = _c(first) if isinstance(first, str) else _lit_int(first)
    top = F.size(st) if stop is None else _c(stop)
    return search(st, en, low.cast("int"), top.cast("int"))


def best_spans(tokens, start_logits, end_logits, *, num_spans: int = 1, max_answer_length: int = 10,
               allow_overlap: bool = True, expand_subwords: bool = True, first=0, stop=None) -> Column:
    """F5 (+H16, H17): the best ``num_spans`` spans of one reader input, starting in [first, stop).

    Returns array<struct<start, end, start_logit, end_logit>> in selection order;
    start/end are the grown edges, the logits those of the original edges (Q21)."""
    tok = _c(tokens)

    def grown(sp):
        s = grow_start(tok, sp["start"]) if expand_subwords else sp["start"]
        e = grow_end(tok, sp["end"]) if expand_subwords else sp["end"]
        return F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"),
                        sp["start_logit"].alias("start_logit"), sp["end_logit"].alias("end_logit"))

    if allow_overlap:
        found = top_spans(start_logits, end_logits, max_answer_length, num_spans, first, stop)
        if not expand_subwords:
            return F.transform(found, grown)
        # Growing looks at an input token by token; where no token is a ## piece, every edge stays.
        still = F.transform(found, lambda sp: F.struct(*[sp[name].alias(name) for name in ("start", "end", "start_logit", "end_logit")]))
        return F.when(_may_grow(tok, _c(start_logits)), F.transform(found, grown)).otherwise(still)

    ranked = all_spans(start_logits, end_logits, max_answer_length, first, stop)
    empty = F.array().cast("array<struct<start:int,end:int,start_logit:double,end_logit:double>>")

    def step(acc, sp):
        nested = F.exists(acc, lambda x: ((sp["start"] <= x["start"]) & (x["end"] <= sp["end"]))
                          | ((x["start"] <= sp["start"]) & (sp["end"] <= x["end"])))
        keep = (F.size(acc) < num_spans) & ~nested
        return F.when(keep, F.concat(acc, F.array(grown(sp)))).otherwise(acc)

    return F.aggregate(ranked, empty, step)


def detokenize(tokens) -> Column:
    """Tokens -> text: blank-joined, ## pieces glued, outer blanks stripped."""
    return F.trim(F.replace(F.array_join(_c(tokens), " "), F.lit(" " + SUBWORD_PREFIX), F.lit("")))


def answer_texts(tokens, span_start, span_end) -> Column:
    """struct(input_text, answer_text, answer_start, answer_end); start is the
    first occurrence of the answer text at or after the left context (-1 if none)."""
    tok = _c(tokens)
    return placed_answer(detokenize(tok), answer_parts(tok, span_start, span_end))


def answer_parts(tokens, span_start, span_end) -> Column:
    """What H18 takes of the tokens beside the input's text: struct(answer_text, left), left the length of the left context."""
    tok = _c(tokens)
    s, e = _c(span_start), _c(span_end)
    return F.struct(detokenize(F.slice(tok, s + 1, e - s + 1)).alias("answer_text"), F.length(detokenize(F.slice(tok, 1, s))).alias("left"))


def placed_answer(input_text, parts) -> Column:
    """H18 from the text of an input and the `answer_parts` of a span in it."""
    text, part = _c(input_text), _c(parts)
    answer = part["answer_text"]
    found = _find(text, answer, part["left"])
    return F.struct(text.alias("input_text"), answer.alias("answer_text"),
                    found.cast("int").alias("answer_start"),
                    (found + F.length(answer)).cast("int").alias("answer_end"))


def _find(haystack: Column, needle: Column, from_pos: Column) -> Column:
    """Python str.find(needle, from_pos): 0-based index, -1 when absent."""
    return F.call_function("locate", needle, haystack, from_pos + 1) - 1


def _py_prefix(text: Column, n: Column) -> Column:
    return F.when(n >= 0, F.substring(text, 1, n)).otherwise(
        F.substring(text, 1, F.greatest(F.length(text) + n, F.lit(0))))


def _py_suffix(text: Column, n: Column) -> Column:
    start = F.when(n >= 0, n).otherwise(F.greatest(F.length(text) + n, F.lit(0)))
    return F.substring(text, start + 1, F.length(text) + 1)


def highlight(input_text, answer_text, answer_start, answer_end) -> Column:
    """Wrap the answer in ``**``, drop [PAD], back-quote special tokens, merge adjacent quotes."""
    t, a = _c(input_text), _c(answer_text)
    out = F.concat(_py_prefix(t, _c(answer_start)), F.lit("**"), a, F.lit("**"), _py_suffix(t, _c(answer_end)))
    out = F.replace(out, F.lit(PAD), F.lit(""))
    for tok in SPECIAL_TOKENS:
        out = F.replace(out, F.lit(tok), F.lit(f"`{tok}`"))
    out = F.replace(out, F.lit("``"), F.lit(""))
    return F.trim(out)
