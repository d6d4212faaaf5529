"""Chat formatting with offset-aligned loss masks.

A conversation's turns, in order, are rendered as one string:

    <s>[INST] role [/INST]
    text</s>

Control strings inside a role or text are escaped by a backslash after their
first character, and one more where backslashes are there already, so a control
string in the output is always the template's and unescaping gives the text
back. The whole string is encoded once with offsets. Turn spans are sorted, and
so are token spans, so a token's turn is found by binary search: it is under
the loss mask if it shares a character with the text of an assistant turn. The
characters under the mask (`loss_spans`) are these tokens' spans within these
turns' spans: a token that crosses the edge of a turn counts as masked and gives
only the characters inside.

Scale: turns are grouped by conversation in a sort, streamed through tasks; a
task holds one conversation at a time.

Defined cases: a null or empty text is an empty turn; a null role reads back as
the empty string; turns come by turn number, nulls first, then role and text;
repeated rows are turns of their own; rows with a null conv_id are one
conversation; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# The control strings of the template.
OPEN, ROLE_END, CLOSE = "<s>[INST] ", " [/INST]\n", "</s>\n"
_CONTROL = re.compile(r"([<\[])(\\*)(?=/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?s>|/?INST\])")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The formatted conversation and (role, start, end) of each turn's escaped text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role or "") + ROLE_END, escape(text or "")
        parts += [head, body, CLOSE]
        at += len(head)
        spans.append((role or "", at, at + len(body)))
        at += len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; the inverse of `render` (nulls come back empty)."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn starts at character {at}")
        head = formatted.index(ROLE_END, at)
        end = formatted.index(CLOSE, head + len(ROLE_END))
        turns.append((unescape(formatted[at + len(OPEN):head]), unescape(formatted[head + len(ROLE_END):end])))
        at = end + len(CLOSE)
    return turns


def loss_mask(offsets: np.ndarray, spans: list[tuple[str, int, int]], trained: tuple[str, ...] = ("assistant",)) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens count towards the loss, and the sorted disjoint character spans under the mask.

    `offsets` has a (start, end) row per token; `spans` is sorted and disjoint.
    """
    kept = np.array([(a, b) for role, a, b in spans if role in trained and b > a], dtype=np.int64).reshape(-1, 2)
    if not len(kept) or not len(offsets):
        return np.zeros(len(offsets), bool), []
    start, end = offsets[:, 0], offsets[:, 1]
    # The first turn that ends after the token's start is the only one the token can begin in.
    turn = np.searchsorted(kept[:, 1], start, side="right")
    inside = turn < len(kept)
    near = np.minimum(turn, len(kept) - 1)
    mask = inside & (kept[near, 0] < end) & (end > start)
    covered: list[tuple[int, int]] = []
    for t, a, b in zip(turn[mask].tolist(), start[mask].tolist(), end[mask].tolist(), strict=True):
        while t < len(kept) and kept[t, 0] < b:
            lo, hi = max(a, int(kept[t, 0])), min(b, int(kept[t, 1]))
            if covered and lo <= covered[-1][1] and covered[-1][1] > kept[t, 0]:
                covered[-1] = (covered[-1][0], max(hi, covered[-1][1]))
            else:
                covered.append((lo, hi))
            t += 1
    return mask, covered


def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
    from tokenizers import Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)  # a token's span has its white space
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


_SPAN = "array<struct<start:long,end:long>>"
_SCHEMA = (f"formatted string, n_turns long, ids array<int>, token_start array<int>, token_end array<int>, mask array<boolean>, "
           f"loss_spans {_SPAN}")


def format_conversations(turns: DataFrame, tokenizer_path: str, trained: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns, ids, token_start, token_end, mask, loss_spans (offsets in code points)."""
    kept = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                        F.col(text_col).alias("text"))
    kind = kept.schema["conv_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _encoder(tokenizer_path)

        def finish(conv, rows) -> pa.RecordBatch:
            text, spans = render(rows)
            got = tokenizer.encode(text, add_special_tokens=False)
            offsets = np.array(got.offsets, dtype=np.int64).reshape(-1, 2)
            mask, covered = loss_mask(offsets, spans, trained)
            columns = [pa.array([conv], id_type), pa.array([text]), pa.array([len(rows)], pa.int64()), pa.array([got.ids], pa.list_(pa.int32())),
                       pa.array([offsets[:, 0].tolist()], pa.list_(pa.int32())), pa.array([offsets[:, 1].tolist()], pa.list_(pa.int32())),
                       pa.array([mask.tolist()], pa.list_(pa.bool_())),
                       pa.array([[{"start": a, "end": b} for a, b in covered]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            return pa.record_batch(columns, names=["conv_id", "formatted", "n_turns", "ids", "token_start", "token_end", "mask", "loss_spans"])

        open_conv, rows = None, []
        for batch in batches:
            ids, roles, texts = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for conv, role, text in zip(ids, roles, texts, strict=True):
                if rows and conv != open_conv:
                    yield finish(open_conv, rows)
                    rows = []
                open_conv = conv
                rows.append((role, text))
        if rows:
            yield finish(open_conv, rows)

    return (kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(run, f"conv_id {kind.simpleString()}, {_SCHEMA}"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The contract's digests, read from the formatted strings and loss spans alone."""
    @F.pandas_udf("struct<n_turns:long,turns_sha256:string,loss_chars:long,loss_sha256:string>")
    def digest(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(text, spans, strict=True):
            turns = parse(t)
            # Spans of one turn are joined before unescaping: an escape is never split.
            loss, at = [], 0
            for x in s:
                loss.append(unescape(t[x["start"]:x["end"]]))
                at = x["end"]
            loss = "".join(loss)
            rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{b}\n" for r, b in turns).encode()).hexdigest(), len(loss),
                         hashlib.sha256(loss.encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256"])

    return formatted.select("conv_id", digest("formatted", "loss_spans").alias("d"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "d.n_turns", "d.turns_sha256", "d.loss_chars", "d.loss_sha256", "formatted_chars")
