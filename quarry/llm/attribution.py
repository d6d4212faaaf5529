"""Token counts by offset-mapped attribution.

A document's fields are joined into one string, each with a line feed after it,
and the string is encoded once, whole, with character offsets. A section is a
stretch of the string: a field, or a line of a field where `by_line` asks for
it, with the line feed that ends it. Sections and tokens are both in order, so
token spans are joined to sections by binary search. A token that crosses a
boundary is allotted whole, by an explicit rule:

    "first"     the section that holds the token's first character
    "majority"  the section that holds most of its characters, the first of equals

so the sections of a document sum to the document's tokens exactly.

Tokens of a byte-level vocabulary may be part of a character; all parts have
that character's span. White space is part of spans.

Where the tokenizer's pre-tokens are those of `PRE_TOKEN`, which no merge crosses, a
batch is split into them by that pattern, each distinct one is encoded once while the
worker remembers it, and the offsets of its tokens are only looked at where a section
boundary falls inside it; the result is that of encoding whole documents. Other
tokenizers encode the whole string.

Defined cases: a null field is an empty one and still has its section (its line
feed); repeated rows are counted each; an empty table gives no rows; fields may
be any columns that cast to strings; other columns are not looked at.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "majority")
# Fixed value: the pre-tokens of the byte-level vocabularies, with the tokenizer's white space.
PRE_TOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
             r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Distinct pre-tokens that a worker remembers (some 30 bytes each), and characters that are looked at together.
REMEMBERED = 1_500_000
SLICE_CHARS = 4 << 20
_PROBE = "It's 12 o'clock,  she'll\t\tgo -- caf\u00e9\u3000\u65e5\u672c 3rd!\n\n x\x1c\x85 y  "

_counters: dict[str, "Counter"] = {}


def allot(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str = "first") -> np.ndarray:
    """The section of each token; section i is [bounds[i], bounds[i + 1])."""
    first = np.searchsorted(bounds, start, side="right") - 1
    if rule == "first":
        return first
    last = np.maximum(np.searchsorted(bounds, end, side="left") - 1, first)
    for t in np.flatnonzero(last > first).tolist():
        s = np.arange(first[t], last[t] + 1)
        overlap = np.minimum(bounds[s + 1], end[t]) - np.maximum(bounds[s], start[t])
        first[t] = s[int(np.argmax(overlap))]
    return first


def sections(fields: list[str | None], by_line: bool) -> tuple[str, list[tuple[int, int]], np.ndarray]:
    """The joined string, (field, line) of each section, and the sections' bounds."""
    whole, names, bounds, at = [], [], [0], 0
    for i, value in enumerate(fields):
        for j, part in enumerate((value or "").split("\n") if by_line else [value or ""]):
            whole.append(part + "\n")
            at += len(part) + 1
            names.append((i, j))
            bounds.append(at)
    return "".join(whole), names, np.array(bounds)


def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
    from tokenizers import Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)  # a token's span has its white space
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


class Counter:
    """Tokens of pre-tokens."""

    def __init__(self, path: str) -> None:
        self.tokenizer = _encoder(path)
        self.pattern = regex.compile(PRE_TOKEN)
        splitter, probe = self.tokenizer.pre_tokenizer, self.pattern.findall(_PROBE)
        spans = np.cumsum([0] + [len(x) for x in probe]).tolist()
        self.by_pre_token = (self.tokenizer.normalizer is None and splitter is not None
                             and [at for _, at in splitter.pre_tokenize_str(_PROBE)] == list(zip(spans, spans[1:]))
                             and self.encode(_PROBE)[0] == [i for x in probe for i in self.encode(x)[0]])
        self.known, self.counts = pa.array([], pa.string()), np.zeros(0, np.int64)

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        got = self.tokenizer.encode(text, add_special_tokens=False)
        return got.ids, got.offsets

    def _count(self, words: pa.Array) -> np.ndarray:
        return np.array([len(x.ids) for x in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)], np.int64)

    def sizes(self, words: pa.Array) -> np.ndarray:
        """The number of tokens of each pre-token."""
        coded = words.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.known)
        there = pc.is_valid(at).to_numpy(zero_copy_only=False)
        found = np.zeros(len(at), np.int64)
        found[there] = self.counts[at.drop_null().to_numpy()]
        new = coded.dictionary.filter(pa.array(~there))
        found[~there] = self._count(new)
        if len(self.known) + len(new) > REMEMBERED:
            keep = len(self.known) // 2
            self.known, self.counts = pa.concat_arrays([self.known.slice(keep)]), self.counts[keep:].copy()
        if len(self.known) + len(new) <= REMEMBERED:
            self.known, self.counts = pa.concat_arrays([self.known, new]), np.concatenate([self.counts, found[~there]])
        return found[coded.indices.to_numpy()]

    def section_tokens(self, texts: list[str], bounds: list[np.ndarray], rule: str) -> list[np.ndarray]:
        """The tokens allotted to each section of each text; `bounds` are the sections' places in their text."""
        if not self.by_pre_token:
            out = []
            for text, b in zip(texts, bounds, strict=True):
                spans = np.array(self.encode(text)[1], dtype=np.int64).reshape(-1, 2)
                out.append(np.bincount(allot(spans[:, 0], spans[:, 1], b, rule), minlength=len(b) - 1))
            return out
        split = [self.pattern.findall(t) for t in texts]
        words = pa.array([w for s in split for w in s], pa.string())
        # All texts lie end to end; sections keep their order.
        base = np.cumsum([0] + [len(t) for t in texts])
        edges = np.concatenate([b[:-1] + at for b, at in zip(bounds, base)])
        end = np.cumsum(pc.utf8_length(words).to_numpy())
        start = np.concatenate([[0], end[:-1]]) if len(end) else end
        first, last = np.searchsorted(edges, start, side="right") - 1, np.searchsorted(edges, end, side="left") - 1
        sizes = self.sizes(words)
        inside = first == last
        found = np.bincount(first[inside], weights=sizes[inside], minlength=len(edges)).astype(np.int64)
        all_edges = np.append(edges, base[-1])
        for i in np.flatnonzero(~inside).tolist():
            spans = np.array(self.encode(words[i].as_py())[1], np.int64).reshape(-1, 2) + start[i]
            np.add.at(found, allot(spans[:, 0], spans[:, 1], all_edges, rule), 1)
        return np.split(found, np.cumsum([len(b) - 1 for b in bounds])[:-1])


def _counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer_path: str, fields: tuple[str, ...] = ("source", "lang", "text"), by_line: bool = False,
                 rule: str = "first", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, field, line, start, n_chars, n_tokens, doc_tokens): one row per section of every document."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kept = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).cast("string").alias(f"field_{i}") for i, c in enumerate(fields)])
    names = ["doc_id", "field", "line", "start", "n_chars", "n_tokens", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for batch in batches:
            docs = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
            held, size = [], 0
            for i, parts in enumerate(docs):
                held.append((i, *sections(parts, by_line)))
                size += len(held[-1][1])
                if size >= SLICE_CHARS:
                    yield counted(counter, batch, held)
                    held, size = [], 0
            if held:
                yield counted(counter, batch, held)

    def counted(counter: Counter, batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
        counts = counter.section_tokens([t for _, t, _, _ in held], [b for _, _, _, b in held], rule)
        each = np.array([len(where) for _, _, where, _ in held])
        rows = np.repeat([i for i, _, _, _ in held], each)
        whole = np.repeat([int(c.sum()) for c in counts], each)
        place = [x for _, _, where, _ in held for x in where]
        columns = ([j for _, j in place], np.concatenate([b[:-1] for _, _, _, b in held]), np.concatenate([np.diff(b) for _, _, _, b in held]),
                   np.concatenate(counts), whole)
        return pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array([fields[f] for f, _ in place], pa.string()),
                                *(pa.array(c, pa.int64()) for c in columns)], names=names)

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, field string, line long, start long, n_chars long, n_tokens long, doc_tokens long")
