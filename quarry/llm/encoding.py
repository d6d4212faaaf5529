"""Whole texts to token ids, for tokenizers that drop white space.

Such a tokenizer merges nothing across white space, so the ids of a text are the
ids of its white-space separated parts in order. A batch's parts are split and
numbered by Arrow kernels, each part that the worker doesn't know yet goes
through the tokenizer once, and the ids of all parts are gathered by numpy. A
worker remembers its latest parts, up to `REMEMBERED`, as Arrow strings
and one array of ids. If the tokenizer lower-cases, ASCII capitals are lowered first, so
that a word at the start of a sentence is the same part. A new part of plain letters,
with or without punctuation behind it, is encoded by the tokenizer's model without
its normalizer, where a check at the start finds that this changes nothing. A
tokenizer for which white space matters encodes whole texts instead.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct parts that a worker remembers (some 40 bytes each).
REMEMBERED = 1_000_000
#: Text that is looked at together.
SLICE_BYTES = 16 << 20
_JOINED = 512
_MARK = "\x01"
#: Letters that normalizers for lower case leave alone, and punctuation that ends a word.
_LETTERS = "abcdefghijklmnopqrstuvwxyz\u00df\u00e0\u00e1\u00e2\u00e3\u00e4\u00e5\u00e6\u00e7\u00e8\u00e9\u00ea\u00eb\u00ec\u00ed\u00ee\u00ef\u00f1\u00f2\u00f3\u00f4\u00f5\u00f6\u00f9\u00fa\u00fb\u00fc"
_POINTS = ".,;:!?"
_PLAIN = f"^(?P<word>[{_LETTERS}]+)(?P<points>[{_POINTS}]*)$"

_encoders: dict[str, "Encoder"] = {}


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... (length of them) of every range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and int(starts.max(initial=0)) < 1 << 30 else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        normalizer = self.tokenizer.normalizer
        capitals = "".join(map(chr, range(65, 91)))
        self.lowers = normalizer is not None and normalizer.normalize_str(capitals) == capitals.lower()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = os.path.commonprefix(added) if added else "\x00"
        self.by_part = self._ids("a b \t\na") == self._ids("a") + self._ids("b") + self._ids("a")
        mark = self._ids(_MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.last = self._last_tokens()
        self.light = self._without_normalizer(path, Tokenizer) if self.by_part else None
        self.parts = pa.array([], pa.string())
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _without_normalizer(self, path: str, kind):
        """The same model behind white-space splitting alone, for ASCII letters and for the others, or None if plain words would get other ids."""
        from tokenizers import pre_tokenizers

        ascii_words, words = kind.from_file(path), kind.from_file(path)
        for light in (ascii_words, words):
            light.normalizer = None
            light.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(),
                                                       pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        cleaned = _LETTERS if self.tokenizer.normalizer is None else self.tokenizer.normalizer.normalize_str(_LETTERS)
        one = self.tokenizer.pre_tokenizer is not None and len(self.tokenizer.pre_tokenizer.pre_tokenize_str(_LETTERS)) == 1
        probes = ["".join(_LETTERS[i:i + n]) for n in (1, 3, 8) for i in range(0, len(_LETTERS), 5)]
        same = all((ascii_words if w.isascii() else words).encode(w, add_special_tokens=False).ids == self._ids(w)
                   and self._ids(w + p) == self._ids(w) + self._ids(p) for w in probes for p in (*_POINTS, _POINTS, "..", "!?"))
        return (ascii_words, words) if cleaned == _LETTERS and one and same and self.last is not None else None

    def _last_tokens(self) -> np.ndarray | None:
        """Which ids end a word, if the model marks them."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        vocabulary = self.tokenizer.get_vocab()
        found = np.zeros(max(vocabulary.values()) + 1, bool)
        found[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        return found

    def _words(self, tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words, many to a call: each ends with its only last token."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), _JOINED):
            some = words[at:at + _JOINED]
            got = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[got])
            if len(ends) == len(some):
                ids.append(got)
                lengths.append(np.diff(ends, prepend=-1))
            else:
                for kept, found in zip((ids, lengths), self._each(some), strict=True):
                    kept.append(found)
        return np.concatenate(ids), np.concatenate(lengths)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())), lengths

    def _joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts, many to a call, with a mark between them that no part holds."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(parts), _JOINED):
            some = parts[at:at + _JOINED]
            joined = f" {_MARK} ".join(some)
            got = None
            if self.mark is not None and joined.count(_MARK) == len(some) - 1:
                got = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
                marks = np.flatnonzero(got == self.mark)
            if got is not None and len(marks) == len(some) - 1:
                ids.append(np.delete(got, marks))
                lengths.append(np.diff(marks, prepend=-1, append=len(got)) - 1)
            else:
                for kept, found in zip((ids, lengths), self._each(some), strict=True):
                    kept.append(found)
        return np.concatenate(ids), np.concatenate(lengths)

    def _new(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts: a plain word's and its points' one after the other, any other part's as a whole."""
        if self.light is None:
            return self._joined(parts.to_pylist())
        split = pc.extract_regex(parts, _PLAIN)
        plain = pc.is_valid(split).to_numpy(zero_copy_only=False)
        starts, lengths = np.zeros((len(parts), 2), np.int64), np.zeros((len(parts), 2), np.int64)
        pools = [self.pool]

        def place(rows: np.ndarray, column: int, texts: pa.Array, encode, known: bool) -> None:
            coded = texts.dictionary_encode()
            words, index = coded.dictionary, coded.indices.to_numpy()
            at = pc.index_in(words, value_set=self.parts) if known else pa.nulls(len(words), pa.int32())
            there = pc.is_valid(at).to_numpy(zero_copy_only=False)
            start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            old = at.drop_null().to_numpy()
            start[there], size[there] = self.starts[old], self.lengths[old]
            ids, new = encode(words.filter(pa.array(~there)).to_pylist())
            start[~there], size[~there] = sum(map(len, pools)) + np.cumsum(new) - new, new
            pools.append(ids)
            starts[rows, column], lengths[rows, column] = start[index], size[index]

        simple = pc.string_is_ascii(parts).to_numpy(zero_copy_only=False)
        for chosen, tokenizer in ((plain & simple, self.light[0]), (plain & ~simple, self.light[1])):
            if chosen.any():
                rows, found = np.flatnonzero(chosen), split.filter(pa.array(chosen))
                place(rows, 0, found.field("word"), lambda words, t=tokenizer: self._words(t, words), True)
                place(rows, 1, found.field("points"), self._joined, False)
        if not plain.all():
            place(np.flatnonzero(~plain), 0, parts.filter(pa.array(~plain)), self._joined, False)
        return np.concatenate(pools)[gather(starts.reshape(-1), lengths.reshape(-1))], lengths.sum(axis=1)

    def _remember(self, new: pa.Array) -> bool:
        """Put `new` parts behind the known ones; the oldest half goes when there are too many. Whether any went."""
        ids, lengths = self._new(new)
        full = len(self.parts) + len(new) > REMEMBERED and len(self.parts) > 0
        if full:
            keep = len(self.parts) // 2
            first = int(self.starts[keep])
            self.parts = pa.concat_arrays([self.parts.slice(keep)])
            self.starts, self.lengths, self.pool = self.starts[keep:] - first, self.lengths[keep:].copy(), self.pool[first:].copy()
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.pool = np.concatenate([self.pool, ids])
        self.parts = pa.concat_arrays([self.parts, new])
        return full

    def _places(self, words: pa.Array) -> np.ndarray | None:
        """The places of parts among the known ones, new ones encoded first; None if there are more than are remembered."""
        for _ in range(2):
            at = pc.index_in(words, value_set=self.parts)
            if not at.null_count:
                return at.to_numpy()
            known = len(self.parts)
            if not self._remember(words.filter(at.is_null())):
                at = at.fill_null(-1).to_numpy(zero_copy_only=False).copy()
                at[at < 0] = known + np.arange(int((at < 0).sum()))
                return at
        at = pc.index_in(words, value_set=self.parts)
        return None if at.null_count else at.to_numpy()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) of a string array without nulls."""
        if not self.by_part:
            return self._each(texts.to_pylist())
        if self.lowers:
            lowered = pc.ascii_lower(texts)
            # Lowering must not make a special token of a text that has none.
            if self.special and not pc.any(pc.match_substring(lowered, self.special)).as_py():
                texts = lowered
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        at = self._places(words)
        if at is None:
            ids, lengths = self._new(words)
            starts, pool = np.cumsum(lengths) - lengths, ids
        else:
            starts, lengths, pool = self.starts[at], self.lengths[at], self.pool
        index = coded.indices.to_numpy()
        n = lengths[index]
        before = np.concatenate([[0], np.cumsum(n)])
        edges = before[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return pool[gather(starts[index], n)], np.diff(edges)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with `end_id` behind each text's ids."""
    return np.insert(ids, np.cumsum(sizes), end_id), sizes + 1


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of about SLICE_BYTES, at least one row each; null texts are empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        base = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop
