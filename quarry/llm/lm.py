"""Language-model scoring by a weighted backoff automaton.

The model is a bigram model with a Dirichlet prior (mu) over an add-one unigram
model, counted on the training documents:

    p1(w)     = (c(w) + 1) / (N + V + 1)
    p(w | u)  = (c(u w) + mu * p1(w)) / (c(u) + mu)

Both sum to one over the V known words and one unknown word. As an automaton:
a state per context word u has an arc per bigram (u, w) seen, weighing
log10 p(w | u), and a failure arc to the root, weighing log10(mu / (c(u) + mu));
the root has an arc per word, weighing log10 p1(w), and one for unknown words.
A text starts in the start state, ends with an end token, and is read from left
to right once: at each token its arc is taken or else the failure arc and the
root's arc, and the state is then that token's. A block's texts are walked side by
side, a token each at a time.

Scale: counts grow with the corpus and are never broadcast or gathered.
Documents are in blocks of `BLOCK_BYTES` of consecutive text. A block counts its
words and bigrams itself and sends each distinct one once, as a 64-bit hash with
its count. Hashes are sent sorted, cut into as many ranges as keep the hashes of
a range (over all blocks) within one task's memory: a row holds a block's hashes
of one range as differences, in byte planes that compress. Per range, the counts
of equal hashes are summed, and each block gets the totals of the hashes it
named back in the order in which it sent them, so no hash returns. Each block
then has the part of the automaton that its texts can reach and scores its
documents. A hash is named once per block at most, however frequent the word.

Defined cases: a null or empty text is the end token alone; a null id is hashed
as an empty string when the training documents are drawn; repeated rows count as
often as they come; without training documents N and V are 0; an empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.common import materialise

SEED = 42
BLOCK_BYTES = 8 << 20
#: Ranges of hashes per block of text: a range has the distinct words and bigrams of about half a block's bytes.
RANGES_PER_BLOCK = 2
MU = 64.0
#: Local ids of the end token and the start context; no word holds white space.
_END, _START = 0, 1


class _Words(dict):
    """Word to local id, given in order of first use."""

    def __init__(self) -> None:
        super().__init__({b"\n": _END, b" ": _START})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def sequence(self, text: bytes) -> np.ndarray:
        """Start, words and end of a text as local ids."""
        words = text.lower().split()
        return np.array([_START, *map(self.__getitem__, words), _END], dtype=np.int64)

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in self), np.uint64, len(self))


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One 64-bit hash per pair of word hashes, by multiplication and shifts."""
    with np.errstate(over="ignore"):
        x = first * np.uint64(0x9E3779B97F4A7C15) + second
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def is_held_out(doc_id: object, folds: int, fold: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


class _Block:
    """The token sequences of one block and its own counts."""

    def __init__(self) -> None:
        self.words, self.rows = _Words(), []

    def add(self, doc_id: object, text: bytes, held_out: bool) -> None:
        self.rows.append((doc_id, held_out, self.words.sequence(text)))

    def count(self) -> None:
        """Distinct pairs (sorted codes) and words, each with its count in this block's training documents."""
        self.hash = self.words.hashes()
        ids = [(s[:-1] << 32) | s[1:] for _, _, s in self.rows]
        weight = np.repeat([0 if h else 1 for _, h, _ in self.rows], [len(x) for x in ids])
        codes = np.concatenate(ids)
        self.pairs, at = np.unique(codes, return_inverse=True)
        self.n_pair = np.bincount(at, weight, len(self.pairs)).astype(np.int64)
        self.n_word = np.bincount(codes & 0xFFFFFFFF, weight, len(self.words)).astype(np.int64)
        self.first, self.second = self.pairs >> 32, self.pairs & 0xFFFFFFFF

    def pair_keys(self) -> np.ndarray:
        return _pair_keys(self.hash[self.first], self.hash[self.second])

    def sent(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(hashes in order, their own counts) of the words and of the pairs."""
        out = []
        for keys, counts in ((self.hash, self.n_word), (self.pair_keys(), self.n_pair)):
            order = np.argsort(keys, kind="stable")
            out.append((keys[order], counts[order]))
        return out

    def take_totals(self, words: np.ndarray, pairs: np.ndarray) -> None:
        """The corpus totals, in the order of `sent`, in the place of the block's own counts."""
        for keys, counts, totals in ((self.hash, self.n_word, words), (self.pair_keys(), self.n_pair, pairs)):
            counts[np.argsort(keys, kind="stable")] = totals

    def score(self, n: int, v: int, mu: float) -> Iterator[tuple]:
        """(doc_id, held_out, n_tokens, n_known, base_score, score) by one traversal of each sequence."""
        root = (self.n_word + 1) / (n + v + 1)
        context = self.n_word.copy()
        context[_START] = self.n_word[_END]  # as many starts as ends
        seen = self.n_pair > 0
        first, second = self.first[seen], self.second[seen]
        arcs = np.log10((self.n_pair[seen] + mu * root[second]) / (context[first] + mu))
        automaton = Automaton(self.pairs[seen], arcs, np.log10(mu / (context + mu)), np.log10(root))
        scores = automaton.walk([s for _, _, s in self.rows])
        for (doc_id, held_out, s), score in zip(self.rows, scores.tolist(), strict=True):
            tokens = s[1:]
            yield (doc_id, held_out, len(tokens), int((self.n_word[tokens] > 0).sum()), float(automaton.root[tokens].sum()), score)


class Automaton:
    """States with weighted arcs and a failure arc each, the part that a block's texts can reach.

    A state is a context word. Its arcs lie together in order: `codes` holds state << 32 | word
    ascending, `weights` the arcs' log-probabilities. A word without an arc takes the
    state's failure arc to the root (`failure`) and the root's arc (`root`). Either way the
    state behind it is the word's.
    """

    def __init__(self, codes: np.ndarray, weights: np.ndarray, failure: np.ndarray, root: np.ndarray) -> None:
        self.codes, self.weights, self.failure, self.root = codes, weights, failure, root

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, next state) of reading one word in each of several states."""
        code = (state << 32) | word
        at = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        found = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
        weight = self.failure[state] + self.root[word]
        weight[found] = self.weights[at[found]]
        return weight, word

    def walk(self, sequences: list[np.ndarray]) -> np.ndarray:
        """The accumulated weight of each sequence, whose first item is the state it starts in: all are read from left to
        right once, a word each at a time, the longest first so that those that are done fall off the end."""
        lengths = np.array([len(s) - 1 for s in sequences], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate(sequences)
        place = (np.cumsum(lengths + 1) - lengths - 1)[order]
        state, total = flat[place], np.zeros(len(sequences))
        going = np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max(initial=0)) + 1), side="right")
        for t, n in enumerate(going.tolist(), 1):
            weight, state = self.step(state[:n], flat[place[:n] + t])
            total[:n] += weight
        out = np.empty(len(sequences))
        out[order] = total
        return out


def _planes(values: np.ndarray) -> bytes:
    """64-bit values as eight planes of bytes, lowest first: the high planes of small values are runs of zeros."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _cut(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, row, doc_id, text as lower-cased UTF-8): consecutive rows of a task in blocks, written to the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, row, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            texts = [(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
            blocks, rows = [], []
            for t in texts:
                if size and size + len(t) > block_bytes:
                    block, row, size = block + 1, 0, 0
                size += len(t)
                blocks.append(block)
                rows.append(row)
                row += 1
            yield pa.record_batch([pa.array(blocks, pa.int64()), pa.array(rows, pa.int64()), batch.column(0), pa.array(texts, pa.binary())],
                                  names=["block", "row", "doc_id", "text"])

    cut = docs.mapInArrow(run, f"block long, row long, doc_id {kind}, text binary")
    return materialise(cut, "lm-blocks")


def _named(blocks: DataFrame, folds: int, fold: int, ranges: int) -> DataFrame:
    """(block, row, part, words, word_counts, pairs, pair_counts): what a block's training documents hold of one range of hashes.

    `row` is the first of the rows that were counted together: all of a block,
    or those of its rows that one task read, if the stored file was split.
    """
    bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)
    names = ["block", "row", "part", "words", "word_counts", "pairs", "pair_counts"]

    def close(at: int, first: int, block: _Block) -> Iterator[pa.RecordBatch]:
        block.count()
        (words, n_word), (pairs, n_pair) = block.sent()
        word_cuts, pair_cuts = ([0, *np.searchsorted(k, bounds).tolist(), len(k)] for k in (words, pairs))
        for part in range(ranges):
            w, p = slice(*word_cuts[part:part + 2]), slice(*pair_cuts[part:part + 2])
            if w.stop > w.start or p.stop > p.start:
                columns = [_planes(np.diff(words[w], prepend=np.uint64(0))), _planes(n_word[w]),
                           _planes(np.diff(pairs[p], prepend=np.uint64(0))), _planes(n_pair[p])]
                yield pa.record_batch([pa.array([x], pa.int64()) for x in (at, first, part)] + [pa.array([c], pa.binary()) for c in columns],
                                      names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = first = after = block = None
        for batch in batches:
            for b, row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (b, row) != (at, after):
                    if block:
                        yield from close(at, first, block)
                    at, first, block = b, row, _Block()
                after = row + 1
                block.add(doc_id, text, is_held_out(doc_id, folds, fold))
        if block:
            yield from close(at, first, block)

    return blocks.select("block", "row", "doc_id", "text").mapInArrow(
        run, "block long, row long, part long, words binary, word_counts binary, pairs binary, pair_counts binary")


def _summed(sent: list[tuple[bytes, bytes]]) -> tuple[list[bytes], np.ndarray]:
    """Each sender's totals in its own order, and the totals of the distinct hashes."""
    keys = [np.cumsum(_values(k), dtype=np.uint64) for k, _ in sent]
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(place, np.concatenate([_values(c) for _, c in sent])).astype(np.int64)
    back = totals[place]
    ends = np.cumsum([len(k) for k in keys])
    return [_planes(x) for x in np.split(back, ends[:-1])], totals


def _totals(named: DataFrame, partitions: int) -> DataFrame:
    """(block, row, part, words, pairs, v, n): totals for each sender, and once per range its distinct trained words and their sum."""
    names = ["block", "row", "part", "words", "pairs", "v", "n"]

    def close(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        words, of_words = _summed([(r["words"], r["word_counts"]) for r in rows])
        pairs, _ = _summed([(r["pairs"], r["pair_counts"]) for r in rows])
        v, n = int((of_words > 0).sum()), int(of_words.sum())
        for i, r in enumerate(rows):
            yield pa.record_batch([pa.array([r["block"]], pa.int64()), pa.array([r["row"]], pa.int64()), pa.array([r["part"]], pa.int64()),
                                   pa.array([words[i]], pa.binary()), pa.array([pairs[i]], pa.binary()),
                                   pa.array([0 if i else v], pa.int64()), pa.array([0 if i else n], pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if rows and rows[0]["part"] != r["part"]:
                    yield from close(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield from close(rows)

    summed = (named.repartition(partitions, "part").sortWithinPartitions("part")
              .mapInArrow(run, "block long, row long, part long, words binary, pairs binary, v long, n long"))
    return materialise(summed, "lm-totals")


def score_documents(docs: DataFrame, folds: int = 7, fold: int = 2, mu: float = MU, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), log10 probabilities of whole texts.

    The model learns from the documents whose crc32(id as text) mod `folds` is not `fold`.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = kept.schema["doc_id"].dataType
    blocks = _cut(kept, block_bytes)
    n_blocks = max(1, blocks.select(F.count_distinct("block")).first()[0])
    ranges = RANGES_PER_BLOCK * n_blocks
    # Few ranges or blocks a task: a task's batches hold whole rows of packed hashes.
    totals = _totals(_named(blocks, folds, fold, ranges), -(-ranges // 4))
    v, n = totals.agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def close(block: _Block, words: list[bytes], pairs: list[bytes]) -> Iterator[pa.RecordBatch]:
        block.count()
        block.take_totals(*(np.concatenate([_values(x) for x in back]).astype(np.int64) for back in (words, pairs)))
        ids, held, tokens, known, base, score = zip(*block.score(n, v, mu), strict=True)
        yield pa.record_batch([pa.array(ids, to_arrow_type(id_type)), pa.array(held), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                               pa.array([n] * len(ids), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())],
                              names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Per block first the totals, by the first row counted and the range, then the texts by row.
        at, back, open_, block = None, {}, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                b, kind, row, _, words, pairs, doc_id, text = (c[i].as_py() for c in batch.columns)
                if b != at or (kind == 1 and row in back):
                    if block:
                        yield from close(block, *back.pop(open_))
                        block = None
                    if b != at:
                        at, back = b, {}
                if kind == 0:
                    held = back.setdefault(row, ([], []))
                    held[0].append(words)
                    held[1].append(pairs)
                else:
                    if block is None:
                        open_, block = row, _Block()
                    block.add(doc_id, text, is_held_out(doc_id, folds, fold))
        if block:
            yield from close(block, *back.pop(open_))

    none, no_bytes = F.lit(None).cast("long"), F.lit(None).cast("binary")
    entries = totals.select("block", F.lit(0).alias("kind"), "row", "part", "words", "pairs", F.lit(None).cast(id_type).alias("doc_id"),
                            no_bytes.alias("text"))
    texts = blocks.select("block", F.lit(1).alias("kind"), "row", none.alias("part"), no_bytes.alias("words"), no_bytes.alias("pairs"),
                          "doc_id", "text")
    return (entries.unionByName(texts).repartition(-(-n_blocks // 2), "block").sortWithinPartitions("block", "kind", "row", "part")
            .mapInArrow(run, f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                             "base_score double, score double"))
