"""Token ids as grammar-compressed binary blocks with random access.

Documents are encoded whole and laid end to end by ascending id. A range
partitioning gives contiguous runs, each task cuts its run's ids into blocks of
about `BLOCK_IDS`, and a block is compressed by Re-Pair: the pairs of
neighbours that occur most often become nonterminals, again and again, until no
pair is frequent. A round takes the pairs of the highest counts together (down
to a `SHARE` of the top count) and where two overlap, the more frequent one
wins; so a round costs one pass of numpy over what is left of the block.

The file format is one row per block: `rules` (two symbols a nonterminal, in
order of their making), `spans` (ids that a nonterminal expands to), `symbols`
(the compressed ids), the documents' ids, and where each document ends in the block. Symbols are little-endian
numbers of `width` bytes; symbols below `base` are token ids. The expansion
lengths give the place of every symbol, so `decode_range` finds any
ids by binary search and expands only the symbols that cover them.

Blocks are written as a Parquet table in the shared folder and committed by
Spark's writer, so a lost executor costs its tasks. One total per run comes
before the places of its documents; no text or id goes through the driver.

Defined cases: a null or empty text is the end id alone; null ids come first;
rows of one id are ordered by the text's hash, and equal rows are documents of
their own; a very long text lies in one block, however large; an empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.encoding import encoder, gather, slices, with_end
from quarry.session import scratch_path

END_ID = 1
BLOCK_IDS = 1 << 20
#: A rule must replace so many pairs of its block.
LEAST = 16
#: A round takes pairs down to this share of the highest count.
SHARE = 1 / 1024
#: Rounds stop when one replaces less than this share of the symbols.
WORTH = 0.03
_BUCKETS = 1 << 20
_MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def _frequent(left: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys there) of the pairs whose bucket holds at least `least` pairs: all frequent ones and few others."""
    buckets = (left * _MIX[0] + right * _MIX[1]) >> np.uint32(12)
    hot = np.bincount(buckets, minlength=_BUCKETS) >= least
    places = np.flatnonzero(hot[buckets])
    return places, (left[places].astype(np.uint64) << np.uint64(32)) | right[places]


def _round(symbols: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The symbols with the most frequent pairs replaced by new ones from `base` on, and the pairs; None if none is frequent."""
    if len(symbols) < 2:
        return None
    places, found = _frequent(symbols[:-1], symbols[1:], LEAST)
    which, pairs = pd.factorize(found)
    counts = np.bincount(which, minlength=len(pairs))
    if not len(pairs) or counts.max() < LEAST:
        return None
    taken = np.flatnonzero(counts >= max(LEAST, int(counts.max() * SHARE)))
    # Of two pairs that share a symbol the more frequent wins; equal counts fall to the smaller pair.
    order = taken[np.lexsort((pairs[taken], -counts[taken]))]
    pairs, rank = pairs[order], np.full(len(counts), -1, np.int64)
    rank[order] = np.arange(len(order))
    mine = rank[which]
    chosen = mine >= 0
    places, mine = places[chosen], mine[chosen]
    beside = np.diff(places) == 1
    same = beside & (mine[1:] == mine[:-1])
    # In a run of one symbol every other pair counts.
    at = np.arange(len(places))
    first = at.copy()
    first[1:][same] = 0
    odd = (at - np.maximum.accumulate(first)) % 2 == 1
    wins = ~odd
    lost = np.zeros(len(places), bool)
    lost[1:] |= beside & (mine[:-1] < mine[1:])
    lost[:-1] |= beside & (mine[1:] < mine[:-1])
    wins &= ~lost
    places, mine = places[wins], mine[wins]
    good = np.bincount(mine, minlength=len(pairs)) >= LEAST
    if not good.any():
        return None
    wins = good[mine]
    places, mine = places[wins], mine[wins]
    number = np.cumsum(good) - 1
    out = symbols.copy()
    out[places] = (base + number[mine]).astype(out.dtype)
    keep = np.ones(len(out), bool)
    keep[places + 1] = False
    kept = pairs[good]
    return out[keep], np.stack([kept >> np.uint64(32), kept & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)


def compress(ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(base, rules, spans, symbols) of a block's ids."""
    base = int(ids.max()) + 1 if len(ids) else 0
    symbols, rules, spans = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)], np.zeros(0, np.int64)
    while found := _round(symbols, base + len(spans)):
        before, (symbols, new) = len(symbols), found
        rules.append(new)
        spans = np.concatenate([spans, _spans(new, base, spans).sum(axis=1)])
        if before - len(symbols) < WORTH * before:
            break
    return base, np.concatenate(rules), spans, symbols


def _spans(symbols: np.ndarray, base: int, spans: np.ndarray) -> np.ndarray:
    """The number of ids that each symbol expands to."""
    if not len(spans):
        return np.ones(symbols.shape, np.int64)
    return np.where(symbols < base, 1, spans[np.maximum(symbols.astype(np.int64) - base, 0)])


def _unfold(symbols: np.ndarray, base: int, rules: np.ndarray) -> np.ndarray:
    """Each nonterminal replaced by its pair until none is left."""
    while (high := symbols >= base).any():
        out = np.repeat(symbols, 1 + high)
        at = np.cumsum(1 + high) - 1 - high
        pairs = rules[symbols[high] - base]
        out[at[high]], out[at[high] + 1] = pairs[:, 0], pairs[:, 1]
        symbols = out
    return symbols


def expand(symbols: np.ndarray, base: int, rules: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The ids behind symbols: the nonterminals that occur are unfolded once each, then all ids are gathered."""
    high = symbols >= base
    if not high.any():
        return symbols
    used, which = np.unique(symbols[high] - base, return_inverse=True)
    pool = _unfold((base + used).astype(np.uint32), base, rules)
    lengths = np.ones(len(symbols), np.int64)
    starts = np.arange(len(pool), len(pool) + len(symbols))
    lengths[high] = spans[used][which]
    starts[high] = (np.cumsum(spans[used]) - spans[used])[which]
    return np.concatenate([pool, symbols])[gather(starts, lengths)]


def decode_range(base: int, rules: np.ndarray, spans: np.ndarray, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The ids [start, stop) of a block: only the symbols that cover them are expanded."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    ends = np.cumsum(_spans(symbols, base, spans))
    low, high = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left"))
    before = int(ends[low - 1]) if low else 0
    return expand(symbols[low:high + 1], base, rules, spans)[start - before:stop - before]


def pack_numbers(numbers: np.ndarray, width: int) -> bytes:
    """Little-endian numbers of `width` bytes."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def unpack_numbers(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 4), np.uint8)
    out[:, :width] = raw
    return out.view("<u4").reshape(-1)


class Block:
    """A block as read from a file."""

    def __init__(self, row: dict) -> None:
        width = row["width"]
        self.base = row["base"]
        self.rules = unpack_numbers(row["rules"], width).reshape(-1, 2)
        self.symbols = unpack_numbers(row["symbols"], width)
        self.spans = np.frombuffer(row["spans"], "<u4").astype(np.int64)

    def all_ids(self) -> np.ndarray:
        return expand(self.symbols, self.base, self.rules, self.spans)

    def ids(self, start: int, stop: int) -> np.ndarray:
        return decode_range(self.base, self.rules, self.spans, self.symbols, start, stop)


_FORMAT = ("run int, block int, ids_before long, n_ids long, base int, width int, rules binary, "
           "spans binary, symbols binary, docs array<{0}>, ends array<long>")


def _blocks(tokenizer_path: str, end_id: int, block_ids: int, id_type: pa.DataType):
    names = [f.strip().split(" ")[0] for f in _FORMAT.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        docs: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        number, before = 0, 0

        def close(ids: np.ndarray, of_docs: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
            nonlocal number, before
            base, rules, spans, symbols = compress(ids)
            width = 2 if base + len(spans) <= 1 << 16 else 3 if base + len(spans) <= 1 << 24 else 4
            values = [part, number, before, len(ids), base, width, pack_numbers(rules.reshape(-1), width),
                      spans.astype("<u4").tobytes(), pack_numbers(symbols, width)]
            number, before = number + 1, before + len(ids)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            columns = [pa.array([v], t) for v, t in zip(values, kinds, strict=True)]
            columns += [pa.ListArray.from_arrays(pa.array([0, len(of_docs)], pa.int32()), c) for c in (of_docs, pa.array(np.cumsum(sizes)))]
            return pa.record_batch(columns, names=names)

        for batch in batches:
            for first, texts in slices(batch.column(1)):
                ids, sizes = with_end(*encode.encode(texts), end_id)
                held.append(ids)
                docs.append(batch.column(0).slice(first, len(texts)))
                lengths.append(sizes)
                if sum(map(len, held)) < block_ids:
                    continue
                ids, of_docs, sizes = np.concatenate(held), pa.concat_arrays(docs), np.concatenate(lengths)
                ends = np.cumsum(sizes)
                low = at = 0
                # A block ends with the document that fills it; what is left waits for the next texts.
                while at < len(sizes) and ends[-1] - low >= block_ids:
                    stop = int(np.searchsorted(ends, low + block_ids, side="left")) + 1
                    yield close(ids[low:ends[stop - 1]], of_docs.slice(at, stop - at), sizes[at:stop])
                    low, at = int(ends[stop - 1]), stop
                held, docs, lengths = [ids[low:]], [of_docs.slice(at)], [sizes[at:]]
        if sum(map(len, held)):
            yield close(np.concatenate(held), pa.concat_arrays(docs), np.concatenate(lengths))

    return run


def write_blocks(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write their ids to `path` in the format above, by ascending id."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Equal ids are spread over ranges by hash and row number.
    order = ["doc_id", "hash", "nth"]
    ordered = kept.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("nth"))
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    kind = ordered.schema["doc_id"].dataType
    run = _blocks(tokenizer_path, end_id, block_ids, to_arrow_type(kind))
    ordered.mapInArrow(run, _FORMAT.format(kind.simpleString())).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]): every document as read from the files; `ids` are little-endian 32-bit bytes."""
    blocks = spark.read.parquet(path)
    # One row per run, and a run is a partition of the writing job: a proven bound for the broadcast.
    totals = blocks.groupBy("run").agg(F.sum("n_ids").alias("n"))
    runs = totals.select(F.col("run").alias("its_run"), F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)),
                                                                   F.lit(0)).alias("run_start"))
    placed = blocks.join(F.broadcast(runs), F.col("run") == F.col("its_run")).select((F.col("run_start") + F.col("ids_before")).alias("block_start"), "base", "width",
                                                                         "rules", "spans", "symbols", "docs", "ends")
    kind = blocks.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("block_start", "base", "width", "rules", "spans", "symbols")}
                docs, ends = (batch.column(n)[i].values for n in ("docs", "ends"))
                ends = ends.to_numpy()
                sizes, raw = np.diff(ends, prepend=0), Block(row).all_ids().astype("<u4").tobytes()
                cut = [raw[4 * (b - n):4 * b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [docs, pa.array(row["block_start"] + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(c) for c in cut], pa.int64())]
                yield pa.record_batch(columns + ([pa.array(cut, pa.binary())] if with_ids else []),
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return placed.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def read_documents(spark: SparkSession, path: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the documents in `wanted` alone: found by the ids and ends of all blocks, and only their ids are expanded."""
    ids = wanted.select(F.col(id_col).alias("wanted")).distinct()
    blocks = spark.read.parquet(path)
    found = (blocks.select("run", "block", F.posexplode("docs").alias("nth", "doc_id"), "ends")
             .join(ids, F.col("doc_id") == F.col("wanted"), "left_semi"))
    start = F.when(F.col("nth") == 0, F.lit(0)).otherwise(F.expr("get(ends, nth - 1)"))
    places = (found.groupBy("run", "block")
              .agg(F.collect_list(F.struct("doc_id", start.alias("start"), F.expr("ends[nth]").alias("stop"))).alias("places")))
    met = blocks.join(places, ["run", "block"]).select("base", "width", "rules", "spans", "symbols", "places")
    kind = blocks.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("places").type.value_type.field("doc_id").type
            for row in batch.to_pylist():
                block = Block(row)
                found = [(p["doc_id"], block.ids(p["start"], p["stop"]).astype("<u4").tobytes()) for p in row["places"]]
                yield pa.record_batch([pa.array([d for d, _ in found], id_type), pa.array([x for _, x in found], pa.binary())], names=["doc_id", "ids"])

    return met.mapInArrow(run, f"doc_id {kind}, ids binary")


def token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write all documents' ids (to a table in the shared folder, or `path`) and read them back."""
    path = path or scratch_path(docs.sparkSession, "token-ids")
    write_blocks(docs, path, tokenizer_path)
    return read_ids(docs.sparkSession, path)
