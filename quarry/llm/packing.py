"""Packing tokenised documents into sequences by swap-based local search.

A document's ids and an end id form one item, or several pieces if it is longer
than a sequence. The pieces' lengths are dealt round-robin into blocks of about
`BLOCK_PIECES` (`BLOCK_TOKENS` where ids are carried), and each block is packed
by one task; best fit by decreasing length gives a start, then local search
works on the bins that are not full. It takes the emptiest bin and gives its
documents away: one or two for none, one or two smaller ones of a bin at least as
full, each of which raises the squared fill, until the bin is empty and goes.
Open bins are indexed by their room under every such sum, so all of them are
asked. It stops at the block's lower bound (tokens / capacity) or when no bin
has an improving exchange any more. Blocks are dealt by row, never by key, so no
document id or length can load one task. The underfull bins of all blocks are
then dealt anew, as whole bins, and searched again in further rounds, until one
block holds them or a round saves no bin.

Tokens come from `encoding`: each distinct white-space separated part is encoded
once per worker while the worker remembers it.

Defined cases: a null or empty text is the end id alone; a null id is an id
like any other; repeated rows are documents of their own; an empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise
from quarry.llm.encoding import encoder, slices, with_end

CAPACITY = 4096
END_ID = 1
BLOCK_PIECES = 32768
BLOCK_TOKENS = 4_000_000


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the items to pack; `ids` are little-endian 32-bit bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                ids, sizes = with_end(*encode.encode(texts), end_id)
                counts = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(length) * 4
                cut = [raw[b - 4 * n:b] for b, n in zip(ends.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(first + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                           pa.array([zlib.crc32(c) for c in cut], pa.int64())]
                yield pa.record_batch(columns + ([pa.array(cut, pa.binary())] if with_ids else []), names=names)

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    return kept.mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indexes into `lengths`, which must be in decreasing order."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set where some bin has room r
    for i, n in enumerate(lengths):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at].append(i)
            room -= n
        else:
            at, room = len(bins), capacity - n
            bins.append([i])
        if room:
            by_room.setdefault(room, []).append(at)
            rooms |= 1 << room
    return bins


def _sums(members: list[int], lengths: list[int]) -> np.ndarray:
    """The sums of none, one and two documents of a bin, each once."""
    found, counts = np.unique([lengths[i] for i in members], return_counts=True)
    pairs = (found[:, None] + found)[np.triu_indices(len(found), 1)]
    return np.unique(np.concatenate([[0], found, pairs, 2 * found[counts > 1]]))


def _members(total: int, members: list[int], lengths: list[int]) -> list[int]:
    """None, one or two documents of a bin whose lengths add up to `total`, one of its `_sums`."""
    if not total:
        return []
    seen: dict[int, int] = {}
    pair: list[int] = []
    for i in members:
        n = lengths[i]
        if n == total:
            return [i]
        if not pair and total - n in seen:
            pair = [seen[total - n], i]
        seen.setdefault(n, i)
    return pair


class _Rooms:
    """Bins by room, per sum that a bin can give back for what it takes."""

    def __init__(self, capacity: int, bins: int) -> None:
        self.bins = bins
        self.by_sum: dict[int, list[int]] = {}  # room * bins + bin, ascending
        self.reach = np.full(capacity + 1, -1, np.int64)  # the largest sum that some bin takes for this one

    def _set_reach(self, total: int, keys: list[int]) -> None:
        self.reach[total] = total + keys[-1] // self.bins if keys else -1

    def add(self, at: int, room: int, sums: np.ndarray) -> None:
        for total in sums.tolist():
            insort(keys := self.by_sum.setdefault(total, []), room * self.bins + at)
            self._set_reach(total, keys)

    def remove(self, at: int, room: int, sums: np.ndarray) -> None:
        for total in sums.tolist():
            keys = self.by_sum[total]
            del keys[bisect_left(keys, room * self.bins + at)]
            self._set_reach(total, keys)

    def best(self, sums: np.ndarray) -> tuple[int, int, int] | None:
        """The largest net gift: the sum given, the sum taken back, and the bin whose room is the closest."""
        back = np.searchsorted(np.maximum.accumulate(self.reach), sums)
        gift = sums - back
        n = int(np.argmax(gift))
        if gift[n] <= 0:
            return None
        keys = self.by_sum[int(back[n])]
        return int(sums[n]), int(back[n]), keys[bisect_left(keys, int(gift[n]) * self.bins)] % self.bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search over the bins that are not full; never returns more bins than it was given."""
    bins = [list(b) for b in bins]
    room = [capacity - sum(lengths[i] for i in b) for b in bins]
    left, bound = len(bins), -(-sum(capacity - r for r in room) // capacity)
    sums = {x: _sums(b, lengths) for x, b in enumerate(bins) if room[x]}
    changed = True
    while changed and left > bound:
        changed = False
        rooms = _Rooms(capacity, len(bins))
        for x in sums:
            rooms.add(x, room[x], sums[x])
        donors = [(-room[x], x) for x in sums]
        heapify(donors)
        # Only bins at least as full as the donor take: so each exchange raises the squared fill, and the search ends.
        level, settled = None, []
        failed: set[tuple[int, ...]] = set()  # lengths of donors that found nothing since the last exchange
        while donors and left > bound:
            at = heappop(donors)
            donor = at[1]
            if donor not in sums or at[0] != -room[donor]:
                continue
            if at[0] != level:
                for x in settled:
                    if x in sums and room[x] == -level:
                        rooms.remove(x, room[x], sums[x])
                level, settled = at[0], []
            mark = tuple(sorted(lengths[i] for i in bins[donor]))
            if mark in failed:
                settled.append(donor)
                continue
            rooms.remove(donor, room[donor], sums[donor])
            gave = False
            while bins[donor] and (found := rooms.best(sums[donor])):
                given, back, to = found
                there, here = _members(given, bins[donor], lengths), _members(back, bins[to], lengths)
                rooms.remove(to, room[to], sums[to])
                bins[donor] = [i for i in bins[donor] if i not in there] + here
                bins[to] = [i for i in bins[to] if i not in here] + there
                room[donor] += given - back
                room[to] -= given - back
                if room[to]:
                    sums[to] = _sums(bins[to], lengths)
                    rooms.add(to, room[to], sums[to])
                    heappush(donors, (-room[to], to))
                else:
                    del sums[to]
                sums[donor] = _sums(bins[donor], lengths)
                gave = changed = True
            if gave:
                failed.clear()
                if not bins[donor]:
                    del sums[donor]
                    left -= 1
            else:
                failed.add(mark)
                rooms.add(donor, room[donor], sums[donor])
                settled.append(donor)
    return [b for b in bins if b]


def _pack_block(capacity: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows.column("length").to_pylist()
        start = best_fit(lengths, capacity)
        if "sequence_id" in rows.column_names:  # bins of an earlier round, unless fewer do
            bins: dict[int, list[int]] = {}
            for i, n in enumerate(rows.column("sequence_id").to_pylist()):
                bins.setdefault(n, []).append(i)
            start = min(list(bins.values()), start, key=len)
            rows = rows.drop_columns(["sequence_id", "offset", "sequence_length"])
        packed = improve(start, lengths, capacity)
        sequence, offset, filled = (np.empty(len(lengths), np.int64) for _ in range(3))
        base = (turn << 54) + (TaskContext.get().partitionId() << 32)
        for n, members in enumerate(packed):
            at = 0
            for i in members:
                sequence[i], offset[i] = base + n, at
                at += lengths[i]
            filled[members] = at
        rows = rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        rows = rows.append_column("sequence_length", pa.array(filled))
        yield from rows.combine_chunks().to_batches(max_chunksize=8192)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`items` (from `pieces`, written to the shared folder here) with sequence_id and offset."""
    items = materialise(items, "pack-pieces")
    size = F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))
    n, tokens = items.agg(*size).first()

    def blocks(n: int, tokens: int) -> int:
        return max(1, -(-n // BLOCK_PIECES), -(-tokens // BLOCK_TOKENS) if "ids" in items.columns else 1)

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long, sequence_length long"
    parts, turn = blocks(n, tokens), 0
    packed = items.repartition(parts).mapInArrow(_pack_block(capacity, turn), columns)
    done, given, starts = [], None, F.count_if(F.col("offset") == 0)
    while parts > 1:
        # Underfull bins of all blocks meet again, whole, until a round saves none.
        made = materialise(packed, f"pack-{turn}")
        done.append(made.where(F.col("sequence_length") == capacity))
        packed = made.where(F.col("sequence_length") < capacity)
        if made.agg(starts).first()[0] == given:
            break
        n, tokens, given = packed.agg(*size, starts).first()
        if given <= -(-tokens // capacity):
            break
        turn += 1
        parts = blocks(n, tokens)
        packed = packed.repartition(parts, F.xxhash64("sequence_id", F.lit(turn))).mapInArrow(_pack_block(capacity, turn), columns)
    for part in done:
        packed = packed.unionByName(part)
    return packed.drop("sequence_length")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from `pack` over pieces with ids: sequence_id, ids, documents.

    A sequence has `capacity` ids at most, so a group is bounded.
    """
    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("p"))
    return grouped.select("sequence_id", F.expr("aggregate(p, CAST('' AS BINARY), (a, x) -> concat(a, x.ids))").alias("ids"),
                          F.expr("transform(p, x -> named_struct('doc_id', x.doc_id, 'piece', x.piece, 'offset', x.offset, 'length', x.length))")
                          .alias("documents"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), one row per piece."""
    return pack(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), capacity)
