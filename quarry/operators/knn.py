"""Exhaustive k-nearest-neighbour joins: inner product (dense) and Hamming (binary).

Questions are dealt into blocks, vectors into slabs, and every (block, slab) pair
is a tile that one task works on::

    questions --one row per slab--+
                                  +-- Exchange(tile) -- Sort(tile, side) -- mapInArrow kernel
    vectors ---one row per block--+                                             |
                                                              partial top-k per tile and question
                                                                                |
                                         Exchange(qid) -- Window row_number() <= k -- rerank

A tile's questions come first in the sorted stream and are held as one matrix; its
vectors then stream past it in Arrow batches, so a slab may have any size. The number
of blocks is the question count over the rows that a task may hold (a scalar
subquery of the same plan, so nothing runs when the plan is built and nothing comes
to the driver), and slabs are added until there are a few tiles per core (at most as many
as shuffle partitions). The question side is thus written about (tiles x rows of
a block) times at most, and the vectors once per block; codes go in rows of many, as packed
arrays. The scores of a tile never become rows: the merging shuffle carries tiles x
questions of a block x k rows.

Ties are broken as the SQL form does (primary key, then passage id ascending), so the
result equals ``row_number() over (partition by qid order by ...)`` on the cross product.
A null vector is no question and no passage. A pair whose inner product is NaN is never
a hit; in a rerank NaN scores come last. Both hold for every batch size and tiling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD_BITS = 32
# What a task holds of a question block: its rows x (vector bytes + k running candidates of ~40 bytes).
BLOCK_BYTES = 256 * 1024 * 1024
BLOCK_ROWS = 8192
# A binary tile holds up to four times k unsorted candidates of about 22 bytes beyond these.
_CANDIDATE_BYTES = 48
# Tiles per core that slabs are added for: more of them even out the tasks, fewer spare the merge.
TILES_PER_CORE = 4
# Questions of a block that are few enough: packed codes are cheap to write once more for another block,
# while another slab gives every question of a block k more candidates.
FEW_ROWS = 1024
# Codes that one row carries from the code table to its tiles.
PACK_ROWS = 512
# Cap on score-matrix cells materialised at once inside a task (float64 cells),
# assuming Arrow batches of up to _BATCH_ROWS rows (Spark's default batch size).
_CELL_BUDGET = 1 << 20
_BATCH_ROWS = 10_000
_Q_STEP = max(1, _CELL_BUDGET // _BATCH_ROWS)
# Questions and codes whose distances a binary tile takes at once: their differing bits stay in a core's cache.
_RUN_ROWS, _RUN_CODES = 32, 1024
# So many runs of codes are searched together for what is within the bounds.
_LONG_RUN = 8
# Codes that a binary tile gathers before its questions meet them.
_GATHERED_CODES = 1 << 16


# ----------------------------------------------------------------------------
# numpy helpers (run inside Python workers)
# ----------------------------------------------------------------------------

def unpack_sign_matrix(words: np.ndarray, dim: int, dtype=np.float32) -> np.ndarray:
    """(n, W) int64 words holding 32-bit values -> (n, dim) matrix of +1/-1."""
    idx = np.arange(dim)
    w = idx // WORD_BITS
    width = np.minimum(WORD_BITS, dim - w * WORD_BITS)
    shift = (width - 1 - (idx - w * WORD_BITS)).astype(np.int64)
    bits = (words[:, w] >> shift) & 1
    return (bits * 2 - 1).astype(dtype)


def sign_matrix(vectors: np.ndarray, dtype=np.float32) -> np.ndarray:
    """float vectors -> +1/-1 (negative -> -1; zero, -0.0 and NaN -> +1)."""
    return np.where(vectors < 0, -1, 1).astype(dtype)


def list_column_matrix(col: pa.Array, width: int | None, dtype) -> np.ndarray:
    """Arrow list<x> column with equal-length rows -> dense (n, width) matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if col.null_count:
        raise ValueError("vector column contains nulls; drop them first (see valid_rows)")
    lengths = pa.compute.list_value_length(col).to_numpy(zero_copy_only=False)
    if n == 0:
        return np.zeros((0, width or 0), dtype=dtype)
    if width is None:
        width = int(lengths[0])
    if not np.all(lengths == width):
        raise ValueError(f"vector rows must all have length {width}")
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(n, width)


def valid_rows(ids: pa.Array, col: pa.Array):
    """Rows whose vector is not null (sorted out in the kernel: a Spark-side filter on a
    derived vector would be pushed below the shuffle and run the encoder twice)."""
    if col.null_count == 0:
        return ids, col
    mask = col.is_valid()
    return ids.filter(mask), col.filter(mask)


def select_topk(rows: np.ndarray, keys: list[np.ndarray], k: int) -> np.ndarray:
    """Indices of the best k entries per row; ``keys`` are ascending sort keys
    (most significant first, the last one must make the order total)."""
    if rows.size == 0:
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort(tuple(reversed(keys)) + (rows,))
    sorted_rows = rows[order]
    starts = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
    run_start = np.repeat(starts, np.diff(np.r_[starts, sorted_rows.size]))
    pos = np.arange(sorted_rows.size) - run_start
    return order[pos < k]


def candidate_cells(primary: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, col) of all cells whose primary key is at most the row's k-th smallest.

    Cells tied with the k-th value are all kept, so an exact tie-break can run
    afterwards on a small set. NaN cells are never kept."""
    if np.issubdtype(primary.dtype, np.floating):
        usable = ~np.isnan(primary)
        primary = np.where(usable, primary, np.inf)
    else:
        usable = np.ones(primary.shape, dtype=bool)
    if primary.shape[1] > k:
        kth = np.partition(primary, k - 1, axis=1)[:, k - 1]
        usable &= primary <= kth[:, None]
    return np.nonzero(usable)


class _Running:
    """Candidates (question row, passage id, keys...) of one question sub-block, trimmed to k per question.

    A question that has k of them bounds what may still enter: the k-th primary key and,
    among equals, the k-th id. Later vectors meet this bound before anything is sorted."""

    def __init__(self, names: list[str], key_names: list[str], k: int, n_rows: int):
        self.names, self.key_names, self.k = names, key_names, k
        self.cols = {n: np.zeros(0, dtype=np.float64 if n in ("neg", "score") else np.int64) for n in names}
        self.full = np.zeros(n_rows, dtype=bool)
        self.bound, self.bound_id = np.full(n_rows, np.nan), np.zeros(n_rows, dtype=np.int64)

    def cells(self, primary: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, col) of the cells of a batch that may enter; NaN never does."""
        rows, cols = np.divmod(np.flatnonzero(primary <= self.bound.astype(primary.dtype)[:, None]), primary.shape[1])
        below = (primary[rows, cols] < self.bound[rows]) | (ids[cols] < self.bound_id[rows])
        rows, cols = rows[below], cols[below]
        short = np.flatnonzero(~self.full)
        if len(short):
            r, c = candidate_cells(primary[short], self.k)
            rows, cols = np.concatenate([rows, short[r]]), np.concatenate([cols, c])
        return rows, cols

    def add(self, **cols) -> None:
        if not len(cols["row"]):
            return
        self.cols = {n: np.concatenate([self.cols[n], cols[n]]) for n in self.names}
        keep = select_topk(self.cols["row"], [self.cols[n] for n in self.key_names], self.k)
        self.cols = {n: v[keep] for n, v in self.cols.items()}
        counts = np.bincount(self.cols["row"], minlength=len(self.full))
        self.full = counts >= self.k
        last = (np.cumsum(counts) - 1)[self.full]
        self.bound[self.full] = self.cols[self.key_names[0]][last]
        self.bound_id[self.full] = self.cols["id"][last]


class _DenseTile:
    """Running inner-product top-k of one tile."""

    fields = (("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64()))

    def __init__(self, qids: np.ndarray, matrix: np.ndarray, k: int, dim: int | None):
        self.qids, self.q = qids, matrix
        self.state = {r: _Running(["row", "id", "neg"], ["neg", "id"], k, len(qids[r:r + _Q_STEP])) for r in range(0, len(qids), _Q_STEP)}

    def batch(self, ids: np.ndarray, col: pa.Array) -> None:
        p = list_column_matrix(col, self.q.shape[1], np.float64)
        for r, state in self.state.items():
            neg = -(self.q[r:r + _Q_STEP] @ p.T)
            rows, cols = state.cells(neg, ids)
            state.add(row=rows, id=ids[cols], neg=neg[rows, cols])

    def result(self):
        for r, state in self.state.items():
            c = state.cols
            yield [self.qids[r + c["row"]], c["id"], -c["neg"]]


def code_words(words: np.ndarray, dim: int) -> np.ndarray:
    """(n, W) int64 words of 32 bits -> (ceil(W / 2), n) uint64, two words in one; bits beyond ``dim`` are none."""
    n_words = -(-dim // WORD_BITS)
    widths = np.minimum(WORD_BITS, dim - np.arange(n_words) * WORD_BITS)
    words = (words[:, :n_words] & ((1 << widths) - 1)).astype(np.uint64)
    out = np.zeros((-(-n_words // 2), len(words)), dtype=np.uint64)
    for w in range(n_words):
        out[w // 2] |= words[:, w] << np.uint64(WORD_BITS * (1 - w % 2))
    return out


def sign_words(vectors: np.ndarray) -> np.ndarray:
    """(n, dim) vectors -> the words of their sign codes, laid out as `code_words` has them."""
    n, dim = vectors.shape
    idx = np.arange(dim)
    width = np.minimum(WORD_BITS, dim - idx // WORD_BITS * WORD_BITS)
    bit = (width - 1 - idx % WORD_BITS).astype(np.uint64)
    words = np.zeros((n, -(-dim // WORD_BITS)), dtype=np.int64)
    for i in range(dim):
        words[:, i // WORD_BITS] |= np.where(vectors[:, i] < 0, 0, 1) << int(bit[i])
    return code_words(words, dim)


def true_cells(mask: np.ndarray) -> np.ndarray:
    """`np.flatnonzero` of a contiguous mask with few true cells: 64 cells are passed over at a time."""
    flat = mask.reshape(-1)
    whole = len(flat) // 64 * 64
    bits = np.packbits(flat[:whole]).reshape(-1, 8)
    some = np.flatnonzero(bits.view(np.uint64).reshape(-1))
    row, bit = np.divmod(np.flatnonzero(np.unpackbits(bits[some], axis=1)), 64)
    return np.concatenate([some[row] * 64 + bit, whole + np.flatnonzero(flat[whole:])])


class _Nearest:
    """The k nearest codes of a run of questions, ties by id, kept as candidates in the order found.

    ``bound`` is the distance of a question's k-th nearest so far: counts of its candidates by
    distance tell it without sorting. Candidates are sorted when there are many more than needed;
    from then on a code at the bound must also have a lower id than the k-th."""

    def __init__(self, n_rows: int, k: int, dim: int, n_words: int):
        self.k, self.dim = k, dim
        self.counts = np.zeros((n_rows, dim + 1), dtype=np.int64)
        self.kind = np.uint8 if dim < 256 else np.int64
        self.bound = np.full(n_rows, dim, dtype=self.kind)
        self.last_id = np.full(n_rows, np.iinfo(np.int64).max)
        self.row, self.distance, self.id = (np.zeros(0, t) for t in (np.int32, self.kind, np.int64))
        self.words = np.zeros((n_words, 0), dtype=np.uint64)
        self.found: list[tuple] = []
        self.waiting = self.held = 0
        self.trimmed = False

    @property
    def open(self) -> bool:
        """Whether no question has a bound yet."""
        return not self.held or int(self.bound.min()) == self.dim

    def _bounds(self, counts: np.ndarray) -> np.ndarray:
        nearer = np.cumsum(counts, axis=1)
        return np.where(nearer[:, -1] >= self.k, (nearer >= self.k).argmax(axis=1), self.dim).astype(self.kind)

    def _places(self, row: np.ndarray, distance: np.ndarray) -> np.ndarray:
        return row.astype(np.int64) * (self.dim + 1) + distance

    def _lower(self, counts: np.ndarray) -> None:
        bound = np.minimum(self.bound, self._bounds(counts))
        self.last_id[bound < self.bound] = np.iinfo(np.int64).max
        self.bound = bound

    def start(self, distance: np.ndarray) -> None:
        """Bounds from the distances of a run of codes alone, before they are added."""
        n, width = len(distance), self.dim + 1
        self._lower(np.bincount((distance + np.arange(n)[:, None] * width).reshape(-1), minlength=n * width).reshape(n, width))

    def add(self, row: np.ndarray, distance: np.ndarray, ids: np.ndarray, words: np.ndarray) -> None:
        if self.trimmed:
            enters = (distance < self.bound[row]) | (ids <= self.last_id[row])
            row, distance, ids, words = row[enters], distance[enters], ids[enters], words[:, enters]
        self.found.append((row, distance, ids, words))
        self.counts += np.bincount(self._places(row, distance), minlength=self.counts.size).reshape(self.counts.shape)
        self.waiting += len(row)
        self.held += len(row)
        if self.held > 4 * self.k * len(self.bound):
            self.trim()
        elif self.waiting > self.k * len(self.bound) // 4:
            self.tighten()

    def tighten(self) -> None:
        self.waiting = 0
        self._lower(self.counts)

    def trim(self) -> None:
        """Sort the candidates and keep k per question."""
        self.tighten()
        kept = [(self.row, self.distance, self.id, self.words), *self.found]
        row, distance, ids = (np.concatenate([x[i] for x in kept]) for i in range(3))
        words = np.concatenate([x[3] for x in kept], axis=1)
        near = np.flatnonzero(distance <= self.bound[row])
        order = near[np.lexsort((ids[near], self._places(row[near], distance[near])))]
        at = np.searchsorted(row[order], np.arange(len(self.bound) + 1))
        order = order[np.arange(len(order)) - at[row[order]] < self.k]
        self.row, self.distance, self.id, self.words, self.found = row[order], distance[order], ids[order], words[:, order], []
        self.held = len(order)
        counts = np.bincount(self.row, minlength=len(self.bound))
        self.counts = np.bincount(self._places(self.row, self.distance), minlength=self.counts.size).reshape(self.counts.shape)
        full = counts >= self.k
        self.last_id[full] = self.id[(np.cumsum(counts) - 1)[full]]
        self.trimmed = True


class _BinaryTile:
    """Running Hamming top-k of one tile; only what is left at its end is scored."""

    fields = (("qid", pa.int64()), ("id", pa.int64()), ("distance", pa.int64()), ("score", pa.float64()))

    def __init__(self, qids: np.ndarray, matrix: np.ndarray, k: int, dim: int, with_score: bool):
        self.qids, self.dim, self.with_score = qids, dim, with_score
        self.q, self.words = matrix, sign_words(matrix)
        self.state = {r: _Nearest(len(qids[r:r + _RUN_ROWS]), k, dim, len(self.words)) for r in range(0, len(qids), _RUN_ROWS)}
        self.gathered: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_gathered = 0
        # What meets at a time, in memory that is used again.
        kind = np.uint8 if dim < 256 else np.int64
        self.bits, self.distance, self.mask = (np.empty(n * _RUN_ROWS * _RUN_CODES, dtype=t)
                                               for n, t in ((1, np.uint64), (_LONG_RUN, kind), (_LONG_RUN, bool)))

    def batch(self, ids: np.ndarray, words: np.ndarray) -> None:
        self.gathered.append((ids, words))
        self.n_gathered += len(ids)
        if self.n_gathered >= _GATHERED_CODES:
            self.meet()

    def meet(self) -> None:
        if not self.gathered:
            return
        ids = np.concatenate([i for i, _ in self.gathered])
        words = code_words(np.concatenate([w for _, w in self.gathered]), self.dim)
        self.gathered, self.n_gathered = [], 0
        for r, state in self.state.items():
            asked = self.words[:, r:r + _RUN_ROWS, None]
            n_rows, at = asked.shape[1], 0
            while at < len(ids):
                # Without a bound one run is looked at, and its own distances give one.
                runs = 1 if state.open else min(_LONG_RUN, max(1, (len(ids) - at) // _RUN_CODES))
                some = words[:, at:min(len(ids), at + runs * _RUN_CODES)].reshape(len(words), runs, 1, -1)
                distance = self._distances(asked, some)
                if state.open:
                    state.start(distance[0])
                mask = self.mask[:distance.size].reshape(distance.shape)
                cells = true_cells(np.less_equal(distance, state.bound[:, None], out=mask))
                if len(cells):
                    rest, cols = np.divmod(cells, some.shape[3])
                    run, rows = np.divmod(rest, n_rows)
                    cols += run * some.shape[3] + at
                    state.add(rows.astype(np.int32), distance.reshape(-1)[cells], ids[cols], words[:, cols])
                at += runs * some.shape[3]

    def _distances(self, asked: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Differing bits of each question and code: (W, rows, 1) and (W, runs, 1, codes) -> (runs, rows, codes)."""
        shape = some.shape[1], asked.shape[1], some.shape[3]
        out = self.distance[:shape[0] * shape[1] * shape[2]].reshape(shape)
        bits = self.bits[:shape[1] * shape[2]].reshape(shape[1:])
        for w in range(len(some)):
            for part, run in zip(out, some[w], strict=True):
                np.bitwise_xor(asked[w], run, out=bits)
                if w == 0:
                    np.bitwise_count(bits, out=part)
                else:
                    part += np.bitwise_count(bits)
        return out

    def _scores(self, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Float question . +-1 code of the pairs, a bounded number at a time."""
        idx = np.arange(self.dim)
        bit = idx + WORD_BITS - np.minimum(WORD_BITS, self.dim - idx // WORD_BITS * WORD_BITS)
        out, step = np.zeros(len(rows)), max(1, _CELL_BUDGET // self.dim)
        for at in range(0, len(rows), step):
            bits = np.unpackbits(np.ascontiguousarray(words[:, at:at + step].T).astype(">u8").view(np.uint8), axis=1)
            signs = np.ascontiguousarray(bits[:, bit]).astype(np.float32) * 2 - 1
            out[at:at + step] = np.einsum("ij,ij->i", self.q[rows[at:at + step]], signs, dtype=np.float64)
        return out

    def result(self):
        self.meet()
        for r, state in self.state.items():
            state.trim()
            score = self._scores(r + state.row, state.words) if self.with_score else np.zeros(len(state.row))
            yield [self.qids[r + state.row], state.id, state.distance.astype(np.int64), score]


def _packed_rows(slab: np.ndarray, ids: np.ndarray, words: np.ndarray):
    """(slab of a row, ends of rows, ids, words) of codes put in rows of one slab and at most `PACK_ROWS`."""
    order = np.argsort(slab, kind="stable")
    slab = slab[order]
    starts = np.flatnonzero(np.r_[True, slab[1:] != slab[:-1]])
    place = np.arange(len(slab)) - np.repeat(starts, np.diff(np.r_[starts, len(slab)]))
    cuts = np.flatnonzero(place % PACK_ROWS == 0)
    return slab[cuts], np.r_[cuts, len(slab)], ids[order], words[order]


def _pack(batches):
    """A mapInArrow function: (slab, slabs, blocks, id, v) -> rows of many codes of a slab, null codes left out."""
    for rb in batches:
        mask = rb.column(4).is_valid()
        rb = rb if rb.column(4).null_count == 0 else rb.filter(mask)
        if rb.num_rows == 0:
            continue
        words = list_column_matrix(rb.column(4), None, np.int64)
        slab, ends, ids, words = _packed_rows(rb.column(0).to_numpy(), rb.column(3).to_numpy(zero_copy_only=False).astype(np.int64), words)
        v = pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
                                        pa.ListArray.from_arrays(pa.array(ends * words.shape[1], pa.int32()), pa.array(words.reshape(-1)))],
                                       names=["ids", "words"])
        n = len(slab)
        yield pa.RecordBatch.from_arrays([pa.array(slab), *[pa.array(np.full(n, rb.column(i)[0].as_py(), np.int32)) for i in (1, 2)],
                                          pa.nulls(n, pa.int64()), v], names=["slab", "slabs", "blocks", "id", "v"])


def _packed_codes(ids: pa.Array, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids and words of a run of packed rows."""
    found = pc.struct_field(col, 0).flatten().to_numpy()
    return found, pc.struct_field(col, 1).flatten().to_numpy().reshape(len(found), -1)


def _kernel(make_tile, q_matrix, fields, vectors_of=None):
    """A mapInArrow function over the sorted tile stream (tile, side, id, q, v); ``vectors_of`` tells the
    ids and vectors of a run of vector rows (default: one in each row)."""
    def run(batches):
        tile = current = None
        held: list[tuple[np.ndarray, pa.Array]] = []

        def build():
            ids = np.concatenate([i for i, _ in held]) if held else np.zeros(0, np.int64)
            return make_tile(ids, q_matrix(pa.concat_arrays([c for _, c in held]))) if len(ids) else None

        def close():
            for cols in (tile.result() if tile is not None else ()):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)],
                                                 names=[n for n, _ in fields])

        for rb in batches:
            if rb.num_rows == 0:
                continue
            key = rb.column(0).to_numpy() * 2 + rb.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                number, side = divmod(int(key[a]), 2)
                if number != current:
                    yield from close()
                    tile, current, held = None, number, []
                ids, col = rb.column(2).slice(a, b - a), rb.column(3 + side).slice(a, b - a)
                if side == 1 and vectors_of is not None:
                    ids, col = vectors_of(ids, col)
                else:
                    ids, col = valid_rows(ids, col)
                    ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
                if not len(ids):
                    continue
                if side == 0:
                    held.append((ids, col))
                    continue
                if tile is None and held:
                    tile, held = build(), []
                if tile is not None:
                    tile.batch(ids, col)
        yield from close()
    return run


# ----------------------------------------------------------------------------
# the plan
# ----------------------------------------------------------------------------

def _block_rows(row_bytes: int, k: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (row_bytes + 40 * k)))


def _tiles(questions: DataFrame, vectors: DataFrame, block_rows: int, pack: bool = False) -> DataFrame:
    """(tile, side, id, q, v) sorted by tile and side: questions are side 0, vectors side 1.

    questions: qid, q. vectors: id, v. The block and slab of a row depend on its content
    alone, so a task that runs again deals its rows alike. With ``pack`` vectors are codes
    and go in rows of many, v being struct<ids, words>."""
    spark = vectors.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = min(partitions, TILES_PER_CORE * spark.sparkContext.defaultParallelism)
    asked, least = F.count(F.lit(1)), F.lit(1)
    if pack:
        least = F.least(F.lit(tiles), F.ceil(asked / F.lit(FEW_ROWS)))
    blocks = questions.select(F.greatest(F.lit(1), least, F.ceil(asked / F.lit(block_rows))).cast("int").alias("n")).scalar()

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("blocks", blocks).withColumn("slabs", F.ceil(F.lit(tiles) / F.col("blocks")).cast("int"))

    q = dealt(questions).select("qid", "q", "slabs", F.pmod(F.xxhash64("qid", "q"), F.col("blocks")).cast("int").alias("block"),
                                F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)).alias("slab"))
    v = dealt(vectors).select(F.pmod(F.xxhash64("id", "v"), F.col("slabs")).cast("int").alias("slab"), "slabs", "blocks", "id", "v")
    if pack:
        v = v.mapInArrow(_pack, "slab int, slabs int, blocks int, id long, v struct<ids:array<bigint>,words:array<bigint>>")
    v = v.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    tile = (F.col("block") * F.col("slabs") + F.col("slab")).alias("tile")
    both = q.select(tile, F.lit(0).alias("side"), F.col("qid").alias("id"), "q", F.lit(None).cast(v.schema["v"].dataType).alias("v")).unionByName(
        v.select(tile, F.lit(1).alias("side"), "id", F.lit(None).cast(q.schema["q"].dataType).alias("q"), "v"))
    return both.repartitionById(partitions, F.col("tile") % partitions).sortWithinPartitions("tile", "side")


def _top(partial: DataFrame, order: list, k: int, rank: str) -> DataFrame:
    window = Window.partitionBy("qid").orderBy(*order)
    return partial.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def dense_knn(questions: DataFrame, vectors: DataFrame, k: int, *, q_id: str = "qid",
              q_vec: str = "embedding", p_id: str = "id", p_vec: str = "embedding",
              dim: int | None = None, block_rows: int | None = None) -> DataFrame:
    """Top-k passages per question by inner product (score desc, id asc).

    Returns (qid, id, score, rank) with rank 1..k. ``block_rows`` bounds the questions
    that a task holds (default: by ``BLOCK_BYTES``)."""
    if k <= 0:
        raise ValueError("k must be positive")
    q = questions.select(F.col(q_id).cast("long").alias("qid"), F.col(q_vec).alias("q"))
    v = vectors.select(F.col(p_id).cast("long").alias("id"), F.col(p_vec).alias("v"))
    tiles = _tiles(q, v, block_rows or _block_rows(8 * (dim or 1024), k))
    run = _kernel(lambda ids, m: _DenseTile(ids, m, k, dim), lambda col: list_column_matrix(col, dim, np.float64), _DenseTile.fields)
    partial = tiles.mapInArrow(run, "qid long, id long, score double")
    hits = _top(partial, [F.col("score").desc(), F.col("id").asc()], k, "rank")
    return hits.withColumnRenamed("qid", q_id).withColumnRenamed("id", p_id)


def _binary_partial(questions: DataFrame, codes: DataFrame, k: int, dim: int, q_id: str, q_col: str, q_kind: str,
                    p_id: str, p_code: str, block_rows: int | None, with_score: bool) -> DataFrame:
    q = questions.select(F.col(q_id).cast("long").alias("qid"), F.col(q_col).alias("q"))
    v = codes.select(F.col(p_id).cast("long").alias("id"), F.col(p_code).alias("v"))

    def matrix(col: pa.Array) -> np.ndarray:
        if q_kind == "code":
            return unpack_sign_matrix(list_column_matrix(col, None, np.int64), dim, np.float64)
        return list_column_matrix(col, dim, np.float64)

    run = _kernel(lambda ids, m: _BinaryTile(ids, m, k, dim, with_score), matrix, _BinaryTile.fields, _packed_codes)
    tiles = _tiles(q, v, block_rows or _block_rows(12 * dim + _CANDIDATE_BYTES * k, k), pack=True)
    return tiles.mapInArrow(run, "qid long, id long, distance long, score double")


def hamming_knn(questions: DataFrame, codes: DataFrame, k: int, dim: int, *, q_id: str = "qid",
                q_col: str = "code", q_kind: str = "code", p_id: str = "id", p_code: str = "code",
                block_rows: int | None = None) -> DataFrame:
    """Nearest k codes per question by Hamming distance (distance asc, id asc).

    ``q_kind`` is "code" (packed question codes) or "float" (question vectors,
    binarised on the fly). Returns (qid, id, distance, rank)."""
    if k <= 0:
        raise ValueError("k must be positive")
    if q_kind not in ("code", "float"):
        raise ValueError("q_kind must be 'code' or 'float'")
    partial = _binary_partial(questions, codes, k, dim, q_id, q_col, q_kind, p_id, p_code, block_rows, with_score=False)
    hits = _top(partial.drop("score"), [F.col("distance").asc(), F.col("id").asc()], k, "rank")
    return hits.withColumnRenamed("qid", q_id).withColumnRenamed("id", p_id)


def binary_retrieve(questions: DataFrame, codes: DataFrame, k: int, binary_k: int, dim: int, *,
                    q_id: str = "qid", q_vec: str = "embedding", p_id: str = "id",
                    p_code: str = "code", block_rows: int | None = None) -> DataFrame:
    """C3+F1+C4+F2: Hamming candidates (binary_k) reranked by float question . +-1 code.

    A tile scores the candidates that are left at its end, so the code table is scanned once
    and never joined back. Order within the final k: score desc (NaN last), distance asc,
    id asc. Returns (qid, id, distance, score, rank)."""
    if k <= 0 or binary_k <= 0:
        raise ValueError("k and binary_k must be positive")
    partial = _binary_partial(questions, codes, binary_k, dim, q_id, q_vec, "float", p_id, p_code, block_rows, with_score=True)
    candidates = _top(partial, [F.col("distance").asc(), F.col("id").asc()], binary_k, "cand_rank")
    best = F.when(F.isnan("score"), None).otherwise(F.col("score")).desc_nulls_last()
    hits = _top(candidates, [best, F.col("distance").asc(), F.col("id").asc()], k, "rank")
    return hits.drop("cand_rank").withColumnRenamed("qid", q_id).withColumnRenamed("id", p_id)
