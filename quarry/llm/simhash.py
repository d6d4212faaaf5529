"""SimHash near-duplicates by multi-index hashing.

Fingerprints: a text's ASCII letters are lower-cased, its words taken, and the
XXH64 of every k-word shingle votes on 64 bits.

Links: fingerprints at most `max_distance` bits apart. A fingerprint is cut
into segments; of two that are linked, one segment differs in at most
r = max_distance // segments bits. The Hamming ball of radius r around a
segment is enumerated half on the query side and half on the table side: each
fingerprint enters the segment's table under all values at most ceil(r / 2)
bits away, so two fingerprints whose segments differ in r bits or fewer meet
under a value between them. With 64 bits, 4 differing bits and two segments
this is 66 rows per distinct fingerprint, and two unrelated fingerprints meet
with a probability of about 1e-7. Whatever meets is verified on all 64 bits.

A table value's members are never paired with each other: they arrive as a
sorted run, and a breadth-first walk that compares one member at a time with
those not yet reached yields a spanning forest of their links (members - 1
edges at most, no link between different components lost). A run of more than
`RUN_LIMIT` members is not walked: its members are linked instead through
the points of the whole 64-bit space within half the distance of each of them.
Two fingerprints within `max_distance` have such a point in common, and two
that have one are within it, so a minimum per point is exact, needs no pair,
and its cost is in proportion to the number of members.

Equal fingerprints are one row from the start, so a group of copies costs one
fingerprint however many rows it has. Components are found by alternating
large-star and small-star steps over the edges, each step an aggregate and a
join, with a table in the shared folder between steps.

Defined cases: a null text has no words; a text without words has fingerprint
zero and is linked like any other; fewer words than a shingle form one shingle;
repeated rows are linked to each other; a component without any non-null id has
a null component; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise

SEED = 42
#: Shingles whose bits are counted at once (64 bytes each).
_BLOCK = 1 << 16
RUN_LIMIT = 8192


def simhash(text: bytes, shingle: int) -> int:
    """The unsigned 64-bit fingerprint of UTF-8 bytes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        h = np.array([digest(joined[a:b - 1], SEED) for a, b in zip(starts[lo:hi], starts[lo + shingle:hi + shingle], strict=True)],
                     dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one signed 64-bit fingerprint per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fp = np.fromiter((simhash(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, fp long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _ball(value: Column, low_bit: int, bits: int, radius: int) -> Column:
    """All longs that differ from `value` in at most `radius` of the given bits, each with its distance."""
    masks = [(0, 0)]
    for _ in range(radius):
        masks += [(m | 1 << b, d + 1) for m, d in masks if d == masks[-1][1] for b in range(low_bit, low_bit + bits) if m < 1 << b]
    signed = [(m - (1 << 64) if m >= 1 << 63 else m, d) for m, d in masks]
    table = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(d).alias("d")) for m, d in signed])
    return F.transform(table, lambda x: F.struct(value.bitwiseXOR(x["m"]).alias("point"), x["d"].alias("d")))


def _segments(max_distance: int) -> tuple[int, int]:
    """Number of segments and the largest difference that one of them must have."""
    n = max(1, max_distance // 2)
    return n, max_distance // n


def _segment_key(segment: int, mask: int):
    return lambda x: F.xxhash64(F.lit(segment), x["point"].bitwiseAND(F.lit(mask)))


def _walk(run: np.ndarray, max_distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links inside one run of distinct fingerprints, as (root, member) arrays."""
    edges, rest = [], run
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= max_distance
            if near.any():
                found, rest = rest[near], rest[~near]
                edges.append((np.full(len(found), root), found))
                queue.extend(found)
    return edges


def _linked_runs(max_distance: int, run_limit: int):
    """Rows (key, fp) in key order to rows (a, b): an edge, or (fp, null) for a member of a run over the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held, over = None, np.empty(0, np.uint64), False

        def close(members: np.ndarray, out: list) -> None:
            if len(members) == 2:
                if np.bitwise_count(members[0] ^ members[1]) <= max_distance:
                    out.append((members[:1], members[1:]))
            elif len(members) > 2:
                out.extend(_walk(members, max_distance))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            fps = batch.column(1).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            out, heavy = [], []
            first = 0
            if open_key == keys[0]:
                part, first = fps[:ends[0]], 1
                if over or len(held) + len(part) > run_limit:
                    heavy += [part] if over else [held, part]
                    over, held = True, held[:0]
                else:
                    held = np.concatenate([held, part])
            last = len(starts) - 1
            if first <= last:  # the run that was open has ended; the batch's last one stays open
                close(held, out)
                over = False
                # Only runs of two or more can link anything.
                for i in np.flatnonzero(ends - starts > 1):
                    if first <= i < last:
                        members = fps[starts[i]:ends[i]]
                        if len(members) > run_limit:
                            heavy.append(members)
                        else:
                            close(members, out)
                held, open_key = fps[starts[last]:], keys[-1]
                if len(held) > run_limit:
                    heavy.append(held)
                    held, over = held[:0], True
            yield from _edge_batch(out, heavy)
        out = []
        close(held, out)
        yield from _edge_batch(out, [])

    return run


def _edge_batch(edges: list, heavy: list) -> Iterator[pa.RecordBatch]:
    if edges or heavy:
        a = np.concatenate([e[0] for e in edges] + heavy).view(np.int64)
        b = [e[1] for e in edges]
        b = np.concatenate(b).view(np.int64) if b else np.empty(0, np.int64)
        yield pa.record_batch([pa.array(a), pa.concat_arrays([pa.array(b), pa.nulls(len(a) - len(b), pa.int64())])], names=["a", "b"])


def links(distinct: DataFrame, max_distance: int = 4, run_limit: int = RUN_LIMIT) -> DataFrame:
    """Edges (a, b), written to the shared folder, whose components are those of all links between rows of `distinct` (fp)."""
    n, r = _segments(max_distance)
    radius, width = (r + 1) // 2, 64 // n
    tables = []
    for s in range(n):
        low, bits = s * width, (64 - s * width if s == n - 1 else width)
        ball = _ball(F.col("fp"), low, bits, radius)
        mask = ((1 << bits) - 1) << low
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        # A key names its segment: all other bits are replaced by the segment's number, hashed.
        tables.append(F.transform(ball, _segment_key(s, mask)))
    # Every row makes many: narrow rows are spread first, by a number that AQE keeps.
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    keyed = spread.select(F.explode(F.concat(*tables)).alias("key"), "fp")
    met = (keyed.repartition("key").sortWithinPartitions("key", "fp")
           .mapInArrow(_linked_runs(max_distance, run_limit), "a long, b long"))
    met = materialise(met, "simhash-met")
    edges = met.where(F.col("b").isNotNull()).distinct()
    # Members of long runs, through the points that lie between them.
    half, other = max_distance // 2, max_distance - max_distance // 2
    heavy = met.where(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    if heavy.isEmpty():
        return edges
    points = heavy.select("fp", F.explode(_ball(F.col("fp"), 0, 64, other)).alias("p")).select("fp", "p.point", "p.d")
    roots = points.where(F.col("d") <= half).groupBy("point").agg(F.min("fp").alias("root"))
    through = points.join(roots, "point").where(F.col("fp") != F.col("root")).select(F.col("root").alias("a"), F.col("fp").alias("b"))
    return materialise(edges.unionByName(through).distinct(), "simhash-edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component."""
    state = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc-0")
    seen = None
    while True:
        # Large star: neighbours above a node are tied to the smallest of its neighbourhood.
        both = state.select("a", "b").unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # Small star: a node and its neighbours below it are tied to the smallest of these.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(low, "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("b"))
                 .where("m < b").select(F.col("m").alias("a"), "b").distinct())
        state = materialise(small, "cc-step")
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return state.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                state.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        seen = mark


def _rooted(docs: DataFrame, shingle: int, max_distance: int, id_col: str, text_col: str, run_limit: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, first_id, root) of each fingerprint with its component's root."""
    marked = materialise(fingerprints(docs, shingle, id_col, text_col), "simhash-fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(nodes.select("fp"), max_distance, run_limit))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    return marked, materialise(rooted, "simhash-roots")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = 4, id_col: str = "doc_id", text_col: str = "text",
                    run_limit: int = RUN_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id that links reach from each document, itself included."""
    marked, rooted = _rooted(docs, shingle, max_distance, id_col, text_col, run_limit)
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.join(smallest, "root").select("fp", "component_id")
    # A fingerprint that a third of all rows share is a skewed key of a plain join, which adaptive execution splits.
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component: that of the smallest id, of several with that id that of the smallest fingerprint.

    A null id comes after all others. Rows with the same id and fingerprint are
    told apart by a number that each row is given here.
    """
    fields = docs.columns
    whole = docs.select(F.struct(*[docs[c] for c in fields]).alias("doc"), F.monotonically_increasing_id().alias("row_key"))
    whole = materialise(whole, "simhash-rows")  # the numbers must not change between the two readings
    keyed = whole.select(F.struct(F.col("doc")[id_col].alias("id"), "row_key").alias("key"), F.col("doc")[text_col].alias("text"))
    marked, rooted = _rooted(keyed, shingle, max_distance, "key", "text", RUN_LIMIT)
    # Least first, with maps' partial sums: per fingerprint, then per root.
    rank = F.struct(F.col("doc_id.id").isNull().alias("no_id"), F.col("doc_id.id").alias("id"), "fp", F.col("doc_id.row_key").alias("row_key"))
    of_fp = marked.groupBy("fp").agg(F.min(rank).alias("least"))
    kept = of_fp.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row_key").alias("kept_key"))
    return whole.join(kept, whole["row_key"] == kept["kept_key"], "left_semi").select("doc.*")
