"""Document fingerprints from content-defined chunks.

A gear hash of the last 32 bytes is taken at every byte of a text's UTF-8 form.
A chunk ends where the hash has the wanted zero bits: more of them before the
normal size and fewer after it (normalised chunking), never under the least and
always at the largest size. As the hash looks back a fixed number of bytes, a
boundary depends on the text around it alone, and chunks after an insertion or
deletion fall into step again.

The fingerprint is the set of chunk digests (XXH64), each with its chunk's
length in bytes, as text: "digest:length" in order of the digest, joined by
commas. `containment(a, b)` is the share of a's distinct chunk bytes that b has
too: 1 for equal texts, 0 for texts without a common chunk.

The gear table follows from a rule: entry i is the low half of the XXH64 of the
byte i under the seed.

Neighbours in id order (`fingerprint_edits`): ids are cut into ranges of about
equal rows, at most `MAX_RANGES`; texts are shuffled once, by range, and each range
also receives the first document of the next one, so each task streams its
documents in order and holds two of them.

Defined cases: a null or empty text has no chunks and an empty fingerprint; it
is contained in everything (1.0), and nothing else is contained in it; null ids
come first; equal ids are in the order of their texts; of one document alone,
the next is itself; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
#: Sizes of a chunk in bytes.
LEAST, NORMAL, LARGEST = 24, 64, 256
_STRICT, _LOOSE = np.uint32(0xFE000000), np.uint32(0xF0000000)  # 7 and 4 high bits, which depend on all 32 bytes
MAX_RANGES, ROWS_PER_RANGE = 65536, 256


def gear_table(seed: int = SEED) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([i]), seed) & 0xFFFFFFFF for i in range(256)], dtype=np.uint32)


_GEAR = gear_table()


def gear_hashes(data: bytes) -> np.ndarray:
    """The gear hash at every byte: the sum of table[byte i places back] << i, over 32 places, by doubling."""
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def chunk_ends(data: bytes) -> list[int]:
    if not data:
        return []
    h = gear_hashes(data)
    loose = np.flatnonzero((h & _LOOSE) == 0)
    strict = (loose[(h[loose] & _STRICT) == 0] + 1).tolist()
    loose = (loose + 1).tolist()
    ends, start, size, n_strict, n_loose = [], 0, len(data), len(strict), len(loose)
    while start < size:
        end = min(size, start + LARGEST)
        i = bisect_left(strict, start + LEAST)
        if i < n_strict and strict[i] < start + NORMAL:
            end = strict[i]
        else:
            i = bisect_left(loose, start + NORMAL)
            if i < n_loose and loose[i] < end:
                end = loose[i]
        ends.append(end)
        start = end
    return ends


def chunk_set(text: str) -> dict[int, int]:
    """Digest to length in bytes, of the distinct chunks."""
    data, start, found = text.encode(), 0, {}
    digest = xxhash.xxh64_intdigest
    for end in chunk_ends(data):
        found[digest(data[start:end], SEED)] = end - start
        start = end
    return found


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    total = sum(a.values())
    return sum(n for d, n in a.items() if d in b) / total if total else 1.0


def to_text(chunks: dict[int, int]) -> str:
    return ",".join([f"{d:016x}:{n}" for d, n in sorted(chunks.items())])


def from_text(fingerprint: str) -> dict[int, int]:
    return {int(d, 16): int(n) for d, n in (x.split(":") for x in fingerprint.split(",") if x)}


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [to_text(chunk_set(t.as_py() or "")) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edit(text: str, following: str) -> str:
    """`text` with its second half replaced by the start of `following`."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _with_next(docs: DataFrame) -> DataFrame:
    """(range, tail, doc_id, text): `docs` by range of ids, and per range the document that follows its last one (tail 1)."""
    # Quantiles of the ids, at most MAX_RANGES of them, cut ranges of about equal rows, however the ids lie.
    n = docs.count()
    ranges = max(1, min(MAX_RANGES, n // ROWS_PER_RANGE))
    shares = ", ".join(f"{i / ranges:.9f}D" for i in range(1, ranges))
    cuts = docs.select(F.expr(f"percentile_approx(doc_id, array({shares}), {max(10000, 2 * ranges)})")).first()[0] if ranges > 1 else None
    cuts = np.array(cuts or [], np.int64)

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), side="right"))

    at = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place(F.coalesce("doc_id", F.lit(0)))) if len(cuts) else \
        F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.lit(0))
    at = at.cast("long")
    dealt = docs.withColumn("range", at)
    # At most MAX_RANGES rows from here on.
    firsts = dealt.groupBy("range").agg(F.min("doc_id").alias("first_id"))
    order = Window.orderBy("range")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for_range = firsts.select("first_id", F.col("range").alias("own"),
                              F.coalesce(F.lag("range").over(order), F.max("range").over(every)).alias("before"))
    heads = (dealt.join(F.broadcast(for_range), (F.col("range") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
             .groupBy("before").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"))).alias("first"))
             .select(F.col("before").alias("range"), F.lit(1).alias("tail"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
                     F.col("first.text").alias("text")))
    return dealt.select("range", F.lit(0).alias("tail"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).unionByName(heads)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the document's second half (floor(n_chars / 2) code
    points) replaced by as many from the start of the next document, by
    ascending id; the first follows the last. Ids are integers.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, doc_id, text, chunks) of the document before
        rows, size = [], 0
        for batch in batches:
            for at, tail, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunks = chunk_set(text)
                if held and held[0] == at:
                    _, own_id, own, own_chunks = held
                    edited = edit(own, text)
                    edited_chunks = chunk_set(edited)
                    rows.append((own_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), to_text(own_chunks), to_text(edited_chunks),
                                 containment(own_chunks, edited_chunks), containment(own_chunks, chunks)))
                    size += len(own)
                held = None if tail else (at, doc_id, text, chunks)
                if size > 1 << 22:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ordered = (_with_next(kept.withColumn("doc_id", F.col("doc_id").cast("long"))).repartition("range")
               .sortWithinPartitions("range", "tail", F.col("doc_id").asc_nulls_first(), "text"))
    found = ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                    "near_edited double, near_next double")
    return found.select(*names)
