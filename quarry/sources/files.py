"""File sources and sinks: TSV passages, QA files, JSON items, gold passages, vector tables.

Readers return DataFrames with the reference's record layouts; writers take
DataFrames. Input order ("line order") is kept as explicit columns (file_no, src_file,
line_no) computed without a single-partition window; rows with text are not moved for it.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quarry.session import plan_bytes, stored

# ------------------------------------------------------------------ ordering helpers

def with_line_numbers(df: DataFrame, col: str = "line_no") -> DataFrame:
    """A16/E4 building block: 0-based global position in partition order; for narrow rows.

    Offsets per partition come from a per-partition count (a tiny aggregate,
    one row per partition); no global window, no single-partition sort. The
    input is checkpointed first (reliable checkpoint in spark.checkpoint.dir):
    partition ids after a shuffle are only stable once materialised, and the
    checkpoint also cuts the lineage so a lost executor does not recompute it."""
    from quarry.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint(eager=True)
    tagged = df.withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    local = F.col("_mono") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    # One row per partition of the sorted input: bounded by its partition count.
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(col, (F.col("_off") + local).cast("bigint"))
            .drop("_pid", "_mono", "_off"))


def numbered_by(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """`df` with the 0-based place of each row in the order of ``keys``, which name it (unique, no nulls).

    Only the keys are sorted and numbered; the numbers come back by key in a hash join, so
    rows with text are neither sorted nor checkpointed."""
    places = with_line_numbers(df.select(*keys).orderBy(*keys), col)
    if set(df.columns) == set(keys):
        return places
    return df.join(places.hint("shuffle_hash"), list(keys))


def with_file_line_numbers(df: DataFrame, col: str = "line_no") -> DataFrame:
    """Line numbers for a DataFrame read straight from files: (src_file, line_no).

    Spark packs scan partitions by file size, so partition order is not file
    order; the position is rebuilt from (file, split start, row within split)
    with a per-split count and a per-file running sum over its few splits. The sums (a row per
    split) are stored, so the join knows their bytes; a job runs here."""
    tagged = (df.withColumn("src_file", F.input_file_name())
              .withColumn("_blk", F.input_file_block_start())
              .withColumn("_mono", F.monotonically_increasing_id()))
    blocks = tagged.groupBy("src_file", "_blk").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_m0"))
    offs = blocks.select("src_file", "_blk", "_m0",
                         (F.sum("_n").over(Window.partitionBy("src_file").orderBy("_blk")) - F.col("_n"))
                         .alias("_off"))
    return (tagged.join(stored(offs, "splits"), ["src_file", "_blk"])
            .withColumn(col, (F.col("_off") + F.col("_mono") - F.col("_m0")).cast("bigint"))
            .drop("_blk", "_mono", "_m0", "_off"))


def global_line_no(df: DataFrame, col: str = "pos") -> DataFrame:
    """The place of each row over all files: lines of the files before plus line_no. The sums
    (a row per file) are stored, so the join knows their bytes; a job runs here."""
    files = df.groupBy("file_no", "src_file").agg((F.max("line_no") + 1).alias("_n"))
    before = Window.orderBy("file_no", "src_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file_no", "src_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return df.join(stored(offsets, "files"), ["file_no", "src_file"]).withColumn(col, F.col("_off") + F.col("line_no")).drop("_off")


def batch_ids(df: DataFrame, batch_size: int, order_col: str = "line_no", col: str = "batch_id") -> DataFrame:
    """Consecutive batches of ``batch_size`` in input order, last one partial."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    return df.withColumn(col, F.floor(F.col(order_col) / F.lit(batch_size)).cast("bigint"))


# ------------------------------------------------------------------ TSV

TSV = {"sep": "\t", "quote": '"', "escape": '"'}
# What is left of a quoted field up to its closing quote.
_CLOSING = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')


def _end_state(line: str, inside: bool) -> bool:
    """Whether the text behind a line is inside a quoted field, given that the line's start is.

    A quote opens a field only where the field starts; any other is text."""
    at = 0
    while True:
        if inside:
            close = _CLOSING.match(line, at)
            if close is None:
                return True
            at, inside = close.end(), False
        elif line.startswith('"', at):
            at, inside = at + 1, True
            continue
        at = line.find("\t", at) + 1
        if not at:
            return False


_STATES = "src_file string, blk long, n long, out0 boolean, out1 boolean, rec0 long, rec1 long"
_RECORDS = "src_file string, blk long, line_no long, part boolean, record string"


def _runs(batch: pa.RecordBatch):
    """(file, start, from, to) of the rows of a batch that are of one split."""
    files, starts = batch.column(1), batch.column(2).to_numpy()
    coded = files.dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero(np.r_[True, (coded[1:] != coded[:-1]) | (starts[1:] != starts[:-1])]).tolist() if len(starts) else []
    for low, high in zip(cuts, cuts[1:] + [len(starts)], strict=True):
        yield files[low].as_py(), int(starts[low]), low, high


def _split_states(batches):
    """For either state that a split (value, src_file, blk) may start in: the state behind its last line so far and the record
    of the split that it belongs to (-1: one from before); a row per split and batch, n being the lines so far."""
    key, n, states, records = None, 0, [False, True], [-1, -1]
    for batch in batches:
        values = pc.fill_null(batch.column(0), "")
        quoted = pc.match_substring(values, '"').to_numpy(zero_copy_only=False)
        filled = ~pc.is_in(values, value_set=pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
        out = []
        for file, start, low, high in _runs(batch):
            if (file, start) != key:
                key, n, states, records = (file, start), 0, [False, True], [-1, -1]
            changes = (low + np.flatnonzero(quoted[low:high])).tolist()
            lines = [values[i].as_py() for i in changes]
            for h in (0, 1):
                at, state, inside = low, states[h], np.zeros(high - low, bool)
                for i, line in zip(changes, lines, strict=True):
                    inside[at - low:i + 1 - low] = state
                    state, at = _end_state(line, state), i + 1
                inside[at - low:] = state
                states[h] = state
                records[h] += int(np.count_nonzero(~inside & filled[low:high]))
            n += high - low
            out.append((file, start, n, *states, *records))
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=[f.split(" ")[0] for f in _STATES.split(", ")])


# Characters of records that are sent on together.
_SENT_CHARS = 1 << 22


def _records(batches):
    """The records of splits (value, src_file, blk, inside, base: the state at its start, the records before it); part: of a record that
    goes on before or behind the split."""
    key, inside, number, held, cut, out, size = None, False, -1, [], False, [], 0
    names = [f.split(" ")[0] for f in _RECORDS.split(", ")]

    def sent():
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)], names=names)

    for batch in batches:
        values = pc.fill_null(batch.column(0), "")
        quoted = pc.match_substring(values, '"').to_numpy(zero_copy_only=False).tolist()
        for file, start, low, high in _runs(batch):
            if (file, start) != key:
                if held:
                    out.append((*key, number, True, "\n".join(held)))
                key, held = (file, start), []
                inside = cut = batch.column(3)[low].as_py()
                number = batch.column(4)[low].as_py() - 1
            for value, marked in zip(values.slice(low, high - low).to_pylist(), quoted[low:high], strict=True):
                if not inside:
                    if value in ("", "\r"):
                        continue
                    number, cut = number + 1, False
                inside = _end_state(value, inside) if marked else inside
                held.append(value)
                if not inside:
                    record = "\n".join(held)
                    out.append((file, start, number, cut, record))
                    held, size = [], size + len(record)
                    if size > _SENT_CHARS:
                        yield sent()
                        out, size = [], 0
    if held:
        out.append((*key, number, True, "\n".join(held)))
    if out:
        yield sent()


def read_tsv_records(spark: SparkSession, path: str) -> DataFrame:
    """(src_file, line_no, record): the records of quoted TSV files, numbered per file; jobs run here.

    Files are read twice, in splits. A split can't know whether it starts inside a quoted
    field, so the first pass finds what either case makes of it (a row per split); a running
    sum over these rows tells which case holds and how many records come before. The second
    pass makes the records where their lines lie and stores them; only the parts of a
    record that lies in several splits are brought together."""
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.input_file_name().alias("src_file"),
                                                               F.input_file_block_start().alias("blk"))
    lines = raw.mapInArrow(_split_states, _STATES)
    blocks = lines.groupBy("src_file", "blk").agg(
        F.max_by("out0", "n").alias("out0"), F.max_by("out1", "n").alias("out1"),
        (F.max("rec0") + 1).alias("n0"), (F.max("rec1") + 1).alias("n1"))
    # A split either settles the state behind it or keeps or swaps the one before: the state at a start is the last
    # settled one, swapped as often as splits since then swap.
    order = Window.partitionBy("src_file").orderBy("blk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    settled = F.col("out0") == F.col("out1")
    swaps = F.when(~settled & F.col("out0"), 1).otherwise(0)
    blocks = blocks.withColumn("_swaps", F.sum(swaps).over(order))
    last = F.last(F.when(settled, F.struct("out0", "_swaps")), ignorenulls=True).over(before)
    blocks = blocks.withColumn("_last", last).withColumn("_before", F.coalesce(F.lag("_swaps").over(order), F.lit(0)))
    since = F.col("_before") - F.coalesce(F.col("_last._swaps"), F.lit(0))
    blocks = blocks.withColumn("inside", F.coalesce(F.col("_last.out0"), F.lit(False)) != (since % 2 == 1))
    records = F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0"))
    starts = blocks.select("src_file", "blk", "inside", F.coalesce(F.sum(records).over(before), F.lit(0)).alias("base"))

    # A row per split. The lines keep their order in a broadcast join, which is what the records are made by.
    placed = raw.join(F.broadcast(stored(starts, "splits")), ["src_file", "blk"]).select("value", "src_file", "blk", "inside", "base")
    records = stored(placed.mapInArrow(_records, _RECORDS), "records", compression="zstd")
    whole = records.where(~F.col("part")).select("src_file", "line_no", "record")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blk", "record"))), lambda x: x["record"]), "\n")
    both = whole.unionByName(records.where("part").groupBy("src_file", "line_no").agg(joined.alias("record")))
    return both.withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def _tsv_columns(spark: SparkSession, path: str, names: Sequence[str] | None) -> DataFrame:
    """src_file, line_no and the fields of every record; without ``names`` each file's first record is its header."""
    header = names is None
    if header:
        names = spark.read.options(**TSV).option("header", "true").csv(path).columns
    schema = ", ".join(f"`{n}` string" for n in names)
    records = read_tsv_records(spark, path)
    if header:
        records = records.where(F.col("line_no") > 0).withColumn("line_no", F.col("line_no") - 1)
    return records.select("src_file", "line_no", F.from_csv("record", schema, TSV).alias("r")).select("src_file", "line_no", "r.*")


def read_passage_tsv(spark: SparkSession, path) -> DataFrame:
    """A1/A8 (+A15): passage TSV file(s) with a header row (id, text, title[, dataset]); .gz by extension.

    Columns are addressed by header name, as a dict reader does; a missing
    ``dataset`` column reads as null. Several paths are read in the given
    order. Returns id, title, text, dataset, file_no, src_file, line_no."""
    if not isinstance(path, str):
        return concat_files([read_passage_tsv(spark, p).drop("file_no") for p in path])
    raw = _tsv_columns(spark, path, None)
    cols = {c.lower(): c for c in raw.columns}
    for need in ("id", "text", "title"):
        if need not in cols:
            raise ValueError(f"passage file lacks a '{need}' column")
    ds = F.col(cols["dataset"]) if "dataset" in cols else F.lit(None).cast("string")
    return raw.select(F.col(cols["id"]).cast("bigint").alias("id"), F.col(cols["title"]).alias("title"),
                      F.col(cols["text"]).alias("text"), ds.alias("dataset"), F.lit(0).alias("file_no"), "src_file", "line_no")


def write_passage_tsv(passages: DataFrame, path: str) -> None:
    """Passage TSV with header (id, text, title, dataset), doubled quotes inside quoted fields; gzip when the
    name ends in .gz (a file, which a task writes, is then read as one split)."""
    (passages.select(F.col("id").cast("string").alias("id"), "text", "title", "dataset")
     .write.mode("errorifexists").option("sep", "\t").option("header", "true")
     .option("quote", '"').option("escape", '"').option("quoteAll", "true")
     .option("compression", "gzip" if path.rstrip("/").endswith(".gz") else "none").csv(path))


def _literal_list(values: pd.Series) -> pd.Series:
    def parse(s):
        if s is None:
            return None
        v = ast.literal_eval(s)
        if not isinstance(v, (list, tuple)):
            raise ValueError(f"answers is not a list literal: {s[:80]!r}")
        return [str(x) for x in v]
    return values.map(parse)


_parse_literal = F.pandas_udf(_literal_list, ArrayType(StringType()))


def read_qa_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Header-less TSV (question, answers); answers is a Python list literal.

    Returns question, answers, positive_ids (null), dataset (null), line_no."""
    raw = _tsv_columns(spark, path, ("question", "answers"))
    return raw.select("question", _parse_literal(F.col("answers")).alias("answers"),
                      F.lit(None).cast("array<string>").alias("positive_ids"),
                      F.lit(None).cast("string").alias("dataset"), "src_file", "line_no")


def python_list_literal(col) -> "F.Column":
    """array<string> -> Python list literal with single-quoted, backslash-escaped items."""
    c = F.col(col) if isinstance(col, str) else col
    item = lambda a: F.concat(F.lit("'"), F.replace(F.replace(a, F.lit("\\"), F.lit("\\\\")),
                                                    F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.concat(F.lit("["), F.array_join(F.transform(c, item), ", "), F.lit("]"))


def write_qa_tsv(qa: DataFrame, path: str) -> None:
    (qa.select("question", python_list_literal("answers").alias("answers"))
     .write.mode("errorifexists").option("sep", "\t").option("header", "false")
     .option("quote", '"').option("escape", '"').csv(path))


# ------------------------------------------------------------------ JSON

def _is_lines(path: str, lines: bool | None) -> bool:
    if lines is not None:
        return lines
    p = path.rstrip("/")
    return p.endswith(".jsonl") or p.endswith(".jsonl.gz")


def read_json_items(spark: SparkSession, path: str, schema=None, lines: bool | None = None) -> DataFrame:
    """A2: JSON Lines (``.jsonl``/``.jsonl.gz`` or lines=True) or one top-level array per file."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return with_file_line_numbers(reader.option("multiLine", str(not _is_lines(path, lines)).lower()).json(path))


def read_variant_items(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """A2 without a schema: (item VARIANT, src_file, line_no), every field of every item kept."""
    whole = not _is_lines(path, lines)
    read = spark.read.option("singleVariantColumn", "item").option("multiLine", str(whole).lower())
    items = with_file_line_numbers(read.json(path))
    if not whole:
        return items
    # A file holds one array: its items are its lines.
    return items.select("src_file", F.posexplode(F.expr("CAST(item AS ARRAY<VARIANT>)")).alias("line_no", "item")) \
        .select("item", "src_file", F.col("line_no").cast("bigint").alias("line_no"))


def write_json_items(df: DataFrame, path: str, lines: bool | None = None) -> None:
    """A3: JSON Lines directory (gzip when the name ends in .gz), nulls kept; or the indented-array
    form, where each partition is one file with an array of its items, written as a stream."""
    gz = path.rstrip("/").endswith(".gz")
    if _is_lines(path, lines):
        w = df.write.mode("errorifexists").option("ignoreNullFields", "false")
        if gz:
            w = w.option("compression", "gzip")
        w.json(path)
        return
    items = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))
    w = items.mapInArrow(_array_lines, "value string").write.mode("errorifexists")
    if gz:
        w = w.option("compression", "gzip")
    w.text(path)


def _array_lines(batches):
    """The text lines of one JSON array: an opening bracket, the items with commas between, a closing bracket."""
    held = "["
    for batch in batches:
        out = []
        for value in batch.column(0).to_pylist():
            out.append(held)
            comma = "" if held == "[" else ","
            if comma:
                out[-1] += comma
            held = value
        if out:
            yield pa.record_batch([pa.array(out, pa.string())], names=["value"])
    yield pa.record_batch([pa.array([held, "]"], pa.string())], names=["value"])


CTX_SCHEMA = "array<struct<passage_id:string,title:string,text:string>>"
RETRIEVER_SCHEMA = (f"question string, answers array<string>, dataset string, positive_ctxs {CTX_SCHEMA}, "
                    f"hard_negative_ctxs {CTX_SCHEMA}, negative_ctxs {CTX_SCHEMA}")


def read_retriever_file(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """A10: question, answers, positive passage ids as strings, optional dataset."""
    items = read_json_items(spark, path, schema=RETRIEVER_SCHEMA, lines=lines)
    return items.select("question", "answers",
                        F.transform(F.coalesce("positive_ctxs", F.array()), lambda c: c["passage_id"].cast("string"))
                        .alias("positive_ids"), "dataset", "src_file", "line_no")


def read_gold_passages(spark: SparkSession, path: str, lines: bool | None = None):
    """A13 (+G3): gold passages: one {"data": [...]} document per file, or (for
    ``.jsonl`` paths / lines=True) one document per line.

    Returns (gold: key -> passage, canonical: question_tokens -> question); a key
    may be a question or its question_tokens form; later items win (order:
    file, line, position in the document)."""
    schema = ("data array<struct<question:string,question_tokens:string,example_id:bigint,title:string,"
              "context:string>>")
    doc = with_file_line_numbers(
        spark.read.schema(schema).option("multiLine", str(not _is_lines(path, lines)).lower()).json(path))
    items = doc.select(F.lit(0).alias("file_no"), "src_file", "line_no", F.posexplode("data").alias("pos", "d")).select(
        "file_no", "src_file", "line_no", "pos", F.col("d.question").alias("question"),
        F.coalesce(F.col("d.question_tokens"), F.col("d.question")).alias("question_tokens"),
        F.col("d.example_id").alias("id"), F.col("d.title").alias("title"), F.col("d.context").alias("text"))
    keyed = items.select(F.col("question").alias("key"), "file_no", "src_file", "line_no", (F.col("pos") * 2).alias("ord"),
                         "id", "title", "text") \
        .unionByName(items.select(F.col("question_tokens").alias("key"), "file_no", "src_file", "line_no",
                                  (F.col("pos") * 2 + 1).alias("ord"), "id", "title", "text"))
    # Later items win; their place is one number, so the winners are found without moving texts.
    gold = last_wins(keyed, "key", _item_place("ord")).select("key", "id", "title", "text")
    canon = last_wins(items.select(F.col("question_tokens").alias("key"), F.col("question").alias("canonical"), "file_no", "src_file",
                                   "line_no", "pos"), "key", _item_place("pos")).select("key", "canonical")
    return gold, canon


def _item_place(ord_col: str):
    """The place of an item of a document over all files: the document's place, then the item's in it."""
    return lambda df: global_line_no(df, "_doc").withColumn("_pos", F.shiftleft("_doc", 32) + F.col(ord_col)).drop("_doc")


# Bytes of the winners' bitmaps (a bit per row of the input) that every executor may hold.
_MARKS_BYTES = 64 * 1024 * 1024


def last_wins(df: DataFrame, key: str = "id", place=None) -> DataFrame:
    """Keyed upsert, the row latest in input order wins.

    ``place`` adds ``_pos``, the row's place as one long (default: its line over all files). A hash
    aggregate finds the last place per key (combined map-side, so a key on a third of all rows
    is reduced before the shuffle). Places over all files have no gaps, so the winners are stored as
    bitmaps, which go to the rows where these lie: no text is shuffled. A job runs for it. Where the
    bitmaps are too large, and for other places, a hash semi-join keeps the winners' rows:
    texts are shuffled once. They are never sorted."""
    placed = place(df) if place else global_line_no(df, "_pos")
    winners = placed.groupBy(key).agg(F.max("_pos").alias("_pos")).select("_pos")
    if place is None:
        marks = stored(winners.groupBy(F.bitmap_bucket_number("_pos").alias("_bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("_pos")).alias("_marks")), "winners", compression="uncompressed")
        if plan_bytes(marks) <= _MARKS_BYTES:
            bit = F.bitmap_bit_position("_pos")
            held = F.conv(F.hex(F.substring("_marks", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            wins = (F.bitmap_bucket_number("_pos") == F.col("_bucket")) & F.getbit(held, (bit % 8).cast("int")).eqNullSafe(1)
            return placed.join(F.broadcast(marks), wins, "left_semi").drop("_pos")
    return placed.join(winners.hint("shuffle_hash"), "_pos", "left_semi").drop("_pos")


# ------------------------------------------------------------------ vector tables

def write_vector_table(df: DataFrame, path: str) -> None:
    """A14 sink: (id, embedding) or (id, code) as Parquet."""
    df.write.mode("errorifexists").parquet(path)


def read_vector_table(spark: SparkSession, path: str) -> DataFrame:
    """A14 source."""
    return spark.read.parquet(path)


# ------------------------------------------------------------------ several files

def concat_files(frames: Sequence[DataFrame]) -> DataFrame:
    """Inputs in the given order; (file_no, src_file, line_no) is the global order."""
    out = None
    for i, df in enumerate(frames):
        tagged = df.withColumn("file_no", F.lit(i).cast("int"))
        out = tagged if out is None else out.unionByName(tagged)
    return out


INPUT_ORDER = ("file_no", "src_file", "line_no")


def dense_index(df: DataFrame, order_cols: Sequence[str], col: str = "index") -> DataFrame:
    """0-based running index over the kept rows in (order_cols) order; these name a row."""
    return numbered_by(df, order_cols, col)
