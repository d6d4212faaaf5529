"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are permuted and laid end to end as a line of words;
the mix takes the line's first `quota` words, running over it again for a
second epoch where the target is larger than the source. The quota is cut into
blocks of equal size. The tree starts from the exact block counts of all
sources and halves the set of output shards at every level: how many blocks of
each source go left is one draw from the multivariate hypergeometric
distribution, so each leaf (shard) ends with an exact composition, shards
differ by a block at most in their totals, and every block is used once. A
shard takes the next blocks of each source's permuted line (disjoint by
construction) and shuffles them locally.

Only DataFrame and SQL functions are used. A draw inverts the distribution
function with logarithms of factorials by Stirling's series; its randomness is
an md5 of (seed, tree node, source), so reruns agree.

Scale: the place of a document on its source's line comes from totals of
(source, bucket of the permutation) and a running sum inside a bucket. Buckets
are slices of the md5 order of about `ROWS_PER_BUCKET` rows, so a source that
holds a third of all rows is spread over many tasks. The tree works on one row
of (number of sources) counts per node; sources are few by their nature, as
each has a weight.

Defined cases: a null text has no words; a null source is a source of its own,
after all others; a null id is an id like any other; repeated rows are
documents of their own; documents without words take nothing; an empty table
gives no rows; sources whose words are all taken twice stop there and pass the
excess on. Other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, materialise, n_words

ROWS_PER_BUCKET = 8192

# log(x!) by Stirling's series, exact values below 8 (fixed values: the factorials of 0 to 7).
_LOG_FACTORIAL = ("(CASE WHEN {x} < 8 THEN ln(element_at(array(1D, 1D, 2D, 6D, 24D, 120D, 720D, 5040D), CAST({x} AS INT) + 1)) "
                  "ELSE {x} * ln({x}) - {x} + 0.5D * ln(6.283185307179586D * {x}) + 1 / (12D * {x}) "
                  "- 1 / (360D * {x} * {x} * {x}) + 1 / (1260D * {x} * {x} * {x} * {x} * {x}) END)")


def _log_choose(n: str, k: str) -> str:
    f = [_LOG_FACTORIAL.format(x=f"CAST({x} AS DOUBLE)") for x in (f"({n})", f"({k})", f"({n} - {k})")]
    return f"({f[0]} - {f[1]} - {f[2]})"


def _uniform(*parts: str) -> str:
    digest = "md5(concat_ws('|', " + ", ".join(parts) + "))"
    return f"((CAST(conv(substr({digest}, 1, 13), 16, 10) AS DOUBLE) + 0.5D) / 4503599627370496D)"


def _hypergeometric(total: str, good: str, drawn: str, u: str) -> str:
    """SQL text: one draw by inversion, walking the support within nine standard deviations of the mode.

    What lies beyond has a probability under 1e-17, less than a double can tell from zero beside one.
    """
    mean = f"({drawn} * CAST({good} AS DOUBLE) / {total})"
    spread = f"(9 * sqrt({mean} * greatest(1 - CAST({good} AS DOUBLE) / {total}, 0D)) + 12)"
    low = f"greatest(0L, {drawn} + {good} - {total}, CAST({mean} - {spread} AS BIGINT))"
    high = f"least({good}, {drawn}, CAST({mean} + {spread} AS BIGINT) + 1)"
    log_p = f"{_log_choose(good, 'i')} + {_log_choose(f'({total} - {good})', f'({drawn} - i)')} - w.base"
    return (f"CASE WHEN {total} = 0 OR {drawn} = 0 OR {good} = 0 THEN 0L WHEN {good} = {total} THEN {drawn} ELSE "
            f"element_at(transform(array(named_struct('base', {_log_choose(total, drawn)}, 'u', {u}, 'lo', {low}, 'hi', {high})), "
            f"w -> aggregate(sequence(w.lo, w.hi), named_struct('p', 0D, 'x', w.lo), "
            f"(s, i) -> IF(s.p > w.u, s, named_struct('p', s.p + exp({log_p}), 'x', i)), s -> s.x)), 1) END")


def splitting_tree(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, pos, n_blocks) from (pos, n_blocks) per source: the leaves of the splitting tree.

    Each level halves every node's set of shards [lo, hi); a node with one shard stays as it is.
    """
    nodes = blocks.groupBy().agg(F.sort_array(F.collect_list(F.struct("pos", "n_blocks"))).alias("c")).select(
        F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"),
        F.expr("transform(c, x -> x.n_blocks)").alias("counts"), F.expr("transform(c, x -> x.pos)").alias("pos"))
    draw = _hypergeometric("a.total", "q", "a.want", _uniform(f"'{int(seed)}'", "CAST(lo AS STRING)", "CAST(hi AS STRING)",
                                                               "CAST(size(a.drawn) AS STRING)"))
    left_total = "(all_blocks * (mid - lo) div (hi - lo))"
    drawn = (f"aggregate(counts, named_struct('total', all_blocks, 'want', {left_total}, 'drawn', CAST(array() AS ARRAY<BIGINT>)), "
             f"(a, q) -> element_at(transform(array({draw}), x -> named_struct('total', a.total - q, 'want', a.want - x, "
             "'drawn', concat(a.drawn, array(x)))), 1), a -> a.drawn)")
    children = (f"IF(hi - lo <= 1, array(named_struct('lo', lo, 'hi', hi, 'counts', counts)), "
                f"element_at(transform(array({drawn}), d -> array(named_struct('lo', lo, 'hi', mid, 'counts', d), "
                "named_struct('lo', mid, 'hi', hi, 'counts', zip_with(counts, d, (q, x) -> q - x)))), 1))")
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        nodes = (nodes.withColumn("all_blocks", F.expr("aggregate(counts, 0L, (a, q) -> a + q)"))
                 .withColumn("mid", F.expr("(lo + hi) div 2"))
                 .select("pos", F.explode(F.expr(children)).alias("n")).select("n.lo", "n.hi", "n.counts", "pos"))
    return nodes.select(F.col("lo").cast("int").alias("shard"), F.explode(F.arrays_zip("pos", "counts")).alias("x")).select(
        "shard", F.col("x.pos").alias("pos"), F.col("x.counts").alias("n_blocks"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5,
                   max_epochs: int = 2) -> DataFrame:
    """(source_key, source, source_size, pos, target) from (source_key, source, source_size).

    Weights repeat over the sources by code point, null last. A target stops at
    `max_epochs` times its source; the excess is shared again by weight. The
    level at which this settles is found in one pass: with sources in the order
    of cap / weight, the first one whose cap is not reached at the level that
    its predecessors' caps leave fixes the level for it and all after it.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "pos")
    ahead, behind = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy("ratio", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    levelled = (sizes.withColumn("pos", F.row_number().over(in_order) - 1)
                .withColumn("weight", weight)
                .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
                .withColumn("ratio", F.col("cap") / F.col("weight"))
                .withColumn("asked", F.sum("source_size").over(every) * F.lit(float(share)))
                .withColumn("level", (F.col("asked") - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0)))
                            / F.sum("weight").over(behind))
                # Past the settling point more than the level is subtracted, so the largest open level is the common one.
                .withColumn("settled", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every)))
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(F.col("settled"), F.col("ratio")))
    return levelled.select("source_key", "source", "source_size", "pos", target.alias("target"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2,
                  shards: int = 64, block_words: int = 1024, seed: int = 17, id_col: str = "doc_id",
                  text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, pieces (and ``carried``).

    `pieces` is an array of (shard, epoch, start, n_words, shuffle_key): words
    [start, start + n_words) of the document go to `shard`, where pieces are
    ordered by `shuffle_key`. A piece's blocks are consecutive; a document has
    more than one piece where a shard boundary or the quota's end cuts it, or
    where it is taken again in the second epoch.
    """
    # The non-null key makes the null source joinable; the order is that of the md5, whatever the number of buckets.
    # With the text's digest in the draw, rows of one id spread, and their order is fixed between reruns.
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
                         F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("source_key"),
                         F.md5(F.concat_ws("|", F.lit(str(int(seed))), F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary"))).cast("binary"))
                         .alias("draw"), *([F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []))
    narrow = materialise(narrow, "mix-sizes")
    buckets = max(1, narrow.count() // ROWS_PER_BUCKET)
    bucket = F.expr(f"CAST(conv(substr(draw, 1, 8), 16, 10) AS BIGINT) * {buckets} div 4294967296").cast("int")
    placed = narrow.withColumn("bucket", bucket)

    totals = placed.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    totals = materialise(totals, "mix-totals")
    sizes = totals.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, share, max_epochs)
                          .withColumn("quota", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * max_epochs).cast("long"))
                          .withColumn("n_blocks", F.ceil(F.col("quota") / block_words).cast("long")), "mix-targets")

    leaves = splitting_tree(targets.select("pos", "n_blocks"), shards, seed)
    cuts = (leaves.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("shard", "n_blocks"))).alias("c"))
            .select("pos", F.expr("aggregate(c, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x.n_blocks)))").alias("cuts")))
    targets = materialise(targets.join(cuts, "pos").drop("pos", "n_blocks", "source"), "mix-quotas")

    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals.select("source_key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words_before"))
               .join(targets, "source_key"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    line = (placed.join(offsets, ["source_key", "bucket"])
            .withColumn("at", F.col("words_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))))
    return line.select("doc_id", "source", "size", "source_size", "target", _pieces(shards, block_words, max_epochs, seed).alias("pieces"),
                       *(["carried"] if carry else []))


def _pieces(shards: int, block_words: int, max_epochs: int, seed: int) -> Column:
    """Overlaps of the document's place on the line, in each epoch, with the shards' word ranges."""
    first = "(at + e * source_size)"
    # Shard s holds blocks [cuts[s], cuts[s + 1]); the last block of a source ends at its quota.
    begin = f"greatest({first}, cuts[s] * {block_words}L)"
    end = f"least({first} + size, cuts[s + 1] * {block_words}L, quota)"
    key = f"md5(concat_ws('|', '{int(seed)}', draw, CAST(e AS STRING), CAST(s AS STRING)))"
    return F.expr(
        f"filter(flatten(transform(sequence(0L, {max_epochs - 1}L), e -> IF(size = 0 OR {first} >= quota, "
        "CAST(array() AS ARRAY<STRUCT<shard: INT, epoch: INT, start: BIGINT, n_words: BIGINT, shuffle_key: STRING>>), "
        f"transform(filter(sequence(0, {shards - 1}), s -> {end} > {begin}), s -> named_struct('shard', s, 'epoch', CAST(e AS INT), "
        f"'start', {begin} - {first}, 'n_words', {end} - {begin}, 'shuffle_key', {key}))))), x -> x.n_words > 0)")


def taken_words() -> Column:
    """Words that the mix takes of a document, repeats counted."""
    return F.expr("aggregate(pieces, 0L, (a, x) -> a + x.n_words)")


def shard_pieces(mixed: DataFrame) -> DataFrame:
    """The mixture itself: one row per piece, shuffled inside each shard and stored by shard."""
    flat = mixed.select("doc_id", "source", "size", F.explode("pieces").alias("p"), *[c for c in mixed.columns if c == "carried"])
    return (flat.select("p.*", *[c for c in flat.columns if c != "p"])
            .repartition("shard", F.substring("shuffle_key", 1, 1)).sortWithinPartitions("shard", "shuffle_key"))


def piece_text(text: Column, size: Column, start: Column, n_words: Column) -> Column:
    """Words [start, start + n_words) of a text of `size` words, each with the white space before it, and behind the last word
    the rest: so the pieces of a text, end to end, are the text."""
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), 0)
    cut = F.array_join(F.slice(words, (start + 1).cast("int"), n_words.cast("int")), "")
    tail = F.when(start + n_words == size, F.regexp_extract(text, r"[\x20\x09-\x0D]*\z", 0)).otherwise(F.lit(""))
    return F.when((start == 0) & (n_words == size), text).otherwise(F.concat(cut, tail))


def mixture(docs: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """(shard, shuffle_key, docs): the mixture's pieces in shard order, each with its row of `docs`, the text cut to the piece.

    `docs` is read from files (or written first): a row's file and place there are its key. Places on the
    line and pieces are worked out on narrow rows; the texts are read again for the
    join by key, cut, and then shuffled by shard: no more than the mixture moves.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = materialise(docs, "mix-docs")
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.struct("_metadata.file_name", "_metadata.row_index").alias("row_key"))
    narrow = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    pieces = mix_documents(narrow, text_col=text_col, carry=("_file", "_row"), **params)
    flat = pieces.select("size", F.struct(F.col("carried._file").alias("file_name"), F.col("carried._row").alias("row_index")).alias("row_key"),
                         F.explode("pieces").alias("p"))
    # The narrow side is hashed, so texts aren't sorted for the join.
    met = keyed.join(flat.hint("shuffle_hash"), "row_key")
    cut = piece_text(F.col(f"row.{text_col}"), F.col("size"), F.col("p.start"), F.col("p.n_words"))
    return (met.select("p.shard", "p.shuffle_key", F.col("row").withField(text_col, cut).alias("row"))
            .repartition("shard", F.substring("shuffle_key", 1, 1)).sortWithinPartitions("shard", "shuffle_key"))
