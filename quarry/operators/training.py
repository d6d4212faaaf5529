"""Training-set assembly: retriever sets, batch samplers, pair tables, reader training rows.

Randomness is a seeded hash: every "random" order is the order of
``md5(seed|epoch|...|item)``, which is reproducible, independent of
partitioning and computable in any SQL engine. ``shuffle=False`` keeps the
input order. No step groups an unbounded set of rows into one task: orders
within a dataset key come from a distributed range sort plus per-key offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import spans as S
from quarry.functions.checks import guard
from quarry.operators import reader as RD
from quarry.session import stored
from quarry.sources.files import INPUT_ORDER, numbered_by, with_line_numbers

PASSAGE_TYPE = "struct<id:string,title:string,text:string>"


def seeded_hash(*parts) -> Column:
    """Deterministic 32-bit pseudo-random value from md5 of '|'-joined parts."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8), 16, 10) \
        .cast("bigint")


def shuffled(arr: Column, *key) -> Column:
    """Seeded permutation of an array (ties impossible: position is part of the key)."""
    tagged = F.transform(arr, lambda x, i: F.struct(seeded_hash(*key, i).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda s: s["x"])


# ------------------------------------------------------------------ A11, B6, B7, B2, B3

def _ctx_list(col: str) -> Column:
    return F.transform(F.coalesce(F.col(col), F.array()),
                       lambda c: F.struct(c["passage_id"].cast("string").alias("id"), c["title"].alias("title"),
                                          c["text"].alias("text")))


def retriever_examples(items: DataFrame, *, max_positives: int | None = None,
                       max_hard_negatives: int | None = None, max_normal_negatives: int | None = None,
                       dataset_keys: Sequence[str] | None = None) -> DataFrame:
    """A11 + B6 + B7 + B2 + B3: parsed, capped and filtered retriever examples.

    items: `read_variant_items` output with file_no. Returns question, answers, dataset (''
    when absent), positives, hard_negatives, normal_negatives
    (array<struct<id,title,text>>), metadata (JSON of every field that is not consumed,
    whatever it is), file_no, src_file, line_no."""
    consumed = ", ".join(f"'{c}'" for c in ("question", "answers", "dataset", "positive_ctxs", "hard_negative_ctxs", "negative_ctxs"))
    meta = F.to_json(F.expr(f"map_filter(CAST(item AS MAP<STRING, VARIANT>), (k, v) -> k NOT IN ({consumed}))"))
    ctx = "array<struct<passage_id:string,title:string,text:string>>"
    fields = {"question": "string", "answers": "array<string>", "positive_ctxs": ctx, "hard_negative_ctxs": ctx, "negative_ctxs": ctx}
    items = items.select(*[F.expr(f"variant_get(item, '$.{c}', '{t}')").alias(c) for c, t in fields.items()],
                         F.coalesce(F.expr("variant_get(item, '$.dataset', 'string')"), F.lit("")).alias("dataset"),
                         meta.alias("metadata"), "file_no", "src_file", "line_no")

    def cap(col, n):
        c = _ctx_list(col)
        return c if n is None else F.slice(c, 1, n) if n > 0 else F.array().cast(f"array<{PASSAGE_TYPE}>")

    ex = items.select("question", "answers", "dataset",
                      cap("positive_ctxs", max_positives).alias("positives"),
                      cap("hard_negative_ctxs", max_hard_negatives).alias("hard_negatives"),
                      cap("negative_ctxs", max_normal_negatives).alias("normal_negatives"),
                      "metadata", "file_no", "src_file", "line_no")
    ex = ex.where(F.size("positives") > 0).where(F.size("hard_negatives") + F.size("normal_negatives") > 0)
    if dataset_keys is not None:
        ex = ex.where(F.col("dataset").isin(list(dataset_keys)))
    return ex


def number_examples(examples: DataFrame, col: str = "index") -> DataFrame:
    """Re-number kept examples 0..n-1 in input order (file_no, src_file, line_no)."""
    return numbered_by(examples, INPUT_ORDER, col)


# ------------------------------------------------------------------ I3, I4, C9, I5

def pick_pairs(examples: DataFrame, *, num_negatives: int, training: bool, seed: int = 0, epoch: int = 0,
               shuffle_positives: bool = True, shuffle_hard: bool = True, shuffle_normal: bool = True,
               max_hard: int | None = None, max_normal: int | None = None) -> DataFrame:
    """I3 + I4 (+G2): one positive and exactly ``num_negatives`` negatives per example.

    Hard negatives come first; fewer negatives than requested is an error."""
    idx = F.col("index")
    pos = F.when(F.lit(training and shuffle_positives),
                 F.get("positives", F.pmod(seeded_hash(seed, epoch, "pos", idx), F.size("positives")).cast("int"))
                 ).otherwise(F.get("positives", 0))
    hard = shuffled(F.col("hard_negatives"), seed, epoch, "hard", idx) if training and shuffle_hard \
        else F.col("hard_negatives")
    normal = shuffled(F.col("normal_negatives"), seed, epoch, "normal", idx) if training and shuffle_normal \
        else F.col("normal_negatives")
    if max_hard is not None:
        hard = F.slice(hard, 1, max_hard) if max_hard > 0 else F.array().cast(f"array<{PASSAGE_TYPE}>")
    if max_normal is not None:
        normal = F.slice(normal, 1, max_normal) if max_normal > 0 else F.array().cast(f"array<{PASSAGE_TYPE}>")
    negs = F.slice(F.concat(hard, normal), 1, num_negatives) if num_negatives > 0 \
        else F.array().cast(f"array<{PASSAGE_TYPE}>")
    out = examples.select("*", pos.alias("positive"), negs.alias("negatives"))
    return out.withColumn("negatives", guard("negatives", F.size("negatives") == num_negatives,
                                             "num_negative_passages is larger than the available negatives"))


def flatten_pairs(picked: DataFrame, keep: Sequence[str] = ("index", "question")) -> DataFrame:
    """(question, passage) rows, positive at slot 0, negatives after it."""
    return picked.select(*keep, F.posexplode(F.concat(F.array("positive"), F.col("negatives")))
                         .alias("slot", "passage")).select(
        *keep, F.col("slot").cast("int").alias("slot"), F.col("passage.id").alias("passage_id"),
        F.col("passage.title").alias("title"), F.col("passage.text").alias("text"))


def backfill_from_store(pairs: DataFrame, store: DataFrame, *, strict: bool = True) -> DataFrame:
    """Take title/text from the passage store where the set has none; fail if still missing.

    Only incomplete pairs meet the store, by numeric id; complete ones pass by. The ids
    that are wanted are stored first, so Spark knows their size: below its broadcast
    threshold the store is filtered where it lies and its texts are not shuffled."""
    whole = F.col("title").isNotNull() & F.col("text").isNotNull()
    missing = pairs.where(~whole)
    wanted = stored(missing.select(F.col("passage_id").cast("bigint").alias("id")).where(F.col("id").isNotNull()).distinct(), "wanted-ids")
    found = store.join(wanted, "id", "left_semi").select("id", F.col("title").alias("_st"), F.col("text").alias("_sx"))
    filled = missing.withColumn("id", F.col("passage_id").cast("bigint")).join(found, "id", "left").drop("id")
    filled = filled.withColumn("title", F.coalesce("title", "_st")).withColumn("text", F.coalesce("text", "_sx")).drop("_st", "_sx")
    if strict:
        filled = filled.withColumn("text", guard("text", F.col("title").isNotNull() & F.col("text").isNotNull(),
                                                 "passage has no title/text and the store lacks it"))
    return pairs.where(whole).unionByName(filled)


# ------------------------------------------------------------------ I9, I1, I2, E5, D7

def plain_batches(examples: DataFrame, batch_size: int, *, shuffle: bool, seed: int = 0, epoch: int = 0,
                  num_replicas: int = 1, rank: int = 0) -> DataFrame:
    """I9 (+I2 sharding): epoch order (seeded hash when shuffling, index order
    otherwise) cut into batches of ``batch_size``; replica ``rank`` keeps every
    num_replicas-th example."""
    if not 0 <= rank < num_replicas:
        raise ValueError(f"invalid rank {rank}, must be in [0, {num_replicas - 1}]")
    key = seeded_hash(seed, epoch, F.col("index")) if shuffle else F.col("index")
    ordered = numbered_by(examples.withColumn("_k", key), ("_k", "index"), "_pos").drop("_k")
    mine = ordered.where(F.pmod(F.col("_pos"), F.lit(num_replicas)) == rank) \
        .withColumn("_pos", F.floor(F.col("_pos") / num_replicas))
    return mine.withColumn("batch_id", F.floor(F.col("_pos") / batch_size).cast("bigint")) \
        .withColumn("batch_pos", F.pmod(F.col("_pos"), F.lit(batch_size)).cast("int")).drop("_pos")


def multi_key_batches(examples: DataFrame, *, batch_size: int, weights: Mapping[str, float] | None = None,
                      shuffle: bool = True, seed: int = 0, epoch: int = 0, num_replicas: int = 1,
                      rank: int = 0, key: str = "dataset", idx: str = "key_idx") -> DataFrame:
    """I1 + I2 + E5: weighted multi-key batches.

    Per key: int(w)+1 permutations of its examples laid end to end and cut to
    floor(size * w); cut into chunks of batch_size * num_replicas, a short
    tail chunk dropped; every chunk holds one key; chunks are ordered by a
    seeded hash; replica ``rank`` takes chunk members rank, rank+R, ...
    Missing weights are 1.0. Returns (batch_no, batch_pos, dataset, key_idx)."""
    if not 0 <= rank < num_replicas:
        raise ValueError(f"invalid rank {rank}, must be in [0, {num_replicas - 1}]")
    chunk = batch_size * num_replicas
    weights = dict(weights or {})
    wmap = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) \
        if weights else None
    w = F.coalesce(F.element_at(wmap, F.col(key)), F.lit(1.0)) if wmap is not None else F.lit(1.0)
    ex = examples.select(key, idx).withColumn("_w", w.cast("double"))
    sizes = ex.groupBy(key, "_w").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_take", F.floor(F.col("_n") * F.col("_w")).cast("bigint"))
    reps = ex.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.floor("_w").cast("int"))))
    order = seeded_hash(seed, epoch, F.col(key), F.col("_rep"), F.col(idx)) if shuffle else F.col(idx)
    reps = reps.withColumn("_o", order)
    # Global range sort by (key, rep, order) spreads even a dominant key over many tasks.
    ranked = with_line_numbers(reps.orderBy(key, "_rep", "_o", idx), "_g")
    first = ranked.groupBy(key).agg(F.min("_g").alias("_g0"))
    # per-key tables (one row per key) are joined without hints: AQE broadcasts them
    # after measuring their runtime size, and shuffles them otherwise
    pos = ranked.join(first, key).withColumn("_pos", F.col("_g") - F.col("_g0")) \
        .join(sizes.select(key, "_take"), key)
    full_chunks = F.floor(F.col("_take") / chunk)
    kept = pos.where(F.col("_pos") < F.col("_take")).withColumn("_chunk", F.floor(F.col("_pos") / chunk)) \
        .where(F.col("_chunk") < full_chunks)
    kept = kept.withColumn("_slot", F.pmod(F.col("_pos"), F.lit(chunk)))
    chunks = kept.select(key, "_chunk").distinct()
    corder = seeded_hash(seed, epoch, "chunk", F.col(key), F.col("_chunk")) if shuffle else F.lit(0)
    chunks = with_line_numbers(chunks.withColumn("_co", corder).orderBy("_co", key, "_chunk"), "batch_no") \
        .select(key, "_chunk", "batch_no")
    mine = kept.where(F.pmod(F.col("_slot"), F.lit(num_replicas)) == rank)
    return (mine.join(chunks, [key, "_chunk"])
            .select("batch_no", F.floor(F.col("_slot") / num_replicas).cast("int").alias("batch_pos"), key, idx))


def multi_key_batch_count(sizes: Mapping[str, int], weights: Mapping[str, float] | None, batch_size: int,
                          num_replicas: int = 1) -> int:
    """Sampler length: sum over keys of floor(floor(size * w) / (batch_size * replicas))."""
    import math
    chunk = batch_size * num_replicas
    return sum(math.floor(math.floor(n * float((weights or {}).get(k, 1.0))) / chunk) for k, n in sizes.items())


def key_indices(examples: DataFrame, key: str = "dataset", order: str = "index", col: str = "key_idx") -> DataFrame:
    """Per-key 0-based index in ``order`` (multi-key addressing (key, idx)), via a
    distributed sort and per-key offsets rather than a per-key window."""
    g = with_line_numbers(examples.orderBy(key, order), "_g")
    first = g.groupBy(key).agg(F.min("_g").alias("_g0"))
    return g.join(first, key).withColumn(col, (F.col("_g") - F.col("_g0")).cast("bigint")) \
        .drop("_g", "_g0")


# ------------------------------------------------------------------ reader training set

def canonical_questions(examples: DataFrame, canonical: DataFrame) -> DataFrame:
    """Replace a question by its canonical form when one is known."""
    return examples.join(canonical.withColumnRenamed("key", "question"), "question", "left") \
        .withColumn("question", F.coalesce("canonical", "question")).drop("canonical")


def with_gold(examples: DataFrame, gold: DataFrame) -> DataFrame:
    """The gold passage of each question as a ctx struct in ``gold`` (null if there is none)."""
    ctx = F.struct("id", "title", "text", F.lit(None).cast("string").alias("dataset"), F.lit(None).cast("double").alias("score"),
                   F.lit(None).cast("boolean").alias("has_answer"))
    return examples.join(gold.select(F.col("key").alias("question"), ctx.alias("gold")), "question", "left")


def gold_positives(pos_idxs: Column, ctxs: Column, gold_title: Column, cap: int | None) -> Column:
    """C7 (+B10 positives cap): positives whose title equals the gold title
    (lower-cased); when none does, the first ``cap`` positives."""
    gold = F.filter(pos_idxs, lambda i: F.lower(F.get(ctxs, i)["title"]) == F.lower(gold_title))
    fallback = pos_idxs if cap is None else F.slice(pos_idxs, 1, cap)
    return F.when(gold_title.isNotNull() & (F.size(gold) > 0), gold).otherwise(fallback)


def append_gold_passage(ctxs: Column, pos_idxs: Column, gold: Column, gold_has_span: Column):
    """C8 (off by default, as in the reference): when the gold passage is not
    already a positive (by id) and an answer span survives in its reader input,
    append it to the ctxs and its index to the positives.

    Returns struct(ctxs, positive_idxs)."""
    already = F.exists(pos_idxs, lambda i: F.get(ctxs, i)["id"] == gold["id"])
    add = gold.isNotNull() & ~already & gold_has_span
    return F.struct(F.when(add, F.concat(ctxs, F.array(gold))).otherwise(ctxs).alias("ctxs"),
                    F.when(add, F.concat(pos_idxs, F.array(F.size(ctxs)))).otherwise(pos_idxs)
                    .alias("positive_idxs"))


def reader_training_rows(loaded: DataFrame, examples: DataFrame, *, num_passages: int, seed: int = 0,
                         epoch: int = 0, max_positives: int | None = None, max_negatives: int | None = None,
                         max_load_passages: int | None = None, gold: DataFrame | None = None,
                         include_gold: bool = False) -> DataFrame:
    """B11 lists -> C7 -> B10 caps -> C8 -> B8 -> I6 -> I8: training slots per question.

    loaded: `ctx_slots` output; with ``include_gold`` it was made from examples with a
    ``gold`` column (`with_gold`). Slot 0 holds a seeded-random positive, then
    seeded-shuffled negatives up to num_passages, then padding (idx -1). Returns
    (qid, slot, idx)."""
    lists = loaded.groupBy("qid").agg(
        F.array_sort(F.collect_set(F.when(F.col("is_positive"), F.col("idx")))).alias("pos"),
        F.array_sort(F.collect_set(F.when(F.col("is_negative"), F.col("idx")))).alias("neg"),
        F.coalesce(F.bool_or(F.col("is_gold") & (F.size("spans") > 0)), F.lit(False)).alias("gold_span"))
    ctxs = F.col("ctxs") if max_load_passages is None else F.slice("ctxs", 1, max_load_passages)
    ex = examples.select("qid", "question", ctxs.alias("ctxs")).join(lists, "qid", "left")
    if gold is not None:
        ex = with_gold(ex, gold)
        pos = gold_positives(F.col("pos"), F.col("ctxs"), F.col("gold.title"), max_positives)
        if include_gold:
            pos = append_gold_passage(F.col("ctxs"), pos, F.col("gold"), F.col("gold_span"))["positive_idxs"]
    else:
        pos = F.col("pos") if max_positives is None else F.slice("pos", 1, max_positives)
    neg = F.col("neg") if max_negatives is None else F.slice("neg", 1, max_negatives)
    ex = ex.select("qid", pos.alias("pos"), neg.alias("neg")).where(F.size("pos") > 0)
    chosen = F.get("pos", F.pmod(seeded_hash(seed, epoch, "rpos", F.col("qid")), F.size("pos")).cast("int"))
    negs = F.slice(shuffled(F.col("neg"), seed, epoch, "rneg", F.col("qid")), 1, num_passages - 1)
    body = F.concat(F.array(chosen), negs)
    slots = F.concat(body, F.array_repeat(F.lit(-1), F.greatest(F.lit(0), F.lit(num_passages) - F.size(body))))
    return ex.select("qid", F.posexplode(slots).alias("slot", "idx")).select(
        "qid", F.col("slot").cast("int").alias("slot"), F.col("idx").cast("int").alias("idx"))


def reader_training_table(examples: DataFrame, *, num_passages: int, max_input_length: int, max_answer_length: int = 10,
                          max_answer_spans: int = 8, max_load_passages: int | None = None, max_positives: int | None = None,
                          max_negatives: int | None = None, gold: DataFrame | None = None, canonical: DataFrame | None = None,
                          include_gold: bool = False, seed: int = 0, epoch: int = 0) -> DataFrame:
    """B9 -> B10 -> H19/H20 -> B11 -> C7 -> C8 -> B8 -> I6 -> H21 -> I8 in one plan.

    Returns a row per slot: qid, slot, idx, win, pid, q_tokens, tokens, spans and
    starts/ends/mask padded to max_answer_spans. Of a passage's windows a slot takes one by
    seed and epoch, the positive's slot one that has an answer span, so that over the
    epochs the whole text is read. `training_batches` nests the slots per question."""
    if canonical is not None:
        examples = canonical_questions(examples, canonical)
    asked = with_gold(examples, gold) if gold is not None and include_gold else examples
    loaded = RD.ctx_slots(asked, max_load_passages=max_load_passages, max_input_length=max_input_length,
                          max_answer_length=max_answer_length)
    rows = reader_training_rows(loaded, examples, num_passages=num_passages, seed=seed, epoch=epoch, max_positives=max_positives,
                                max_negatives=max_negatives, max_load_passages=max_load_passages, gold=gold, include_gold=include_gold)
    fits = rows.join(loaded, ["qid", "idx"]).where((F.col("slot") > 0) | (F.size("spans") > 0))
    draw = Window.partitionBy("qid", "slot").orderBy(seeded_hash(seed, epoch, "rwin", F.col("qid"), F.col("idx"), F.col("win")), F.col("win"))
    columns = ["qid", "slot", "idx", "win", "offset", "first", "stop", "pid", "q_tokens", "tokens", "spans"]
    real = fits.withColumn("_draw", F.row_number().over(draw)).where(F.col("_draw") == 1).select(*columns)
    none = F.array().cast(loaded.schema["spans"].dataType).alias("spans")
    pad = rows.where(F.col("idx") < 0).select("qid", "slot", "idx", *RD.padding_columns(max_input_length), none)
    table = real.unionByName(pad).withColumn("_spans", S.pad_spans("spans", max_answer_spans))
    return table.select(*columns, "_spans.*")


def training_batches(table: DataFrame) -> DataFrame:
    """(qid, inputs): the slots of each question as one array, in slot order."""
    inputs = F.array_sort(F.collect_list(F.struct("slot", "idx", "win", "pid", "tokens", "starts", "ends", "mask")))
    return table.groupBy("qid").agg(inputs.alias("inputs"))


def dataset_sizes(examples: DataFrame, key: str = "dataset") -> DataFrame:
    """Examples per dataset key plus the total (key null)."""
    return examples.rollup(key).agg(F.count(F.lit(1)).cast("bigint").alias("n_examples"))
