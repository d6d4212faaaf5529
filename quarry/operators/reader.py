"""Reader-side operators: reader sets, padded slots, candidate answers and metrics.

Row layouts
-----------
examples : qid, question, answers array<string>, ctxs array<struct<id,title,text,dataset,score,has_answer>>
loaded   : qid, idx (ctx index), win, offset, first, stop, pid, q_tokens, tokens, spans, is_positive, is_negative
slots    : qid, slot (0..num_passages-1), idx (-1 = padding), win, offset, first, stop, pid, q_tokens, tokens
scores   : slots + classifier_logit double, start_logits array<double>, end_logits array<double>

A passage longer than a reader input is read in windows (`spans.with_windows`) that
together cover it: a row is one window, and a passage's score is the best of its
windows'. All per-question work is keyed by qid; a question holds at most
``max_load_passages`` ctxs, so nothing unbounded is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import spans as S
from quarry.functions.text import clean_question, normalize_answer, word_tokens

CTX_TYPE = "struct<id:bigint,title:string,text:string,dataset:string,score:double,has_answer:boolean>"


def nest_hits(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """D15/A17 shape: one row per question with its ctxs ordered by rank.

    hits: qid, rank, id, title, text, dataset, score, has_answer."""
    ctx = F.struct(F.col("rank"), F.struct(
        F.col("id").cast("bigint").alias("id"), "title", "text", "dataset",
        F.col("score").cast("double").alias("score"), F.col("has_answer").cast("boolean").alias("has_answer")
    ).alias("c"))
    nested = hits.groupBy("qid").agg(F.array_sort(F.collect_list(ctx)).alias("_ctxs"))
    return (questions.select("qid", "question", "answers").join(nested, "qid", "left")
            .select("qid", "question", "answers",
                    F.coalesce(F.transform("_ctxs", lambda x: x["c"]), F.array().cast(f"array<{CTX_TYPE}>"))
                    .alias("ctxs")))


def tokenize_examples(examples: DataFrame) -> DataFrame:
    """Question tokens (after B1) and answer tokens, computed once per question."""
    return (examples.withColumn("q_tokens", word_tokens(clean_question("question")))
            .withColumn("a_tokens", F.transform("answers", lambda a: word_tokens(a))))


def ctx_slots(examples: DataFrame, *, max_load_passages: int | None, max_input_length: int,
              max_answer_length: int = 10, from_start: bool = False) -> DataFrame:
    """B10 (cap) + H19 + H20 + B11 per loaded ctx: one row per (qid, idx, win).

    Windows share as many tokens as the longest span or answer has, less one, so none of
    these is cut. is_positive = has_answer and an answer span lies in this window;
    is_negative = not has_answer (null has_answer counts as negative). With a column
    ``gold`` (a ctx struct or null, C8) that passage follows the loaded ones, as neither."""
    ex = tokenize_examples(examples)
    if max_load_passages is not None:
        ex = ex.withColumn("ctxs", F.slice("ctxs", 1, max_load_passages))
    ex = ex.withColumn("_n", F.size("ctxs"))
    if "gold" in ex.columns:
        ex = ex.withColumn("ctxs", F.when(F.col("gold").isNotNull(), F.concat("ctxs", F.array("gold"))).otherwise(F.col("ctxs")))
    rows = ex.select("qid", "q_tokens", "a_tokens", "_n", F.posexplode("ctxs").alias("idx", "ctx"))
    rows = rows.withColumn("_p", S.passage_part(word_tokens(F.coalesce(F.col("ctx.title"), F.lit(""))),
                                                word_tokens(F.coalesce(F.col("ctx.text"), F.lit("")))))
    longest = F.coalesce(F.array_max(F.transform("a_tokens", lambda a: F.size(a))), F.lit(0))
    has = F.coalesce(F.col("ctx.has_answer"), F.lit(False))
    rows = rows.select("qid", F.col("idx").cast("int").alias("idx"), F.col("ctx.id").alias("pid"), has.alias("_has"),
                       (F.col("idx") >= F.col("_n")).alias("is_gold"), "q_tokens", "a_tokens", "_p")
    rows = S.with_windows(rows, "q_tokens", "_p", max_input_length, F.greatest(F.lit(max_answer_length), longest) - 1)
    rows = rows.withColumn("spans", S.answer_spans("tokens", "a_tokens", from_start=from_start))
    return rows.select("qid", "idx", "win", "offset", "first", "stop", "pid", "q_tokens", "tokens", "spans", "is_gold",
                       (F.col("_has") & (F.size("spans") > 0)).alias("is_positive"), (~F.col("_has") & ~F.col("is_gold")).alias("is_negative"))


def positive_negative_lists(slots: DataFrame) -> DataFrame:
    """B11 per question: ordered positive and negative ctx indices; a ctx is positive if one of its windows is."""
    return slots.groupBy("qid").agg(
        F.array_sort(F.collect_set(F.when(F.col("is_positive") & ~F.col("is_gold"), F.col("idx")))).alias("positive_idxs"),
        F.array_sort(F.collect_set(F.when(F.col("is_negative"), F.col("idx")))).alias("negative_idxs"))


def padding_columns(max_input_length: int) -> list:
    """I8: the input of a slot without a passage, after qid, slot and idx."""
    none = F.array().cast("array<string>")
    return [F.lit(0).alias("win"), F.lit(0).alias("offset"), F.lit(0).alias("first"), F.lit(max(max_input_length, 4)).alias("stop"),
            F.lit(None).cast("bigint").alias("pid"), none.alias("q_tokens"), S.reader_input(none, none, none, max_input_length).alias("tokens")]


def eval_slots(examples: DataFrame, *, num_passages: int, max_load_passages: int | None,
               max_input_length: int, max_answer_length: int = 10, loaded: DataFrame | None = None) -> DataFrame:
    """I7 + I8: the windows of the first num_passages loaded ctxs in order, padded with idx -1 slots."""
    if loaded is None:
        loaded = ctx_slots(examples, max_load_passages=max_load_passages, max_input_length=max_input_length,
                           max_answer_length=max_answer_length)
    real = loaded.where(F.col("idx") < num_passages).select(
        "qid", F.col("idx").alias("slot"), "idx", "win", "offset", "first", "stop", "pid", "q_tokens", "tokens")
    n_loaded = F.size("ctxs") if max_load_passages is None else F.least(F.size("ctxs"), F.lit(max_load_passages))
    pad = (examples.select("qid", S._range(n_loaded, F.lit(num_passages - 1)).alias("pads"))
           .select("qid", F.explode("pads").alias("slot"))
           .select("qid", F.col("slot").cast("int").alias("slot"), F.lit(-1).alias("idx"), *padding_columns(max_input_length)))
    return real.unionByName(pad)


def top_passages(scores: DataFrame, n: int) -> DataFrame:
    """the slots of the n highest classifier logits per question (ties: lowest slot), all
    their windows; a passage's logit is its best window's."""
    whole = Window.partitionBy("qid", "slot")
    order = Window.partitionBy("qid").orderBy(F.col("_best").desc(), F.col("slot").asc())
    # Both windows need rows dealt by question only.
    ranked = (scores.repartition("qid").withColumn("_best", F.max("classifier_logit").over(whole))
              .withColumn("passage_rank", F.dense_rank().over(order)))
    return ranked.where(F.col("passage_rank") <= n).drop("_best")


def answer_candidates(scores: DataFrame, *, num_passages_to_read: int = 1, num_spans: int = 1,
                      max_answer_length: int = 10, allow_overlap: bool = True) -> DataFrame:
    """F4 -> F5 -> H17 -> H18 -> F6: ranked answer candidates per question.

    Spans are found per window; of all windows of a passage its num_spans best stay. score =
    classifier logit of the window + start logit + end logit (logits of the original span
    edges); order: score desc, then passage order, then span order. span_start and span_end
    are places in the window's input, passage_start is the place among the passage's tokens
    (title, separator, text; null for a span that starts before them)."""
    best = S.best_spans("tokens", "start_logits", "end_logits", num_spans=num_spans,
                        max_answer_length=max_answer_length, allow_overlap=allow_overlap, first="first", stop="stop")
    # Spans are searched where the inputs were scored: token and logit arrays are never shuffled.
    found = scores.select("qid", "slot", "idx", "win", "offset", F.size("q_tokens").alias("q_size"), "tokens", "classifier_logit", best.alias("spans"))
    # Of the texts only what needs tokens is made before the cut: the input's once, a span's part of it per span.
    parts = F.transform("spans", lambda sp: S.answer_parts("tokens", sp["start"], sp["end"]))
    found = found.select("qid", "slot", "idx", "win", "offset", "q_size", "classifier_logit", "spans", parts.alias("parts"),
                         S.detokenize("tokens").alias("text"))
    read = top_passages(found, num_passages_to_read)
    found = read.select("qid", "slot", "idx", "win", "offset", "q_size", "passage_rank", "classifier_logit", "text",
                        F.posexplode(F.arrays_zip("spans", "parts")).alias("nth", "x"))
    found = found.select("*", "x.spans", "x.parts").withColumnsRenamed({"spans": "span", "parts": "part"})
    total = F.col("classifier_logit") + F.col("span.start_logit") + F.col("span.end_logit")
    per_passage = Window.partitionBy("qid", "slot").orderBy(total.desc(), F.col("win").asc(), F.col("nth").asc())
    cands = found.withColumn("span_rank", F.row_number().over(per_passage)).where(F.col("span_rank") <= num_spans)
    place = F.col("span.start") - F.col("q_size") - 2 + F.col("offset")
    cands = cands.select(
        "qid", "slot", "idx", "win", "passage_rank", "span_rank", S.placed_answer("text", "part").alias("t"),
        F.col("classifier_logit").alias("classifier_score"),
        (F.col("span.start_logit") + F.col("span.end_logit")).alias("span_score"),
        F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"),
        F.when(F.col("span.start") >= F.col("q_size") + 2, place).alias("passage_start"))
    cands = cands.withColumn("score", F.col("classifier_score") + F.col("span_score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("passage_rank").asc(),
                                          F.col("span_rank").asc())
    return cands.withColumn("rank", F.row_number().over(w)).select(
        "qid", "rank", "slot", "idx", "win", "span_start", "span_end", "passage_start", F.col("t.input_text").alias("input_text"),
        F.col("t.answer_text").alias("answer_text"), F.col("t.answer_start").alias("answer_start"),
        F.col("t.answer_end").alias("answer_end"), "score", "classifier_score", "span_score")


def classifier_precision(scores: DataFrame, pos_neg: DataFrame) -> DataFrame:
    """D4 per question: is the arg-max slot (padding included, Q10) a positive ctx."""
    w = Window.partitionBy("qid").orderBy(F.col("classifier_logit").desc(), F.col("slot").asc(), F.col("win").asc())
    top = scores.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select("qid", "idx")
    return top.join(pos_neg, "qid", "left").select(
        "qid", F.coalesce(F.array_contains("positive_idxs", F.col("idx")), F.lit(False)).alias("correct"))


def answer_accuracy(scores: DataFrame, examples: DataFrame, *, max_answer_length: int,
                    normalization: str = "dpr") -> DataFrame:
    """D5 per question: normalised best answer (1 passage, 1 span) in normalised gold answers."""
    best = answer_candidates(scores, num_passages_to_read=1, num_spans=1,
                             max_answer_length=max_answer_length).where(F.col("rank") == 1)
    gold = examples.select("qid", F.explode("answers").alias("a")) \
        .select("qid", normalize_answer("a", normalization).alias("a"))
    gold = gold.groupBy("qid").agg(F.collect_set("a").alias("gold"))
    pred = best.select("qid", normalize_answer("answer_text", normalization).alias("pred"))
    return examples.select("qid").join(pred, "qid", "left").join(gold, "qid", "left").select(
        "qid", F.coalesce(F.array_contains("gold", F.col("pred")), F.lit(False)).alias("correct"))


def mean_metric(per_question: DataFrame, name: str) -> DataFrame:
    """D14 tail: one value over questions; shards that overlap are merged before (`metrics.merge_shards`)."""
    # The index is counted where there is one, so that a check on it is not pruned away.
    n = F.count("example_idx" if "example_idx" in per_question.columns else F.lit(1))
    return per_question.agg(F.round(F.avg(F.col("correct").cast("double")), 6).alias(name), n.cast("bigint").alias("n_questions"))


def classifier_loss(scores: DataFrame, *, label_slot: int = 0, mask_value: float = -1e8) -> DataFrame:
    """Sum over questions of -log softmax(masked logits)[label slot]; padding masked."""
    logit = F.when(F.col("idx") >= 0, F.col("classifier_logit")).otherwise(F.lit(mask_value))
    s = scores.select("qid", "slot", logit.alias("z"))
    mx = s.groupBy("qid").agg(F.max("z").alias("mx"))
    per_q = (s.join(mx, "qid").groupBy("qid", "mx")
             .agg(F.sum(F.exp(F.col("z") - F.col("mx"))).alias("se"),
                  F.max(F.when(F.col("slot") == label_slot, F.col("z"))).alias("zl")))
    return per_q.agg(F.round(F.sum(F.log("se") + F.col("mx") - F.col("zl")), 6).alias("classifier_loss"))


def span_loss(train_rows: DataFrame) -> DataFrame:
    """-log sum over labelled spans of p_start(s) * p_end(e), summed over questions.

    train_rows: qid, start_logits, end_logits, starts, ends, mask (slot 0 rows)."""
    def log_softmax_at(logits, pos):
        mx = F.array_max(logits)
        lse = F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - mx))) + mx
        return F.get(logits, pos) - lse

    probs = F.zip_with(
        F.arrays_zip("starts", "ends"), F.col("mask"),
        lambda se, m: F.when(m == 1, F.exp(log_softmax_at(F.col("start_logits"), se["starts"])
                                           + log_softmax_at(F.col("end_logits"), se["ends"]))).otherwise(0.0))
    total = F.aggregate(probs, F.lit(0.0), lambda acc, x: acc + x)
    return train_rows.agg(F.round(F.sum(-F.log(total)), 6).alias("span_loss"))
