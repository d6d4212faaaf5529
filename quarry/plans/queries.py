"""Registered queries: one per operator of the inventory, each over whole tables.

Every callable takes (spark, sf_dir) and returns a DataFrame whose column
names equal those of the matching SQL in ``quarry.plans.oracle``.
Doubles are rounded to 6 places and counts cast to bigint in both.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import inference as INF
from quarry.functions import spans as SP
from quarry.functions import text as X
from quarry.functions import vectors as V
from quarry.operators import knn
from quarry.operators import matching as MT
from quarry.operators import metrics as M
from quarry.operators import reader as RD
from quarry.operators import training as TR
from quarry.plans import reading as RG
from quarry.plans import retrieval as R
from quarry.session import scratch_path
from quarry.sources import files as FS
from quarry.sources import passages as PS
from quarry.sources import tables as T

DIM = 64
FLAG_K = 100
FLAG_BINARY_K = 128
RECALL_KS = (1, 2, 5, 10, 20, 50, 100)

QUERIES = {}


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- vectors

@query("h6_binarize")
def h6_binarize(spark, sf):
    v = T.vectors(spark, sf)
    bits = F.transform(V.binarize("embedding"), lambda b: b.cast("string"))
    return v.select("id", F.array_join(bits, "").alias("bits"))


@query("h7_pack_bits")
def h7_pack_bits(spark, sf):
    v = T.vectors(spark, sf)
    code = V.pack_bits(V.binarize("embedding"))
    return v.select("id", F.array_join(F.transform(code, lambda x: x.cast("string")), ",").alias("code"))


@query("h8_unpack_signs")
def h8_unpack_signs(spark, sf):
    v = T.vectors(spark, sf)
    signs = V.unpack_signs(V.sign_code("embedding"), DIM)
    return v.select("id", F.array_join(F.transform(signs, lambda x: F.when(x > 0, "+").otherwise("-")), "")
                    .alias("signs"))


@query("h9_inner_product")
def h9_inner_product(spark, sf):
    v = T.vectors(spark, sf)
    return v.select("id", _r6(V.inner_product("embedding", "embedding")).alias("sq_norm"),
                    _r6(V.inner_product("embedding", V.plus_minus_one("embedding"))).alias("l1_norm"))


@query("h10_hamming")
def h10_hamming(spark, sf):
    c = R.code_table(T.vectors(spark, sf))
    nxt = c.select((F.col("id") - 1).alias("id"), F.col("code").alias("next_code"))
    return c.join(nxt, "id").select("id", V.hamming("code", "next_code").alias("distance"))


# ---------------------------------------------------------------- k-NN

@query("c2_dense_knn")
def c2_dense_knn(spark, sf):
    v = T.vectors(spark, sf)
    hits = knn.dense_knn(v.select(F.col("id").alias("qid"), "embedding"), v, k=10, dim=DIM)
    return hits.select("qid", "id", _r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("c3_hamming_knn")
def c3_hamming_knn(spark, sf):
    c = R.code_table(T.vectors(spark, sf))
    hits = knn.hamming_knn(c.select(F.col("id").alias("qid"), "code"), c, k=10, dim=DIM)
    return hits.select("qid", "id", "distance", F.col("rank").cast("bigint").alias("rank"))


@query("c4_binary_rerank")
def c4_binary_rerank(spark, sf):
    v = T.vectors(spark, sf)
    hits = knn.binary_retrieve(v.select(F.col("id").alias("qid"), "embedding"), R.code_table(v),
                               k=10, binary_k=64, dim=DIM)
    return hits.select("qid", "id", "distance", _r6("score").alias("score"),
                       F.col("rank").cast("bigint").alias("rank"))


@query("d2_first_positive_rank")
def d2_first_positive_rank(spark, sf):
    _, ranks, _ = R.binary_label_eval(T.vectors(spark, sf), k=FLAG_K, binary_k=FLAG_BINARY_K, dim=DIM,
                                      ks=RECALL_KS)
    return ranks


@query("d1_recall_at_k")
def d1_recall_at_k(spark, sf):
    _, _, recall = R.binary_label_eval(T.vectors(spark, sf), k=FLAG_K, binary_k=FLAG_BINARY_K, dim=DIM,
                                       ks=RECALL_KS)
    return recall


@query("c1_hits_with_passages")
def c1_hits_with_passages(spark, sf):
    v = T.vectors(spark, sf)
    hits = knn.binary_retrieve(v.select(F.col("id").alias("qid"), "embedding"), R.code_table(v),
                               k=5, binary_k=64, dim=DIM)
    joined = R.attach_passages(hits.select("qid", "id", "rank"), T.passages(spark, sf))
    return joined.select("qid", F.col("rank").cast("bigint").alias("rank"), "id", "title", "dataset",
                         F.length("text").cast("bigint").alias("text_chars"))


# ---------------------------------------------------------------- text


TEXT_DIM = 64


@query("h1_nfd")
def h1_nfd(spark, sf):
    d = T.table(spark, sf, "documents")
    return d.select("doc_id", X.nfd("text").alias("nfd_text"))


@query("h1_nfkc")
def h1_nfkc(spark, sf):
    d = T.table(spark, sf, "documents")
    return d.select("doc_id", X.nfkc("text").alias("nfkc_text"))


@query("h2_word_tokens")
def h2_word_tokens(spark, sf):
    d = T.table(spark, sf, "documents")
    toks = X.word_tokens("text")
    return d.select("doc_id", F.size(toks).cast("bigint").alias("n_tokens"),
                    F.array_join(toks, " ").alias("tokens"))


@query("b1_clean_question")
def b1_clean_question(spark, sf):
    c = T.table(spark, sf, "conversations").where(F.col("role") == "user")
    asked = F.concat(F.col("text"), F.repeat(F.lit("?"), F.pmod(F.col("turn"), F.lit(3)).cast("int")))
    return c.select("conv_id", "turn", X.clean_question(asked).alias("question"))


@query("h5_normalize_answer")
def h5_normalize_answer(spark, sf):
    q = T.questions(spark, sf).select("qid", F.posexplode("answers").alias("idx", "answer"))
    return q.select("qid", F.col("idx").cast("bigint").alias("idx"),
                    X.normalize_answer("answer", "dpr").alias("n_dpr"),
                    X.normalize_answer("answer", "simple_nfd").alias("n_simple_nfd"),
                    X.normalize_answer("answer", "simple_nfkc").alias("n_simple_nfkc"),
                    X.normalize_answer("answer", "none").alias("n_none"))


@query("j1_encode_questions")
def j1_encode_questions(spark, sf):
    qv = R.encode_questions(T.questions(spark, sf), TEXT_DIM)
    return qv.select("qid", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")
                     .alias("vec"))


@query("j2_encode_passages")
def j2_encode_passages(spark, sf):
    pv = R.encode_passages(T.passages(spark, sf), TEXT_DIM)
    return pv.select("id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")
                     .alias("vec"))


def _text_eval(spark, sf):
    return R.text_retrieval_eval(T.questions(spark, sf), T.passages(spark, sf), k=20, binary_k=100,
                                 dim=TEXT_DIM, ks=(1, 5, 20))


@query("c5_has_answer_hits")
def c5_has_answer_hits(spark, sf):
    hits, _, _ = _text_eval(spark, sf)
    return hits.select("qid", F.col("rank").cast("bigint").alias("rank"), "id", "distance",
                       _r6("score").alias("score"), "has_answer")


@query("p3_text_recall")
def p3_text_recall(spark, sf):
    _, _, recall = _text_eval(spark, sf)
    return recall


@query("h3_match_types")
def h3_match_types(spark, sf):
    hits, _, _ = _text_eval(spark, sf)
    pairs = hits.select("qid", "id", X.match_text("title", "text", True).alias("passage"),
                        F.posexplode("answers").alias("idx", "answer"))
    return pairs.select("qid", "id", F.col("idx").cast("bigint").alias("idx"),
                        *[X.has_answer("answer", "passage", m).alias(f"m_{m}") for m in X.MATCH_TYPES])


# ---------------------------------------------------------------- reader


def _ints(col):
    return F.array_join(F.transform(col, lambda x: x.cast("bigint").cast("string")), ",")


def _spans_str(col):
    return F.array_join(F.transform(col, lambda s: F.concat_ws("-", s["start"].cast("string"),
                                                               s["end"].cast("string"))), ",")


def _examples(spark, sf):
    return RG.reader_set(T.questions(spark, sf), T.passages(spark, sf))


@query("p4_reader_set")
def p4_reader_set(spark, sf):
    ex = _examples(spark, sf)
    return ex.select("qid", F.size("ctxs").cast("bigint").alias("n_ctxs"),
                     _ints(F.transform("ctxs", lambda c: c["id"])).alias("ctx_ids"),
                     F.array_join(F.transform("ctxs", lambda c: F.when(c["has_answer"], "1").otherwise("0")), "")
                     .alias("has_answer"))


@query("h19_reader_input")
def h19_reader_input(spark, sf):
    slots = RD.eval_slots(_examples(spark, sf), num_passages=RG.NUM_PASSAGES,
                          max_load_passages=RG.MAX_LOAD_PASSAGES, max_input_length=RG.MAX_INPUT_LENGTH)
    return slots.select("qid", F.col("slot").cast("bigint").alias("slot"), F.col("idx").cast("bigint").alias("idx"),
                        F.col("win").cast("bigint").alias("win"), F.array_join("tokens", " ").alias("tokens"))


@query("h20_answer_spans")
def h20_answer_spans(spark, sf):
    rows = RD.ctx_slots(_examples(spark, sf), max_load_passages=RG.MAX_LOAD_PASSAGES,
                        max_input_length=RG.MAX_INPUT_LENGTH)
    return rows.select("qid", F.col("idx").cast("bigint").alias("idx"), F.col("win").cast("bigint").alias("win"),
                       _spans_str("spans").alias("spans"))


@query("h4_sublist_positions")
def h4_sublist_positions(spark, sf):
    """Every position of each question's token trigrams inside the question itself (H4 incl. overlaps)."""
    q = T.questions(spark, sf).select("qid", X.word_tokens("question").alias("t"))
    grams = q.select("qid", "t", F.posexplode(F.transform(
        SP._range(F.lit(0), F.size("t") - 3), lambda i: F.slice("t", i + 1, 3))).alias("g", "gram"))
    return grams.select("qid", F.col("g").cast("bigint").alias("g"),
                        _ints(SP.sublist_positions("gram", "t")).alias("positions"))


@query("b11_positive_negative")
def b11_positive_negative(spark, sf):
    rows = RD.ctx_slots(_examples(spark, sf), max_load_passages=RG.MAX_LOAD_PASSAGES,
                        max_input_length=RG.MAX_INPUT_LENGTH)
    pn = RD.positive_negative_lists(rows)
    return pn.select("qid", _ints("positive_idxs").alias("positive_idxs"),
                     _ints("negative_idxs").alias("negative_idxs"))


def _scores(spark, sf):
    slots = RD.eval_slots(_examples(spark, sf), num_passages=RG.NUM_PASSAGES,
                          max_load_passages=RG.MAX_LOAD_PASSAGES, max_input_length=RG.MAX_INPUT_LENGTH)
    return RG.score_slots(slots)


@query("j3_reader_logits")
def j3_reader_logits(spark, sf):
    s = _scores(spark, sf)
    return s.select("qid", F.col("slot").cast("bigint").alias("slot"), F.col("win").cast("bigint").alias("win"),
                    F.col("classifier_logit").alias("classifier_logit"),
                    _ints("start_logits").alias("start_logits"), _ints("end_logits").alias("end_logits"))


@query("f4_passages_to_read")
def f4_passages_to_read(spark, sf):
    top = RD.top_passages(_scores(spark, sf), 3).where(F.col("win") == 0)
    return top.select("qid", F.col("passage_rank").cast("bigint").alias("passage_rank"),
                      F.col("slot").cast("bigint").alias("slot"), F.col("idx").cast("bigint").alias("idx"))


@query("f5_best_spans")
def f5_best_spans(spark, sf):
    s = _scores(spark, sf)
    found = {name: _spans_str(SP.best_spans("tokens", "start_logits", "end_logits", num_spans=3, max_answer_length=RG.MAX_ANSWER_LENGTH,
                                            allow_overlap=overlap, first="first", stop="stop")).alias(name)
             for name, overlap in (("spans_overlap", True), ("spans_nested_off", False))}
    return s.select("qid", F.col("slot").cast("bigint").alias("slot"), F.col("win").cast("bigint").alias("win"), *found.values())


def _cand_cols(c):
    return c.select("qid", F.col("rank").cast("bigint").alias("rank"), F.col("slot").cast("bigint").alias("slot"),
                    F.col("win").cast("bigint").alias("win"), F.col("passage_start").cast("bigint").alias("passage_start"),
                    F.col("span_start").cast("bigint").alias("span_start"),
                    F.col("span_end").cast("bigint").alias("span_end"), "answer_text",
                    F.col("answer_start").cast("bigint").alias("answer_start"),
                    F.col("answer_end").cast("bigint").alias("answer_end"),
                    _r6("score").alias("score"), _r6("classifier_score").alias("classifier_score"),
                    _r6("span_score").alias("span_score"))


@query("h17_subword_edges")
def h17_subword_edges(spark, sf):
    """Words of more than four letters in pieces (`##` goes on): span edges grow over whole words."""
    q = T.questions(spark, sf).select(F.col("qid").alias("pid"), X.word_tokens("question").alias("words"))
    pieces = F.flatten(F.transform("words", lambda w: F.when(F.length(w) > 4, F.array(F.substring(w, 1, 4), F.concat(F.lit(SP.SUBWORD_PREFIX), F.substring(w, 5, 100000))))
                                   .otherwise(F.array(w))))
    scored = RG.score_slots(q.select("pid", pieces.alias("tokens"), F.array().cast("array<string>").alias("q_tokens")))
    best = SP.best_spans("tokens", "start_logits", "end_logits", num_spans=3, max_answer_length=5)
    found = scored.select(F.col("pid").alias("qid"), "tokens", F.posexplode(best).alias("nth", "s"))
    texts = SP.answer_texts("tokens", F.col("s.start"), F.col("s.end"))
    return found.select("qid", F.col("nth").cast("bigint").alias("nth"), F.col("s.start").cast("bigint").alias("span_start"),
                        F.col("s.end").cast("bigint").alias("span_end"), texts["answer_text"].alias("answer_text"))


@query("f6_answer_candidates")
def f6_answer_candidates(spark, sf):
    c = RD.answer_candidates(_scores(spark, sf), num_passages_to_read=2, num_spans=2,
                             max_answer_length=RG.MAX_ANSWER_LENGTH)
    return _cand_cols(c)


@query("h23_highlight")
def h23_highlight(spark, sf):
    c = RD.answer_candidates(_scores(spark, sf), num_passages_to_read=1, num_spans=1,
                             max_answer_length=RG.MAX_ANSWER_LENGTH)
    return c.select("qid", SP.highlight("input_text", "answer_text", "answer_start", "answer_end")
                    .alias("highlighted"))


def _examples_from_file(spark, sf):
    """P4 -> A17 (reader set written as JSON Lines) -> A12 (read back), as P5 consumes it."""
    path = scratch_path(spark, "reader-set.jsonl")
    FS.write_json_items(_examples(spark, sf), path)
    schema = f"qid bigint, question string, answers array<string>, ctxs array<{RD.CTX_TYPE}>"
    return FS.read_json_items(spark, path, schema=schema).drop("src_file", "line_no")


@query("d4_classifier_precision")
def d4_classifier_precision(spark, sf):
    _, prec, _ = RG.reader_eval(_examples_from_file(spark, sf))
    return RD.mean_metric(prec, "classifier_precision")


@query("d5_answer_accuracy")
def d5_answer_accuracy(spark, sf):
    _, _, acc = RG.reader_eval(_examples_from_file(spark, sf))
    return RD.mean_metric(acc, "answer_accuracy")


@query("p6_batch_qa")
def p6_batch_qa(spark, sf):
    c = RG.answer_questions(T.questions(spark, sf), T.passages(spark, sf), num_retrieval_passages=10,
                            num_passages_to_read=3, num_answer_candidates_per_passage=1)
    return _cand_cols(c)


# ---------------------------------------------------------------- sources, store


@query("a1_passage_tsv")
def a1_passage_tsv(spark, sf):
    path = scratch_path(spark, "passages.tsv")
    FS.write_passage_tsv(T.passages(spark, sf).orderBy("id"), path)
    df = FS.global_line_no(FS.read_passage_tsv(spark, path))
    return df.select("id", "title", "dataset", F.md5("text").alias("text_md5"), "pos")


def _store(spark, sf):
    """A4 fixture: the corpus, then a revised copy of every passage twice over
    (' [r1]' then ' [r2]'), as three ordered TSV inputs: the last copy must win."""
    p = T.passages(spark, sf)
    paths = [scratch_path(spark, f"store-v{i}.tsv.gz") for i in (1, 2, 3)]
    # The order of the inputs says which copy is last; within one, ids may come in any order.
    for path, revised in zip(paths, ("", " [r1]", " [r2]"), strict=True):
        FS.write_passage_tsv(p.withColumn("text", F.concat("text", F.lit(revised))) if revised else p, path)
    store = scratch_path(spark, "store.parquet")
    PS.build_passage_store(spark, paths, store)
    return store


@query("a4_passage_store")
def a4_passage_store(spark, sf):
    s = PS.scan_store(spark, _store(spark, sf))
    return s.select("id", "title", "dataset", F.md5("text").alias("text_md5"))


@query("a5_store_key_order")
def a5_store_key_order(spark, sf):
    return PS.key_order_positions(PS.scan_store(spark, _store(spark, sf))).select("id", "pos")


@query("a6_store_size")
def a6_store_size(spark, sf):
    return PS.store_size(PS.scan_store(spark, _store(spark, sf)))


@query("a7_lookup")
def a7_lookup(spark, sf):
    store = PS.scan_store(spark, _store(spark, sf))
    ids = T.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    return PS.lookup(ids, store).select("id", "quality", "title", F.md5("text").alias("text_md5"))


@query("a8_passage_table")
def a8_passage_table(spark, sf):
    path = scratch_path(spark, "passages-mem.tsv")
    p = T.passages(spark, sf)
    FS.write_passage_tsv(p.unionByName(p.select("id", "title", F.upper("dataset").alias("dataset"), "text"))
                         .orderBy(F.col("dataset").desc(), "id"), path)
    return PS.passage_table(spark, path).select("id", "dataset", F.md5("text").alias("text_md5"))


@query("a9_qa_tsv")
def a9_qa_tsv(spark, sf):
    path = scratch_path(spark, "qa.tsv")
    FS.write_qa_tsv(T.questions(spark, sf).orderBy("qid"), path)
    df = FS.global_line_no(FS.read_qa_tsv(spark, path).withColumn("file_no", F.lit(0)))
    return df.select("pos", "question", F.array_join("answers", "|").alias("answers"),
                     F.size("answers").cast("bigint").alias("n_answers"))


@query("a15_concat_files")
def a15_concat_files(spark, sf):
    """Two QA files read in order (benchmark questions, then user turns) + E4 index."""
    p1, p2 = scratch_path(spark, "qa1.tsv"), scratch_path(spark, "qa2.tsv")
    FS.write_qa_tsv(T.questions(spark, sf).orderBy("qid"), p1)
    conv = T.table(spark, sf, "conversations").where(F.col("role") == "user")
    FS.write_qa_tsv(conv.select(F.col("text").alias("question"), T.answers_of(F.col("text")).alias("answers"),
                                "conv_id", "turn").orderBy("conv_id", "turn"), p2)
    both = FS.concat_files([FS.read_qa_tsv(spark, p1), FS.read_qa_tsv(spark, p2)])
    idx = FS.dense_index(both, list(FS.INPUT_ORDER), "index")
    return idx.select("index", F.col("file_no").cast("bigint").alias("file_no"), F.md5("question").alias("q_md5"))


@query("a16_batches")
def a16_batches(spark, sf):
    path = scratch_path(spark, "qa-batches.tsv")
    FS.write_qa_tsv(T.questions(spark, sf).orderBy("qid"), path)
    df = FS.global_line_no(FS.read_qa_tsv(spark, path).withColumn("file_no", F.lit(0)))
    b = FS.batch_ids(df, 7, order_col="pos")
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                     F.min("pos").cast("bigint").alias("first_pos"))


@query("a17_reader_set_json")
def a17_reader_set_json(spark, sf):
    """A17 + A3 (lines and array forms) + A2/A12 read-back of the reader set."""
    ex = _examples(spark, sf)
    lines, arr = scratch_path(spark, "reader.jsonl.gz"), scratch_path(spark, "reader.json")
    FS.write_json_items(ex, lines)
    FS.write_json_items(ex, arr)
    schema = f"qid bigint, question string, answers array<string>, ctxs array<{RD.CTX_TYPE}>"
    a = FS.read_json_items(spark, lines, schema=schema)
    b = FS.read_json_items(spark, arr, schema=schema)
    both = a.select("qid", F.lit("lines").alias("form"), "ctxs").unionByName(
        b.select("qid", F.lit("array").alias("form"), "ctxs"))
    return both.select("qid", "form", F.size("ctxs").cast("bigint").alias("n_ctxs"),
                       _ints(F.transform("ctxs", lambda c: c["id"])).alias("ctx_ids"),
                       F.array_join(F.transform("ctxs", lambda c: F.when(c["has_answer"], "1").otherwise("0")), "")
                       .alias("has_answer"))


@query("a14_vector_table")
def a14_vector_table(spark, sf):
    path = scratch_path(spark, "codes.parquet")
    FS.write_vector_table(R.code_table(T.vectors(spark, sf)), path)
    back = FS.read_vector_table(spark, path)
    return back.select("id", F.array_join(F.transform("code", lambda x: x.cast("string")), ",").alias("code"))


# ---------------------------------------------------------------- training sets


P7_SEED, P7_EPOCH, P7_NEG = 11, 1, 1  # one negative: B2 guarantees it for every kept example


def _retriever_file(spark, sf):
    """Retriever-set JSON Lines built from text-retrieval hits: positives = hits
    with the answer; hard negatives = answerless hits labelled quality 0 (title
    and text left null, to be taken from the passage store); normal negatives =
    the other answerless hits. Extra field qid ends up in metadata."""
    hits, _, _ = _text_eval(spark, sf)
    lab = T.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    h = hits.join(lab, "id", "left")
    ctx = F.struct(F.col("id").cast("string").alias("passage_id"), "title", "text")
    bare = F.struct(F.col("id").cast("string").alias("passage_id"), F.lit(None).cast("string").alias("title"),
                    F.lit(None).cast("string").alias("text"))

    def ordered(cond, value):
        return F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("rank", value.alias("c"))))),
                           lambda x: x["c"])

    items = h.groupBy("qid").agg(
        ordered(F.col("has_answer"), ctx).alias("positive_ctxs"),
        ordered(~F.col("has_answer") & (F.col("quality") == 0), bare).alias("hard_negative_ctxs"),
        ordered(~F.col("has_answer") & (F.col("quality").isNull() | (F.col("quality") == 1)), ctx)
        .alias("negative_ctxs"),
        F.min_by("dataset", "rank").alias("dataset"))
    q = T.questions(spark, sf)
    path = scratch_path(spark, "retriever.jsonl")
    more = F.struct(F.array(F.col("qid"), F.lit(None).cast("bigint")).alias("list"), F.lit("free").alias("note")).alias("extra")
    FS.write_json_items(q.join(items, "qid").select("*", more).orderBy("qid"), path)
    return path


def _retriever_examples(spark, sf):
    """Fields that no schema names (qid, extra) end up in metadata."""
    items = FS.read_variant_items(spark, _retriever_file(spark, sf)).withColumn("file_no", F.lit(0))
    ex = TR.retriever_examples(items, max_positives=3, max_hard_negatives=5, max_normal_negatives=5)
    return TR.number_examples(ex)


@query("a10_retriever_file")
def a10_retriever_file(spark, sf):
    path = _retriever_file(spark, sf)
    r = FS.read_retriever_file(spark, path)
    return r.select(F.md5("question").alias("q_md5"), F.array_join("positive_ids", ",").alias("positive_ids"),
                    "dataset")


@query("a11_retriever_examples")
def a11_retriever_examples(spark, sf):
    ex = _retriever_examples(spark, sf)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["id"]), ",")
    return ex.select("index", "dataset", ids("positives").alias("positives"),
                     ids("hard_negatives").alias("hard_negatives"), ids("normal_negatives").alias("normal_negatives"),
                     "metadata")


@query("b3_dataset_keys")
def b3_dataset_keys(spark, sf):
    """The examples of two datasets only, numbered among themselves."""
    items = FS.read_variant_items(spark, _retriever_file(spark, sf)).withColumn("file_no", F.lit(0))
    ex = TR.number_examples(TR.retriever_examples(items, max_positives=3, max_hard_negatives=5, max_normal_negatives=5, dataset_keys=["src0", "src2"]))
    return ex.select("index", "dataset", F.md5("question").alias("q_md5"))


@query("p7_biencoder_pairs")
def p7_biencoder_pairs(spark, sf):
    ex = _retriever_examples(spark, sf)
    picked = TR.pick_pairs(ex, num_negatives=P7_NEG, training=True, seed=P7_SEED, epoch=P7_EPOCH)
    pairs = TR.flatten_pairs(picked)
    filled = TR.backfill_from_store(pairs, T.passages(spark, sf))
    return filled.select("index", F.col("slot").cast("bigint").alias("slot"), "passage_id",
                         F.md5("title").alias("title_md5"), F.md5("text").alias("text_md5"))


def _doc_examples(spark, sf):
    d = T.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("index"), F.col("source").alias("dataset"))


@query("d7_dataset_sizes")
def d7_dataset_sizes(spark, sf):
    return TR.dataset_sizes(_doc_examples(spark, sf))


I1_WEIGHTS = {"src0": 2.5, "src1": 0.5, "src2": 0.29}


@query("i1_multi_key_batches")
def i1_multi_key_batches(spark, sf):
    ex = TR.key_indices(_doc_examples(spark, sf))
    b = TR.multi_key_batches(ex, batch_size=4, weights=I1_WEIGHTS, shuffle=True, seed=3, epoch=1,
                             num_replicas=2, rank=1)
    return b.select(F.col("batch_no").cast("bigint").alias("batch_no"),
                    F.col("batch_pos").cast("bigint").alias("batch_pos"), "dataset",
                    F.col("key_idx").cast("bigint").alias("key_idx"))


@query("i9_plain_batches")
def i9_plain_batches(spark, sf):
    b = TR.plain_batches(_doc_examples(spark, sf), 6, shuffle=True, seed=5, epoch=2, num_replicas=2, rank=0)
    return b.select("index", "batch_id", F.col("batch_pos").cast("bigint").alias("batch_pos"))


READER_TRAIN_PASSAGES = 4


def _train_table(spark, sf, gold=None):
    return TR.reader_training_table(_examples(spark, sf), num_passages=READER_TRAIN_PASSAGES, max_input_length=RG.MAX_INPUT_LENGTH,
                                    max_answer_length=RG.MAX_ANSWER_LENGTH, max_answer_spans=3, max_load_passages=RG.MAX_LOAD_PASSAGES,
                                    max_positives=3, max_negatives=10, gold=gold, seed=9, epoch=0)


def _slot_cols(rows):
    return rows.select("qid", F.col("slot").cast("bigint").alias("slot"), F.col("idx").cast("bigint").alias("idx"))


@query("i6_reader_training_slots")
def i6_reader_training_slots(spark, sf):
    return _slot_cols(_train_table(spark, sf))


def _train_scores(spark, sf):
    return RG.score_slots(_train_table(spark, sf))


@query("h21_padded_spans")
def h21_padded_spans(spark, sf):
    s = _train_table(spark, sf).where(F.col("slot") == 0)
    return s.select("qid", _ints("starts").alias("starts"), _ints("ends").alias("ends"), _ints("mask").alias("mask"))


@query("d12_classifier_loss")
def d12_classifier_loss(spark, sf):
    return RD.classifier_loss(_train_scores(spark, sf))


@query("d13_span_loss")
def d13_span_loss(spark, sf):
    return RD.span_loss(_train_scores(spark, sf).where(F.col("slot") == 0))


# ---------------------------------------------------------------- evaluation modes, gold passages, P9, K1


def _retriever_questions(spark, sf):
    r = FS.read_retriever_file(spark, _retriever_file(spark, sf)).withColumn("file_no", F.lit(0))
    return FS.dense_index(r, list(FS.INPUT_ORDER), "qid")


@query("c6_labelled_positive_recall")
def c6_labelled_positive_recall(spark, sf):
    """P3 in is_labeled_positive mode: a hit counts when its id (as a string) is listed."""
    q = _retriever_questions(spark, sf)
    hits = knn.binary_retrieve(R.encode_questions(q, TEXT_DIM),
                               R.code_table(R.encode_passages(T.passages(spark, sf), TEXT_DIM)),
                               k=20, binary_k=100, dim=TEXT_DIM)
    flagged = hits.join(q.select("qid", "positive_ids"), "qid") \
        .withColumn("is_positive", F.array_contains("positive_ids", F.col("id").cast("string")))
    return M.recall_at_k(M.first_positive_rank(q, flagged), (1, 5, 20))


def _labelled_file(spark, sf):
    """A retriever file whose positives come from no retrieval run: every document that holds the question's whole text."""
    q, p = T.questions(spark, sf), T.passages(spark, sf)
    held = MT.answer_occurrences(q.select("qid", "question"), p, a_id="qid", answer="question")
    ctx = F.struct(F.col("id").cast("string").alias("passage_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("text"))
    listed = held.join(p.select("id", "dataset"), "id").groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", ctx.alias("c")))), lambda x: x["c"]).alias("positive_ctxs"),
        F.min_by("dataset", "id").alias("dataset"))
    path = scratch_path(spark, "labelled.jsonl")
    items = q.join(listed, "qid", "left").withColumn("dataset", F.coalesce("dataset", F.lit("src1")))
    FS.write_json_items(items.orderBy("qid").drop("qid"), path)
    return path


@query("p3_labelled_positives")
def p3_labelled_positives(spark, sf):
    _, _, recall = R.evaluate_retriever(spark, T.passages(spark, sf), retriever_files=[_labelled_file(spark, sf)], top_k=(1, 5, 20),
                                        binary_k=100, eval_mode="is_labeled_positive")
    return recall


@query("p3_same_dataset")
def p3_same_dataset(spark, sf):
    """Recall by answers among the hits of the question's own dataset; the title does not count."""
    _, ranks, _ = R.evaluate_retriever(spark, T.passages(spark, sf), retriever_files=[_labelled_file(spark, sf)], top_k=(1, 5, 20),
                                       binary_k=100, restrict_to_same_dataset=True)
    return ranks


@query("p3_qa_files")
def p3_qa_files(spark, sf):
    """Two QA files, dense retrieval, the reader set written on the way and read back."""
    q = T.questions(spark, sf)
    paths, out = [scratch_path(spark, f"qa-{i}.tsv") for i in (0, 1)], scratch_path(spark, "reader-set.jsonl")
    for i, path in enumerate(paths):
        FS.write_qa_tsv(q.where(F.pmod("qid", F.lit(2)) == i).orderBy("qid"), path)
    _, _, recall = R.evaluate_retriever(spark, T.passages(spark, sf), qa_files=paths, top_k=(1, 5, 20), binary=False, include_title=True, output=out)
    ctxs = FS.read_json_items(spark, out, schema=f"ctxs array<{RD.CTX_TYPE}>").agg(F.sum(F.size("ctxs")).cast("bigint").alias("n_ctxs"))
    return recall.join(F.broadcast(ctxs))


@query("b4_same_dataset_hits")
def b4_same_dataset_hits(spark, sf):
    q = _retriever_questions(spark, sf)
    p = T.passages(spark, sf)
    hits = knn.binary_retrieve(R.encode_questions(q, TEXT_DIM), R.code_table(R.encode_passages(p, TEXT_DIM)),
                               k=20, binary_k=100, dim=TEXT_DIM)
    asked = hits.select("qid", "id", "rank").join(q.select("qid", F.col("dataset").alias("q_dataset")), "qid")
    h = R.attach_passages(asked, p.select("id", "dataset"))
    kept = R.restrict_to_dataset(h)
    return kept.select("qid", F.col("rank").cast("bigint").alias("rank"), "id")


def _gold_file(spark, sf):
    """Gold passages: each question's rank-1 hit, keyed by the question and by its
    lower-cased 'question_tokens' form. Written as one {"data": [...]} document
    per partition of the question table, so no document holds more than a
    partition's questions."""
    hits, _, _ = _text_eval(spark, sf)
    top = hits.where(F.col("rank") == 1).join(T.questions(spark, sf).select("qid", "question"), "qid")
    item = F.struct(F.col("question"), F.lower("question").alias("question_tokens"),
                    F.col("id").alias("example_id"), "title", F.col("text").alias("context"))
    docs = (top.withColumn("_part", F.spark_partition_id()).groupBy("_part")
            .agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("qid", item.alias("d")))),
                                                lambda x: x["d"]).alias("data"))).alias("value"))
            .select("value"))
    path = scratch_path(spark, "gold.jsonl")
    docs.write.text(path)
    return path


@query("a13_gold_passages")
def a13_gold_passages(spark, sf):
    gold, canon = FS.read_gold_passages(spark, _gold_file(spark, sf))
    g = gold.select(F.md5("key").alias("key_md5"), F.col("id").alias("id"), F.md5("title").alias("title_md5"))
    return g


@query("b9_canonical_question")
def b9_canonical_question(spark, sf):
    _, canon = FS.read_gold_passages(spark, _gold_file(spark, sf))
    ex = T.questions(spark, sf).select("qid", F.lower("question").alias("question"))
    return TR.canonical_questions(ex, canon).select("qid", F.md5("question").alias("q_md5"))


@query("c7_gold_positives")
def c7_gold_positives(spark, sf):
    gold, _ = FS.read_gold_passages(spark, _gold_file(spark, sf))
    return _slot_cols(_train_table(spark, sf, gold=gold))


def _item_gold_file(spark, sf):
    """Gold passages no retrieval run returns: each question's own text, under an id of its own."""
    item = F.struct(F.col("question"), F.lower("question").alias("question_tokens"), (F.col("qid") + 1000000).alias("example_id"),
                    F.lit("item").alias("title"), F.col("question").alias("context"))
    path = scratch_path(spark, "gold-items.jsonl")
    T.questions(spark, sf).select(F.to_json(F.struct(F.array(item).alias("data"))).alias("value")).write.text(path)
    return path


def _gold_training(spark, sf):
    """P8 from files: lower-cased questions, canonical forms, and the gold passage as a further positive."""
    gold, canonical = FS.read_gold_passages(spark, _item_gold_file(spark, sf))
    asked = _examples(spark, sf).withColumn("question", F.lower("question"))
    return TR.reader_training_table(asked, num_passages=READER_TRAIN_PASSAGES, max_input_length=RG.MAX_INPUT_LENGTH,
                                    max_answer_length=RG.MAX_ANSWER_LENGTH, max_load_passages=RG.MAX_LOAD_PASSAGES, max_positives=3,
                                    max_negatives=10, gold=gold, canonical=canonical, include_gold=True, seed=9, epoch=0)


@query("c8_gold_passage")
def c8_gold_passage(spark, sf):
    return _slot_cols(_gold_training(spark, sf))


@query("p8_reader_training_table")
def p8_reader_training_table(spark, sf):
    """The whole training table, nested per question and laid out again by slot."""
    rows = TR.training_batches(_gold_training(spark, sf)).select("qid", F.inline("inputs"))
    return rows.select("qid", *[F.col(c).cast("bigint").alias(c) for c in ("slot", "idx", "win")],
                       F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
                       _ints("starts").alias("starts"), _ints("ends").alias("ends"), _ints("mask").alias("mask"))


@query("p5_gold_file")
def p5_gold_file(spark, sf):
    """P5 on a reader set whose questions are another form of the gold file's (B9 before the inputs are built)."""
    _, canonical = FS.read_gold_passages(spark, _item_gold_file(spark, sf))
    asked = _examples_from_file(spark, sf).withColumn("question", F.lower("question"))
    _, _, acc = RG.reader_eval(asked, canonical=canonical)
    return RD.mean_metric(acc, "answer_accuracy")


@query("h22_encoder_input")
def h22_encoder_input(spark, sf):
    p = T.passages(spark, sf)
    toks = SP.encoder_input(X.word_tokens("title"), X.word_tokens("text"), 32)
    return p.select("id", F.array_join(toks, " ").alias("tokens"))


@query("h22_question_input")
def h22_question_input(spark, sf):
    q = T.questions(spark, sf)
    return q.select("qid", F.array_join(SP.question_input(X.word_tokens(X.clean_question("question")), 16), " ").alias("tokens"))


def _vec(v):
    return F.array_join(F.transform(v, lambda x: x.cast("int").cast("string")), ",").alias("vec")


@query("j1_limited_questions")
def j1_limited_questions(spark, sf):
    return R.encode_questions(T.questions(spark, sf), TEXT_DIM, max_length=16).select("qid", _vec("embedding"))


@query("j2_limited_passages")
def j2_limited_passages(spark, sf):
    return R.encode_passages(T.passages(spark, sf), TEXT_DIM, max_length=256).select("id", _vec("embedding"))


@query("d14_merge_shards")
def d14_merge_shards(spark, sf):
    """Per-question precision laid out as 3 replicas would produce it (wrap-around
    padding repeats the first examples), then merged back without duplicates."""
    _, prec, _ = RG.reader_eval(_examples(spark, sf))
    per = FS.dense_index(prec, ["qid"], "example_idx").withColumn("_k", F.lit(1))
    replicas = 3
    extra = per.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(1).alias("_k"), (F.ceil(F.col("n") / replicas) * replicas - F.col("n")).alias("extra"))
    dup = per.join(F.broadcast(extra), "_k").where(F.col("example_idx") < F.col("extra")).drop("extra")
    merged = M.merge_shards(per.unionByName(dup).drop("_k"))
    return RD.mean_metric(merged, "classifier_precision")


P9_BATCH = 4


def _in_batch(spark, sf):
    ex = _retriever_examples(spark, sf)
    picked = TR.pick_pairs(ex, num_negatives=P7_NEG, training=False)
    pairs = TR.backfill_from_store(TR.flatten_pairs(picked, keep=("index",)), T.passages(spark, sf))
    qv = ex.select("index", INF.hash_encoder(X.clean_question("question"), TEXT_DIM).alias("q_vec"))
    batches = TR.plain_batches(ex.select("index"), P9_BATCH, shuffle=False)
    rows = pairs.join(batches, "index").join(qv, "index").select(
        "batch_id", "batch_pos", "slot", "q_vec",
        INF.hash_encoder(INF.passage_encoder_input(F.col("title"), F.col("text")), TEXT_DIM).alias("p_vec"))
    return M.in_batch_metrics(rows, n_passages=1 + P7_NEG)


@query("p9_biencoder_eval")
def p9_biencoder_eval(spark, sf):
    return M.epoch_summary(_in_batch(spark, sf))


@query("p9_before_rank_epoch")
def p9_before_rank_epoch(spark, sf):
    """The same in an epoch before ranks are measured."""
    return M.epoch_summary(_in_batch(spark, sf), epoch=1, rank_start_epoch=2)


@query("k1_question_stream")
def k1_question_stream(spark, sf):
    """User turns arrive as two files, one per micro-batch; each micro-batch is
    answered against the stored code table."""
    from quarry.streaming.questions import read_answers, start_answer_stream
    asked = T.table(spark, sf, "conversations").where(F.col("role") == "user")
    keys = FS.with_line_numbers(asked.select("conv_id", "turn").orderBy("conv_id", "turn"), "qid")
    conv = asked.join(keys, ["conv_id", "turn"]).select("qid", F.col("text").alias("question"))
    src = scratch_path(spark, "question-stream")
    conv.repartitionByRange(2, "qid").write.parquet(src)
    p = T.passages(spark, sf)
    codes_path = scratch_path(spark, "passage-codes.parquet")
    FS.write_vector_table(R.code_table(R.encode_passages(p, TEXT_DIM)), codes_path)
    sink, ckpt = scratch_path(spark, "answers"), scratch_path(spark, "answers-ckpt")
    q = start_answer_stream(spark, src, "qid bigint, question string", p, FS.read_vector_table(spark, codes_path),
                            sink, ckpt, num_retrieval_passages=10, num_passages_to_read=3,
                            num_answer_candidates_per_passage=1)
    q.awaitTermination()
    return _cand_cols(read_answers(spark, sink).drop("batch_id"))


# ---------------------------------------------------------------- corpus-wide answer search (C5 corpus form)


@query("c5_corpus_answer_search")
def c5_corpus_answer_search(spark, sf):
    """Every document containing each benchmark answer (dpr_string), without a hit list; every tenth
    question has one more answer without tokens, which comes back with a null id."""
    q = T.questions(spark, sf)
    blank = F.when(F.pmod("qid", F.lit(10)) == 0, F.array(F.lit(" "))).otherwise(F.array().cast("array<string>"))
    ans = q.select("qid", F.posexplode(F.concat("answers", blank)).alias("idx", "answer"))
    occ = MT.answer_occurrences(ans.select(F.struct("qid", "idx").alias("aid"), "answer"), T.passages(spark, sf))
    return occ.select("aid.qid", F.col("aid.idx").cast("bigint").alias("idx"), "id")


@query("j4_dense_text_retrieval")
def j4_dense_text_retrieval(spark, sf):
    """J4 in dense mode: question text -> vector -> exact inner-product top 20."""
    hits = knn.dense_knn(R.encode_questions(T.questions(spark, sf), TEXT_DIM),
                         R.encode_passages(T.passages(spark, sf), TEXT_DIM), k=20, dim=TEXT_DIM)
    return hits.select("qid", F.col("rank").cast("bigint").alias("rank"), "id", _r6("score").alias("score"))


@query("p2_passage_codes")
def p2_passage_codes(spark, sf):
    """Passage table -> encoder -> sign codes -> stored vector table, read back."""
    path = scratch_path(spark, "p2-codes.parquet")
    FS.write_vector_table(R.code_table(R.encode_passages(T.passages(spark, sf), TEXT_DIM)), path)
    return FS.read_vector_table(spark, path).select(
        "id", F.array_join(F.transform("code", lambda x: x.cast("string")), ",").alias("code"))
