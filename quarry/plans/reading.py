"""Reader jobs: P4 reader-set production, P5 reader evaluation, P6 batch question answering.

Models are parameters: ``encoder`` (text column -> vector column) and ``reader``
((pid, tokens, question tokens) -> `READER_TYPE` column) default to the deterministic
stand-ins of `quarry.functions.inference`; ``codes`` is the stored vector table of P2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import spans as S
from quarry.functions.inference import lexical_reader
from quarry.functions.text import clean_question, word_tokens
from quarry.operators import knn
from quarry.operators import reader as RD
from quarry.operators import training as TR
from quarry.plans import retrieval as R

Reader = Callable[[Column, Column, Column], Column]

# The reference's lengths of reader inputs and answers.
MAX_INPUT_LENGTH = 350
MAX_ANSWER_LENGTH = 10
# Fixture reader parameters.
NUM_PASSAGES = 8
MAX_LOAD_PASSAGES = 20
# Hits of a passage that are read from one copy of its tokens.
PASSAGE_HITS = 64


def score_slots(slots: DataFrame, reader: Reader | None = None) -> DataFrame:
    """Reader logits for every input (padding slots get pid -1)."""
    pid = F.coalesce(F.col("pid"), F.lit(-1).cast("bigint"))
    logits = (reader or lexical_reader)(pid, F.col("tokens"), F.col("q_tokens"))
    return slots.withColumn("_logits", logits).select("*", "_logits.*").drop("_logits")


def reader_set(questions: DataFrame, passages: DataFrame, *, k: int = 20, binary_k: int = 100,
               dim: int = 64, encoder: R.Encoder | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Retrieval hits with has_answer nested per question (reader-set rows)."""
    hits, _, _ = R.text_retrieval_eval(questions, passages, k=k, binary_k=binary_k, dim=dim, ks=(k,), encoder=encoder, codes=codes)
    return RD.nest_hits(hits, questions)


def reader_eval(examples: DataFrame, *, num_passages: int = NUM_PASSAGES,
                max_load_passages: int | None = MAX_LOAD_PASSAGES, max_input_length: int = MAX_INPUT_LENGTH,
                max_answer_length: int = MAX_ANSWER_LENGTH, canonical: DataFrame | None = None, reader: Reader | None = None):
    """P5: (scores, classifier precision per question, answer accuracy per question).

    ``canonical`` (from a gold-passages file, A13) replaces questions by their canonical
    form before their inputs are built (B9)."""
    if canonical is not None:
        examples = TR.canonical_questions(examples, canonical)
    loaded = RD.ctx_slots(examples, max_load_passages=max_load_passages, max_input_length=max_input_length,
                          max_answer_length=max_answer_length)
    slots = RD.eval_slots(examples, num_passages=num_passages, max_load_passages=max_load_passages,
                          max_input_length=max_input_length, max_answer_length=max_answer_length, loaded=loaded)
    scores = score_slots(slots, reader)
    pos_neg = RD.positive_negative_lists(loaded)
    prec = RD.classifier_precision(scores, pos_neg)
    acc = RD.answer_accuracy(scores, examples, max_answer_length=max_answer_length)
    return scores, prec, acc


def hits_by_passage(hits: DataFrame, *, most: int = PASSAGE_HITS) -> DataFrame:
    """(id, hits): the hits of a passage as arrays of at most ``most``, so its tokens are made once for all of an array.

    hits: id and any other columns, which become the fields of an array's elements. A passage
    with more hits has several rows, which a skewed join may deal to several tasks."""
    rest = [c for c in hits.columns if c != "id"]
    place = F.row_number().over(Window.partitionBy("id").orderBy("qid"))
    return (hits.withColumn("_group", F.floor((place - 1) / most))
            .groupBy("id", "_group").agg(F.collect_list(F.struct(*rest)).alias("hits")).drop("_group"))


def answer_questions(questions: DataFrame, passages: DataFrame, *, num_retrieval_passages: int = 10,
                     num_passages_to_read: int = 1, num_answer_candidates_per_passage: int = 1,
                     binary_k: int = 100, dim: int = 64, max_input_length: int = MAX_INPUT_LENGTH,
                     max_answer_length: int = MAX_ANSWER_LENGTH, codes: DataFrame | None = None,
                     encoder: R.Encoder | None = None, reader: Reader | None = None) -> DataFrame:
    """P6 (J4 -> H19 -> J3 -> F4 -> F5 -> H17 -> H18 -> F6) for a whole question table.

    ``codes`` is the stored (id, code) table of the passages (P2); when absent
    the passages are encoded on the fly. Passages are read whole, in windows."""
    qv = R.encode_questions(questions, dim, encoder=encoder)
    if codes is None:
        codes = R.code_table(R.encode_passages(passages, dim, encoder=encoder))
    hits = knn.binary_retrieve(qv, codes, k=num_retrieval_passages, binary_k=binary_k, dim=dim)
    q = questions.select("qid", word_tokens(clean_question("question")).alias("q_tokens"))
    fetched = R.attach_passages(hits_by_passage(hits.select("qid", "id", "rank").join(q, "qid")), passages)
    blank = F.lit("")
    read = fetched.select("id", "hits", S.passage_part(word_tokens(F.coalesce("title", blank)), word_tokens(F.coalesce("text", blank))).alias("_p"))
    parts = read.select("id", "_p", F.explode("hits").alias("_h")).select(
        "_h.qid", (F.col("_h.rank") - 1).cast("int").alias("slot"), F.col("id").alias("pid"), "_h.q_tokens", "_p")
    slots = S.with_windows(parts, "q_tokens", "_p", max_input_length, max_answer_length - 1) \
        .select("qid", "slot", F.col("slot").alias("idx"), "pid", "q_tokens", "win", "offset", "first", "stop", "tokens")
    return RD.answer_candidates(score_slots(slots, reader), num_passages_to_read=num_passages_to_read,
                                num_spans=num_answer_candidates_per_passage, max_answer_length=max_answer_length)
