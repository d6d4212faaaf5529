"""Retrieval jobs over the vector table: binary/dense k-NN, hit fetch, evaluation.

P3 (retriever evaluation) = questions -> k-NN -> optional dataset restriction
(B4) -> text to match (B5) -> has_answer (C5) or labelled positive (C6) ->
first positive rank (D2) -> recall@k (D1). P4 nests the hits per question.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import inference as INF
from quarry.functions import vectors as V
from quarry.functions.text import match_text, normalized_answers, with_any_answer
from quarry.operators import knn
from quarry.operators.metrics import first_positive_rank, recall_at_k
from quarry.operators.reader import nest_hits
from quarry.session import ensure_parallelism, stored
from quarry.sources import files as FS

Encoder = Callable[[Column], Column]
EVAL_MODES = ("has_answer", "is_labeled_positive")

def code_table(vectors: DataFrame, *, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """P2 tail / A14: (id, code) from (id, float vector)."""
    return vectors.select(F.col(id_col).alias("id"), V.sign_code(vec_col).alias("code"))


def attach_passages(hits: DataFrame, passages: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Fetch title/text/dataset for the hits, after the top-k cut.

    The narrow hits (with what belongs to their questions) are stored first, so the
    join knows their bytes: below Spark's broadcast threshold the passage table is
    streamed and never shuffled, above it both sides are shuffled by id (a passage
    table bucketed by id is not). A job runs here."""
    # Per-hit text work runs where the passage rows stream; keep that spread out.
    return stored(hits, "hits").join(ensure_parallelism(passages), id_col, "inner")


def restrict_to_dataset(hits: DataFrame, *, q_id: str = "qid", q_dataset: str = "q_dataset",
                        dataset: str = "dataset", rank: str = "rank") -> DataFrame:
    """B4 + E1: keep hits of the question's own dataset (after top-k), re-rank 1..n.

    A null question dataset is an error, as in the reference."""
    from quarry.functions.checks import guard
    checked = hits.withColumn(q_dataset, guard(q_dataset, F.col(q_dataset).isNotNull(),
                                               "restricting to the same dataset needs a question dataset"))
    kept = checked.where(F.col(dataset) == F.col(q_dataset))
    w = Window.partitionBy(q_id).orderBy(F.col(rank).asc())
    return kept.withColumn(rank, F.row_number().over(w).cast("bigint"))


def binary_label_eval(vectors: DataFrame, *, k: int, binary_k: int, dim: int,
                      ks: Sequence[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flagship: every vector queries the code table; labelled positives are the
    other vectors with the same label. Returns (hits, ranks, recall)."""
    codes = code_table(vectors)
    questions = vectors.select(F.col("id").alias("qid"), "embedding", F.col("label").alias("q_label"))
    hits = knn.binary_retrieve(questions.select("qid", "embedding"), codes, k=k, binary_k=binary_k, dim=dim)
    labels = vectors.select("id", "label")
    qlab = questions.select("qid", "q_label")
    flagged = (hits.join(labels, "id", "left").join(qlab, "qid", "left")
               .withColumn("is_positive", (F.col("label") == F.col("q_label")) & (F.col("id") != F.col("qid"))))
    ranks = first_positive_rank(questions, flagged)
    return flagged, ranks, recall_at_k(ranks, ks)


def encode_questions(questions: DataFrame, dim: int, *, q_id: str = "qid", question: str = "question",
                     encoder: Encoder | None = None, max_length: int | None = None) -> DataFrame:
    """J1 after B1: (qid, embedding) from question text; ``max_length`` cuts it as H22 does."""
    text = INF.question_encoder_input(F.col(question), max_length)
    return questions.select(F.col(q_id).alias("qid"), _encoded(text, dim, encoder))


def encode_passages(passages: DataFrame, dim: int, *, encoder: Encoder | None = None, max_length: int | None = None) -> DataFrame:
    """(id, embedding) from (title, text); ``max_length`` cuts the text as H22 does."""
    text = INF.passage_encoder_input(F.col("title"), F.col("text"), max_length)
    return ensure_parallelism(passages).select("id", _encoded(text, dim, encoder))


def _encoded(text: Column, dim: int, encoder: Encoder | None) -> Column:
    return (encoder(text) if encoder else INF.hash_encoder(text, dim)).alias("embedding")


def retrieve(questions: DataFrame, passages: DataFrame, *, k: int, binary_k: int, dim: int, binary: bool = True,
             encoder: Encoder | None = None, codes: DataFrame | None = None, max_question_length: int | None = None) -> DataFrame:
    """Question text -> vector -> top k. ``codes`` is the stored table of P2: (id, code), or (id, embedding) in dense mode."""
    qv = encode_questions(questions, dim, encoder=encoder, max_length=max_question_length)
    if codes is None:
        codes = encode_passages(passages, dim, encoder=encoder)
        codes = code_table(codes) if binary else codes
    if binary:
        return knn.binary_retrieve(qv, codes, k=k, binary_k=binary_k, dim=dim)
    return knn.dense_knn(qv, codes, k=k, dim=dim)


def text_retrieval_eval(questions: DataFrame, passages: DataFrame, *, k: int, binary_k: int, dim: int,
                        ks: Sequence[int], match_type: str = "dpr_string", include_title: bool = True,
                        binary: bool = True, encoder: Encoder | None = None, codes: DataFrame | None = None,
                        eval_mode: str = "has_answer", restrict_dataset: bool = False, max_question_length: int | None = None):
    """P3 on tables: returns (hits, ranks, recall).

    Mode "has_answer" flags a hit whose text contains an answer (C5); mode
    "is_labeled_positive" one whose id is among the question's positive_ids (C6). With
    ``restrict_dataset`` hits of other datasets go before ranks are counted (B4)."""
    if eval_mode not in EVAL_MODES:
        raise ValueError(f"eval_mode must be one of {EVAL_MODES}")
    hits = retrieve(questions, passages, k=k, binary_k=binary_k, dim=dim, binary=binary, encoder=encoder, codes=codes,
                    max_question_length=max_question_length)
    # What belongs to a question meets the narrow hits, before the text does: answers are normalised once per question.
    pre = match_type not in ("dpr_regex", "none")
    own = ["qid", "answers", (normalized_answers("answers", match_type) if pre else F.col("answers")).alias("_answers_norm")]
    if restrict_dataset:
        own.append(F.col("dataset").alias("q_dataset"))
    if eval_mode == "is_labeled_positive":
        own.append("positive_ids")
    fetched = attach_passages(hits.join(questions.select(*own), "qid"), passages)
    if restrict_dataset:
        fetched = restrict_to_dataset(fetched).drop("q_dataset")
    if eval_mode == "has_answer":
        flagged = with_any_answer(fetched, "_answers_norm", match_text("title", "text", include_title), match_type, prenormalized=pre)
        flagged = flagged.withColumn("is_positive", F.col("has_answer"))
    else:
        flagged = fetched.withColumn("has_answer", F.lit(None).cast("boolean")).withColumn(
            "is_positive", F.coalesce(F.array_contains("positive_ids", F.col("id").cast("string")), F.lit(False))).drop("positive_ids")
    flagged = flagged.drop("_answers_norm")
    ranks = first_positive_rank(questions, flagged)
    return flagged, ranks, recall_at_k(ranks, ks)


def evaluate_retriever(spark: SparkSession, passages: DataFrame, *, qa_files: Sequence[str] | None = None,
                       retriever_files: Sequence[str] | None = None, top_k: Sequence[int] = (1, 5, 20, 100), retrieval_k: int | None = None,
                       binary: bool = True, binary_k: int = 2048, dim: int = 64, eval_mode: str = "has_answer",
                       match_type: str = "dpr_string", include_title: bool = False, restrict_to_same_dataset: bool = False,
                       encoder: Encoder | None = None, codes: DataFrame | None = None, max_question_length: int | None = None,
                       output: str | None = None):
    """P3, the job: question files -> retrieval -> flags -> recall, and the reader set written to ``output``.

    Either QA files (A9) or retriever files (A10), several of them in the given order
    (A15); labels need retriever files. Returns (hits, ranks, recall); qid is a question's
    place in the files (E4)."""
    if (qa_files is None) == (retriever_files is None):
        raise ValueError("give either qa_files or retriever_files")
    if eval_mode == "is_labeled_positive" and retriever_files is None:
        raise ValueError("eval_mode is_labeled_positive needs retriever_files")
    if not top_k:
        raise ValueError("top_k must name at least one k")
    read = FS.read_qa_tsv if qa_files is not None else FS.read_retriever_file
    asked = FS.concat_files([read(spark, f) for f in (qa_files or retriever_files)])
    questions = stored(FS.dense_index(asked, list(FS.INPUT_ORDER), "qid").drop(*FS.INPUT_ORDER), "questions")
    found = text_retrieval_eval(questions, passages, k=retrieval_k or max(top_k), binary_k=binary_k, dim=dim, ks=top_k, match_type=match_type,
                                include_title=include_title, binary=binary, encoder=encoder, codes=codes, eval_mode=eval_mode,
                                restrict_dataset=restrict_to_same_dataset, max_question_length=max_question_length)
    if output is not None:
        FS.write_json_items(nest_hits(found[0], questions).drop("qid"), output)
    return found
