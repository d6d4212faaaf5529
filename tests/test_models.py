"""Encoders and readers as parameters of the jobs; the retriever evaluation job; the reader training table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import inference as INF
from quarry.operators import reader as RD
from quarry.operators import training as TR
from quarry.plans import reading as RG
from quarry.plans import retrieval as R
from quarry.sources import files as FS
from quarry.sources import tables as T

SF = "/root/testdata/sf0.001"


def _factories():
    """Models as local functions, so that workers get them by value."""
    def vowels():
        """A second encoder: signed counts of letters, nothing to do with the hash encoder."""
        def predict(texts):
            out = np.zeros((len(texts), 32), dtype=np.float32)
            for i, t in enumerate(texts):
                for ch in str(t).lower():
                    if "a" <= ch <= "z":
                        out[i, ord(ch) - 97] += 1.0 if ch in "aeiou" else -0.5
            return out
        return predict


    def word_lengths():
        """A second reader: logits are token lengths, the passage's is the number of distinct tokens."""
        def predict(pids, inputs, questions):
            toks = [str(x).split(" ") for x in inputs]
            lengths = [np.array([float(len(t)) for t in ts]) for ts in toks]
            return {"classifier_logit": np.array([float(len(set(ts))) for ts in toks]), "start_logits": np.stack(lengths),
                    "end_logits": np.stack(lengths)}
        return predict

    return vowels, word_lengths


vowels, word_lengths = _factories()


def test_hash_encoder_behind_the_model_hook_gives_the_same_hits(spark):
    q, p = T.questions(spark, SF), T.passages(spark, SF)
    hook = INF.model_encoder(INF.hash_predict_fn(64), batch_size=16)
    plain, hooked = (R.retrieve(q, p, k=5, binary_k=20, dim=64, encoder=e) for e in (None, hook))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, hooked.collect()))


@pytest.mark.parametrize("binary", [True, False])
def test_another_encoder_through_retrieval_and_stored_vectors(spark, binary):
    q, p = T.questions(spark, SF), T.passages(spark, SF)
    encoder = INF.model_encoder(vowels, batch_size=32)
    vectors = R.encode_passages(p, 32, encoder=encoder)
    stored = R.code_table(vectors) if binary else vectors
    fly = R.retrieve(q, p, k=5, binary_k=30, dim=32, binary=binary, encoder=encoder)
    kept = R.retrieve(q, p, k=5, binary_k=30, dim=32, binary=binary, encoder=encoder, codes=stored)
    assert sorted(map(tuple, fly.collect())) == sorted(map(tuple, kept.collect()))
    texts = {r.id: " ".join([r.title, r.text]) for r in p.collect()}
    predict = vowels()
    ids = sorted(texts)
    matrix = predict([texts[i] for i in ids]).astype(float)
    for r in q.limit(3).collect():
        vec = predict([r.question.rstrip("?")])[0].astype(float)
        if binary:
            signs = np.where(matrix < 0, -1.0, 1.0)
            far = ((matrix < 0) != (vec < 0)).sum(1)
            near = sorted(range(len(ids)), key=lambda i: (far[i], ids[i]))[:30]
            best = sorted(near, key=lambda i: (-(signs[i] @ vec), far[i], ids[i]))[:5]
        else:
            best = sorted(range(len(ids)), key=lambda i: (-(matrix[i] @ vec), ids[i]))[:5]
        assert [h.id for h in fly.where(F.col("qid") == r.qid).orderBy("rank").collect()] == [ids[i] for i in best]


def test_another_reader_through_p5_and_p6(spark):
    q, p = T.questions(spark, SF), T.passages(spark, SF)
    reader = INF.model_reader(word_lengths, batch_size=8)
    found = RG.answer_questions(q, p, num_retrieval_passages=3, reader=reader, encoder=INF.model_encoder(vowels), dim=32).collect()
    assert {r.qid for r in found} == {r.qid for r in q.collect()}
    for r in found:
        assert r.span_score == 2 * max(len(t) for t in r.input_text.split(" ")) or r.span_end - r.span_start < 10
    scores, prec, acc = RG.reader_eval(RG.reader_set(q, p, k=4), num_passages=3, reader=reader)
    row = scores.where("idx >= 0").first()
    assert row.classifier_logit == len(set(row.tokens)) and row.start_logits == [float(len(t)) for t in row.tokens]
    assert prec.count() == acc.count() == q.count()


# ---------------------------------------------------------------- the retriever evaluation job

@pytest.fixture(scope="module")
def qa(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("qa")
    q = T.questions(spark, SF).orderBy("qid")
    one, two = str(base / "one.tsv"), str(base / "two.tsv")
    FS.write_qa_tsv(q.where("qid % 2 = 0"), one)
    FS.write_qa_tsv(q.where("qid % 2 = 1"), two)
    return one, two


def test_evaluate_retriever_over_several_qa_files(spark, qa, tmp_path):
    p = T.passages(spark, SF)
    out = str(tmp_path / "reader.jsonl")
    hits, ranks, recall = R.evaluate_retriever(spark, p, qa_files=qa, top_k=(1, 5), binary_k=50, include_title=True, output=out)
    _, _, want = R.text_retrieval_eval(T.questions(spark, SF), p, k=5, binary_k=50, dim=64, ks=(1, 5))
    assert sorted(map(tuple, recall.collect())) == sorted(map(tuple, want.collect()))
    asked = [r.question for r in T.questions(spark, SF).orderBy(F.col("qid") % 2, "qid").collect()]
    written = {r.question: len(r.ctxs) for r in spark.read.json(out).collect()}
    assert written == {q: 5 for q in asked}
    assert ranks.count() == len(asked) == ranks.agg(F.max("qid")).first()[0] + 1


def test_evaluate_retriever_by_labels_and_dataset(spark, tmp_path):
    p = T.passages(spark, SF)
    path = str(tmp_path / "set.jsonl")
    rows = p.orderBy("id").limit(6).select(F.col("text").alias("question"), F.array(F.lit("x")).alias("answers"), "dataset",
                                           F.array(F.struct(F.col("id").alias("passage_id"), "title", "text")).alias("positive_ctxs"))
    FS.write_json_items(rows.coalesce(1), path)
    _, ranks, recall = R.evaluate_retriever(spark, p, retriever_files=[path], top_k=(1, 20), binary_k=50, eval_mode="is_labeled_positive")
    assert recall.where("k = 20").first().n_correct >= 5     # a passage's own text finds it
    hits, _, _ = R.evaluate_retriever(spark, p, retriever_files=[path], top_k=(20,), binary_k=50, restrict_to_same_dataset=True)
    datasets = {r.qid: r.dataset for r in FS.dense_index(FS.concat_files([FS.read_retriever_file(spark, path)]), list(FS.INPUT_ORDER), "qid").collect()}
    assert all(h.dataset == datasets[h.qid] for h in hits.collect())


def test_evaluate_retriever_checks_its_arguments(spark, qa):
    p = T.passages(spark, SF)
    with pytest.raises(ValueError, match="either"):
        R.evaluate_retriever(spark, p)
    with pytest.raises(ValueError, match="either"):
        R.evaluate_retriever(spark, p, qa_files=qa, retriever_files=qa)
    with pytest.raises(ValueError, match="needs retriever_files"):
        R.evaluate_retriever(spark, p, qa_files=qa, eval_mode="is_labeled_positive")
    with pytest.raises(ValueError, match="eval_mode"):
        R.evaluate_retriever(spark, p, qa_files=qa, eval_mode="other")
    with pytest.raises(Exception, match="question dataset"):
        R.evaluate_retriever(spark, p, qa_files=qa, top_k=(3,), binary_k=20, restrict_to_same_dataset=True)[2].collect()


# ---------------------------------------------------------------- reader training table

def _set(spark):
    rows = [(1, "Q one", ["blue sky"], [(1, "A", "the blue sky", "d", 1.0, True), (2, "B", "no", "d", 0.9, False), (3, "C", "blue sky too", "d", 0.8, True)]),
            (2, "q two", ["green"], [(4, "D", "nothing", "d", 1.0, False)]),
            (3, "Q three", ["red"], [(5, "E", "not it", "d", 1.0, None), (6, "F", "red", "d", 0.9, True)])]
    return spark.createDataFrame(rows, f"qid long, question string, answers array<string>, ctxs array<{RD.CTX_TYPE}>")


GOLD = [("Q one", 3, "C", "blue sky too"), ("canonical two", 40, "G", "so green"), ("Q three", 50, "H", "without the word")]


def _gold(spark):
    return spark.createDataFrame(GOLD, "key string, id long, title string, text string")


def _table(spark, **kw):
    args = dict(num_passages=3, max_input_length=20, gold=_gold(spark), seed=1)
    return {(r.qid, r.slot): r for r in TR.reader_training_table(_set(spark), **{**args, **kw}).collect()}


def test_training_table_slots_spans_and_padding(spark):
    t = _table(spark)
    assert {q for q, _ in t} == {1, 3}                        # question 2 has no positive (B8)
    assert t[1, 0].idx == 2 and t[1, 1].idx == 1 and t[1, 2].idx == -1   # C7: the gold title's positive only
    for r in t.values():
        assert len(r.tokens) == 20 and len(r.starts) == len(r.mask) == 8
    assert [t[1, 0].tokens[s:e + 1] for s, e, m in zip(t[1, 0].starts, t[1, 0].ends, t[1, 0].mask) if m] == [["blue", "sky"]]
    assert t[3, 0].idx == 1 and t[3, 1].idx == 0              # a null flag is a negative


def test_gold_passage_joins_the_positives_once(spark):
    canonical = spark.createDataFrame([("q two", "canonical two")], "key string, canonical string")
    t = _table(spark, include_gold=True, canonical=canonical)
    assert t[2, 0].idx == 1 and t[2, 0].pid == 40 and "green" in t[2, 0].tokens   # C8 with B9: appended behind its one ctx
    assert t[1, 0].idx == 2                                   # already a positive: not again
    assert t[3, 0].idx == 1                                   # the gold passage has no answer span: left out
    assert 2 not in {q for q, _ in _table(spark, canonical=canonical)}           # off by default


def test_epochs_draw_different_windows_of_a_long_passage(spark):
    text = " ".join(f"w{i}" for i in range(300)) + " blue sky"
    rows = [(1, "q", ["blue sky"], [(1, "A", "blue sky", "d", 1.0, True), (2, "B", text, "d", 0.9, False)])]
    ex = spark.createDataFrame(rows, f"qid long, question string, answers array<string>, ctxs array<{RD.CTX_TYPE}>")
    drawn = {TR.reader_training_table(ex, num_passages=2, max_input_length=60, seed=3, epoch=e).where("slot = 1").first().win for e in range(8)}
    assert len(drawn) > 2


def test_training_batches_nest_in_slot_order(spark):
    table = TR.reader_training_table(_set(spark), num_passages=3, max_input_length=20, seed=1)
    for r in TR.training_batches(table).collect():
        assert [i.slot for i in r.inputs] == [0, 1, 2]
