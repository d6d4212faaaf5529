"""Ranking and reader metrics as aggregations (partial + final hash aggregates).

D1  recall@k for a list of k            D2  first positive rank per question
D6  average in-batch rank               D7  sizes per dataset key + total
D8  in-batch cross-entropy (dense)      D9  margin ranking loss on code scores
D10 rerank cross-entropy                D11 total loss, mean of batch means
D14 shard merge without wrap-around duplicates
(D4, D5, D12, D13 live with the reader operators.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.checks import guard


def first_positive_rank(questions: DataFrame, hits: DataFrame, *, q_id: str = "qid",
                        rank: str = "rank", is_positive: str = "is_positive") -> DataFrame:
    """1-based rank of the first positive hit per question; null on a miss.

    (The reference substitutes the passage count for a miss; a null never
    counts as a hit, which is identical whenever k < number of passages.)"""
    best = (hits.where(F.col(is_positive))
            .groupBy(q_id).agg(F.min(rank).cast("bigint").alias("positive_rank")))
    return questions.select(q_id).join(best, q_id, "left")


def recall_at_k(ranks: DataFrame, ks: Sequence[int], *, rank_col: str = "positive_rank") -> DataFrame:
    """Share of questions whose first positive rank is <= k, per k ascending."""
    ks = sorted(set(int(k) for k in ks))
    per_k = ranks.select(F.col(rank_col), F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    hit = F.when(F.col(rank_col).isNotNull() & (F.col(rank_col) <= F.col("k")), 1).otherwise(0)
    return (per_k.groupBy("k").agg(F.sum(hit).cast("bigint").alias("n_correct"),
                                   F.count(F.lit(1)).cast("bigint").alias("n_questions"))
            .select(F.col("k").cast("bigint").alias("k"), "n_correct", "n_questions",
                    F.round(F.col("n_correct") / F.col("n_questions"), 6).alias("recall")))


IN_BATCH_SCHEMA = ("batch_id long, n_questions long, rank_sum double, dpr_loss double, cand_loss double, "
                   "rerank_loss double")


def _ce(scores, labels):
    """Mean cross-entropy of rows of `scores` against integer `labels` (log-sum-exp with max shift)."""
    import numpy as np
    mx = scores.max(axis=1, keepdims=True)
    lse = np.log(np.exp(scores - mx).sum(axis=1)) + mx[:, 0]
    return float(np.mean(lse - scores[np.arange(len(labels)), labels]))


def in_batch_metrics(rows: DataFrame, *, n_passages: int, margin: float = 0.1,
                     cand_cross_entropy: bool = False) -> DataFrame:
    """D6 + D8 + D9 + D10 (H11, H13, H14) per batch, one Arrow group per batch.

    rows: batch_id, batch_pos, slot, q_vec, p_vec (question i's labelled passage
    is slot 0, i.e. column i * n_passages of the batch score matrix). A batch
    holds batch_size x n_passages rows, so the group is bounded by parameters;
    the score matrix lives only inside the task and no pair rows are emitted.

    Returns one row per batch: question count, sum of labelled-passage ranks
    (1 + #passages scoring strictly higher), dense cross-entropy, margin
    ranking loss on sign-code scores (or their cross-entropy with
    ``cand_cross_entropy``), cross-entropy of float question x sign code."""
    def per_batch(pdf):
        import numpy as np
        import pandas as pd
        pdf = pdf.sort_values(["batch_pos", "slot"])
        qv = pdf.drop_duplicates("batch_pos")
        q = np.stack(qv["q_vec"].to_numpy()).astype(np.float64)
        p = np.stack(pdf["p_vec"].to_numpy()).astype(np.float64)
        labels = np.arange(len(q)) * n_passages
        s = q @ p.T
        pos = s[np.arange(len(q)), labels]
        ranks = (s > pos[:, None]).sum(axis=1) + 1.0
        qb, pb = np.where(q < 0, -1.0, 1.0), np.where(p < 0, -1.0, 1.0)
        sb = qb @ pb.T
        pos_b = sb[np.arange(len(q)), labels]
        mask = np.ones_like(sb, dtype=bool)
        mask[np.arange(len(q)), labels] = False
        hinge = np.maximum(0.0, margin - (pos_b[:, None] - sb))[mask]
        cand = _ce(sb, labels) if cand_cross_entropy else (float(hinge.mean()) if hinge.size else 0.0)
        return pd.DataFrame({"batch_id": [int(pdf["batch_id"].iloc[0])], "n_questions": [len(q)],
                             "rank_sum": [float(ranks.sum())], "dpr_loss": [_ce(s, labels)],
                             "cand_loss": [cand],
                             "rerank_loss": [_ce(q @ pb.T, labels)]})

    return rows.groupBy("batch_id").applyInPandas(per_batch, IN_BATCH_SCHEMA)


#: The average rank that stands for "not measured yet" before the start epoch.
NO_RANK = 1e7


def epoch_summary(per_batch: DataFrame, *, binary: bool = True, epoch: int = 0, rank_start_epoch: int = 0) -> DataFrame:
    """D6 + D11: average rank over questions (`NO_RANK` before ``rank_start_epoch``); losses as
    the mean of per-batch values. In binary mode the total is candidate + rerank loss,
    otherwise the dense loss."""
    rank = F.round(F.sum("rank_sum") / F.sum("n_questions"), 6) if epoch >= rank_start_epoch else F.lit(NO_RANK)
    total = (F.col("cand_loss") + F.col("rerank_loss")) if binary else F.col("dpr_loss")
    return per_batch.agg(
        rank.alias("avg_rank"),
        F.round(F.avg("dpr_loss"), 6).alias("dpr_loss"), F.round(F.avg("cand_loss"), 6).alias("cand_loss"),
        F.round(F.avg("rerank_loss"), 6).alias("rerank_loss"), F.round(F.avg(total), 6).alias("total_loss"),
        F.count(F.lit(1)).cast("bigint").alias("n_batches"))


def merge_shards(per_example: DataFrame, *, idx: str = "example_idx") -> DataFrame:
    """Drop wrap-around duplicates of a distributed sampler (same example index); the
    indices that are left must be 0 to n-1, or the query fails."""
    merged = per_example.dropDuplicates([idx])
    whole = merged.agg(F.coalesce((F.min(idx) == 0) & (F.max(idx) == F.count(F.lit(1)) - 1), F.lit(True)).alias("whole")).scalar()
    return merged.withColumn(idx, guard(idx, whole, "a shard is missing: the example indices are not 0 to n-1"))
