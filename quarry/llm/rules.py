"""Quality rules: a decision list learned by sequential covering.

Statistics of a text's words, lines and symbols are the attributes. From
labelled documents, rules for rejection are learned one after another: a
conjunction of thresholds is grown on two thirds of the rows, condition by
condition, by the gain of information about the rejected class, until it covers
no kept document there; conditions are then pruned from the end while that
raises the rule's worth (rejected minus kept, of those covered) on the other
third. A rule is accepted while its precision on the pruning rows is at least
`PRECISION`; the rows it covers are set aside and the next rule is grown on the
rest. The list is emitted as one ordered Spark expression
(CASE WHEN rule THEN false ... ELSE true).

The labelled rows used are bounded: those with the `max_labelled` smallest
hashes of the document id (all, where there are fewer). Everything else covers
all documents.

Defined cases: a null or empty text has no words and fails the base rule; labels
that are null are left out, and of several labels of one document the worst
counts; without labels of both kinds the list is empty and the base rule alone
decides; repeated rows are judged each; null ids are judged like any other; an
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_LABELLED = 100_000
PRECISION = 0.9
MAX_RULES, MAX_CONDITIONS = 12, 4
#: Least number of rejected growing rows that a rule covers.
MIN_COVER = 3
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_letters", "n_digits")


def statistics(text: str) -> tuple[int, ...]:
    """The counts of a text, in the order of `_COUNTS`."""
    data = text.encode()
    words = data.split()
    n = len(words)
    seen: set[bytes] = set()
    dup = lines = 0
    for line in data.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeated = 0
    if n >= WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            twice = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
            covered = np.zeros(n, bool)
            for i in range(WINDOW):
                covered[i:i + len(windows)] |= twice
            repeated = int(covered.sum())
    # Code points are the bytes that do not continue a character.
    chars = len(b"".join(words).decode())
    return (n, chars, len(_SYMBOLS.findall(text)), dup, repeated, lines, len(set(words)), sum(map(str.isalpha, text)), sum(map(str.isdigit, text)))


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                counts = np.array([statistics(t.as_py() or "") for t in batch.column(1)], dtype=np.int64)
                yield pa.record_batch([batch.column(0), *(pa.array(counts[:, i]) for i in range(len(_COUNTS)))], names=["doc_id", *_COUNTS])

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS))


def attributes() -> dict[str, Column]:
    """What rules test: counts relative to the text's length."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {"n_words": F.col("n_words").cast("double"), "chars_per_word": F.col("word_chars") / words, "symbols_per_word": F.col("n_symbols") / words,
            "dup_line_share": F.col("n_dup_lines") / lines, "repeat_share": F.col("n_repeat_words") / words, "words_per_line": F.col("n_words") / lines,
            "distinct_share": F.col("n_distinct_words") / words, "letter_share": F.col("n_letters") / chars, "digit_share": F.col("n_digits") / chars}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    attribute: str
    at_least: bool
    threshold: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.attribute] >= self.threshold if self.at_least else rows[self.attribute] < self.threshold

    def column(self) -> Column:
        a = attributes()[self.attribute]
        return a >= F.lit(self.threshold) if self.at_least else a < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.attribute} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


def _covered(rule: list[Condition], rows: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(rows)
    return hit


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        best, gain = None, 1e-9
        for name, values in rows.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cuts):
                continue
            below_p = np.concatenate([[0], np.cumsum(b)])[cuts]
            below_n = cuts - below_p
            for at_least, cp, cn in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                ok = cp >= MIN_COVER
                if not ok.any():
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(ok, cp * (np.log2(cp / (cp + cn)) - np.log2(p / (p + n))), -np.inf)
                i = int(np.argmax(g))
                if g[i] > gain:
                    gain, best = float(g[i]), Condition(name, at_least, float((v[cuts[i]] + v[cuts[i] - 1]) / 2))
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(rows)
    return rule


def _worth(rule: list[Condition], rows: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, float]:
    hit = _covered(rule, rows, len(bad))
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return ((p - n) / (p + n) if p + n else -1.0), ((p + 1) / (p + n + 1) if p else 0.0)


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, seed: int = 17) -> list[list[Condition]]:
    """The ordered rules; each is a conjunction that rejects."""
    rules: list[list[Condition]] = []
    rng = np.random.default_rng(seed)
    while len(rules) < MAX_RULES and bad.sum() >= 2 * MIN_COVER and not bad.all():
        growing = np.zeros(len(bad), bool)
        for kind in (True, False):  # both thirds have both classes
            at = rng.permutation(np.flatnonzero(bad == kind))
            growing[at[:-(-2 * len(at) // 3)]] = True
        rule = _grow({k: v[growing] for k, v in rows.items()}, bad[growing])
        held = {k: v[~growing] for k, v in rows.items()}
        while len(rule) > 1 and _worth(rule[:-1], held, bad[~growing])[0] >= _worth(rule, held, bad[~growing])[0]:
            rule = rule[:-1]
        if not rule or _worth(rule, held, bad[~growing])[1] < PRECISION:
            break
        rules.append(rule)
        rest = ~_covered(rule, rows, len(bad))
        rows, bad = {k: v[rest] for k, v in rows.items()}, bad[rest]
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """True where no rule of the list rejects: an ordered conditional expression."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", label_id_col: str = "doc_id") -> list[list[Condition]]:
    """The decision list from labelled documents that pass the base rule (label 0 is rejected)."""
    picked = (labels.where(F.col(label_col).isNotNull() & F.col(label_id_col).isNotNull())
              .groupBy(F.col(label_id_col).alias("label_id")).agg(F.min(F.col(label_col)).alias("label"))
              .orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = narrow.join(F.broadcast(picked), narrow["doc_id"] == picked["label_id"])  # max_labelled rows of two numbers
    names = list(attributes())
    rows = (with_statistics(texts.select("doc_id", "text")).where(~base_failed())
            .join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))
            .select("label", "doc_id", *[a.alias(n) for n, a in attributes().items()])
            # An id may be on many rows, so the rows that come to the driver are bounded, not the ids alone.
            .dropDuplicates().orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(max_labelled)
            .toPandas().sort_values(["doc_id", *names], ignore_index=True))
    if rows.empty:
        return []
    return learn({n: rows[n].to_numpy(np.float64) for n in names}, (rows["label"] == 0).to_numpy())


def apply_rules(docs: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed and kept, for every document."""
    return (with_statistics(docs, id_col, text_col).withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & verdict(rules)))


def keep_good(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> DataFrame:
    """`docs` without the rows that the base rule or the list rejects; all columns as they are."""
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = fields.names.index(text_col)
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = np.array([statistics(t.as_py() or "") for t in batch.column(at)], dtype=np.int64)
            stats = pa.StructArray.from_arrays([pa.array(counts[:, i]) for i in range(len(_COUNTS))], names=list(_COUNTS))
            whole = pa.StructArray.from_arrays(batch.columns, names=fields.names)
            yield pa.record_batch([whole, stats], names=["doc", "stats"])

    stats = ", ".join(f"{c}: long" for c in _COUNTS)
    judged = docs.mapInArrow(run, f"doc {fields.simpleString()}, stats struct<{stats}>").select("doc", "stats.*")
    return judged.where(~base_failed() & verdict(rules)).select("doc.*")
