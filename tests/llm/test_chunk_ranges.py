"""Ranges of ids for the next document: by rows, whatever the ids."""

from pyspark.sql import functions as F

from quarry.llm import chunks


def test_outlying_ids_do_not_crowd_one_range(spark):
    ids = [*range(3000), 10**18, -(10**17)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    dealt = chunks._with_next(docs).where("tail = 0").groupBy("range").count().collect()
    assert len(dealt) > 8 and max(r["count"] for r in dealt) < 3 * chunks.ROWS_PER_RANGE


def test_next_documents_across_ranges_and_odd_ids(spark):
    rows = [(i * 7 - 900, f"text number {i} " * (i % 5)) for i in range(700)] + [(10**18, "last " * 20), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    found = {r.doc_id: r.edited_sha256 for r in chunks.fingerprint_edits(docs).collect()}
    import hashlib
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        assert found[i] == hashlib.sha256(chunks.edit(text, following).encode()).hexdigest()
    assert chunks.fingerprint_edits(docs.limit(0)).count() == 0
    one = chunks.fingerprint_edits(docs.where(F.col("doc_id") == -900)).collect()
    assert len(one) == 1
