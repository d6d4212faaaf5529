"""The pipeline's stages, each on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import rules, simhash
from quarry.llm.common import materialise, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    inputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(materialise(stage(spark, inputs[-1], SF), "stage"))
    _, good, single, mixed, packed = inputs
    assert all(d.columns == docs.columns for d in inputs[:4])
    judged = rules.apply_rules(docs, rules.learn_rules(docs, table(spark, SF, "labels")))
    assert sorted(r[0] for r in good.select("doc_id").collect()) == sorted(r[0] for r in judged.where("kept").select("doc_id").collect())
    first = {r["component_id"] for r in simhash.near_duplicates(good).collect()}
    assert {r[0] for r in single.select("doc_id").collect()} == first
    assert mixed.join(single, "doc_id", "left_anti").count() == 0
    assert packed.where("piece = 0").count() == mixed.count()
    over = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096")
    assert over.count() == 0
