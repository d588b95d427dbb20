from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from lexstrata.llm import minmax
from lexstrata.llm.cluster import stored

from .helpers import with_clashes

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(1).select(F.lit(10**6).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), "source", F.lit(0).cast("long").alias("n_chars")))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), "stage")
        assert out.columns == docs.columns, name
        docs = out
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    left = minmax.clusters(docs)
    assert left.where("NOT kept").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == sizes[-1] and last.where("NOT round_trip").count() == 0


def test_stages_take_empty_tables_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0
    wide = with_clashes(docs.limit(30))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, wide, SF).count() <= 30


def test_run_equals_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
