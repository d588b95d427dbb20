"""Searches by a pass over the texts give what the stored index gives, without building one."""

from lexstrata import catalog
from lexstrata.operators import index as I
from lexstrata.operators.scan import TextScan

TEXTS = ["Alpha beta gamma delta\n" + "alpha Wald! " * 900, "the alpha of beta, beta gamma", "Straßenbahn beta gamma delta epsilon; wald", "", "x-ray, zeta beta gamma delta zeta"]
ITEMS = [(1, "beta gamma delta"), (2, "phab"), (3, "ra"), (4, "; "), (5, "beta, beta gamma"), (6, "a beta gamma delta e"), (7, "assenbahn"), (8, "of beta gamma"), (9, "traßenbahn b")]


def test_scan_is_the_index(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index, scan = I.TextIndex.build(docs), TextScan(docs)
    for ask in (lambda s: s.bm25_topk("alpha wald the zeta"), lambda s: s.bm25_topk("the"), lambda s: s.coverage_topk("alpha beta nowhere", least=0.1), lambda s: s.tf_cosine_topk(0), lambda s: s.idf_weights().orderBy("term")):
        assert [tuple(r) for r in ask(scan).collect()] == [tuple(r) for r in ask(index).collect()]
    wanted = sorted((d, i) for d, t in enumerate(TEXTS) for i, x in ITEMS if x in t)
    assert sorted(map(tuple, scan.holders_of(items).collect())) == wanted


def test_one_search_builds_no_index(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(I.TextIndex, "build", None)
    for name in ("bm25_topk", "composed_answer", "item_containment"):
        catalog.queries()[name](spark, str(tmp_path)).collect()
