"""Steps whose cost decides at size: how often rows are dealt, and results on rows that share an id."""

import re

from pyspark.sql import functions as F

from lexstrata import catalog
from lexstrata.functions import text as X
from lexstrata.operators import fields as P
from lexstrata.operators import ngrams as N
from lexstrata.operators import retrieval as R
from lexstrata.operators import scoring as S


def steps(df, name: str) -> int:
    return len(re.findall(name, df._jdf.queryExecution().executedPlan().toString()))


def test_vectors_are_dealt_by_id(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (1, "beta"), (2, "wald")], "doc_id long, text string")
    vectors = R.hashed_vectors(docs)
    assert steps(R.postings(docs), "Exchange hashpartitioning") == 1
    assert steps(vectors, "Exchange hashpartitioning") == 2 and steps(vectors, "SortMergeJoin") == 0
    norms = vectors.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert len(norms) == 2 and all(abs(r["n"] - 1) < 1e-9 for r in norms)


def test_pairs_are_dealt_twice(spark):
    words = spark.createDataFrame([(["wald", "see", "wald", "berg"],), (["see", "wald"],)], "t array<string>")
    pairs = P.cooccurrence(words)
    assert steps(pairs, "Exchange hashpartitioning") == 2
    got = {(r["a"], r["b"]): r["weight"] for r in pairs.collect()}
    assert got["wald", "see"] == 1.0 and abs(got["wald", "berg"] - (1 / 2 + 1 / 4) / (3 / 2)) < 1e-12 and len(got) == 6


def test_a_context_counts_both_roles_at_once(spark):
    turns = spark.createDataFrame([(1, "user", "wald see see"), (1, "assistant", "wald berg"), (1, "system", "meer"), (2, "user", "wald"), (3, "user", "und")], "conv_id long, role string, text string")
    part = lambda role: P.prompt_field(turns.where(F.col("role") == role), "conv_id")
    was = P.summed(part("user"), part("assistant"), by=["conv_id"])
    now = P.context(turns, "conv_id", "role", ("user", "assistant"))
    assert steps(now, "SortMergeJoin|HashJoin") == 1 < steps(was, "SortMergeJoin|HashJoin")
    rows = lambda df: sorted((r["conv_id"], r["token"], round(r["amplitude"], 12)) for r in df.collect())
    assert rows(now) == rows(was) and len(rows(now)) == 4


def test_words_of_a_text_are_found_whole(spark, tmp_path):
    texts = [(1, "Handel; handhand"), (2, "Die Hand."), (3, "hand2 ENTRE-ligne"), (4, None), (5, "ßhand"), (6, "x hand")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = S.overlapping(docs, "entre the hand")
    assert [r["doc_id"] for r in found.orderBy("doc_id").collect()] == [2, 3, 6]
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert S.overlapping(docs, "the").isEmpty()
    rows = [(1, "that"), (1, "by this"), (2, "That, by THIS!"), (3, "that by thistle")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["doc_id"] for r in catalog.queries()["relational_division"](spark, str(tmp_path)).collect()) == [1, 2]


def test_stop_words_are_looked_up(spark):
    plan = spark.range(1).select(X.search_tokens(F.concat(F.lit("der Wald "), F.col("id").cast("string")))).alias("t")
    assert "array_contains" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_appends_deal_rows_once(spark, tmp_path):
    from lexstrata.operators import store

    rows = [(i, f"text {i % 3}", "s") for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalog.queries()["store_append"](spark, str(tmp_path)).collect()] == [(3, 18, 2)]
    held = store.DocumentStore(spark, f"{tmp_path}/held")
    batch = spark.createDataFrame([("a", "x", "s"), ("a", "x", "s"), ("b", "x", "s"), ("c", "y", "s")], "id string, text string, source string")
    assert held.append(batch) == {"revision": 1, "added": 2, "existing": 2}
    assert held.append(batch) == {"revision": 1, "added": 0, "existing": 4}


def test_prefixes_are_sorted_by_hash(spark):
    counts = spark.createDataFrame([(0, "", "a", 3), (1, "a", "b", 1), (1, "a", "c", 3), (2, "a b", "c", 1), (3, "a b c", "d", 2)], "depth int, prefix string, target string, n long")
    top = N.top_transitions(N.probabilities(counts), 1)
    assert steps(top, r"Sort \[_w0#\d+L ASC") == steps(top, r"Sort \[") > 0
    rows = sorted((r["prefix"], r["target"], r["p"]) for r in top.collect())
    assert rows == [("", "a", 1.0), ("a", "c", 0.75), ("a b", "c", 1.0), ("a b c", "d", 1.0)]
    assert rows == sorted((r["prefix"], r["target"], r["p"]) for r in N.top_transitions(N.probabilities(counts, ordered=True), 1).collect())


def test_sampling_looks_prefixes_up_or_reads_all(spark, monkeypatch):
    from lexstrata.operators import ngrams

    docs = spark.range(60).selectExpr("id AS doc_id", "concat_ws(' ', 'a', id % 3, 'b', id % 5, 'c', id % 7) AS text")
    prompts = spark.range(6).selectExpr("id AS prompt_id", "'' AS text")
    before, found = spark.conf.get(ngrams.IN_KEY), []
    for few in (0, 512):
        monkeypatch.setattr(ngrams, "FEW", few)
        found.append(sorted(map(tuple, ngrams.sample_decode(prompts, ngrams.transitions(docs), seed=7, steps=3).collect())))
    assert found[0] == found[1] and len(found[0]) == 6 and spark.conf.get(ngrams.IN_KEY) == before
