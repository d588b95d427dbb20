"""Queries on inputs beyond their former caps."""

from __future__ import annotations

from lexstrata import catalog
from lexstrata.operators import graph, ngrams


def test_parent_chains_have_no_longest_depth(spark):
    rows = [(f"a{i}", f"a{i - 1}" if i else None, "t", "ab"[i % 2]) for i in range(150)]
    rows += [(f"r{i}", f"r{(i + 1) % 6}", "u", "ab"[i % 2]) for i in range(6)] + [("x", "r0", "u", "b")]
    got = {r["message_id"]: r for r in graph.parent_chains(spark.createDataFrame(rows, "message_id string, parent_id string, message_tree_id string, role string")).collect()}
    assert len(got) == len(rows) and all(got[f"a{i}"]["depth"] == i and got[f"a{i}"]["ok"] for i in range(150))
    assert all(got[f"r{i}"]["depth"] == 6 and not got[f"r{i}"]["ok"] for i in range(6)) and (got["x"]["depth"], got["x"]["ok"]) == (7, False)


def test_mmr_select_gives_every_label_its_candidates(spark, tmp_path):
    rows = [(i, [1.0, 0.001 * (i % 50)], 0) for i in range(1200)] + [(2000 + i, [0.2, 1.0 + i], 1) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.queries()["mmr_select"](spark, str(tmp_path)).collect()
    assert sorted((r["label"], r["pick"]) for r in got) == [(label, k) for label in (0, 1) for k in range(4)]


def test_samples_follow_rare_transitions(spark):
    frequent = [(2, f"p{i} q", "z", 5) for i in range(20_000)]
    rare = [(2, "<BOS> a", "b", 1), (2, "a b", "c", 1), (2, "a b", "d", 1), (2, "b c", "<EOS>", 1), (2, "b d", "<EOS>", 1)]
    counts = spark.createDataFrame([*frequent, *rare], "depth int, prefix string, target string, n long")
    prompts = spark.createDataFrame([(i, "a") for i in range(200)], "prompt_id long, text string")
    got = [r["text"] for r in ngrams.sample_decode(prompts, counts, seed=3).collect()]
    assert len(got) == 200 and set(got) == {"b c", "b d"} and 60 < got.count("b c") < 140


def test_physical_energy_has_long_texts(spark, tmp_path):
    spark.createDataFrame([(1, "short"), (2, "long text " * 900), (3, None), (4, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in catalog.queries()["physical_energy"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4} and abs(got[2]["energy"] - 900 * sum(((b - 127.5) / 127.5) ** 2 for b in b"long text ")) < 1e-3
    assert got[2]["physical"] is not None and got[3]["physical"] == got[4]["physical"]


def test_codes_of_any_length_return_and_no_text_stays_none(spark, tmp_path):
    texts = [None, "", "ä", "ab", "Straße 東京", "x" * 4097, "lange Zeile 9\n" * 3001]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in catalog.queries()["codec_round_trip"](spark, str(tmp_path)).collect()}
    assert [got[i]["decoded"] for i in range(len(texts))] == texts and all(r["valid"] for r in got.values())
