"""What plans shuffle and store, by their shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexstrata.operators import automaton as A
from lexstrata.operators import ngrams as N

TEXTS = [(1, "Der Mond ist hell. Der Mond ist fern."), (2, "der Mond"), (3, ""), (4, None), (5, "Ein Mond, ein Stern")]


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_trigrams_are_shuffled_once(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    counts = N.transitions(docs)
    assert not [x for x in counts.inputFiles() if "grams-" in x]
    longest = counts.where("depth = 2")
    assert exchanges(longest) == exchanges(N.top_transitions(N.probabilities(longest))) == 1


def test_asked_prefixes_are_counted_like_all(spark):
    docs = spark.createDataFrame([(i, t, "a" if i % 2 else "b") for i, t in TEXTS], "doc_id long, text string, group string")
    asked = spark.createDataFrame([("der mond",), ("mond",), ("",), ("kein",), ("der mond",)], "prefix string")
    every = N.transitions(docs, by=("group",)).where(F.col("prefix").isin("der mond", "mond", ""))
    got = N.transitions(docs, by=("group",), prefixes=asked)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect())) != []


def test_lanes_end_where_prefixes_do(spark):
    grammar = spark.createDataFrame([(1, s, r) for s, r in enumerate("abcdef")], "prompt_id long, segment int, role string")
    tokens = F.array(F.col("role"))
    roles = grammar.select("prompt_id", "role", tokens.alias("tokens"), tokens.alias("shown"))
    lanes = A.lanes_of(grammar, roles, 3)
    assert lanes.agg(F.max("segment"), F.min("segments"), F.max("segments")).first()[:] == (3, 6, 6)
    prefixes = grammar.select("prompt_id").distinct().select("prompt_id", F.lit(1).alias("state"), F.array(*map(F.lit, "abc")).alias("spoken"))
    field = roles.select("prompt_id", F.col("role").alias("token"), F.lit(0.5).alias("amplitude"))
    got = A.role_distribution(prefixes, grammar, roles, grammar.where("segment = 0"), field, A.role_wave(roles))
    assert [tuple(r) for r in got.collect()] == [(1, 1, "d", 1.0)]


def test_runs_of_three_are_shuffled_once(spark):
    docs = spark.createDataFrame([(1, "Der Mond Ist. der mond ist! Der Mond IST"), (2, "der MOND ist"), (3, None)], "doc_id long, text string")
    found = N.context_form(docs)
    assert exchanges(found) == 1
    assert ("der", "mond", "ist", "ist", 2) in [tuple(r) for r in found.select("a", "b", "token", "form", "n").collect()]
