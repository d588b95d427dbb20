"""Grammars that a row holds whole, against the automaton that is stepped by joins, and how much is shuffled for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexstrata import catalog
from lexstrata.functions import text as X
from lexstrata.operators import automaton as A
from lexstrata.operators import fields as P

from .conftest import SF
from .test_grams import shuffled


def by_joins(docs):
    """The rows of role_grammar by the operator over all rows of an id."""
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("prompt_id"), "text")
    lines = docs.select("prompt_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("segment", "line"))
    grammar = lines.select("prompt_id", "segment", F.explode(X.sentences(F.col("line"))).alias("role")).distinct()
    tokens = X.compiler_tokens(F.col("role"))
    roles = grammar.select("prompt_id", "role").distinct().select("prompt_id", "role", tokens.alias("tokens"), tokens.alias("shown"), F.lit("line").alias("origin"))
    first = grammar.where("segment = 0").groupBy("prompt_id").agg(F.min("role").alias("role")).join(roles, ["prompt_id", "role"])
    prefixes = first.select("prompt_id", F.explode(F.array(F.lit(0), F.lit(3))).alias("state"), "tokens").select("prompt_id", "state", F.slice("tokens", F.lit(1), F.col("state")).alias("spoken"))
    out = A.role_distribution(prefixes, grammar, roles, grammar.where("segment = 0").select("prompt_id", "role"), P.prompt_field(docs, "prompt_id"), A.role_wave(roles))
    return {(r["prompt_id"], r["state"], r["target"]): r["probability"] for r in out.collect()}


ODD = [
    (1, "Der Wald. der wald. Der See!\nEin Berg.\n\nEin Ende."),
    (2, "Ja.\nNein.\n \n\t\nUnd nun? Ja."),  # a line of blanks that trim leaves: a segment without a role
    (3, "\t\nKein Anfang."),
    (4, "_ _\n___. Eins zwei drei."),  # roles without a word
    (5, "_. Ja. Ja_nein.\nDann."),
    (6, "Eins"), (7, "Eins zwei"), (8, "A.\nB.\nC.\nD.\nE.\nF."), (9, "A.\nB.\nC."),
    (10, ""), (11, None), (None, "Ohne Nummer."), (12, "   \n  "),
    (13, "Das Haus. Das Haus ist alt.\nDas Haus."), (14, "über Straße straße STRASSE 3,5 über.\nüber é"),
    (15, "A. B.\nC. D.\n_\nE."), (16, "a b c. a b c d. a b\nx y. z"),
]
TWICE = [(20, "Der Wald. Der See.\nEin Berg."), (20, "Der Wald. Am Meer.\nEin Tal.\nSchluss."), (21, "Ja."), (21, "Ja."), (22, None), (22, "Und ja."), (23, "\t"), (23, "")]


def test_rows_of_their_own_give_what_joins_give(spark, tmp_path):
    for name, rows in {"alone": ODD, "twice": ODD + TWICE, "only": TWICE, "none": []}.items():
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        want = by_joins(docs)
        got = {(r["doc_id"], r["spoken"], r["target"]): r["probability"] for r in catalog.queries()["role_grammar"](spark, f"{tmp_path}/{name}").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-8 for k, v in want.items()), name
        assert bool(want) == bool(rows)


def test_energies_are_those_of_the_roles(spark):
    docs = spark.createDataFrame([(i, 1, [[0]], [["a", f"b{i % 7}"], ["a", "a", "c"], []], ["a"]) for i in range(50)], "prompt_id long, segments int, lanes array<array<int>>, tokens array<array<string>>, words array<string>")
    rows = A.own_grammars(docs.repartition(1), lengths=(0, 3)).where("state IS NULL").groupBy("target").agg(F.sum("amplitude").alias("e")).collect()
    energy = {r["target"]: r["e"] for r in rows}
    want = A.role_spread(docs.select(F.explode("tokens").alias("tokens")))
    assert all(abs(energy[r["token"]] - r["energy"]) < 1e-9 for r in want.collect()) and len(energy) == want.count()


def test_texts_of_role_grammars_are_not_shuffled(spark):
    assert shuffled(spark, lambda: catalog.queries()["role_grammar"](spark, SF).collect()) < 1.5e6
