"""N-grams that travel in blocks: the plain counts, whatever is counted at once, and how much is shuffled for them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexstrata import catalog
from lexstrata.operators import grams as G
from lexstrata.operators import ngrams as N

from .conftest import SF


def shuffled(spark, run) -> int:
    """The bytes that executors write for shuffles while ``run`` runs."""
    written = lambda: sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(True)))
    before = written()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return written() - before


def same(a, b, names):
    assert sorted(map(tuple, a.select(*names).collect())) == sorted(map(tuple, b.select(*names).collect()))


@pytest.mark.parametrize("at_once", [G.WORDS, 7])
def test_counts_equal_the_plain_ones(spark, monkeypatch, at_once):
    monkeypatch.setattr(G, "WORDS", at_once)
    monkeypatch.setattr(G, "ROWS", at_once)
    rows = [(i, f"Wort{i % 5} und, und wort{i % 3} é\x85 {i % 20}.", f"g\n{i % 4}") for i in range(60)] + [(90, "", "g\n1"), (91, None, "leer"), (92, "a " * 40, ""), (93, " \t", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group string").repartition(3)
    whole = N.transitions(docs, by=("group",))
    names = ["group", "depth", "prefix", "target", "n"]
    with G.lean(spark):
        same(G.transitions_by_home(docs, F.length("group"), 5, by="group"), whole, names)
        assert all(r["home"] == len(r["group"]) for r in G.transitions_by_home(docs, F.length("group"), 5, by="group").collect())
        asked = spark.createDataFrame([("",), ("und",), (", und",), ("<BOS> <BOS>",), ("nie da",), ("a",)], "prefix string")
        same(G.asked_transitions(docs, asked, by="group"), whole.join(asked, "prefix", "left_semi"), names)
        want = {r["target"]: r["amplitude"] for r in N.symbol_energy(N.transitions(docs)).collect()}
        got = {r["token"]: r["amplitude"] for r in G.symbol_wave(docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[t] - a) < 1e-12 for t, a in want.items())
    assert G.symbol_wave(docs.limit(0)).isEmpty()


def test_sums_of_wide_rows_equal_those_of_narrow_ones():
    columns, n = [np.array(c, np.int32) for c in ([3, 1, 3, 1], [2, 0, 2, 5], [1, 1, 1, 1])], np.array([4, 1, 6, 2])
    for words in (8, 1 << 30):
        got, sums = G.summed(columns, n, words)
        assert [c.tolist() for c in got] == [[1, 1, 3], [0, 5, 2], [1, 1, 1]] and sums.tolist() == [1, 2, 10]
        assert G.summed(columns, None, words)[1].tolist() == [1, 1, 2]


def test_the_wave_of_all_texts_travels_in_blocks(spark):
    assert shuffled(spark, lambda: catalog.queries()["group_distribution"](spark, SF).collect()) < 8e6


def test_compiled_counts_travel_in_blocks(spark):
    assert shuffled(spark, lambda: catalog.queries()["incremental_transitions"](spark, SF).collect()) < 2e6
