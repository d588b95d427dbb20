"""Operators over fields, scores, stores and splitters, by literal cases and brute force."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexstrata.functions import text as X
from lexstrata.operators import etl, fields, graph, scoring, store
from lexstrata.operators.index import TextIndex
from lexstrata.sources.shared import fresh_path


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in rows.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_splitters_and_rendering(spark):
    assert values(spark, X.spoken_sentences, "Das ist z. B. gut. Am 14. April war es kalt! Ende", None)[0] == ["Das ist z. B. gut.", "Am 14. April war es kalt!", "Ende"]
    text = 'Er kam um 3. Dann ging er.\n\n"Halt!" rief sie. u. a. dort'
    (spans,) = values(spark, X.sentence_spans, text)
    assert [text[s["start"] : s["end"]] for s in spans] == ["Er kam um 3. Dann ging er.", '"Halt!"', "rief sie.", "u. a. dort"]
    assert values(spark, X.sentence_spans, "", None, " \n ") == [[], None, []]
    words = spark.createDataFrame([(["<BOS>", "der", "wert", "(", "etwa", "3", ".", "grad", ")", "steigt", ".", "danach", "nicht", "<EOS>"],)], "w array<string>")
    assert words.select(X.rendered("w")).first()[0] == "Der wert (etwa 3. grad) steigt. Danach nicht"
    assert values(spark, X.surface_words, "Der Baum, der baum und das Haus") == [["baum", "haus"]]
    assert values(spark, X.relation_arguments, "Sie ist das Produkt aus Masse und Beschleunigung.") == [["beschleunigung", "mass"]]
    assert values(spark, X.unit_owner, "Die Einheit der Frequenz ist das Hertz.") == ["frequenz"]
    assert values(spark, lambda c: X.search_tokens(c, normal=False), "ﬁnden Ａbc") == [["finden", "abc"]]


def test_fields(spark):
    rows = spark.createDataFrame([(1, "baum baum haus"), (2, "haus"), (3, "der die")], "k int, text string")
    got = {(r["k"], r["token"]): r["amplitude"] for r in fields.prompt_field(rows, "k").collect()}
    assert got == pytest.approx({(1, "baum"): 2 / 5**0.5, (1, "haus"): 1 / 5**0.5, (2, "haus"): 1.0})
    wave = fields.prompt_field(rows, "k").where("k = 1").select("token", "amplitude")
    prior = {r["token"]: r["amplitude"] for r in fields.mode_prior(wave, spark.createDataFrame([("baum",), ("x",)], "token string"), 0.15).collect()}
    assert prior == pytest.approx({"baum": 0.15}) and fields.mode_prior(wave, wave, 0.0).count() == 0
    token = spark.createDataFrame([("hertz",)], "t string").select(fields.stable_frequency()("t").alias("f")).first()["f"]
    assert token == pytest.approx(0.25 + 29.75 * int.from_bytes(hashlib.blake2b(b"hertz", digest_size=8).digest(), "little") / 2**64)
    one = spark.createDataFrame([(0.5, 0.2), (1.0, 0.9)], "amplitude double, p double")
    r = fields.readouts(one, coupling=1.0, phase=0.7).first()
    assert r["agrees"] and r["direct_energy"] == pytest.approx(sum(abs(a * (1 + np.exp(0.7j) * p)) ** 2 for a, p in ((0.5, 0.2), (1.0, 0.9))))
    a, b = np.arange(5.0), np.array([1.0, 0, 2, 0, 0])
    assert np.allclose(fields.spectral_convolution(a, b), [sum(a[k] * b[(i - k) % 5] for k in range(5)) for i in range(5)])
    modes = spark.createDataFrame([([("a", 1.0)],), ([("", 1.0)],), ([("a", 1001.0)],), ([("a", 1.0)] * 257,), ([("a", float("nan"))],)], "m array<struct<token:string,amplitude:double>>")
    assert [r[0] for r in modes.select(fields.valid_context(F.col("m"))).collect()] == [True, False, False, False, False]


def test_cooccurrence_equals_brute_force(spark):
    t = "a1 baum haus der baum see haus tier baum wald see see".split()
    want: dict = {}
    for i, x in enumerate(t):
        for j in range(max(0, i - 6), min(len(t), i + 7)):
            if x != t[j] and x.isalpha() and t[j].isalpha() and x != "der":
                want[x, t[j]] = want.get((x, t[j]), 0) + 1 / (1 + abs(i - j))
    most = {x: max(v for (a, _), v in want.items() if a == x) for x, _ in want}
    got = {(r["a"], r["b"]): r["weight"] for r in fields.cooccurrence(spark.createDataFrame([(t,), ([],), (["x"],)], "t array<string>")).collect()}
    assert got == pytest.approx({k: v / most[k[0]] for k, v in want.items()})


def test_wave_scores_equal_dense_vectors(spark):
    texts = ["Die Frequenz ist ein Maß.", "Der Baum steht im Wald.", "Frequenzen und Wellen"]
    weights = {"frequenz": 1.5}

    def dense(words):
        v = np.zeros(4096)
        slot = lambda f: (int.from_bytes(hashlib.blake2b(f.encode(), digest_size=16).digest()[:8], "little") % 2048, 1.0 if hashlib.blake2b(f.encode(), digest_size=16).digest()[8] & 1 else -1.0)
        for w in words:
            at, sign = slot("w:" + w)
            v[at] += sign * weights.get(w, 0.35) * 0.75**0.5
            for n in (3, 4):
                p = f"^{w}$"
                for i in range(len(p) - n + 1):
                    at, sign = slot("c:" + p[i : i + n])
                    v[2048 + at] += sign * 0.25**0.5
        return v / np.linalg.norm(v)

    rows = spark.createDataFrame(list(enumerate([*texts, "Was ist Frequenz?"])), "id long, text string")
    words = [r["w"] for r in rows.orderBy("id").select(F.transform(X.search_tokens(F.col("text")), X.canonical_term).alias("w")).collect()]
    want = [float(dense(w) @ dense(words[3])) ** 2 for w in words[:3]]
    table = spark.createDataFrame(list(weights.items()), "term string, weight double")
    got = {r["id"]: r["wave"] for r in scoring.wave_scores(rows.where("id < 3"), "Was ist Frequenz?", table).collect()}
    assert [got[i] for i in range(3)] == pytest.approx(want)


def test_sentence_scores_prefer_definitions(spark):
    rows = [(1, "Frequenz", "Die Frequenz ist ein Maß für die Zahl der Schwingungen in einer Sekunde.", 0), (2, "Wald", "Der Wald besteht aus vielen Bäumen und anderen Pflanzen aller Art.", 0), (3, "Liste der Größen", "Frequenz, Masse, Länge, Zeit, Strom, Stoffmenge, Licht: siehe auch dort.", 4)]
    out = scoring.sentence_scores(spark.createDataFrame(rows, "id long, title string, text string, position int"), "Was ist Frequenz?", "Frequenz").collect()
    assert [r["id"] for r in out][0] == 1 and out[0]["score"] > 4 and out[-1]["id"] in (2, 3)
    weights = {r["term"]: r["weight"] for r in scoring.term_weights(spark.createDataFrame([("frequenz a",), ("masse",)], "text string"), ["Frequenz"]).collect()}
    assert weights["frequenz"] == pytest.approx(0.25 + 1.75 * math.log(2) / math.log(3))
    assert values(spark, scoring.alias_expansions, "Was kostet ein PC mit KI?", "Kino") == [["kuenstliche intelligenz", "personalcomputer"], []]
    assert values(spark, scoring.ambiguous, "Bank steht für:", "Ein Satz.") == [True, False]
    assert values(spark, scoring.list_page, "Liste der Berge", "Berge") == [True, False]


def test_leads(spark):
    markers = etl.MARKERS["de"]
    long = "Die Frequenz ist ein Maß dafür, wie schnell bei einem Vorgang die Wiederholungen aufeinander folgen () und das in der Zeit."
    run = lambda t: values(spark, lambda c: etl.lead_reason(F.lit("Frequenz"), c, markers), t)[0]
    got = run("Frequenz\n\n" + long)
    assert got["reason"] is None and got["text"] == long.replace(" ()", "")
    assert run("Dabei ist es so, dass die Wellen und das Licht von der Sonne sind.")["reason"] == "dependent_opening"
    assert run("Die Frequenz ist das.")["reason"] == "too_few_words" and run("")["reason"] == "opening_too_short"
    assert run(long + " Und die Welle ist das nicht von der Art wie. " * 40 + "ohne Ende")["reason"] == "opening_not_complete_prose"
    clipped = run((long + " ") * 12 + long)
    assert clipped["reason"] is None and len(clipped["text"]) <= 1200 and clipped["text"].endswith("Zeit.")


def test_inference_statuses(spark):
    edges = graph.edges(spark.createDataFrame([("a", "is_a", "b", "s1"), ("b", "is_a", "c", "s2"), ("c", "is_a", "d", "s3"), ("x", "is_a", "y", "s4")], "subject string, predicate string, object string, source string"))
    ask = spark.createDataFrame([("a", "c"), ("a", "a"), ("a", "y"), ("a", "nope"), ("a", "d")], "subject string, target string")
    got = {r["target"]: r for r in graph.infer(edges, ask, max_hops=2).collect()}
    assert {t: r["reason"] for t, r in got.items()} == {"c": "proved_by_transitivity", "a": "reflexivity", "y": "hop_limit", "nope": "unknown_node", "d": "hop_limit"}
    assert got["c"]["sources"] == ["s1", "s2"] and [tuple(e) for e in got["c"]["proof"]] == [("a", "b", "s1"), ("b", "c", "s2")] and got["c"]["status"] == "proved"
    assert {r["target"]: r["reason"] for r in graph.infer(edges, ask).collect()}["y"] == "no_path"


def test_store_mutations(spark):
    held = store.DocumentStore(spark, fresh_path(spark, "store"))
    held.append(spark.createDataFrame([("doc-3", "t1", "user"), ("p", "t2", "prior / one")], "id string, text string, source string"))
    assert held.add_one("another") == "doc-4" and held.add_one("named", document_id="n") == "n"
    with pytest.raises(ValueError):
        held.add_one("again", document_id="n")
    before = held.revision()
    moved = held.migrate(F.startswith("source", F.lit("prior / ")))
    assert moved == {"revision": before + 1, "archived": 1, "retained": 3, "changed": 1} and held.documents().count() == 3
    assert [r["id"] for r in held.archived().collect()] == ["p"] and held.migrate(F.lit(False))["changed"] == 0
    with pytest.raises(store.SnapshotRequired):
        held.changes_since(before, reset_revision=moved["revision"])
    triple = "subject string, predicate string, object string, source string"
    assert held.add_relations(spark.createDataFrame([("a", "is_a", "b", "s"), ("a", "is_a", "b", "s")], triple))["added"] == 1
    assert held.add_relations(spark.createDataFrame([("a", "is_a", "b", "s")], triple)) == {"revision": before + 2, "added": 0, "existing": 1}
    with pytest.raises(ValueError):
        held.add_relations(spark.createDataFrame([("a", "part_of", "b", "s")], triple))
    assert held.commit_conversation("s-1", 0, '{"turn": 1}') == 1 and held.conversation("s-1") == (1, '{"turn": 1}')
    with pytest.raises(store.RevisionConflict):
        held.commit_conversation("s-1", 0, "{}")
    held.record_query("Was ist?", '{"answer": 1}')
    with pytest.raises(ValueError):
        held.record_query("Was ist?", '{"answer": NaN}')


def test_index_grows_by_batches(spark):
    docs = spark.createDataFrame([(1, "baum haus\nbaum im wald"), (2, None), (3, "see und wald")], "doc_id long, text string")
    index = TextIndex.build(docs.where("doc_id < 3"))
    index.append(docs)
    whole = TextIndex.build(docs)
    for of in (lambda x: x.postings(), lambda x: x.frequencies(), lambda x: x.bm25_topk("wald baum"), lambda x: x.coverage_topk("wald baum", least=0.1), lambda x: x.tf_cosine_topk(1)):
        assert sorted(map(tuple, of(index).collect())) == sorted(map(tuple, of(whole).collect()))
    assert index.texts() == 3
    items = spark.createDataFrame([(1, "haus\nbaum im"), (2, "wald"), (3, "ald"), (4, "baum see wald")], "item_id long, text string")
    assert sorted(map(tuple, whole.holders_of(items, docs).collect())) == [(1, 1), (1, 2), (1, 3), (3, 2), (3, 3)]
