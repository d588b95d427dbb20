from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexstrata.functions import language as L
from lexstrata.functions import text as X
from lexstrata.operators import conversations, etl, graph, ngrams, retrieval, store, waves
from lexstrata.sources import files
from lexstrata.sources.shared import fresh_path


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("word", "term"), [("Häuser", "haus"), ("Beine", "bein"), ("Autos", "autos"), ("Straße", "strass"), ("Kinder", "kind"), ("h2o", "h2o"), ("des", "des"), ("Rings", "ring")])
def test_canonical_term(spark, word, term):
    assert value(spark, X.canonical_term(F.lit(word))) == term


def test_tokens(spark):
    assert value(spark, X.search_tokens(F.lit("Der HUND und die Straße, 3 Äpfel"))) == ["hund", "strasse", "3", "äpfel"]
    assert value(spark, X.compiler_tokens(F.lit("Es kostet 3,50 - so war's."))) == ["es", "kostet", "3,50", "-", "so", "war's", "."]
    assert value(spark, X.term_set(F.lit("Autos Frauen a"))) == ["autos", "auto", "frauen", "fraue"]
    assert value(spark, X.concept(F.lit("die Masse (Physik) m"))) == "mass"
    assert value(spark, X.sentences(F.lit("Das ist z. B. gut. Am 3. Mai kam er. Ende!"))) == ["Das ist z. B. gut.", "Am 3. Mai kam er.", "Ende!"]
    assert value(spark, X.statement_facets(F.lit("Die Einheit der Kraft ist das Newton."))) == ["about", "unit"]
    assert value(spark, X.clean_text(F.lit("Wort [a[b]] ( ) und „so“ , ja ."))) == 'Wort und "so", ja.'
    assert value(spark, X.finished(F.lit("ein satz,"))) == "Ein satz."
    assert value(spark, X.title_of(F.lit("Titel\nKörper."))) == "Titel" and value(spark, X.body_of(F.lit("Titel\nKörper."))) == "Körper."
    assert value(spark, X.title_of(F.lit("Ein Satz.\nMehr"))) == ""
    assert value(spark, X.passages(F.lit("abcdefg"), 3)) == ["abc", "def", "g"] and value(spark, X.passages(F.lit(""), 3)) == [""]
    assert value(spark, X.byte_tokens(F.lit("é"))) == ["<byte:c3>", "<byte:a9>"]
    assert value(spark, X.from_byte_tokens(X.byte_tokens(F.lit("naïve")))) == "naïve"
    assert value(spark, X.quoted_title(F.lit("Über (Film) x"))) == "%C3%9Cber_(Film)_x"
    assert value(spark, X.title_proximity(F.lit("Auto"), F.lit("auto"))) == 7.0
    assert value(spark, X.nfkc(F.lit("ﬁ ①"))) == "fi 1"


@pytest.mark.parametrize(("prompt", "kind"), [("", "leer"), ("Hallo du", "begruessung"), ("Vielen Dank, danke!", "dank"), ("Tschüss dann", "abschied"), ("Auf Wiedersehen!", "abschied"), ("Stell dich doch bitte vor, wer bist denn du", "selbstbeschreibung"), ("Kannst du hören?", "fahigkeit"), ("Fasse den Text zusammen", "zusammenfassung"), ("Gib dir Zeit", "selbstauskunft"), ("Dann kommt sie später nach Hause", "folgebegriff"), ("Der Fluss ist sehr tief und kalt im Winter gewesen", "aussage"), ("Welche Farbe hat das Meer", "definition"), ("Hiob kommt gleich zurück in die Stadt", "aussage"), (None, "leer"), ("Wie alt bist du?", "selbstauskunft"), ("Wie heißt du?", "name"), ("Wie geht es dir?", "befinden"), ("Was ist der Unterschied zwischen A und B?", "vergleich"), ("Wann war das?", "zeit"), ("Warum ist das so?", "ursache"), ("Wer war Ohm?", "person"), ("Was ist eine Frequenz?", "definition"), ("Frequenz", "stichwort"), ("Übersetze den Satz", "auftrag"), ("Nenne drei Flüsse", "liste"), ("Kann Wasser brennen?", "entscheidung"), ("Erkläre die Schwerkraft", "erklaerung")])
def test_intents(spark, prompt, kind):
    assert L.with_kind(spark.createDataFrame([(prompt,)], "text string")).first()["kind"] == kind


def test_targets_and_assertions(spark):
    targets = {
        "Bitte, was ist die Frequenz?": "Frequenz", "Okay, also kannst du mir mal erklären, was eine Welle ist?": "Welle ist", "Wie funktioniert ein Motor": "funktioniert ein Motor",
        "Was?": "Was", "Nenne mir bitte die Flüsse Europas.": "Flüsse Europas", "Frequenz": "Frequenz", "Die Alpen": "Alpen",
    }
    assert {t: value(spark, L.target(F.lit(t))) for t in targets} == targets
    assert value(spark, L.modifiers(F.lit("Was ist Kraft in der Physik, und was aus dem Jahr 1921?"))) == ["in der physik", "aus dem jahr 1921"]
    assert value(spark, L.sub_questions(F.lit("Kraft und Masse"))) == []
    assert value(spark, L.topics(F.lit("Wie alt bist du, und träumst du auch?"))) == ["Alter", "Träume"]
    assert value(spark, L.sub_questions(F.lit("Definition der Kraft und Einheit der Masse"))) == ["Definition der Kraft", "Einheit der Masse"]
    assert [tuple(x) for x in value(spark, conversations.assertions(F.lit("Mein Name ist Anna. Ich mag Tee.")))] == [("name", "Anna"), ("preference", "Tee")]


def test_codec_and_energies(spark):
    texts = ["", "a", "Grüße", "東京 🙂", "x" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = waves.coefficients(df)
    for r in rows.select("text", "coefficients", waves.byte_energy(F.col("text")).alias("e")).collect():
        assert abs(sum(x * x for x in r["coefficients"]) - r["e"]) < 1e-9
    packets = rows.select("doc_id", "text", "coefficients", F.octet_length("text").alias("byte_length"), F.sha2("text", 256).alias("sha256"))
    assert all(r["valid"] and r["decoded"] == r["text"] for r in waves.decoded(packets).collect())
    assert not any(r["valid"] for r in waves.decoded(packets.withColumn("sha256", F.lit("0"))).collect())


def test_reachability_with_cycles(spark):
    e = graph.edges(spark.createDataFrame([("a", "is_a", "b", "s2"), ("a", "is_a", "b", "s1"), ("b", "is_a", "c", "s"), ("c", "is_a", "a", "s"), ("x", "is_a", "x", "s"), ("a", "is_a", "d", "s"), ("d", "is_a", "c", "s")], "subject string, predicate string, object string, source string"))
    assert {(r["subject"], r["object"]): r["source"] for r in e.collect()}[("a", "b")] == "s1"
    ways = {(r["start"], r["node"]): (r["hops"], r["path"]) for r in graph.reachable(e).collect()}
    assert ways[("a", "c")] == (2, ["a", "b", "c"]) and ways[("c", "b")][0] == 2 and ways[("x", "x")] == (0, ["x"]) and ("x", "a") not in ways
    asked = spark.createDataFrame([("a", "c"), ("a", "a"), ("c", "x"), ("a", "zz")], "subject string, target string")
    assert {(r["subject"], r["target"]): r["reason"] for r in graph.infer(e, asked).collect()} == {("a", "c"): "proved_by_transitivity", ("a", "a"): "reflexivity", ("c", "x"): "no_path", ("a", "zz"): "unknown_node"}


def test_store(spark):
    s = store.DocumentStore(spark, fresh_path(spark, "store"))
    rows = lambda *r: spark.createDataFrame(list(r), "id string, text string, source string")
    assert s.append(rows(("1", "a", "s"), ("2", "b", "s"), ("3", "a", "s"))) == {"revision": 1, "added": 2, "existing": 1}
    assert s.append(rows(("1", "a", "s"))) == {"revision": 1, "added": 0, "existing": 1}
    assert s.append(rows(("4", "c", "s"), ("2", "b", "s")), expected_revision=1) == {"revision": 2, "added": 1, "existing": 1}
    now, changes = s.changes_since(1)
    assert now == 2 and [r["id"] for r in changes.collect()] == ["4"] and s.documents(1).count() == 2
    for batch, error in ((rows(("1", "other", "s")), store.RevisionConflict), (rows(("5", "x", "s"), ("5", "y", "s")), store.RevisionConflict), (rows((" ", "x", "s")), ValueError)):
        with pytest.raises(error):
            s.append(batch)
    with pytest.raises(store.RevisionConflict):
        s.append(rows(("9", "z", "s")), expected_revision=7)
    with pytest.raises(store.RevisionConflict):
        s.changes_since(3)
    with pytest.raises(store.SnapshotRequired):
        s.changes_since(0, reset_revision=1)
    assert s.page(0, 2).count() == 2 and s.statistics().first()["documents"] == 3


def test_openings(spark):
    sentence = "Der Hund ist ein Tier, das mit dem Menschen und von ihm lebt und das er mag."
    cases = {
        f"{sentence} {sentence}": None, sentence: "opening_too_short", "Er ist der Hund und die Katze von dem Mann mit Hut.": "dependent_opening", "- der Punkt der Liste ist ein Punkt und keiner sonst.": "opening_not_complete_prose",
        "Das ist kurz.": "too_few_words", "One two three four five six seven eight nine.": "language_heuristic", f"{sentence}\n{sentence}": "opening_embedded_linebreak", " ".join([sentence] * 20): "opening_too_long", "Titel": "opening_too_short",
    }
    for text, reason in cases.items():
        assert value(spark, etl.opening_reason(F.lit("Titel"), F.lit(text), markers=etl.MARKERS["de"])) == reason, text


def test_messages(spark):
    kind = "message_id string, parent_id string, message_tree_id string, role string, lang string, text string, review_result boolean, deleted boolean, synthetic boolean, labels map<string,struct<value:double>>"
    good = ("m", None, "t", "prompter", "de", "Das ist der Text und die Frage.", True, False, False, {})
    change = lambda **k: tuple(k.get(n, v) for n, v in zip(["message_id", "parent_id", "tree", "role", "lang", "text", "review", "deleted", "synthetic", "labels"], good, strict=True))
    rows = [good, change(lang="en"), change(review=False), change(synthetic=None), change(labels={"spam": (0.5,)}), change(labels={"toxicity": (0.6,)}), change(text="siehe https://x")]
    df = spark.createDataFrame(rows, kind)
    assert [r[0] for r in df.select(etl.message_reason(df)).collect()] == [None, "language_tag", "not_accepted_or_deleted", "synthetic_or_unknown", "adverse_review_label", "toxicity_or_violence_label", "code_or_external_reference"]
    chain = spark.createDataFrame([("1", None, "t", "prompter"), ("2", "1", "t", "assistant"), ("3", "2", "t", "prompter"), ("4", "9", "t", "assistant"), ("5", "6", "t", "prompter"), ("6", "5", "t", "assistant"), ("7", "1", "t", "prompter")], "message_id string, parent_id string, message_tree_id string, role string")
    assert {r["message_id"]: r["ok"] for r in graph.parent_chains(chain).collect()} == {"1": True, "2": True, "3": True, "4": False, "5": False, "6": False, "7": False}


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"id": "1", "text": "x"}\n\n{"id": "2", "text": "y"}\n', encoding="utf-8")
    assert [tuple(r) for r in files.jsonl(spark, f"file://{tmp_path}/a.jsonl", "id string, text string").collect()] == [("1", "x"), ("2", "y")]
    (tmp_path / "b.json").write_text('{"documents": [{"id": "3", "text": "z"}]}')
    (tmp_path / "c.json").write_text('[{"id": "4", "text": "w"}]')
    assert files.json_documents(spark, f"file://{tmp_path}/b.json", "id string, text string").first()["id"] == "3"
    assert files.json_documents(spark, f"file://{tmp_path}/c.json", "id string, text string").first()["id"] == "4"
    assert files.whole_texts(spark, f"file://{tmp_path}/c.json").first()["source"].endswith("c.json")
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, text string")
    assert files.write_jsonl(df, f"file://{tmp_path}/out", order="id").count() >= 1 and files.jsonl(spark, f"file://{tmp_path}/out", "id string, text string").count() == 2
    df.write.parquet(f"file://{tmp_path}/p")
    with pytest.raises(ValueError):
        files.pinned_parquet(spark, f"file://{tmp_path}/p", ["id"])
    assert value(spark, files.contract_violation(F.lit('{"Answer": 1, "text": "x"}'))) == "forbidden_field"
    assert value(spark, files.contract_violation(F.lit('{"text": " "}'))) == "text" and value(spark, files.contract_violation(F.lit('{"text": "ok"}'))) is None
    import hashlib

    assert value(spark, files.content_id(F.lit(""), F.lit('a"b'), F.lit("s"))) == "text-" + hashlib.sha256(b'["", "a\\"b", "s"]').hexdigest()[:24]
    assert files.cached(df, f"file://{tmp_path}/cache", "k").count() == 2 and files.cached(df.limit(0), f"file://{tmp_path}/cache", "k").count() == 2


def test_transitions_and_decoding(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "a b c")], "doc_id long, text string")
    counts = ngrams.transitions(df)
    p = {(r["depth"], r["prefix"], r["target"]): r["p"] for r in ngrams.probabilities(counts).collect()}
    assert p[(2, "a b", "c")] == pytest.approx(2 / 3) and p[(2, "<BOS> <BOS>", "a")] == 1.0 and p[(0, "", "a")] == 0.25
    out = ngrams.decode_beam(spark.createDataFrame([(1, "a")], "prompt_id long, text string"), counts, steps=4).first()
    assert out["text"] == "b c" and out["done"]
    assert ngrams.sample_decode(spark.createDataFrame([(1, "a")], "prompt_id long, text string"), counts, seed=3).first()["text"] in ("b c", "b d")


def test_selection_and_budget(spark):
    rows = [("g", 1, 1.0, [1.0, 0.0]), ("g", 2, 0.99, [1.0, 0.01]), ("g", 3, 0.5, [0.0, 1.0])]
    picks = retrieval.mmr_select(spark.createDataFrame(rows, "g string, id long, score double, vector array<double>"), group="g", limit=2).collect()
    assert [r["id"] for r in sorted(picks, key=lambda r: r["pick"])] == [1, 3]
    turns = spark.createDataFrame([(1, 0, "user", "aaaa"), (1, 1, "assistant", "bb"), (1, 2, "user", "c")], "conv_id long, turn long, role string, text string")
    assert sorted(r["turn"] for r in conversations.history(turns, 3).collect()) == [1, 2]
    assert value(spark, conversations.surface_flags(F.lit("no no no"))) == ["unfinished", "lowercase_start", "token_loop"]
