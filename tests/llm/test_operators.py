from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexstrata.llm import bytetext as bt
from lexstrata.llm import decontaminate, graph, langid, licenses, lm_scoring, minmax, pieces, quality, token_rollup, vectors, warc
from lexstrata.llm.cluster import fresh_path

from .helpers import DDL, alnum_words, components, documents, plain_words, with_clashes

WORDS = ["the", "of", "and", "to", "in", "über", "naïve", "tree", "house", "river", "blue", "seven", "stone", "light", "Ωmega", "x1", "y2", "run", "walk", "sing"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (4, "One"), (None, "no id here"), (5, "x " * 30_000), (6, "!?!  ..."), (7, "ÄÖÜ straße 東京 🙂")]


def test_words_and_hashes():
    texts = ["A b  C", "", "é-x", "ab"]
    (chunk,) = bt.chunks(pa.array(texts, pa.large_string()))
    lowered = chunk.lowered()
    starts, ends, row = lowered.words(bt.ALNUM)
    assert [lowered.buf[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == ["a", "b", "c", "é", "x", "ab"]
    assert row.tolist() == [0, 0, 0, 2, 2, 3]
    h = lowered.hashes(starts, ends)
    assert int(h[0]) == bt.text_hash("a") and len(set(h.tolist())) == 6
    long = "z" * (3 << 20)
    parts = list(bt.chunks(pa.array(["a", long, "b"], pa.large_string())))
    assert sum(c.rows for c in parts) == 3


# -- decontamination


def brute_contamination(docs, items, window=10):
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = alnum_words(text)
        if item is None or not w:
            continue
        n = min(window, len(w))
        for k in range(len(w) - n + 1):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if g := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= g
        out.append((doc, len(w), len(hit), len(found), decontaminate.digest([str(x) for x in found]), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_equals_brute_force(spark):
    items = [(1, prose(1, 40)), (2, prose(2, 12)), (3, "seven blue"), (4, "river"), (5, None), (6, ""), (None, prose(3, 20)), (7, prose(1, 25))]
    docs = [*EDGE, (20, "start " + prose(1, 15) + " end " + prose(2, 12)), (21, prose(1, 9)), (22, "Seven BLUE stones"), (23, prose(9, 400)), (24, prose(1, 40) * 2)]
    got = decontaminate.report(with_clashes(documents(spark, docs)), spark.createDataFrame(items, "item_id long, text string")).drop("longest_match").collect()
    assert sorted(map(tuple, got), key=str) == brute_contamination(docs, items)


def test_decontamination_cuts_spans_and_drops_covered_documents(spark):
    item = prose(5, 20)
    docs = with_clashes(documents(spark, [(1, "before it " + " ".join(["w%d" % i for i in range(30)]) + " " + item + " after"), (2, item), (3, None), (4, "clean text")]))
    got = {r["doc_id"]: r for r in decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 3, 4} and got[3]["text"] is None and got[4]["text"] == "clean text"
    assert "before it" in got[1]["text"] and got[1]["text"].rstrip(".").endswith("after") and got[1]["n_chars"] == len(got[1]["text"])
    assert brute_contamination([(1, got[1]["text"])], [(1, item)])[0][2] == 0


def test_decontamination_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 8)
    items = [(i, prose(i, 14)) for i in range(12)]
    docs = [(i, prose(100 + i, 20) + " " + prose(i, 14)) for i in range(12)]
    got = decontaminate.report(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).drop("longest_match").collect()
    assert sorted(map(tuple, got), key=str) == brute_contamination(docs, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DDL)
    items, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert decontaminate.report(none, items).count() == 0
    assert decontaminate.report(documents(spark, EDGE), items).where("contaminated").count() == 0
    assert minmax.report(none).count() == 0
    assert langid.report(none).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in langid.report(documents(spark, [(3, "hello", None)])).collect()} == {("und", 0.0)}
    assert lm_scoring.score(none).count() == 0
    assert quality.report(none, labels).count() == 0
    assert pieces.report(none).count() == 0
    assert licenses.report(none).count() == 0
    assert vectors.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert token_rollup.report(spark, none, labels).count() == 0


# -- near-duplicates


def brute_sets(docs, size):
    out = {}
    for doc, text in docs:
        w = plain_words(text)
        out[doc] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    return out


def test_minmax_equals_brute_force(spark):
    docs = [x for x in EDGE if x[0] is not None]
    base = prose(7, 300).split(" ")
    for i in range(40):  # near copies, some of which are linked only through others
        w = list(base)
        for k in range(i // 2):
            w[k * 7] = f"new{i // 4}"
        docs.append((100 + i, " ".join(w)))
    docs += [(200 + i, prose(50 + i, 60)) for i in range(20)] + [(300 + i, prose(50, 60)) for i in range(5)]
    sets = brute_sets(docs, 3)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = components(sets, links)
    got = minmax.report(with_clashes(documents(spark, [*docs, (None, "no id here")]))).collect()
    assert len(got) == len(docs) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])


def test_minmax_compares_the_rest_of_a_bucket_in_blocks(monkeypatch):
    """Members that the smallest id isn't linked to are still linked among themselves, in one block and across two."""
    import pandas as pd

    a, b = np.arange(100), np.arange(1000, 1100)
    rows = [(0, 100, a), (1, 100, b), (2, 100, np.append(b[:-2], [1, 2])), (3, 60, a[:60])]
    for blocks, where in ((0, [0, 0, 0, 0]), (1, [0, 0, 1, 1])):
        group = pd.DataFrame({"band": 1, "i": 0, "j": blocks, "id": [r[0] for r in rows], "n": [r[1] for r in rows], "block": where, "component": [r[0] for r in rows], "grams": [np.sort(r[2]) for r in rows]})
        out = minmax._verify_block(80)(group)
        assert sorted(map(sorted, out[["u", "v"]].to_numpy().tolist())) == [[1, 2]]


def test_min_and_max_estimate_similarity():
    r = np.random.default_rng(3)
    v = r.integers(0, 2**53, 3000, dtype=np.int64).astype(np.uint64)
    x, y = v[:2000], v[500:2500]
    s = minmax.min_max(np.concatenate([x, y]), np.array([0, 2000]), 400)
    assert abs((s[0] == s[1]).mean() - 1500 / 2500) < 0.06


def test_keep_one_keeps_all_columns(spark):
    docs = with_clashes(documents(spark, [(1, prose(1, 80)), (2, prose(1, 80)), (3, prose(2, 80)), (4, None), (5, "")]))
    out = minmax.keep_one(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4, 5]


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 160), 100)}


def brute_links(rows, least=0.93):
    links = set()
    fine = [(i, np.array(v, float), label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for n, (i, v, a) in enumerate(fine):
        for j, w, b in fine[n + 1 :]:
            if a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= least:
                links.add((i, j))
    return links


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_MOST", 64)
    monkeypatch.setattr(vectors, "CELL_AIM", 16)
    r = np.random.default_rng(5)
    rows = []
    for c in range(40):
        center = r.normal(size=16)
        for _ in range(120 if c == 0 else 4):  # one group is larger than a cell
            rows.append((len(rows), (center + 0.25 * r.normal(size=16)).tolist(), c % 2))
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [1.0] * 16, None), (n + 4, [], 1), (n + 5, [None] + [1.0] * 15, 1), (n + 6, [1.0, 2.0], 1), (n + 7, rows[0][1], 0), (n + 8, rows[0][1], 0)]
    links = brute_links(rows)
    root = components([x[0] for x in rows], links)
    found = vectors.clusters(with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))).collect()
    assert len(found) == len(rows)
    count = {i: sum(i in x for x in links) for i, _, _ in rows}
    wrong = [x for x in found if (x["n_links"], x["component_id"], x["kept"]) != (count[x["vec_id"]], root[x["vec_id"]], root[x["vec_id"]] == x["vec_id"])]
    assert len(wrong) <= 0.02 * len(rows)
    assert all(x["n_links"] <= count[x["vec_id"]] for x in found)


def test_pruned_graph_misses_nothing_within_a_cell():
    r = np.random.default_rng(8)
    v = np.concatenate([r.normal(size=(200, 8)), np.repeat(r.normal(size=(5, 8)), 20, axis=0)])
    v[200:] += 0.1 * r.normal(size=(100, 8)) * (np.arange(100)[:, None] % 3 > 0)
    s = vectors.cosines(v, v)
    assert (vectors.range_search(s, vectors.prune(s), 0.93) == (s >= 0.93)).all()


# -- pieces


def test_pieces_equal_the_library_and_round_trip(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    r = random.Random(4)
    texts = ["", "  two  blanks \n\ttab", "▁mark ▁▁ x", "a" * 300, "   " * 50 + "x   y" * 20, "日本語テキスト naïve 🙂🙃", "def f(x):\n        return x**2  # note\n" * 9, prose(1, 3000)]
    texts += ["".join(r.choice("abcdeghinorst ABC012.,;:!?()-_éüß\n") for _ in range(r.randrange(1, 120))) for _ in range(400)]
    docs = documents(spark, [(i, t) for i, t in enumerate(texts)] + [(9999, None)])
    got = {x["doc_id"]: x for x in pieces.report(with_clashes(docs)).collect()}
    assert got[9999]["n_pieces"] == 0 and all(x["round_trip"] for x in got.values())
    for i, t in enumerate(texts):
        assert got[i]["pieces"] == library.encode(t), t[:60]
    back = {x["doc_id"]: x["text"] for x in pieces.decode(pieces.report(docs)).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in enumerate(texts))


def test_unigram_pieces_have_the_best_sum():
    vocabulary = {"▁": -3.0, "a": -2.0, "b": -2.1, "c": -2.5, "ab": -2.6, "bc": -3.0, "abc": -5.5, "▁a": -2.2, "▁ab": -4.0, "ca": -3.3}
    model = pieces.PieceModel(["<unk>", *vocabulary], [0.0, *vocabulary.values()], ["unknown", *["normal"] * len(vocabulary)], merges=False)

    def best(text):
        if not text:
            return 0.0
        return max(vocabulary[text[:n]] + best(text[n:]) for n in range(1, 4) if text[:n] in vocabulary)

    r = random.Random(2)
    texts = ["".join(r.choice("abc ") for _ in range(r.randrange(1, 14))) for _ in range(200)]
    (chunk,) = bt.chunks(pa.array(texts, pa.large_string()))
    ids, at = model.encode(chunk)
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]]
        assert abs(model.scores[own].sum() - best("▁" + t.replace(" ", "▁"))) < 1e-9


# -- scores


def test_lm_scores_equal_the_formulas(spark):
    docs = [(i, prose(i, 30 + i % 7)) for i in range(60)] + [(100, None), (101, ""), (102, "unheard words only"), (103, "the " * 20_000)]
    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1]
    counts: dict[bytes, int] = {}
    for t in train:
        for w in [*plain_words(t), b"\0end"]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for bounds in ({}, {"head_words": 6, "context_words": 4, "arcs": 50}):
        got = {r["doc_id"]: r for r in lm_scoring.score(with_clashes(documents(spark, docs)), **bounds).collect()}
        for i, t in docs:
            w = [*plain_words(t), b"\0end"]
            base = sum(np.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(x in counts for x in w), n)
            assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] <= 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_automaton_is_a_probability_model_and_the_traversal_a_walk():
    r = np.random.default_rng(1)
    hashes = np.sort(r.integers(1, 2**60, 30).astype(np.uint64))
    text = hashes[r.integers(0, 30, 4000) % r.integers(1, 31, 4000)]
    row = np.zeros(4000, np.int64)
    keys, counts = np.unique(text, return_counts=True)
    model = lm_scoring.Automaton(keys, counts, int(counts.sum()), len(keys), 20)
    for level in (1, 2):
        context = model.contexts(text)
        state = model.states(context, row, level)
        on = np.flatnonzero((state[:-1] >= 0) & (context[1:] >= 0)) + 1
        k, c = np.unique(state[on - 1] << lm_scoring.SHIFT | context[on], return_counts=True)
        model.add_level(k[c >= 2], c[c >= 2], 0.6)
    weight, head = model.traverse(text, row)
    # the same by a literal walk with failure arcs
    bigrams, trigrams = (dict(zip(x[0].tolist(), zip(range(len(x[0])), x[1], strict=True), strict=True)) for x in model.levels)
    context = model.contexts(text).tolist()
    one = two = -1
    for i, w in enumerate(context):
        total, place = 0.0, None
        if two >= 0:
            hit = trigrams.get(two << lm_scoring.SHIFT | w) if w >= 0 else None
            place = hit and hit[1]
            total += 0 if hit else model.levels[1][2][two]
        if place is None and one >= 0:
            hit = bigrams.get(one << lm_scoring.SHIFT | w) if w >= 0 else None
            place = hit and hit[1]
            total += 0 if hit else model.levels[0][2][one]
        total += model.root[head[i]] if place is None else place
        assert abs(total - weight[i]) < 1e-9
        two = bigrams.get(one << lm_scoring.SHIFT | w, (-1,))[0] if one >= 0 and w >= 0 else -1
        one = w
    # after any context the probabilities of all words and the unknown one sum to one
    unknown = 0.5 / model.denominator
    for s in range(len(model.context_hashes)):
        p = 10 ** model._step(1, np.full(len(model.context_hashes), s), np.arange(len(model.context_hashes)))
        rest = np.setdiff1d(np.arange(len(model.hashes)), np.flatnonzero(model.context_of >= 0))
        tail = (10 ** model.root[rest]).sum() + unknown
        assert abs(p.sum() + 10 ** model.levels[0][2][s] * tail - 1) < 1e-6


def test_languages_are_told_apart(spark):
    rows = [(i, " ".join(random.Random(i).choices(["der", "die", "und", "nicht", "haus", "straße"], k=20)), "de") for i in range(60)]
    rows += [(i, " ".join(random.Random(i).choices(["the", "and", "not", "house", "street"], k=20)), "en") for i in range(100, 160)]
    rows += [(900, None, "de"), (901, "", "en"), (902, "123 !!", "en"), (903, "das haus und die straße " * 3000, None), (None, "the house", "en")]
    got = {r["doc_id"]: r for r in langid.report(with_clashes(documents(spark, rows))).collect()}
    assert len(got) == len(rows) and got[903]["lang_pred"] == "de"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(got[i]["lang_pred"] == lang for i, t, lang in rows if i is not None and i < 900)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    kept = langid.keep_known(with_clashes(documents(spark, rows)))
    assert "lang_pred" in kept.columns and {r["doc_id"] for r in kept.collect()} >= {i for i, _, _ in rows if i is not None and i < 900}
    assert {900, 901, 902}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_quality_rejects_junk_and_keeps_prose(spark):
    r = random.Random(6)
    good = [(i, prose(i, 60)) for i in range(200)]
    junk = [(1000 + i, " ".join(f"{r.choice(WORDS)}{r.choice(['%%%', '###', '***'])} qz{r.randrange(10**6)}" for _ in range(40))) for i in range(30)]
    rows = [*good, *junk, (2000, None), (2001, ""), (None, prose(3, 40)), (2002, prose(9, 40_000))]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(5, 1, 0)] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int")
    docs = with_clashes(documents(spark, rows))
    got = {x["doc_id"]: x for x in quality.report(docs, labels).collect()}
    assert not any(got[i]["accepted"] for i, _ in junk) and sum(got[i]["accepted"] for i, _ in good) >= 0.97 * len(good)
    assert got[2000]["accepted"] and got[2000]["perplexity"] is None and got[2001]["n_tokens"] == 0 and got[2002]["accepted"] and got[None]["accepted"]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {i for i, x in got.items() if x["accepted"]}


def test_kneser_ney_equals_brute_force(spark):
    texts = [prose(i, 25) for i in range(30)]
    model = quality.train(documents(spark, [(i, t) for i, t in enumerate(texts)]).select("text"))
    tokens = []
    for t in texts:
        (chunk,) = bt.chunks(pa.array([t], pa.large_string()))
        tokens.append(["<s>", "<s>", *map(int, quality.tokens(chunk)[0])])
    full: dict[int, dict] = {3: {}, 2: {}, 1: {}}
    for t in tokens:
        for i in range(2, len(t)):
            full[3][tuple(t[i - 2 : i + 1])] = full[3].get(tuple(t[i - 2 : i + 1]), 0) + 1
    for n in (2, 1):
        for g in full[n + 1]:
            full[n][g[1:]] = full[n].get(g[1:], 0) + 1

    def probability(g):
        p = 1 / (len(full[1]) + 1)
        for n in (1, 2, 3):
            c = full[n]
            k = [sum(x == i for x in c.values()) for i in range(5)]
            y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0.5
            d = [0] + [min(max(i - (i + 1) * y * (k[i + 1] / k[i] if k[i] else 1.0), 0.1), i - 0.05) for i in (1, 2, 3)]
            same = {x: v for x, v in c.items() if x[:-1] == g[3 - n : 2]}
            if same:
                total, own = sum(same.values()), same.get(g[3 - n :], 0)
                p = (max(own - d[min(own, 3)], 0) if own else 0) / total + sum(d[min(v, 3)] for v in same.values()) / total * p
        return p

    (chunk,) = bt.chunks(pa.array([texts[3] + " unheard river the"], pa.large_string()))
    t, _, at = quality.padded(chunk)
    seen = ["<s>", "<s>", *map(int, t[2:])]
    want = [np.log(probability(tuple(seen[i - 2 : i + 1]))) for i in range(2, len(seen))]
    assert np.allclose(model.log_probability(t, at), want, atol=1e-4)


# -- archives, licenses, rollups


def test_archives_come_back_whole(spark):
    long = "".join(random.Random(1).choices("abc <p>é\n", k=3_000_000))
    pages = [(3, "http://a/x y\r\nZ", "<p>same</p>"), (1, "http://a", "<p>same</p>"), (2, None, None), (9, "u", ""), (4, "u", long), (5, "u", "WARC/1.1\r\n\r\n" * 50), (5, "u", "WARC/1.1\r\n\r\n" * 50), (None, "u", "<p>same</p>"), (7, "u", "東京")]
    pages += [(100 + i, f"http://b/{i}", f"<html><body>{prose(i, 120)}</body></html>") for i in range(60)]
    df = with_clashes(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = warc.round_trip(spark, df).collect()
    first: dict[str, int] = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = [(i, len((h or "").encode()), warc.sha1_base32((h or "").encode()), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""], None) for i, _, h in pages]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    manifest = warc.write_archives(df, fresh_path(spark, "warc"))
    back = {(r["record_id"], r["payload"] and bytes(r["payload"]).decode()) for r in warc.read_archives(manifest).where("record_type = 'response'").collect()}
    assert ("urn:page:4", long) in back and ("urn:page:7", "東京") in back


def test_archives_with_faults_are_told():
    good = warc.record_bytes("urn:page:1", "http://a", b"payload", "2024-01-01T00:00:00Z", None)
    assert warc.parse_record(good)["error"] is None
    assert "trailer" in warc.parse_record(good[:-4] + b"xxxx")["error"] or "length" in warc.parse_record(good[:-4] + b"xxxx")["error"]
    assert "digest" in warc.parse_record(good.replace(b"payload\r\n", b"paYload\r\n"))["error"]
    assert "length" in warc.parse_record(good + b"x")["error"]
    assert "version" in warc.parse_record(b"HTTP/1.1 200")["error"]
    assert "missing" in warc.parse_record(good.replace(b"WARC-Date", b"X-Date"))["error"]


def test_skippable_dictionary_frame(tmp_path):
    import zstandard

    samples = [f"<html>{prose(i, 80)}</html>".encode() for i in range(200)]
    dictionary = zstandard.train_dictionary(4096, samples).as_bytes()
    writer = warc.ArchiveWriter(f"file://{tmp_path}", dictionary)
    records = [warc.record_bytes(f"urn:page:{i}", "u", s, "2024-01-01T00:00:00Z", None) for i, s in enumerate(samples)]
    for r in records:
        writer.add(r)
    path, count = writer.close()
    with open(path.removeprefix("file://"), "rb") as f:
        head = f.read(4)
        f.seek(0)
        assert int.from_bytes(head, "little") == warc.SKIPPABLE_MAGIC and count == len(records) and list(warc._frames(f)) == records
        f.seek(0)
        import io

        with pytest.raises(ValueError, match="truncated"):
            list(warc._frames(io.BytesIO(f.read()[:-5])))


def brute_phrases(text):
    w, places, labels = alnum_words(text), [], set()
    for label, phrase in licenses.PHRASES.items():
        p = [x.encode() for x in phrase]
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += found
        if found:
            labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    docs = [*EDGE, (20, gpl), (21, "text. Released under the MIT License. CC BY cc-by"), (22, "Permission is hereby granted, free of charge, to any person also obtaining a copy of this software and associated documentation files"), (23, "All rights  reserved. ALL RIGHTS RESERVED"), (24, ("filler words here " * 9000) + "Licensed under the Apache License, Version 2.0."), (25, "this work is licensed under nothing"), (26, (gpl + " ") * 300)]
    got = licenses.report(with_clashes(documents(spark, docs))).collect()
    assert len(got) == len(docs)
    want = {i: brute_phrases(t) for i, t in docs}
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want[r["doc_id"]]
        assert 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[20] == labels[26] == "gpl,gpl-3.0" and labels[21] == "cc-by,mit" and labels[23] == "reserved" and labels[24] == "apache-2.0" and labels[25] == "" and labels[22] == "mit"


def test_rollup_is_exact_and_idempotent(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    docs = [*EDGE, *[(100 + i, prose(i, 20 + i)) for i in range(20)]]
    df = documents(spark, docs)
    rollup = token_rollup.TokenRollup(spark, fresh_path(spark, "rollup"))
    assert rollup.commit("a", token_rollup.count_tokens(with_clashes(df)))
    assert not rollup.commit("a", token_rollup.count_tokens(df))
    totals = lambda: {tuple(r[:3]): tuple(r[3:]) for r in rollup.totals().select("source", "lang", "tokenizer", "n_docs", "n_tokens").collect()}
    known = {i: t for i, t in docs if i is not None}
    assert totals() == {("s", "en", token_rollup.WORDS): (len(known), sum(len(alnum_words(t)) for t in known.values())), ("s", "en", token_rollup.PIECES): (len(known), sum(len(library.encode(t or "")) for t in known.values()))}
    before = totals()
    row = lambda i, n, version, alive=True, source="s": (i, token_rollup.WORDS, source, "en", n, version, alive)
    changes = [row(4, 50, 1), row(4, 70, 2), row(100, None, 1, False), row(101, 9, 1, True, None), row(999, 5, 1), row(998, None, 1, False), row(None, 5, 1), row(7, 1000, 0)]
    rollup.commit("b", spark.createDataFrame(changes, "doc_id long, tokenizer string, source string, lang string, n_tokens long, version long, alive boolean"))
    n, tokens = before[("s", "en", token_rollup.WORDS)]
    after = totals()
    assert after[("s", "en", token_rollup.WORDS)] == (n - 2 + 1, tokens - 1 + 70 - len(alnum_words(known[100])) - len(alnum_words(known[101])) + 5)
    assert after[(None, "en", token_rollup.WORDS)] == (1, 9)
    assert rollup.batches() == ["a", "b"]
    assert not rollup.commit("b", spark.createDataFrame(changes[:1], "doc_id long, tokenizer string, source string, lang string, n_tokens long, version long, alive boolean")) and totals() == after
