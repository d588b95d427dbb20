"""Operators on inputs beyond their former caps, against brute force."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd

from lexstrata.llm import lm_scoring, minmax, quality

from .helpers import documents, plain_words
from .test_operators import prose


def test_lm_scores_do_not_depend_on_the_caches(spark):
    docs = [(i, prose(i, 30 + i % 7) + f" only{i // 2} once{i}") for i in range(60)] + [(100, None), (101, "unheard words only")]
    words = {i: [*plain_words(t), b"\0end"] for i, t in docs}
    train = [w for i, w in words.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    grams = [Counter(tuple(w[i : i + n]) for w in train for i in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total, distinct = sum(grams[0].values()), len(grams[0])
    discounts = [None]
    for n in (1, 2):
        lower = grams[n - 1]
        once = sum(c == 1 and (n == 1 or lower[g[:-1]] > 1 and lower[g[1:]] > 1) for g, c in grams[n].items())
        twice = sum(c == 2 for c in grams[n].values())
        discounts.append(once / (once + 2 * twice))

    def p(gram):
        n = len(gram) - 1
        if n == 0:
            return (grams[0][gram] + 0.5) / (total + 0.5 * (distinct + 1))
        context, lower = gram[:-1], p(gram[1:])
        if grams[n - 1][context] < 2:
            return lower
        arcs = [c for g, c in grams[n].items() if g[:-1] == context and c > 1]
        left = 1 - sum(c - discounts[n] for c in arcs) / grams[n - 1][context]
        c = grams[n][gram]
        return (c - discounts[n]) / grams[n - 1][context] * (c > 1) + left * lower

    want = {i: sum(np.log10(p(tuple(w[max(0, k - 2) : k + 1]))) for k in range(len(w))) for i, w in words.items()}
    for bounds in ({}, {"head_words": 6, "context_words": 4, "arcs": 50}, {"head_words": 6, "arcs": 50, "filter_bits": 15}):
        got = {r["doc_id"]: r["score"] for r in lm_scoring.score(documents(spark, docs), **bounds).collect()}
        assert all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_quality_rejects_repeats_and_toxic_passages(spark):
    abuse = ["vile", "rotten", "filthy"]
    good = [(i, prose(i, 80)) for i in range(200)]
    toxic = [(500 + i, " ".join(w + (" " + abuse[k % 3] if k % 20 == i % 7 else "") for k, w in enumerate(prose(500 + i, 80).split(" ")))) for i in range(40)]
    repeats = [(800, "the the the the " * 20), (801, prose(801, 200) + " of and to the" * 40)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 1, 1) for i, _ in toxic[:20]], "doc_id long, quality int, toxic int")
    docs = documents(spark, [*good, *toxic, *repeats, (900, prose(900, 5000))])
    got = {x["doc_id"]: x["accepted"] for x in quality.report(docs, labels).collect()}
    assert not any(got[i] for i, _ in [*toxic, *repeats])
    assert sum(got[i] for i, _ in good) >= 0.97 * len(good) and got[900]
    assert {x["doc_id"] for x in quality.keep_good(docs, labels).collect()} == {i for i, x in got.items() if x}


def test_minmax_links_all_rows_of_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(100)) for x in "abcd")
    near = lambda t: t + " end"
    docs = [(1, a), (1, b), (2, near(a)), (2, near(a)), (3, near(b)), (3, near(b)), (14, c), (15, c), (15, d), (16, near(d)), (20, "alone here"), (20, "alone here")]
    got = minmax.report(documents(spark, docs)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, 1 if i < 4 else 14 if i < 17 else 20) for i, _ in docs)
    first, second = np.arange(100), np.arange(500, 600)
    rows = [(7, 100, 0, 7, first), (7, 100, 0, 7, second), (9, 100, 0, 9, second + (second == 599))]
    group = pd.DataFrame(rows, columns=["id", "n", "block", "component", "grams"]).assign(band=0, i=0, j=0)
    assert minmax._verify_block(80)(group).values.tolist() == [[7, 9]]
