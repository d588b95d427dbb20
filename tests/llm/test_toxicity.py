"""Positive-unlabelled learning: the risk and its slope against plain versions, held-out accuracy, and all kinds of rows."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from lexstrata.llm import bytetext as bt
from lexstrata.llm import toxicity
from lexstrata.llm.registry import queries

from .helpers import documents, with_clashes
from .test_operators import prose


def test_risk_and_slope_equal_the_plain_estimate():
    rng = np.random.default_rng(2)
    softplus = lambda x: math.log1p(math.exp(x))
    for prior, shift in ((0.1, 0.0), (0.4, 2.0), (0.4, -3.0)):
        g, positive = rng.normal(shift, 2, 40), np.arange(40) < 15
        g[15:] -= shift
        plain = prior * sum(softplus(-x) for x in g[:15]) / 15, sum(softplus(x) for x in g[15:]) / 25 - prior * sum(softplus(x) for x in g[:15]) / 15
        assert np.allclose(toxicity.risk(g, positive, prior), plain)
        follows = (lambda x: sum(toxicity.risk(x, positive, prior))) if plain[1] >= 0 else (lambda x: -toxicity.risk(x, positive, prior)[1])
        for i in (0, 7, 15, 39):
            up, down = g.copy(), g.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            assert abs((follows(up) - follows(down)) / 2e-6 - toxicity.slope(g, positive, prior)[i]) < 1e-6
    assert any(toxicity.risk(np.array([9.0, -9.0]), np.array([True, False]), p)[1] < 0 for p in (0.1, 0.5))


def test_scores_equal_plain_sums():
    texts = ["You IDIOT, you", "", "été idiotic x", "a b c d e f g idiot"]
    raw = [t.encode() for t in texts]
    chunk = bt.Chunk(0, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    weights = np.random.default_rng(1).normal(size=toxicity.BUCKETS)
    got = toxicity.Model(weights, -1.5).scores(chunk)
    bucket = lambda h: int(bt.mix(np.array([h], np.uint64))[0]) >> 46
    for text, score in zip(texts, got, strict=True):
        words = [w.encode() for w in text.lower().replace(",", "").split(" ") if w]
        total = sum(weights[bucket(bt.text_hash(w))] + sum(weights[bucket((bt.text_hash(w[:n]) + n) % 2**64)] for n in range(3, 9) if len(w) >= n) for w in words)
        assert abs(score - 1 / (1 + math.exp(1.5 - 20 * total / (len(words) + 10)))) < 1e-5


def planted(rows=500):
    bad = ["vile", "Rotten", "filth", "dégoût"]
    out, marks = [], []
    for i in range(rows):
        text, toxic = prose(i, 40 + i % 90), int(i % 8 == 0)
        if toxic:
            text = " ".join(w + (f" {bad[(i + k) % 4]}" if k % 15 == i % 11 else "") for k, w in enumerate(text.split(" ")))
        out.append((i, text))
        marks.append((i, 1, toxic))
    return out, marks


def test_held_out_texts(spark):
    docs, marks = planted()
    extra = [(9000, None), (9001, ""), (9002, "!!"), (9003, "vile"), (9004, prose(9004, 20_000)), (None, "vile rotten filth"), (3, docs[3][1])]
    labels = spark.createDataFrame([m for m in marks if m[0] % 3], "doc_id long, quality int, toxic int")
    labels = labels.union(spark.createDataFrame([(None, 1, 1), (2, 1, None), (7, 0, None)], labels.schema))
    got = toxicity.report(with_clashes(documents(spark, docs + extra)), with_clashes(labels)).collect()
    assert len(got) == len(docs) + len(extra)
    score = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [m for m in marks if score[m[0]]["held_out"]]
    assert sum(m[2] for m in held) > 10
    assert sum(score[m[0]]["predicted"] == m[2] for m in held) >= 0.97 * len(held)
    assert all(score[i]["predicted"] == 0 for i in (9000, 9001, 9002, 9004)) and score[None]["predicted"] == 1
    assert score[9000]["score"] == score[9001]["score"] == score[9002]["score"]


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["score"] < 1e-9 and r["predicted"] == 0 for r in toxicity.report(docs, none).collect())
    few = spark.createDataFrame([(1, 1, 1), (4, 1, 0), (5, 1, 0), (77, 1, 0)], none.schema)
    assert len({r["score"] for r in toxicity.report(docs, few).collect()}) == 1
    assert toxicity.report(docs.limit(0), few).collect() == []


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_finds_held_out_toxic_documents(spark, sf):
    folder = f"/root/testdata/{sf}"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(r["predicted"], toxic[r["doc_id"]]) for r in queries()["op11_toxicity"](spark, folder).where("held_out").collect() if r["doc_id"] in toxic]
    hit = sum(p and t for p, t in rows)
    assert hit >= 0.85 * sum(t for _, t in rows) and sum(p and not t for p, t in rows) <= 0.05 * len(rows)
