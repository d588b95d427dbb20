"""Cases that once went wrong."""

from __future__ import annotations

import numpy as np

from lexstrata.llm import decontaminate, langid, lm_scoring, quality, warc
from lexstrata.llm import bytetext as bt

from .helpers import documents
from .test_operators import brute_contamination, prose


def test_cuts_leave_nothing_to_match_across_the_seam(spark):
    first = [f"a{i}" for i in range(10)]
    items = [(1, " ".join(first)), (2, " ".join(f"b{i}" for i in range(10)))]
    filler = " ".join(f"w{i}" for i in range(60))
    text = f"{filler} {' '.join(first[:5])} {items[1][1]} {' '.join(first[5:])} end"
    got = decontaminate.clean(documents(spark, [(1, text)]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == 1 and brute_contamination([(1, got[0]["text"])], items)[0][2] == 0
    assert got[0]["text"].startswith(filler) and got[0]["text"].rstrip().endswith("end") and got[0]["n_chars"] == len(got[0]["text"])


def test_record_ids_come_back_whole(spark):
    ids = ["a:1", "b:1", "null", None, "x y+%2F/é", ""]
    pages = spark.createDataFrame([(i, "u", f"<p>{k}</p>") for k, i in enumerate(ids)] + [("c:9", "u", "<p>0</p>")], "page_id string, url string, html string")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark, pages).collect()}
    assert got == {(i, "response", None) for i in ids} | {("c:9", "revisit", "a:1")}


def test_temperature_has_an_optimum():
    r = np.random.default_rng(1)
    classes = r.integers(0, 3, 200)
    sure = np.eye(3)[classes] * 5
    t = langid.calibrate(sure, classes)
    assert 0.05 < t < 5
    noisy = sure + r.normal(size=(200, 3)) * 4
    losses = [-np.log(langid.softmax(noisy / x)[np.arange(200), classes]).mean() for x in (langid.calibrate(noisy, classes), 0.3, 30.0)]
    assert losses[0] == min(losses)


def test_ftrl_equals_a_plain_version():
    r = np.random.default_rng(2)
    examples = [(np.unique(r.integers(0, 40, 6)), None, int(r.integers(0, 3))) for _ in range(30)]
    examples = [(at, r.random(len(at)), y) for at, _, y in examples]
    w, bias = langid.train_ftrl(examples, 3, epochs=2)
    z, n = {}, {}

    def weight(i, k, alpha=4.0, beta=1.0, l1=0.002, l2=0.01):
        zi, ni = z.get((i, k), 0.0), n.get((i, k), 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((beta + ni**0.5) / alpha + l2)

    rng = np.random.default_rng(7)
    for _ in range(2):
        for e in rng.permutation(len(examples)):
            at, x, y = examples[e]
            terms = [*zip(at.tolist(), x.tolist(), strict=True), ("bias", 1.0)]
            own = {(i, k): weight(i, k) for i, _ in terms for k in range(3)}
            logits = np.array([sum(v * own[i, k] for i, v in terms) for k in range(3)])
            p = np.exp(logits - logits.max())
            p /= p.sum()
            for i, v in terms:
                for k in range(3):
                    g, before = v * (p[k] - (k == y)), n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / 4.0 * own[i, k]
                    n[i, k] = before + g * g
    assert np.allclose(bias, [weight("bias", k) for k in range(3)])
    assert all(np.allclose(w[i], [weight(i, k) for k in range(3)]) for i in range(40))


def test_document_frequencies_count_texts(spark):
    texts = ["abc abc", "abc", "", "xyz" * 50]
    df, n = langid.document_frequencies(documents(spark, list(enumerate(texts))).select("text"))
    want = np.zeros(langid.BUCKETS, np.int64)
    for t in texts:
        points, offsets = langid.characters(next(iter(bt.chunks(__import__("pyarrow").array([t], "large_string")))))
        want[np.unique(np.concatenate([langid.buckets(points, offsets, o)[0] for o in langid.ORDERS]))] += 1
    assert n == 4 and (df == want).all()


def test_a_model_of_four_words_is_the_sum_of_a_walk(spark):
    """Orders above three: the score never falls when longer contexts that were seen often are added, and ties keep all."""
    docs = [(i, "one two three four five six") for i in range(40)] + [(90 + i, prose(i, 20)) for i in range(10)]
    scores = [{r["doc_id"]: r["score"] for r in lm_scoring.score(documents(spark, docs), order=n).collect()} for n in (2, 3, 4)]
    assert scores[2][1] > scores[1][1] > scores[0][1] and len(scores[2]) == 50


def test_shards_do_not_change_a_probability(spark, monkeypatch):
    texts = documents(spark, [(i, prose(i, 30)) for i in range(40)]).select("text")
    one = quality.train(texts)
    monkeypatch.setattr(quality, "SHARD_ROWS", 200)
    many = quality.train(texts)
    assert len(one.shards) == 1 and len(many.shards) > 4
    (chunk,) = bt.chunks(__import__("pyarrow").array([prose(3, 30), prose(99, 50)], "large_string"))
    t, _, at = quality.padded(chunk)
    assert np.allclose(one.log_probability(t, at), many.log_probability(t, at))
