"""Toxicity by non-negative positive-unlabelled learning.

Positive are texts that ``labels`` confirms as toxic; all other texts, whatever their label, are unlabelled. The risk of a
classifier g is estimated as ``prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])``: the unlabelled
texts hold toxic ones in the share ``prior``, whose part is taken off, and where that difference falls below zero (the model
begins to learn the unlabelled texts by heart) a step is taken against it instead. The prior is the share of toxic documents
among the labelled ones that may be learned from.

A text is a bag of features: each word (a run of letters and digits, A-Z lower-cased) and its first 3 to 8 bytes, hashed to
``BUCKETS``; a feature's value is its rate among the words, so length alone says nothing. All texts that may be learned from
are counted: rates of every bucket in toxic and in unlabelled texts. The classifier takes the ``FEATURES`` buckets at most
that are markedly more frequent in toxic texts; it is fitted by numpy on a sample of at most
``POSITIVE`` toxic and ``UNLABELLED`` other texts, by hash of the id, of which only the values of these features travel.

Defined results: null and empty texts have no words and score as the bias alone; a document with several labels is toxic if
one of them says so; rows without id are held out; repeated ids are scored row by row; without toxic texts to learn from, or
without any feature, every score is the prior (0 where there are no labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .blocks import thin
from .cluster import add_columns, crc_mod, dropped, picked, stored, text_rows

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
BITS = 18
BUCKETS = 1 << BITS
PREFIXES = range(3, 9)
FEATURES = 4096
POSITIVE, UNLABELLED = 4000, 12_000
#: A feature stands in this many toxic texts at least, at this many times its rate in unlabelled texts.
LEAST_TEXTS, LEAST_RATIO = 3, 2.0
#: Words that are added to a text's length: rates of very short texts are less certain.
SMOOTH = 10.0
SCALE = 20.0


def features(chunk: bt.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the row of each, and the words of each row."""
    low = chunk.lowered()
    starts, ends, row = low.words(bt.ALNUM)
    size = ends - starts
    parts, rows = [low.hashes(starts, ends)], [row]
    for n in PREFIXES:
        on = size >= n
        parts.append(low.hashes(starts[on], starts[on] + n) + np.uint64(n))
        rows.append(row[on])
    h = bt.mix(np.concatenate(parts))
    return (h >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows), np.bincount(row, minlength=chunk.rows)


class Model:
    """Weights by bucket (those of buckets that are no feature are 0) and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def scores(self, chunk: bt.Chunk) -> np.ndarray:
        b, row, words = features(chunk)
        return sigmoid(self.bias + SCALE * np.bincount(row, self.weights[b], chunk.rows) / (words + SMOOTH))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def learnable() -> Column:
    return F.coalesce(crc_mod("doc_id", FOLDS) != HELD_OUT, F.lit(False))


def risk(g: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float]:
    """The part of the risk that positive texts give, and the corrected part of the negative class (before it is held at 0),
    by logistic loss."""
    loss = np.logaddexp(0, -g[positive])
    against = np.logaddexp(0, g)
    return prior * loss.mean(), against[~positive].mean() - prior * against[positive].mean()


def slope(g: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """The derivative by each text's logit that a step follows: of the whole risk, or, where the negative part is below zero,
    of that part turned round."""
    p, n = sigmoid(g), positive.sum()
    out = np.where(positive, -prior * p / n, p / (len(g) - n))
    if risk(g, positive, prior)[1] < 0:
        return -out
    return out + np.where(positive, prior * (p - 1) / n, 0.0)


def train_nnpu(texts: list[tuple[np.ndarray, np.ndarray]], positive: np.ndarray, width: int, prior: float, *, epochs: int = 100, batch: int = 1024, rate: float = 0.1, l2: float = 1e-4, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier of (columns, values) by Adam; each step sees some positive and some unlabelled texts."""
    sizes = np.array([len(c) for c, _ in texts])
    begin = np.cumsum(sizes) - sizes
    columns, values = (np.concatenate(x) for x in zip(*texts, strict=True))
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean, square, step = np.zeros(width + 1), np.zeros(width + 1), 0
    rng = np.random.default_rng(seed)
    is_positive, other = np.flatnonzero(positive), np.flatnonzero(~positive)
    parts = -(-len(other) // batch)
    for _ in range(epochs):
        some = np.array_split(rng.permutation(is_positive), parts) if len(is_positive) >= parts else [is_positive] * parts
        for a, b in zip(some, np.array_split(rng.permutation(other), parts), strict=True):
            at = np.concatenate([a, b])
            row = np.repeat(np.arange(len(at)), sizes[at])
            entry = np.repeat(begin[at] - np.cumsum(sizes[at]) + sizes[at], sizes[at]) + np.arange(len(row))
            c, x = columns[entry], values[entry]
            d = slope(np.bincount(row, x * w[c], len(at)) + w[-1], np.arange(len(at)) < len(a), prior)
            gradient = np.append(np.bincount(c, d[row] * x, width) + l2 * w[:-1], d.sum())
            step += 1
            mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
            w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def toxic_texts(docs: DataFrame, labels: DataFrame, slots: int = 1 << 20) -> DataFrame:
    """(doc_id, text) of the documents that may be learned from and are confirmed as toxic, stored. Only texts whose id falls in a
    slot of a toxic id (``slots`` at most are broadcast) go through the join's shuffle."""
    ids = labels.where((F.col("toxic") == 1) & learnable()).select(F.col("doc_id").alias("id")).distinct()
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(slots))
    near = docs.where(learnable()).withColumn("slot", slot("doc_id")).join(F.broadcast(ids.select(slot("id").alias("slot")).distinct()), "slot", "left_semi").drop("slot")
    return stored(near.join(ids, F.col("doc_id") == F.col("id"), "left_semi"), "toxic-texts")


def rates(texts: DataFrame, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int, int]:
    """In how many texts each bucket is and how often it is in all of them, the words and the texts. With ``among`` only these
    buckets are counted, and only how often they are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, often = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for chunk in bt.chunks(bt.string_column(batch, "text")):
                b, row, words = features(chunk)
                texts[BUCKETS] += chunk.rows
                often[BUCKETS] += words.sum()
                often[:BUCKETS] += np.bincount(b, minlength=BUCKETS)
                if among is None:
                    texts[:BUCKETS] += np.bincount(np.unique(row * BUCKETS + b) % BUCKETS, minlength=BUCKETS)
        found = np.flatnonzero(texts + often) if among is None else np.append(among, BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(texts[found]), pa.array(often[found])], names=["bucket", "texts", "often"])

    out = np.zeros((2, BUCKETS + 1), np.int64)
    got = text_rows(texts, "text").mapInArrow(thin(work), "bucket long, texts long, often long").groupBy("bucket").agg(F.sum("texts").alias("texts"), F.sum("often").alias("often")).toArrow()
    out[:, got["bucket"].to_numpy()] = got["texts"].to_numpy(), got["often"].to_numpy()
    return out[0, :-1], out[1, :-1], int(out[1, -1]), int(out[0, -1])


def chosen_features(toxic: tuple, every: tuple) -> np.ndarray:
    """The buckets that mark toxic texts, from the counts of toxic texts and of all: by rate against the unlabelled texts, and by
    the texts that hold them."""
    holders, often, words, _ = toxic
    other, other_words = np.maximum(every[1] - often, 0), max(1, every[2] - words)
    ratio = (often / max(1, words)) / ((other + 0.5) / other_words)
    on = np.flatnonzero((holders >= LEAST_TEXTS) & (ratio >= LEAST_RATIO))
    return np.sort(on[np.lexsort((on, -holders[on] * np.log(ratio[on])))[:FEATURES]])


def _sample(texts: DataFrame, share: float, chosen: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(columns, values) of a sample of texts by hash of the id: only counts of chosen features come to the driver."""
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in bt.chunks(bt.string_column(batch, "text")):
                b, row, words = features(chunk)
                c = column[b]
                k, n = np.unique(row[c >= 0] * len(chosen) + c[c >= 0], return_counts=True)
                of = k // len(chosen)
                cuts = pa.array(np.searchsorted(of, np.arange(chunk.rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in ((k % len(chosen)).astype(np.int32), (SCALE * n / (words[of] + SMOOTH)).astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows), *lists], names=["id", "c", "x"])

    taken = texts.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity sample")), F.lit(1 << 24)) < share * (1 << 24))
    schema = add_columns(taken.select(F.col("doc_id").alias("id")).schema, c="array<int>", x="array<float>")
    got = text_rows(taken, "doc_id", "text").mapInArrow(thin(work), schema).orderBy("id", "c", "x").toArrow()
    return [(np.array(c, np.int64), np.array(x)) for c, x in zip(got["c"].to_pylist(), got["x"].to_pylist(), strict=True)]


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier from the labelled and unlabelled documents that may be learned from."""
    marks = labels.where(learnable() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_toxic, n = marks.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first()
    prior = n_toxic / n if n else 0.0
    bounded = min(max(prior, 1e-3), 0.5)
    constant = Model(np.zeros(BUCKETS), np.log(bounded / (1 - bounded)) if prior else -30.0)
    if not n_toxic:
        return constant
    toxic = toxic_texts(docs, labels)
    known = rates(toxic)
    candidates = np.flatnonzero(known[0] >= LEAST_TEXTS)
    others = docs.where(learnable())
    every = rates(others, candidates)
    chosen = chosen_features(known, every)
    positive = _sample(toxic, min(1.0, POSITIVE / max(1, known[3])), chosen) if len(chosen) else []
    unlabelled = _sample(others, min(1.0, UNLABELLED / max(1, every[3])), chosen) if positive else []
    dropped(toxic)
    if not unlabelled:
        return constant
    w, bias = train_nnpu([*positive, *unlabelled], np.arange(len(positive) + len(unlabelled)) < len(positive), len(chosen), bounded)
    weights = np.zeros(BUCKETS)
    weights[chosen] = w
    return Model(weights, bias)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: a score for every text."""
    docs, labels = picked(docs, "doc_id", "text"), picked(labels, "doc_id", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    rows = docs.select("doc_id", (~learnable()).alias("held_out"), F.col("text").alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in bt.chunks(bt.string_column(batch, "_text")):
                part = [c.slice(chunk.first, chunk.rows) for c in batch.columns[:2]]
                score = shared.value.scores(chunk)
                yield pa.RecordBatch.from_arrays([*part, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    schema = add_columns(docs.select("doc_id").schema, held_out="boolean", score="double", predicted="int")
    return text_rows(rows, "doc_id", "held_out", "_text").mapInArrow(thin(work), schema)
