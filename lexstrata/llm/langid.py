"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased; all that aren't letters count as a blank. n-grams of one to three
characters are hashed to ``BUCKETS``. Document frequencies are counted over all training texts.
The weights are trained by follow-the-regularised-leader with elastic-net penalties on a bounded
sample of labelled rows (``SAMPLE_PER_LANGUAGE`` of each language, by hash of the id, texts up to
``SAMPLE_BYTES``), a part of which sets the temperature. Term frequencies are shares of the text's
n-grams, so a text is scored in one pass, without gathering its distinct n-grams.

Defined results: null texts and texts without letters are ``und`` with score 0, as are all texts if
there is nothing to learn from; rows without id are held out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .cluster import add_columns, crc_mod, filtered, picked, text_rows

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SAMPLE_PER_LANGUAGE = 600
SAMPLE_BYTES = 1 << 15
LANGUAGES = 256
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each character of the basic plane, and 0 for those that aren't letters."""
    lower = np.zeros(1 << 16, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            small = c.lower()
            lower[i] = ord(small) if len(small) == 1 else i
    return lower


_TABLE: list[np.ndarray] = []


def characters(chunk: bt.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Letters as numbers (0 for other characters), and where each row begins."""
    if not _TABLE:
        _TABLE.append(_letters())
    text = chunk.buf.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    begins = (chunk.buf & 0xC0) != 0x80
    offsets = np.append(0, np.cumsum(begins))[chunk.offsets]
    small = points < 1 << 16
    out = _TABLE[0][np.where(small, points, 0)]
    if not small.all():
        for p in np.unique(points[~small]).tolist():
            out[points == p] = ord(chr(p).lower()[:1]) if chr(p).isalpha() else 0
    return out, offsets


def buckets(points: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of one order, and the row of each."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = points.astype(np.uint64) + np.uint64(order)
    h = np.zeros(n, np.uint64)
    for k in range(order):
        h += wide[k : k + n] * _FACTORS[k]
    h ^= h >> np.uint64(29)
    h *= _FACTORS[1]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:n] == row[order - 1 :]
    return (h >> np.uint64(48)).astype(np.int64)[inside], row[:n][inside]


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the texts; each task sends one row a bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for chunk in bt.chunks(bt.string_column(batch, "text")):
                points, offsets = characters(chunk)
                df[BUCKETS] += chunk.rows
                held = [row * BUCKETS + b for b, row in (buckets(points, offsets, order) for order in ORDERS)]
                df[:BUCKETS] += np.bincount(np.unique(np.concatenate(held)) % BUCKETS, minlength=BUCKETS)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(df[found])], names=["bucket", "n"])

    out = np.zeros(BUCKETS + 1, np.int64)
    got = rows.mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out[:BUCKETS], int(out[BUCKETS])


class Model:
    """Weights (bucket by language) that have the inverse document frequency in them, biases, temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf = languages, idf
        self.weights, self.bias, self.temperature = np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages)), 1.0

    def logits(self, chunk: bt.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: the logits, and whether it has a letter."""
        points, offsets = characters(chunk)
        sums, total = np.zeros((chunk.rows, len(self.languages))), np.zeros(chunk.rows)
        for order in ORDERS:
            b, row = buckets(points, offsets, order)
            total += np.bincount(row, minlength=chunk.rows)
            for k in range(len(self.languages)):
                sums[:, k] += np.bincount(row, self.weights[:, k][b], chunk.rows)
        letters = np.bincount(np.repeat(np.arange(chunk.rows), np.diff(offsets))[points > 0], minlength=chunk.rows) > 0
        return sums / np.maximum(total, 1)[:, None] + self.bias, letters

    def predict(self, chunk: bt.Chunk) -> tuple[np.ndarray, np.ndarray]:
        if not self.languages:
            return np.full(chunk.rows, UNKNOWN, object), np.zeros(chunk.rows)
        logits, letters = self.logits(chunk)
        p = softmax(logits / self.temperature)
        names = np.array(self.languages, object)[p.argmax(1)]
        names[~letters] = UNKNOWN
        return names, np.where(letters, p.max(1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, *, alpha: float = 4.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, epochs: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by FTRL-proximal with elastic-net penalties; an example is (buckets, values, class)."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            at, x, y = examples[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)  # the bias
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at], n[at] = zi + g - sigma * w, ni + g * g
    w = weights(z, n)
    return w[:BUCKETS], w[BUCKETS]


def calibrate(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of least cross-entropy. One text's worth of doubt, spread over all classes, is added, so there is an
    optimum even where every text is right; the loss is convex in the inverse temperature."""
    doubt = 1.0 / (len(classes) + 1)

    def loss(log_inverse: float) -> float:
        p = np.log(np.maximum(softmax(logits * np.exp(log_inverse)), 1e-300))
        return float(-((1 - doubt) * p[np.arange(len(classes)), classes] + doubt * p.mean(1)).mean())

    low, high = -12.0, 12.0
    for _ in range(80):
        left, right = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, right) if loss(left) <= loss(right) else (left, high)
    return float(np.exp(-(low + high) / 2))


def learn(rows: DataFrame) -> Model:
    """The model from labelled rows (id, text, lang)."""
    counts = sorted((r["lang"], r["count"]) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect())
    languages = [x for x, _ in counts]
    df, texts = document_frequencies(rows.select("text"))
    model = Model(languages, np.log((1 + texts) / (1 + df)) + 1)
    if not languages:
        return model
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, SAMPLE_PER_LANGUAGE / n))])
    chosen = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 24)) < share[F.col("lang")] * (1 << 24)
    sample = rows.where(chosen).where((F.octet_length("text") <= SAMPLE_BYTES) & F.col("text").isNotNull()).select("id", "text", "lang").orderBy("id", "text").toArrow()
    known = {lang: k for k, lang in enumerate(languages)}
    examples = []
    for chunk in bt.chunks(sample["text"].combine_chunks().cast(pa.large_string()) if sample.num_rows else pa.array([], pa.large_string()), max_rows=1):
        points, offsets = characters(chunk)
        b = np.concatenate([buckets(points, offsets, order)[0] for order in ORDERS])
        if len(b):
            at, times = np.unique(b, return_counts=True)
            examples.append((at, times / len(b) * model.idf[at], known[sample["lang"][chunk.first].as_py()]))
    held = max(1, len(examples) // 5)
    order = np.random.default_rng(3).permutation(len(examples))
    fit, rest = [examples[i] for i in order[held:]] or examples, [examples[i] for i in order[:held]]
    w, model.bias = train_ftrl(fit, len(languages))
    if rest:
        logits = np.array([x @ w[at] + model.bias for at, x, _ in rest])
        model.temperature = calibrate(logits, np.array([y for _, _, y in rest]))
    model.weights = np.asfortranarray((w * model.idf[:, None]).astype(np.float32))
    return model


def held_out(fold: int = 3):
    return F.coalesce(crc_mod("doc_id", fold) == 1, F.lit(True))


def training_rows(docs: DataFrame, fold: int = 3) -> DataFrame:
    """(id, text, lang) of the rows that may be learned from."""
    return text_rows(docs.where(~held_out(fold) & F.col("lang").isNotNull()).withColumnRenamed("doc_id", "id"), "id", "text", "lang")


def identify(docs: DataFrame, *, fold: int = 3) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang)."""
    docs = picked(docs, "doc_id", "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(learn(training_rows(docs, fold)))
    rows = docs.select("doc_id", held_out(fold).alias("held_out"), F.col("text").alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [], []
            for chunk in bt.chunks(bt.string_column(batch, "_text")):
                name, score = model.predict(chunk)
                names.append(name)
                scores.append(score)
            if names:
                extra = [pa.array(np.concatenate(names), pa.string()), pa.array(np.concatenate(scores))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], names=["doc_id", "held_out", "lang_pred", "score"])

    schema = add_columns(docs.select("doc_id").schema, held_out="boolean", lang_pred="string", score="double")
    return text_rows(rows, "doc_id", "held_out", "_text").mapInArrow(work, schema)


def keep_known(docs: DataFrame, *, least: float = 0.5) -> DataFrame:
    """``docs`` without the documents of no known language or of a score below ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(training_rows(picked(docs, "doc_id", "text", "lang"))))
    text = f"c{docs.columns.index('text')}"

    def decide(batch: pa.RecordBatch) -> np.ndarray:
        keep = np.zeros(batch.num_rows, bool)
        for chunk in bt.chunks(bt.string_column(batch, text)):
            names, scores = shared.value.predict(chunk)
            keep[chunk.first : chunk.first + chunk.rows] = (names != UNKNOWN) & (scores >= least)
        return keep

    return filtered(docs, decide)


def report(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    return identify(docs)
