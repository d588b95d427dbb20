"""Spectral codes of text and their display, as column arithmetic (A11-A12, A20-A21, H4, M1-M8, V-1 to V-4, W3, J11, K10)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_HZ = 30.0


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, not once for each element that a function visits."""
    return F.transform(F.array(value), use)[0]


def byte_values(text: Column) -> Column:
    """UTF-8 bytes scaled to -1..1; an empty text is one zero byte."""
    raw = F.regexp_extract_all(F.hex(F.encode(F.when(text == "", "\0").otherwise(text), "UTF-8")), F.lit(".."), F.lit(0))
    return F.transform(raw, lambda h: (F.conv(h, 16, 10).cast("double") - 127.5) / 127.5)


#: A byte's value is (2 b - 255) / 255, so sums of squares are whole numbers over 255 ** 2.
_SQUARES = (2 * np.arange(256, dtype=np.int64) - 255) ** 2


@F.arrow_udf(T.DoubleType())
def byte_energy(text: pa.Array) -> pa.Array:
    """The summed squared coefficients of the text's code; by Parseval's theorem that of its bytes, added up for a whole
    batch at once and exactly. An empty text is one zero byte."""
    whole = text.cast(pa.large_string())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SQUARES[data], out=sums[1:])
    at = offsets - offsets[0]
    energy = np.where(at[1:] > at[:-1], sums[at[1:]] - sums[at[:-1]], 255**2) / 255**2
    return pa.array(energy, mask=whole.is_null().to_numpy(zero_copy_only=False))


def _encoded(raw: bytes) -> np.ndarray:
    """The orthonormal DCT-II of scaled bytes, by a Fourier transform of the same length."""
    x = (np.frombuffer(raw or b"\0", np.uint8) - 127.5) / 127.5
    n = len(x)
    c = (np.fft.fft(np.concatenate([x[::2], x[1::2][::-1]])) * np.exp(-0.5j * np.pi / n * np.arange(n))).real * math.sqrt(2 / n)
    c[0] *= math.sqrt(0.5)
    return c


def _bytes(c: np.ndarray) -> bytes | None:
    """The bytes of a code: the inverse of :func:`_encoded`; None if a value is no byte."""
    n = len(c)
    c = c * math.sqrt(n / 2)
    c[0] *= math.sqrt(2)
    v = np.fft.ifft(np.exp(0.5j * np.pi / n * np.arange(n)) * (c - 1j * np.append(0.0, c[:0:-1]))).real
    x = np.empty(n)
    x[::2], x[1::2] = v[: (n + 1) // 2], v[(n + 1) // 2 :][::-1]
    whole = np.rint(x * 127.5 + 127.5)
    return whole.astype(np.uint8).tobytes() if np.all((whole >= 0) & (whole <= 255)) else None


def _raw(text: pa.Array):
    """The UTF-8 bytes of each text, or None."""
    return (x.as_buffer().to_pybytes() if x.is_valid else None for x in text.cast(pa.large_binary()))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _codes(text: pa.Array) -> pa.Array:
    return pa.array([None if r is None else _encoded(r) for r in _raw(text)], pa.list_(pa.float64()))


@F.arrow_udf(T.BinaryType())
def _payloads(codes: pa.Array) -> pa.Array:
    return pa.array([_bytes(c.values.to_numpy().astype(float)) if c.is_valid and len(c.values) else None for c in codes], pa.binary())


@F.arrow_udf(T.DoubleType())
def code_energy(text: pa.Array) -> pa.Array:
    """:func:`physical_energy` of the text's code, which doesn't leave the task's text by text work."""
    of = lambda c: 0.5 * float(np.sum((2 * math.pi * BASE_HZ / len(c) * np.arange(len(c)) * c) ** 2))
    return pa.array([None if r is None else of(_encoded(r)) for r in _raw(text)], pa.float64())


def turned_back(text: Column, seconds: float) -> Column:
    """M1, M4: the bytes of each text after its code was turned by the phases of a time (q and p of each mode), recovered and
    read; one text after another, as codes take many times the room of texts. Null where a value is no byte."""

    def of(raw: bytes) -> bytes | None:
        c = _encoded(raw)
        k, n = np.arange(len(c)), len(c)
        turn = k * (seconds * BASE_HZ / n % 1.0) % 1.0
        cos, sin = np.cos(2 * np.pi * turn), np.sin(2 * np.pi * turn)
        q, p = c * cos, c * sin
        return _bytes(q * cos + p * sin)

    @F.arrow_udf(T.BinaryType())
    def trip(text: pa.Array) -> pa.Array:
        return pa.array([None if r is None else of(r) for r in _raw(text)], pa.binary())

    return trip(text)


def coefficients(docs: DataFrame) -> DataFrame:
    """M1: the orthonormal DCT-II of each text's bytes (column ``coefficients``)."""
    return docs.withColumn("coefficients", _codes("text"))


def read(payload: DataFrame) -> DataFrame:
    """M2: the text of each payload (columns payload, byte_length, sha256), and whether length and digest hold (columns ``decoded``,
    ``valid``). What was never there, without digest, is valid as null."""
    ok = F.octet_length("payload") == F.greatest("byte_length", F.lit(1))
    out = payload.withColumn("decoded", F.when(F.col("byte_length") == 0, "").when(ok, F.decode("payload", "UTF-8"))).drop("payload")
    return out.withColumn("valid", F.sha2(F.col("decoded"), 256).eqNullSafe(F.col("sha256")))


def decoded(packets: DataFrame) -> DataFrame:
    """M1, M2: the text of each code, and whether length, range and digest hold (columns ``decoded``, ``valid``)."""
    return read(packets.withColumn("payload", _payloads("coefficients")))


def physical_energy(coefficient_array: Column) -> Column:
    """Half the sum of (2 pi 30 k / N)^2 a_k^2."""
    terms = lambda c: F.transform(c, lambda a, k: F.pow(F.lit(2 * math.pi * BASE_HZ) * k / F.size(c), 2) * a * a)
    return 0.5 * F.aggregate(bound(coefficient_array, terms), F.lit(0.0), lambda s, x: s + x)


def phase(k: Column, n: Column, seconds: float) -> Column:
    """M3: the angle of mode ``k`` of ``n``; whole turns are dropped first."""
    turn = lambda x: x - F.floor(x)
    return 2 * math.pi * turn(k * turn(F.lit(seconds * BASE_HZ) / n))


def quadratures(coefficient_array: Column, seconds: float) -> Column:
    """M4: (q, p) of each mode at a time."""
    turned = lambda a, k, n: F.struct((a * F.cos(phase(k, n, seconds))).alias("q"), (a * F.sin(phase(k, n, seconds))).alias("p"))
    return bound(coefficient_array, lambda c: F.transform(c, lambda a, k: turned(a, k, F.size(c))))


def recovered(quadrature_array: Column, seconds: float) -> Column:
    """M4: the coefficients again."""
    back = lambda s, k, n: s["q"] * F.cos(phase(k, n, seconds)) + s["p"] * F.sin(phase(k, n, seconds))
    return bound(quadrature_array, lambda c: F.transform(c, lambda s, k: back(s, k, F.size(c))))


def displacement(coefficient_array: Column, place: Column, seconds: float) -> Column:
    """M7: the inverse DCT at one byte place, with every mode turned by its phase."""
    scale = lambda k, n: F.when(k == 0, F.sqrt(1 / n)).otherwise(F.sqrt(2 / n))
    term = lambda a, k, n: a * scale(k, n) * F.cos(F.lit(math.pi) * (2 * place + 1) * k / (2 * n)) * F.cos(phase(k, n, seconds))
    return F.aggregate(bound(coefficient_array, lambda c: F.transform(c, lambda a, k: term(a, k, F.size(c)))), F.lit(0.0), lambda s, x: s + x)


def offsets(docs: DataFrame, *, order: str = "doc_id", block: int = 10_000) -> DataFrame:
    """(doc_id, length, end_mode): running sums of byte lengths in order.

    Sums of ranges of ids come first; a window runs over these few totals and within each range, so no
    task sorts all rows.
    """
    rows = docs.select(order, F.greatest(F.octet_length("text"), F.lit(1)).cast("long").alias("length")).withColumn("block", F.floor(F.col(order) / block))
    totals = rows.groupBy("block").agg(F.sum("length").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("length").over(Window.partitionBy("block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("inside", inside).join(totals.select("block", before.alias("before")), "block").select(order, "length", (F.col("inside") + F.col("before")).alias("end_mode"))


def coordinate_lookup(docs: DataFrame, points: int) -> DataFrame:
    """The document and byte place at each of ``points`` evenly spaced coordinates (a bounded, broadcast list)."""
    ends = offsets(docs)
    size = ends.agg(F.max("end_mode").alias("size"))
    at = F.floor(F.col("i") * (F.col("size") - 1) / F.lit(max(points - 1, 1))).cast("long")
    sampled = docs.sparkSession.range(points).select(F.col("id").alias("i")).join(F.broadcast(size)).select(F.col("i").alias("point"), at.alias("coordinate"))
    hit = (F.col("coordinate") >= F.col("end_mode") - F.col("length")) & (F.col("coordinate") < F.col("end_mode"))
    return ends.join(F.broadcast(sampled), hit).select("point", "coordinate", "doc_id", (F.col("coordinate") - (F.col("end_mode") - F.col("length"))).alias("place"))


def snapshot(docs: DataFrame, *, seconds: float, points: int) -> DataFrame:
    """V-1: displacement at sampled coordinates; only documents that hold one are transformed."""
    hits = coordinate_lookup(docs, points)
    packets = coefficients(docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi"))
    return hits.join(packets.select("doc_id", "coefficients"), "doc_id").select("point", "coordinate", displacement(F.col("coefficients"), F.col("place"), seconds).alias("displacement"))


def resonance(left: DataFrame, right: DataFrame) -> DataFrame:
    """The cosine of two fields (symbol, amplitude), between 0 and 1."""
    dot = left.join(right.withColumnRenamed("amplitude", "other"), "symbol").agg(F.sum(F.col("amplitude") * F.col("other")).alias("dot"))
    norm = lambda f, name: f.agg(F.sqrt(F.sum(F.col("amplitude") * F.col("amplitude"))).alias(name))
    value = F.coalesce(F.col("dot") / (F.col("a") * F.col("b")), F.lit(0.0))
    return dot.join(norm(left, "a")).join(norm(right, "b")).select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("resonance"))


def superposed(fields: DataFrame) -> DataFrame:
    """The weighted complex sum of fields (symbol, re, im, weight)."""
    return fields.groupBy("symbol").agg(F.sum(F.col("weight") * F.col("re")).alias("re"), F.sum(F.col("weight") * F.col("im")).alias("im"))


def unit(field: DataFrame) -> DataFrame:
    """A field of norm one."""
    norm = field.agg(F.sqrt(F.sum(F.col("amplitude") * F.col("amplitude"))).alias("norm"))
    return field.join(F.broadcast(norm)).select("symbol", F.when(F.col("norm") > 0, F.col("amplitude") / F.col("norm")).otherwise(0.0).alias("amplitude"))


def restricted(field: DataFrame, symbols: DataFrame) -> DataFrame:
    """Amplitudes at the wanted symbols, 0 where the field has none."""
    return symbols.join(field, "symbol", "left").select("symbol", F.coalesce("amplitude", F.lit(0.0)).alias("amplitude"))


def fingerprint(field: DataFrame, kind: str) -> DataFrame:
    """H4: a digest of kind and rounded amplitudes in order of symbol (a bounded field)."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("symbol", F.bround("amplitude", 12).alias("a")))), lambda s: F.concat_ws(":", s["symbol"].cast("string"), s["a"].cast("string")))
    return field.agg(F.substr(F.sha2(F.concat_ws("|", F.lit(kind), F.array_join(rows, ",")), 256), F.lit(1), F.lit(16)).alias("fingerprint"))


def composed(spans: DataFrame) -> DataFrame:
    """M8: verified byte spans (group, position, payload, begin, end, sha256) put together in order; null where a span fails."""
    ok = (F.sha2("payload", 256) == F.col("sha256")) & (F.col("begin") >= 0) & (F.col("end") <= F.octet_length("payload"))
    piece = F.when(ok, F.substr("payload", F.col("begin") + 1, F.col("end") - F.col("begin")))
    listed = F.array_sort(F.collect_list(F.struct("position", F.hex(piece).alias("hex"), ok.alias("ok"))))
    return spans.groupBy("group").agg(listed.alias("s")).select("group", F.when(F.forall("s", lambda x: x["ok"]), F.decode(F.unhex(F.array_join(F.transform("s", lambda x: x["hex"]), "")), "UTF-8")).alias("text"))
