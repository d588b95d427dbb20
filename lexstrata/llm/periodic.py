"""Periodic runs of words: tandem repeats by the linear method of Gusfield and Stoye, merged into maximal runs.

The words of a text, as numbers, are cut to the stretches that can hold a run at all: each trigram of a run of exponent 4 or
more occurs three times in it, so a stretch is a sequence of words whose trigrams all occur three times in it (checked again
after each cut). The stretches of a chunk of texts are put end to end, with unique separators, and

1. the Lempel-Ziv blocks are found from each place's longest previous factor (neighbours in the suffix array);
2. at each block's border, for each period that its own or the next block's length allows, common extensions to both sides
   give the squares over the border: a set that covers the leftmost occurrence of every square;
3. from each such square a walk along suffix links (each to the next rotation) completes the vocabulary of squares: a square
   is the interval of the suffix array (the locus in the suffix tree) of its text, and is kept once;
4. all occurrences of the vocabulary are read off the intervals; consecutive occurrences of a period merge into runs.

Only squares of primitive words are followed, so there are O(n log n) occurrences. No shuffle: each text is read once, in
chunks, and a text is the largest unit of memory.

Defined results: null and empty texts have no words and no runs; ids may repeat or be null (each row stands for itself).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .blocks import thin
from .cluster import add_columns, bounded_batches, numbered, picked, text_rows
from .suffixes import Suffixes

LEAST_LENGTH = 6
LEAST_EXPONENT = 4


def _previous_factors(s: Suffixes) -> np.ndarray:
    """Of each place, the length of the longest prefix that also begins at an earlier place."""
    n = len(s.array)
    rank = np.empty(n, np.int64)
    rank[s.array] = np.arange(n)
    rank = rank.tolist()
    before, after = list(range(-1, n)), list(range(1, n + 2))
    left, right = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):  # places leave in falling order: what is left beside one begins earlier
        x = rank[i]
        p, q = before[x], after[x]
        left[i], right[i] = p, q
        after[p] = q
        before[q] = p
    out = np.zeros(n, np.int64)
    for side, none in ((np.array(left), -1), (np.array(right), n)):
        at = np.flatnonzero(side != none)
        out[at] = np.maximum(out[at], s.common(at, s.array[side[at]]))
    return out


def _blocks(s: Suffixes) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin, and the end."""
    factors, starts, at = _previous_factors(s).tolist(), [], 0
    while at < len(factors):
        starts.append(at)
        at += factors[at] or 1
    return np.array([*starts, len(factors)])


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _covering(s: Suffixes, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of squares over block borders, periods up to ``most``; of equal stretches the smallest period."""
    starts = _blocks(s)
    sizes, begins = np.diff(starts), starts[:-1]
    after = np.append(sizes[1:], 0)
    ahead = np.minimum(np.minimum(sizes + after, len(s.array) - 1 - begins), most)
    back = np.minimum(sizes[:-1], most)
    right = np.repeat(begins, ahead)
    right_period = _ranges(ahead) + 1
    left = np.repeat(begins[1:], back)
    left_period = _ranges(back) + 1
    a, period = np.concatenate([right, left - left_period]), np.concatenate([right_period, left_period])
    forward, backward = s.common(a, a + period), s.common_before(a, a + period)
    on = forward + backward >= period
    start, end, period = (a - backward)[on], (a + period + forward)[on], period[on]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    one = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    return start[one], end[one], period[one]


def _vocabulary(s: Suffixes, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(period, first, last) of each square's interval in the suffix array: all rotations along the covering squares, once each."""
    walk = np.minimum(end - start - 2 * period + 1, period)
    at, period = np.repeat(start, walk) + _ranges(walk), np.repeat(period, walk)
    level = np.frexp(2.0 * period)[1] - 1
    for each in np.unique(level):
        on = level == each
        i, q = at[on], period[on]
        rank, shift = s.levels[each], 2 * q - (1 << each)
        x, y = rank[i], rank[i + shift]
        order = np.lexsort((y, x, q))
        x, y, i, q = x[order], y[order], i[order], q[order]
        one = np.append(True, (q[1:] != q[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
        i, q = i[one], q[one]
        low, high = s.interval(i, 2 * q, int(each))
        yield q, low, high


def runs(ids: np.ndarray, most: int, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs in ``ids`` (begins and ends with a separator; separators are unique) with
    periods up to ``most`` whose length is at least ``least_length`` and ``least_exponent`` periods (2 or more)."""
    nothing = np.zeros(0, np.int64)
    if len(ids) < 3:
        return nothing, nothing, nothing
    s = Suffixes(ids)
    places, periods = [nothing], [nothing]
    for q, low, high in _vocabulary(s, *_covering(s, most)):
        counts = high - low
        places.append(s.array[np.repeat(low, counts) + _ranges(counts)])
        periods.append(np.repeat(q, counts))
    place, period = np.concatenate(places), np.concatenate(periods)
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    first = np.flatnonzero(np.append(True, (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1))[: len(place)])
    start, q = place[first], period[first]
    length = np.diff(np.append(first, len(place))) - 1 + 2 * q
    on = length >= np.maximum(least_length, least_exponent * q)
    return start[on], length[on], q[on]


def _stretches(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that may stand in a run, and the stretch of each: all trigrams of a stretch occur three times in it."""
    at, part = np.arange(len(h)), row
    while len(at):
        n = len(at) - 2
        whole = part[2:] == part[:-2] if n > 0 else np.zeros(0, bool)
        if not whole.any():
            return at[:0], part[:0]
        w = h[at]
        key = bt.mix(w[:-2] + bt.mix(w[1:-1] + bt.mix(w[2:] + bt.mix(part[2:].astype(np.uint64)))))
        whole = np.flatnonzero(whole)
        _, inverse, counts = np.unique(key[whole], return_inverse=True, return_counts=True)
        good = whole[counts[inverse] >= 3]
        keep = np.zeros(len(at), bool)
        for k in range(3):
            keep[good + k] = True
        begins = np.zeros(len(at), bool)
        begins[good] = True
        begins[good[1:][good[1:] == good[:-1] + 1]] = False  # the first trigram of each stretch; stretches may touch or share words
        if keep.all() and np.array_equal(np.cumsum(begins), np.cumsum(np.append(True, part[1:] != part[:-1]))):
            return at, part
        first = good[begins[good]]
        last = good[np.append(good[1:] != good[:-1] + 1, True)] + 2 if len(good) else good
        sizes = last - first + 1
        first, sizes = first[sizes >= LEAST_LENGTH], sizes[sizes >= LEAST_LENGTH]
        at, part = at[np.repeat(first, sizes) + _ranges(sizes)], np.repeat(np.arange(len(first)), sizes)
    return at, part


def found(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, period) of all runs of the contract among words (hash and row of each), by place and period."""
    at, part = _stretches(h, row)
    nothing = np.zeros(0, np.int64)
    if not len(at):
        return nothing, nothing, nothing
    _, ids = np.unique(h[at], return_inverse=True)
    into = np.arange(len(at)) + part + 1
    n, known = len(at) + part[-1] + 2, ids.max() + 1
    line, source = np.arange(known, known + n), np.full(n, -1)
    line[into], source[into] = ids, at
    start, length, period = runs(line, int(np.bincount(part).max()) // LEAST_EXPONENT)
    place = source[start]
    # stretches may share words, never whole runs
    order = np.lexsort((period, place))
    return place[order], length[order], period[order]


def tails(row: np.ndarray, rows: int, h: np.ndarray) -> np.ndarray:
    """Of each word, the place of the word that stands there after the contract's change: where h % 10 is 0, words from g % n on
    repeat the first of them with a period of 1 + (n - a) // (3 + g % 8). A negative h changes nothing."""
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    g = np.maximum(h, 0) // 10
    a = g % np.maximum(n, 1)
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(len(row)) - first[row]
    on = (h % 10 == 0) & (h >= 0)
    moved = on[row] & (i >= a[row])
    return np.where(moved, (first + a)[row] + (i - a[row]) % p[row], np.arange(len(row)))


def _kept(words: int, place: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words no run contains after its first period."""
    edge = np.bincount(place + period, minlength=words + 1) - np.bincount(place + length, minlength=words + 1)
    return np.cumsum(edge)[:words] == 0


def _collapsed(chunk: bt.Chunk, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> Iterator[bytes]:
    """The words of each row, joined by single spaces."""
    data, offsets = bt.spaced(chunk.buf, starts, ends)
    cuts = offsets[np.searchsorted(row, np.arange(chunk.rows + 1))].tolist()
    raw = memoryview(data)
    for i in range(chunk.rows):
        yield raw[cuts[i] : max(cuts[i], cuts[i + 1] - 1)]


def report(docs: DataFrame) -> DataFrame:
    """The contract's rows: the runs of every text after the contract's change of every tenth, and the text without repeats."""
    docs = picked(docs, "doc_id", "text")
    rows = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(-1)).alias("_h"), F.col("text").alias("_text"))
    numbers = ("n_runs", "start", "length", "period", "exponent_milli")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(1).to_numpy()
            for chunk in bt.chunks(bt.string_column(batch, "_text")):
                starts, ends, row = chunk.words(bt.NOT_SPACE)
                source = tails(row, chunk.rows, hashes[chunk.first : chunk.first + chunk.rows])
                place, length, period = found(chunk.hashes(starts, ends)[source], row)
                first = np.searchsorted(row, np.arange(chunk.rows))
                keep = source[_kept(len(row), place, length, period)]
                texts = [hashlib.sha256(x).hexdigest() for x in _collapsed(chunk, starts[keep], ends[keep], row[keep])]
                of_row = row[place]
                cuts = np.searchsorted(of_row, np.arange(chunk.rows + 1)).tolist()
                start = (place - first[of_row]).tolist()
                length, period = length.tolist(), period.tolist()
                best, lists = [], []
                for a, b in zip(cuts, cuts[1:], strict=False):
                    lists.append("".join([f"{start[i]},{length[i]},{period[i]}\n" for i in range(a, b)]))
                    i = max(range(a, b), key=lambda i: (Fraction(length[i], period[i]), -start[i], -period[i]), default=None)
                    best.append((b - a, *((start[i], length[i], period[i], 1000 * length[i] // period[i]) if b > a else (None,) * 4)))
                columns = [pa.array(x, pa.int64()) for x in zip(*best, strict=True)]
                listed = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lists])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows), *columns, listed, pa.array(texts)], names=["doc_id", *numbers, "runs_sha256", "collapsed_sha256"])

    schema = add_columns(docs.select("doc_id").schema, **dict.fromkeys(numbers, "long"), runs_sha256="string", collapsed_sha256="string")
    return text_rows(rows, "doc_id", "_h", "_text").mapInArrow(thin(work), schema)


def run_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period): a row for each run of each text."""
    docs = picked(docs, "doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in bt.chunks(bt.string_column(batch, "text")):
                starts, ends, row = chunk.words(bt.NOT_SPACE)
                place, length, period = found(chunk.hashes(starts, ends), row)
                of_row = row[place]
                start = place - np.searchsorted(row, np.arange(chunk.rows))[of_row]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(chunk.first + of_row)), *map(pa.array, (start, length, period))], names=["doc_id", "start", "length", "period"])

    return text_rows(docs, "doc_id", "text").mapInArrow(thin(work), add_columns(docs.select("doc_id").schema, start="long", length="long", period="long"))


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with every run of a text cut to its first period, words joined by single spaces; texts without a run, and nulls,
    stay as they are."""
    bounded_batches(docs.sparkSession)
    rows, at = numbered(docs), docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for chunk in bt.chunks(bt.string_column(batch, f"c{at}")):
                starts, ends, row = chunk.words(bt.NOT_SPACE)
                place, length, period = found(chunk.hashes(starts, ends), row)
                keep = np.flatnonzero(_kept(len(row), place, length, period) & np.isin(row, row[place]))
                for i, text in enumerate(_collapsed(chunk, starts[keep], ends[keep], row[keep])):
                    if len(text):
                        texts[chunk.first + i] = bytes(text).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return rows.mapInArrow(thin(work), rows.schema).toDF(*docs.columns)
