"""Phrase collocation mining: word n-grams counted by suffix arrays, scored by their weakest cut.

Texts are cut to pieces at punctuation and line ends, and pieces to words; everything is counted for each language. A shard
is some megabytes of texts: its words are numbered, the suffix array of the numbers is built by prefix doubling, and each
interval of common prefixes of n words is one n-gram with its count in the shard. Spark adds the counts of all shards by
language and phrase, so equality of phrases is that of their texts.

An n-gram that occurs ``least`` times consists of shorter ones that do. So words are counted first, then pairs of such words,
then longer n-grams of such pairs. What is frequent is broadcast as a bitmap of ``2 ** filter_bits`` places, whatever the size
of the corpus: it only spares rows, and a place that a rare n-gram shares with a frequent one costs a row but changes nothing.

A phrase of m words is cut after its first k words; the cut's score is floor(2000000 a / (l + r)), with the counts of the
phrase and both parts, and the phrase takes its weakest cut. A phrase inside a longer one that occurs at least ``COVER``
hundredths as often goes. The first ``most`` of each language are found without bringing a language to one task: all phrases
are sorted by ranges, and ranks are counted from the sizes of the ranges before.

Defined results: null texts are empty; null languages are ``und``; ids are not read, so repeated rows count each time; ties of
score go by count and then by phrase in byte order, so ranks are unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext as bt
from .blocks import thin
from .cluster import dropped, picked, stored, text_rows
from .lm_scoring import bitmap, joint_key, marked
from .suffixes import Suffixes

LONGEST = 4
LEAST = 30
MOST = 2000
COVER = 80
FILTER_BITS = 27
SHARD_BYTES = 4 << 20
#: Phrases whose texts are put together at once: their places take some hundred bytes a phrase.
ROWS = 1 << 15
#: Words that are hashed at once.
HASHED = 1 << 16
UNKNOWN = "und"

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_BREAK
_WORD[[9, 32]] = False


class Words:
    """The words of a shard: where they are, their texts' rows, keys by language, and whether the next word follows in the same piece."""

    def __init__(self, chunk: bt.Chunk, languages: list[str]):
        self.buf = chunk.lowered().buf
        low = bt.Chunk(chunk.first, self.buf, chunk.offsets)
        self.starts, self.ends, self.row = low.words(_WORD)
        of_language = {x: bt.text_hash(x) for x in set(languages)}
        # mixed once more than words are: a sum of like hashes would take `es` in `en` for `en` in `es`
        salt = np.array([of_language[x] for x in languages], np.uint64)
        self.keys = bt.mix(salt + np.uint64(1))[self.row]
        for at in range(0, len(self.keys), HASHED):  # a hash takes some eight times the bytes of its text, so not all at once
            starts, ends = self.starts[at : at + HASHED], self.ends[at : at + HASHED]
            self.keys[at : at + HASHED] += bt.Chunk(0, self.buf[starts[0] : ends[-1]], low.offsets).hashes(starts - starts[0], ends - starts[0])
        self.keys = bt.mix(self.keys)
        breaks = np.cumsum(_BREAK[self.buf], dtype=np.int32 if len(self.buf) < 1 << 31 else np.int64)
        self.follows = np.zeros(len(self.starts), bool)
        if len(self.starts) > 1:
            self.follows[:-1] = (self.row[1:] == self.row[:-1]) & (breaks[self.starts[1:]] == breaks[self.starts[:-1]])

    def phrases(self, first: np.ndarray, m: int) -> pa.Array:
        """The texts of the ``m`` words from each place on."""
        at = (first[:, None] + np.arange(m)).ravel()
        data, offsets = bt.spaced(self.buf, self.starts[at], self.ends[at])
        keep = np.ones(len(data), bool)
        keep[offsets[m::m] - 1] = False
        bounds = (offsets[::m] - np.arange(len(first) + 1)).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(data[keep])])


def intervals(words: Words, follows: np.ndarray, lengths: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, first word of one occurrence, count) of all n-grams of ``m`` words linked by ``follows``: the intervals of common
    prefixes of m words in the suffix array."""
    used = follows.copy()
    used[1:] |= follows[:-1]
    at = np.flatnonzero(used)
    if not len(at):
        return
    closed = ~follows[at]  # a separator comes after each of these
    into = np.arange(len(at)) + np.cumsum(closed) - closed + 1
    n = len(at) + closed.sum() + 1
    _, ids = np.unique(words.keys[at], return_inverse=True)
    line, source = np.arange(n) + ids.max() + 1, np.full(n, -1)
    line[into], source[into] = ids, at
    del used, closed, into, ids, at
    s = Suffixes(line, lengths[-1])
    del line
    ends = np.flatnonzero(source < 0)
    reach = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    shared = s.common(s.array[:-1], s.array[1:])
    s.levels.clear()
    for m in lengths:
        first = np.flatnonzero(np.append(True, shared < m))
        count, place = np.diff(np.append(first, n)), s.array[first]
        on = reach[place] >= m
        yield m, source[place[on]], count[on]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """Words of about ``SHARD_BYTES`` of texts, and the languages of their rows."""
    held, size = [], 0

    def words() -> Iterator[tuple[Words, list[str]]]:
        table = pa.Table.from_batches(held)
        languages = table["lang"].to_pylist()
        for chunk in bt.chunks(bt.string_column(table.combine_chunks().to_batches()[0], "text"), SHARD_BYTES, 1 << 30):
            of_rows = languages[chunk.first : chunk.first + chunk.rows]
            yield Words(chunk, of_rows), of_rows

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= SHARD_BYTES:
            yield from words()
            held, size = [], 0
    if held:
        yield from words()


def _counts(texts: DataFrame, lengths: range, known: Broadcast, pairs: Broadcast) -> DataFrame:
    """(lang, words, phrase, n) of every n-gram of the given lengths; a null phrase counts all words. Words outside ``known``
    and neighbours outside ``pairs`` part a piece."""

    def rows(of_rows: list[str], words: Words, m: int, firsts: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        named = pa.array(of_rows, pa.string())
        for at in range(0, len(firsts), ROWS):
            first, n = firsts[at : at + ROWS], counts[at : at + ROWS]
            yield pa.RecordBatch.from_arrays([named.take(pa.array(words.row[first])), pa.array(np.full(len(first), m, np.int32)), words.phrases(first, m), pa.array(n.astype(np.int64))], names=["lang", "words", "phrase", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, of_rows in _shards(batches):
            if not len(words.row):
                continue
            if lengths[0] == 1:
                _, first, n = np.unique(words.keys, return_index=True, return_counts=True)
                yield from rows(of_rows, words, 1, first, n)
                names, of_row = np.unique(of_rows, return_inverse=True)
                all_words = np.bincount(of_row[words.row], minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(np.zeros(len(names), np.int32)), pa.nulls(len(names), pa.string()), pa.array(all_words)], names=["lang", "words", "phrase", "n"])
                continue
            follows, often = words.follows.copy(), marked(known.value, words.keys)
            follows[:-1] &= often[:-1] & often[1:]
            if pairs:
                follows[:-1] &= marked(pairs.value, joint_key(words.keys[:-1], words.keys[1:], 2))
            for m, first, n in intervals(words, follows, lengths):
                yield from rows(of_rows, words, m, first, n)

    return texts.mapInArrow(thin(work), "lang string, words int, phrase string, n long").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def _bits(frequent: DataFrame, m: int, filter_bits: int) -> Broadcast:
    """The broadcast bitmap of the frequent phrases of ``m`` words (1 or 2)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = batch.column(0).to_pylist()
            for chunk in bt.chunks(bt.string_column(batch, "phrase")):
                words = Words(chunk, languages[chunk.first : chunk.first + chunk.rows])
                keys = words.keys if m == 1 else joint_key(words.keys[::2], words.keys[1::2], 2)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["k"])

    keys = frequent.where(F.col("words") == m).select("lang", "phrase").mapInArrow(work, "k long")
    return frequent.sparkSession.sparkContext.broadcast(bitmap(keys, filter_bits))


def frequent_phrases(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, filter_bits: int = FILTER_BITS) -> list[DataFrame]:
    """Stored tables (lang, words, phrase, n) of all n-grams up to ``longest`` words (3 or more) that occur ``least`` times, and in
    the first of them the count of all words (a null phrase)."""
    docs = picked(docs, "text", "lang")
    texts = text_rows(docs.select("text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang")), "text", "lang")
    often = F.col("n") >= least
    single = stored(_counts(texts, range(1, 2), None, None).where(often | F.col("phrase").isNull()), "words")
    known = _bits(single, 1, filter_bits)
    double = stored(_counts(texts, range(2, 3), known, None).where(often), "pairs")
    pairs = _bits(double, 2, filter_bits)
    longer = stored(_counts(texts, range(3, longest + 1), known, pairs).where(often), "phrases")
    known.destroy()
    pairs.destroy()
    return [single, double, longer]


def _long(name: str) -> str:
    return f"CAST({name} AS DECIMAL(20, 0))"


def scored(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of all phrases of two words or more, by their weakest cut."""
    phrases = counts.where("words > 1")
    cut = [F.when(F.col("words") > k, F.struct(F.lit(k).alias("k"), F.substring_index("phrase", " ", k).alias("left"), F.expr(f"substring_index(phrase, ' ', {k} - words)").alias("right"))) for k in range(1, longest)]
    cuts = phrases.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.array(*cut)).alias("cut")).where("cut IS NOT NULL")
    parts = counts.where("phrase IS NOT NULL").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    sides = cuts.select("lang", "phrase", "words", "a", "cut.k", F.explode(F.create_map(F.lit("l"), F.col("cut.left"), F.lit("r"), F.col("cut.right"))).alias("side", "part"))
    met = sides.join(parts, ["lang", "part"]).groupBy("lang", "phrase", "words", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    score = F.expr(f"(2000000BD * {_long('a')}) div ({_long('l')} + {_long('r')})")
    weakest = met.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return weakest.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def uncovered(phrases: DataFrame, longest: int = LONGEST, cover: int = COVER) -> DataFrame:
    """``phrases`` without those inside a longer one that occurs at least ``cover`` hundredths as often."""
    words = F.split("phrase", " ")
    inner = [F.when((F.col("words") >= k + m) & (F.col("words") > m), F.array_join(F.slice(words, k + 1, m), " ")) for m in range(2, longest) for k in range(longest - m + 1)]
    inside = phrases.where("words > 2").select("lang", F.explode(F.array(*inner)).alias("phrase"), "a").where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = F.expr(f"longer IS NULL OR 100BD * {_long('longer')} < {cover}BD * {_long('a')}")
    return phrases.join(inside, ["lang", "phrase"], "left").where(kept).drop("longer")


def ranked(phrases: DataFrame, most: int = MOST) -> DataFrame:
    """The first ``most`` phrases of each language with their rank. Phrases are dealt by ranges of the order; a phrase's rank is
    its place in its range and the sizes of the language's ranges before."""
    spark = phrases.sparkSession
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    dealt = phrases.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("lang"), *order)
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = dealt.groupBy("lang", "part").agg(F.count("*").alias("size")).select("lang", "part", before.alias("before")).where(F.col("before") < most)
    rank = F.col("before") + F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    return dealt.join(first, ["lang", "part"]).withColumn("rank", rank).where(F.col("rank") <= most).drop("part", "before")


def report(docs: DataFrame, *, least: int = LEAST, most: int = MOST, longest: int = LONGEST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The contract's rows: of each language the first ``most`` phrases."""
    tables = frequent_phrases(docs, least=least, longest=longest, filter_bits=filter_bits)
    counts = tables[0].unionByName(tables[1]).unionByName(tables[2])
    weakest = stored(scored(counts, longest), "scored")
    best = ranked(uncovered(weakest, longest), most)
    words = tables[0].where("phrase IS NULL").select("lang", F.col("n"))
    out = best.join(words, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
    dropped(*tables[1:], weakest)
    return out
