"""Language-model scores from a weighted backoff automaton learned from the corpus itself.

Unigram counts cover every token of all training texts. Every word is a context, and every n-gram
that occurs twice or more is kept, up to ``order`` words. Smoothing is interpolated absolute
discounting, with discounts from all pairs and from all longer n-grams whose shorter parts are kept.
Each kept context is a state; its arcs hold smoothed log10 probabilities, and its failure arc leads to
the context without its first word, at the weight of the mass that is left. A traversal starts each
text at the root, follows an arc or fails towards the root, and adds the weights.

The sum over a traversal is taken apart by n-gram: a word adds the weight of its root arc and of its
failure arc, a longer n-gram what its arc has over failing to the shorter one, and its own failure
arc. So a text's score is a sum of one value for each n-gram in it, and the automaton is a table dealt
by hash that meets the n-grams of the texts in a shuffle. n-grams travel as blocks (:mod:`blocks`):

1. counts of n-grams are dealt by their context: a task then has whole states, their totals and arcs;
2. states and arcs are dealt by the n-gram's suffix: a task then has the weight after the failure arc;
3. values and the n-grams of texts are dealt by key, and the sums go back to the texts.

The most frequent words (``HEAD_WORDS`` at most) and n-grams (``ARCS`` at most a level) are also
broadcast, and so is a bitmap of all kept n-grams (``FILTER_BITS``): both only save rows of the
shuffle. Every count and score is exact at any size.

Defined results: null and empty texts are the end token only; rows without id are held out; with no
training text every probability is 1; repeated ids are scored row by row; n-grams of equal counts are
all kept or none, so ties decide nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from . import bytetext as bt
from .cluster import crc_mod, dropped, no_shuffle_left, picked, stored, text_rows

END = np.uint64(1)
NONE = np.uint64(0)
#: Sizes of the broadcast caches; no result depends on them.
HEAD_WORDS = 1 << 18
ARCS = 1 << 18
FILTER_BITS = 27
ORDER = 3
SHIFT = 20
#: n-grams, or sums of texts, that a task holds before it hands them on.
HELD = 1 << 19
#: Documents are scored in so many rounds by hash of their text, which bounds the shuffle's disk.
ROUNDS = 2
#: Kinds of blocks and their columns.
GRAM, KEPT, STATE, ARC, SINGLE, LOWER, WORD, VALUE, WORDS_OF, GRAMS_OF, TEXTS, WORD_SUMS, GRAM_SUMS = range(13)
_K, _C, _X = np.uint64, np.int64, np.float64
KINDS = {
    GRAM: (_K, _K, _C),  # context, suffix, count
    KEPT: (_K, _C),  # key, count
    STATE: (_K, _C, _C, _C),  # key, count, counts of its arcs, its arcs
    ARC: (_K, _K, _C, _C, _C, _C),  # key, suffix, count, and of its state: count, counts of arcs, arcs
    SINGLE: (_K,),  # suffix
    LOWER: (_K, _C, _X, _X),  # key, count, log10 probability, gain
    WORD: (_K, _X, _X),  # key, what it adds to the base score and to the score
    VALUE: (_K, _X),
    WORDS_OF: (_K, np.uint32),  # key, text
    GRAMS_OF: (_K, np.uint32),
    TEXTS: (np.uint8,),
    WORD_SUMS: (np.uint32, _C, _X, _X),  # text, known words, additions to both scores
    GRAM_SUMS: (np.uint32, _X),
}


def tokens(chunk: bt.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each row closed by the end token, and the row of each."""
    low = chunk.lowered()
    starts, ends, row = low.words(bt.NOT_SPACE)
    out = np.empty(len(row) + chunk.rows, np.uint64)
    rows = np.empty(len(out), np.int64)
    at = np.arange(len(row)) + row
    out[at], rows[at] = low.hashes(starts, ends), row
    last = np.searchsorted(row, np.arange(1, chunk.rows + 1)) + np.arange(chunk.rows)
    out[last], rows[last] = END, np.arange(chunk.rows)
    return out, rows


def cut_for(counts: DataFrame, most: int, least: int = 1) -> int:
    """The smallest count (``least`` at least) that at most ``most`` keys reach; found from a histogram of bounded size."""
    step = F.when(F.col("c") < 4096, F.col("c")).otherwise(F.pow(F.lit(2), F.ceil(F.log2("c"))).cast("long"))
    n, cut = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        n += r["count"]
        if n > most:
            break
        cut = r["step"] if r["step"] <= 4096 else r["step"] // 2 + 1
    return max(least, cut if cut is not None else 1 << 62)


class Automaton:
    """The whole model in memory, for small corpora and as a reference. Level n holds arcs out of contexts of n words: sorted keys, log10 weights, and failure weights by context."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, context_cut: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.denominator = total + 0.5 * (distinct + 1)
        self.root = np.log10((self.counts + 0.5) / self.denominator)
        context = np.flatnonzero(self.counts >= context_cut)
        self.context_of = np.full(len(self.hashes), -1, np.int64)
        self.context_of[context] = np.arange(len(context))
        self.context_hashes = self.hashes[context]
        self.context_totals = self.counts[context]
        self.context_root = self.root[context]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        #: Of each level's arcs, as states of the next: where their failure arcs lead.
        self.suffixes: list[np.ndarray] = []

    def contexts(self, t: np.ndarray) -> np.ndarray:
        return bt.find_sorted(self.context_hashes, t)

    def states(self, context: np.ndarray, row: np.ndarray, level: int) -> np.ndarray:
        """Of each token: the state of ``level`` words that ends with it, or -1."""
        state = context
        for keys, _, _ in self.levels[: level - 1]:
            after = np.full(len(state), -1, np.int64)
            on = np.flatnonzero((row[1:] == row[:-1]) & (state[:-1] >= 0) & (context[1:] >= 0)) + 1
            after[on] = bt.find_sorted(keys, state[on - 1] << SHIFT | context[on])
            state = after
        return state

    def add_level(self, keys: np.ndarray, counts: np.ndarray, discount: float) -> None:
        """Arcs of the next level; ``keys`` are state << SHIFT | word, states numbered as in the level below."""
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(float)
        totals = self.context_totals if not self.levels else self.arc_counts
        state, word = keys >> SHIFT, keys & ((1 << SHIFT) - 1)
        seen = np.bincount(state, counts - discount, minlength=len(totals)) / np.maximum(totals, 1)
        left = np.log10(np.maximum(1 - seen, 1e-12))
        p = (counts - discount) / totals[state] + 10 ** (left[state] + self._lower(state, word))
        suffixes = self._suffixes(keys)
        self.levels.append((keys, np.log10(p), left))
        self.suffixes.append(suffixes)
        self.arc_counts = counts

    def _lower(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 probability of ``word`` after the failure arc of ``state``."""
        if not self.levels:
            return self.context_root[word]
        return self._step(len(self.levels), self.suffixes[-1][state], word)

    def _suffixes(self, keys: np.ndarray) -> np.ndarray:
        """Of arcs of the next level, as states: the states one word shorter."""
        state, word = keys >> SHIFT, keys & ((1 << SHIFT) - 1)
        if not self.levels:
            return word
        found = bt.find_sorted(self.levels[-1][0], self.suffixes[-1][state] << SHIFT | word)
        if (found < 0).any():
            raise ValueError("an arc's suffix is no arc of the level below")
        return found

    def _step(self, level: int, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 probability of ``word`` after a state of ``level`` words."""
        keys, logs, left = self.levels[level - 1]
        at = bt.find_sorted(keys, state << SHIFT | word)
        lower = self.context_root[word] if level == 1 else self._step(level - 1, self.suffixes[level - 2][state], word)
        return np.where(at >= 0, logs[at] if len(logs) else 0.0, left[state] + lower)

    def traverse(self, t: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Left to right, all rows at once: the weight of each token, but for the unigram weight of words outside the head,
        and its place in the head or -1. Each row carries its state, the longest kept context that ends there: a token
        follows its arc, or the state's failure arc is taken and the token tried again."""
        head = bt.find_sorted(self.hashes, t)
        context = np.where(head >= 0, self.context_of[head], -1) if len(self.hashes) else head
        weight, first = np.zeros(len(t)), np.searchsorted(row, np.arange(row[-1] + 1 if len(row) else 0))
        length = np.diff(np.append(first, len(t)))
        level, state, most = np.zeros(len(first), np.int64), np.full(len(first), -1), len(self.levels)
        for step in range(length.max(initial=0)):
            live = np.flatnonzero(length > step)
            at, open_ = first[live] + step, np.ones(len(live), bool)
            for n in range(most, 0, -1):
                here = np.flatnonzero(open_ & (level[live] == n))
                keys, logs, left = self.levels[n - 1]
                s, w = state[live[here]], context[at[here]]
                arc = np.where(w >= 0, bt.find_sorted(keys, s << SHIFT | np.maximum(w, 0)), -1)
                taken, failed = here[arc >= 0], here[arc < 0]
                weight[at[taken]] += logs[arc[arc >= 0]]
                open_[taken] = False
                level[live[taken]] = min(n + 1, most)
                state[live[taken]] = arc[arc >= 0] if n < most else self.suffixes[n - 1][arc[arc >= 0]]
                weight[at[failed]] += left[s[arc < 0]]
                level[live[failed]] = n - 1
                state[live[failed]] = self.suffixes[n - 2][s[arc < 0]] if n > 1 else -1
            rest = np.flatnonzero(open_)
            known = rest[head[at[rest]] >= 0]
            weight[at[known]] += self.root[head[at[known]]]
            state[live[rest]] = context[at[rest]]
            level[live[rest]] = (context[at[rest]] >= 0) & (most > 0)
        return weight, head


def gram_keys(t: np.ndarray, row: np.ndarray, level: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n up to ``level``: keys of the n tokens that end at the places from n - 1 on, and which of them lie in one row.
    The key of a longer n-gram is that of its context and its suffix."""
    out = [(t, np.ones(len(t), bool))]
    for n in range(2, level + 1):
        key = out[-1][0]
        out.append((joint_key(key[:-1], key[1:], n), row[n - 1 :] == row[: max(0, len(row) - n + 1)]))
    return out


def joint_key(context: np.ndarray, suffix: np.ndarray, level: int) -> np.ndarray:
    return bt.mix(bt.mix(context + np.uint64(level)) + suffix)


def gram_blocks(rows: DataFrame, level: int, shared: Broadcast, buckets: int) -> DataFrame:
    """GRAM blocks, by context, of the n-grams of ``level`` words; ``shared`` is a bitmap of the shorter ones that are kept,
    or none. Pairs of the end token and none count the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = texts = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key := joint_key(a, b, level))
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            return a[order[first]], b[order[first]], np.add.reduceat(c[order], first)

        def out(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(a)  # equal contexts side by side take little of the compressed shuffle
            return blocks.dealt(GRAM, a[order], [a[order], b[order], c[order]], buckets)

        for batch in batches:
            for chunk in bt.chunks(bt.string_column(batch, "text")):
                t, row = tokens(chunk)
                texts += chunk.rows
                below = gram_keys(t, row, level - 1)[-1][0]
                here = row[level - 1 :] == row[: max(0, len(row) - level + 1)]
                if shared.value is not None:
                    kept = marked(shared.value, below)
                    here &= kept[:-1] & kept[1:]
                if not here.any():
                    continue
                held.append((below[:-1][here], below[1:][here], np.ones(int(here.sum()), np.int64)))
                size += len(held[-1][0])
                if size > HELD:
                    joined = merged()
                    if len(joined[0]) > HELD // 2:
                        yield out(*joined)
                        held, size = [], 0
                    else:
                        held, size = [joined], len(joined[0])
        if held:
            yield out(*merged())
        if texts and level == 2:
            yield blocks.dealt(GRAM, np.array([END]), [np.array([END]), np.array([NONE]), np.array([texts])], buckets)

    return blocks.mapped(rows, work)


def table_blocks(table: DataFrame, kind: int, columns: list[str], buckets: int) -> DataFrame:
    """Blocks, by the first of ``columns``, of a table's rows."""
    types = KINDS[kind]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            return blocks.dealt(kind, whole[0], whole, buckets)

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False).view(t) for c, t in zip(batch.columns, types, strict=True)])
            size += batch.num_rows
            if size > HELD:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    as_sql = {_K: "long", _C: "long", _X: "double"}
    rows = table.select(*[F.col(c).cast(as_sql[t]).alias(f"v{i}") for i, (c, t) in enumerate(zip(columns, types, strict=True))])
    return blocks.mapped(rows, work)


def _states(level: int, buckets: int):
    """Of the n-grams of each context: the state, by its own key, and its arcs, by their suffixes."""

    def work(found: Iterator[tuple[int, blocks.Found]]) -> Iterator[pa.RecordBatch]:
        going, singles = blocks.Outgoing(buckets, HELD), 0
        for _, parts in found:
            a, b, c = blocks.cat(parts, GRAM, KINDS[GRAM])
            order = np.argsort(key := joint_key(a, b, level))
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            key, a, b, c = key[first], a[order[first]], b[order[first]], np.add.reduceat(c[order], first) if len(first) else c
            order = np.argsort(a, kind="stable")
            key, a, b, c = key[order], a[order], b[order], c[order]
            start = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(a))))
            kept, once = (c >= 2) & (b != NONE), (c == 1) & (b != NONE)
            sums, arcs = (np.bincount(group, x, len(start)).astype(np.int64) for x in (np.where(kept, c, 0), kept))
            if level == 2:  # every word is a state; its count is that of its pairs
                total = np.add.reduceat(c, start) if len(start) else c
                yield from going.add(STATE, a[start], [a[start], total, sums, arcs], total)
                singles += int(once.sum())
            else:
                k, n = blocks.cat(parts, KEPT, KINDS[KEPT])
                order = np.argsort(k)
                place = bt.find_sorted(k[order], a[start])
                known = place >= 0  # the bitmap lets some contexts pass that aren't kept
                total = np.where(known, n[order][place] if len(n) else 0, 0)
                kept, once = kept & known[group], once & known[group]
                some = known & (arcs > 0)
                yield from going.add(STATE, a[start][some], [a[start][some], total[some], sums[some], arcs[some]])
                yield from going.add(SINGLE, b[once], [b[once]])
            g = group[kept]
            yield from going.add(ARC, b[kept], [key[kept], b[kept], c[kept], total[g], sums[g], arcs[g]])
        yield from going.rest()
        if level == 2:
            yield blocks.batch_of(np.zeros(1), SINGLE, np.array([0, 0]), np.array([singles]), [])

    return work


ARC_ROWS = "kind int, k long, c long, total long, sums long, arcs long, low double, gain double"


def _with_lower(level: int):
    """Rows of states and arcs; arcs with the log10 probability of their suffix, in pairs its count (as ``gain``: the total
    of all words isn't known yet)."""
    names = ["kind", "k", "c", "total", "sums", "arcs", "low", "gain"]
    batch = lambda kind, *columns: pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], names=names)

    def work(found: Iterator[tuple[int, blocks.Found]]) -> Iterator[pa.RecordBatch]:
        for _, parts in found:
            state, count, sums, arcs = blocks.cat(parts, STATE, KINDS[STATE])
            if level == 2:
                k, n, p, gain = state, count, np.zeros(len(state)), np.zeros(len(state))
            else:
                k, n, p, gain = blocks.cat(parts, LOWER, KINDS[LOWER])
            order = np.argsort(k)
            k, n, p, gain = (x[order] for x in (k, n, p, gain))
            taken = [np.zeros(len(k), np.int64) for _ in range(2)]
            for x, y in zip(taken, (sums, arcs), strict=True):
                x[bt.find_sorted(k, state)] = y
            yield batch(STATE, k.view(np.int64), n, n, *taken, p, gain)
            key, b, c, total, sums, arcs = blocks.cat(parts, ARC, KINDS[ARC])
            place = bt.find_sorted(k, b)
            yield batch(ARC, key.view(np.int64), c, total, sums, arcs, p[place], n[place].astype(float))
            (single,) = blocks.cat(parts, SINGLE, KINDS[SINGLE])
            if len(single):
                count, zero = np.array([(bt.find_sorted(k, single) >= 0).sum()]), np.zeros(1, np.int64)
                yield batch(SINGLE, zero, count, zero, zero, zero, np.zeros(1), np.zeros(1))

    return work


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2 ** ``bits`` places in which the places of all keys (k) are set."""
    place = F.shiftrightunsigned("k", 64 - bits) + 1
    # dealt before they are gathered: a key takes less of the shuffle than every task's own bitmap
    places = keys.select(F.bitmap_bucket_number(place).alias("block"), F.bitmap_bit_position(place).cast("int").alias("bit")).repartition(F.col("block"))
    with no_shuffle_left(keys.sparkSession):
        found = places.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("map")).toArrow()
    out = np.zeros(max(1, (1 << bits) >> 15) * 4096, np.uint8)
    for block, part in zip(found["block"].to_pylist(), found["map"].to_pylist(), strict=True):
        out[(block - 1) * 4096 : (block - 1) * 4096 + len(part)] = np.frombuffer(part, np.uint8)
    return out


def marked(parts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the place of each key is set; true for all keys in the bitmap and few others."""
    bits = max(15, (len(parts) * 8).bit_length() - 1)
    place = keys.view(np.uint64) >> np.uint64(64 - bits)
    return (parts[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


class Slots:
    """A table with one place for each key, where the first of the given keys with that place stays. It travels as the keys
    and columns given, and is built where it is first used."""

    def __init__(self, keys: np.ndarray, columns: list[np.ndarray]):
        self.given: tuple | None = (keys, columns)
        self.shift = np.uint64(64 - max(4, (len(keys) - 1).bit_length() + 1))

    def _build(self) -> None:
        (keys, columns), self.given = self.given, None
        place, first = np.unique((keys >> self.shift).astype(np.int64), return_index=True)
        size = 1 << (64 - int(self.shift))
        self.keys, self.columns = np.zeros(size, np.uint64), [np.zeros(size) for _ in columns]
        self.keys[place] = keys[first]
        for mine, given in zip(self.columns, columns, strict=True):
            mine[place] = given[first]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places, and which of them hold the key."""
        if self.given:
            self._build()
        place = (keys >> self.shift).astype(np.int64)
        return place, self.keys[place] == keys


class Cache:
    """The most frequent words (weights of root and failure arcs) and n-grams (values), and the bitmap of all n-grams."""

    def __init__(self, words: pa.Table, grams: list[pa.Table], denominator: float, bits: np.ndarray):
        self.bits, self.unknown = bits, np.log10(0.5 / denominator)
        column = lambda t, c: t[c].to_numpy()
        order = np.argsort(-column(words, "c"), kind="stable")
        root = np.log10((column(words, "c") + 0.5) / denominator)
        self.words = Slots(column(words, "k").view(np.uint64)[order], [root[order], column(words, "fail")[order]])
        self.grams = []
        for t in grams:
            order = np.argsort(-column(t, "c"), kind="stable")
            self.grams.append(Slots(column(t, "k").view(np.uint64)[order], [column(t, "value")[order]]))


class Learned:
    """The broadcast cache, all words (k, c, fail) and all kept n-grams (k, value) as tables, and totals."""

    def __init__(self, cache: Cache, words: DataFrame, grams: list[DataFrame], total: int, denominator: float, tables: list[DataFrame]):
        self.cache, self.words, self.grams, self.total, self.denominator, self.stored = cache, words, grams, total, denominator, tables


def learn(train: DataFrame, *, head_words: int = HEAD_WORDS, context_words: int | None = None, arcs: int = ARCS, order: int = ORDER, filter_bits: int = FILTER_BITS) -> Learned:
    """The automaton of ``train`` (column text). ``context_words`` bounds nothing: all words are contexts."""
    buckets = blocks.bucket_count(train.sparkSession)
    below: DataFrame | None = None  # kept n-grams of the level below: k, c, p, gain
    words: DataFrame | None = None
    grams: list[DataFrame] = []
    total, denominator, tables = 0, 0.0, []
    for level in range(2, order + 1):
        shared = train.sparkSession.sparkContext.broadcast(None if below is None else bitmap(below, filter_bits))
        counted = gram_blocks(train, level, shared, buckets)
        if below is not None:
            counted = counted.unionByName(table_blocks(below, KEPT, ["k", "c"], buckets))
        states = stored(blocks.reduced(counted, KINDS, _states(level, buckets)), f"states-{level}")
        shared.destroy()
        if level == 2:
            total, distinct, once = states.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0)) for kind, c in ((STATE, "weight"), (STATE, "n"), (SINGLE, "weight"))]).first()
            denominator = total + 0.5 * (distinct + 1)
        lower = states.where((F.col("kind") != SINGLE) | (F.col("n") > 0))
        if below is not None:
            lower = lower.unionByName(table_blocks(below, LOWER, ["k", "c", "p", "gain"], buckets))
        rows = stored(blocks.reduced(lower, KINDS, _with_lower(level), ARC_ROWS), f"arcs-{level}")
        tables.append(rows)
        dropped(states)
        single, twice = rows.agg(F.coalesce(F.sum(F.when(F.col("kind") == SINGLE, F.col("c"))), F.lit(0)), F.count_if((F.col("kind") == ARC) & (F.col("c") == 2))).first()
        once = once if level == 2 else single
        discount = once / (once + 2 * twice) if once and twice else 0.5

        def fail(count: Column, discount: float = discount) -> Column:
            return F.log10(F.greatest(1 - (F.col("sums") - discount * F.col("arcs")) / count, F.lit(1e-12)))

        state = rows.where(F.col("kind") == STATE).withColumn("fail", fail(F.col("c")))
        lower = F.log10((F.col("gain") + 0.5) / F.lit(denominator)) if level == 2 else F.col("low")
        p = F.log10((F.col("c") - discount) / F.col("total") + F.pow(F.lit(10.0), fail(F.col("total")) + lower))
        if level == 2:
            words = state.select("k", "c", "fail")
        else:
            grams.append(state.select("k", "c", (F.col("gain") + F.col("fail")).alias("value")))
        below = rows.where(F.col("kind") == ARC).select("k", "c", p.alias("p"), (p - fail(F.col("total")) - lower).alias("gain"))
    grams.append(below.select("k", "c", F.col("gain").alias("value")))
    head = words.where(F.col("c") >= cut_for(words, head_words)).toArrow()
    often = [x.where(F.col("c") >= cut_for(x, arcs, 2)).toArrow() for x in grams]
    keys = grams[0].select("k")
    for more in grams[1:]:
        keys = keys.unionAll(more.select("k"))
    return Learned(Cache(head, often, denominator, bitmap(keys, filter_bits)), words, grams, total, denominator, tables)


class _Sums:
    """Sums for each text of each home, gathered over the buckets of a task; a bounded number is held."""

    def __init__(self, kind: int):
        self.kind, self.held, self.size = kind, [], 0

    def add(self, *rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(rows)
        self.size += len(rows[0])
        if self.size > HELD:
            joined = self._merged()
            if len(joined[0]) > HELD // 2:
                self.held, self.size = [], 0
                yield self._blocks(joined)
            else:
                self.held, self.size = [joined], len(joined[0])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield self._blocks(self._merged())

    def _merged(self) -> tuple:
        home, text, *sums = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((text, home))
        home, text = home[order], text[order]
        first = np.flatnonzero(np.append(True, (home[1:] != home[:-1]) | (text[1:] != text[:-1])))
        return home[first], text[first], *(np.add.reduceat(x[order], first) for x in sums)

    def _blocks(self, rows: tuple) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))
        return blocks.batch_of(rows[0][cuts], self.kind, np.append(cuts, len(rows[0])), np.zeros(len(cuts)), list(rows[1:]))


def _look_up(found: Iterator[tuple[int, blocks.Found]]) -> Iterator[pa.RecordBatch]:
    """Of the words and n-grams of texts in a bucket: sums for each text, by the texts' own block."""
    words, grams = _Sums(WORD_SUMS), _Sums(GRAM_SUMS)
    for _, parts in found:
        for home, (raw,) in parts.get(TEXTS, []):
            yield blocks.batch_of(np.array([home]), TEXTS, np.array([0, len(raw)]), np.array([home]), [raw])
        for table, asked, sums in ((WORD, WORDS_OF, words), (VALUE, GRAMS_OF, grams)):
            if asked not in parts or table not in parts:
                continue
            known, *values = blocks.cat(parts, table, KINDS[table])
            key, text = blocks.cat(parts, asked, KINDS[asked])
            home = np.repeat([w for w, _ in parts[asked]], [len(c[0]) for _, c in parts[asked]])
            order = np.argsort(known)
            place = bt.find_sorted(known[order], key)
            on = np.flatnonzero(place >= 0)
            place = order[place[on]]
            counts = [np.ones(len(on), np.int64)] if table == WORD else []
            yield from sums.add(home[on], text[on], *counts, *(v[place] for v in values))
    yield from words.rest()
    yield from grams.rest()


def score(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", fold: int = 5, **bounds) -> DataFrame:
    """The contract's rows: every text scored by the base formula and by the automaton."""
    docs = picked(docs, id_column, text_column)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = text_rows(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.coalesce(crc_mod(id_column, fold) == 1, F.lit(True)).alias("held_out")), "doc_id", "held_out", "text")
    model = learn(rows.where("NOT held_out").select("text"), **bounds)
    order, total, buckets = bounds.get("order", ORDER), model.total, blocks.bucket_count(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.cache)
    part_names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, home = shared.value, TaskContext.get().partitionId() << 32
        parts: list[pa.RecordBatch] = []
        asked: dict[int, list] = {WORDS_OF: [], GRAMS_OF: []}
        n = size = 0

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_batch(table)
            raw = np.frombuffer(sink.getvalue(), np.uint8)
            yield blocks.batch_of(np.array([home % buckets]), TEXTS, np.array([0, len(raw)]), np.array([home]), [raw])
            for what, pieces in asked.items():
                key, text = (np.concatenate(x) for x in zip(*pieces, strict=True))
                yield blocks.dealt(what, key, [key, text.astype(np.uint32)], buckets, weight=home)

        for batch in batches:
            for chunk in bt.chunks(bt.string_column(batch, "text")):
                t, row = tokens(chunk)
                place, head = cache.words.find(t)
                root, fail = (np.where(head, c[place], 0.0) for c in cache.words.columns)
                base = np.bincount(row, root + np.where(head, 0.0, cache.unknown), chunk.rows)
                value = base + np.bincount(row, fail, chunk.rows)
                asked[WORDS_OF].append((t[~head], row[~head] + n))
                for level, (key, inside) in enumerate(gram_keys(t, row, order)[1:]):
                    place, hit = cache.grams[level].find(key)
                    ends = row[level + 1 :]
                    hit &= inside
                    value += np.bincount(ends[hit], cache.grams[level].columns[0][place[hit]], chunk.rows)
                    rest = np.flatnonzero(inside & ~hit)
                    rest = rest[marked(cache.bits, key[rest])]
                    asked[GRAMS_OF].append((key[rest], ends[rest] + n))
                    size += len(rest)
                size += int((~head).sum())
                ids = [batch.column(i).slice(chunk.first, chunk.rows) for i in (0, 1)]
                parts.append(pa.RecordBatch.from_arrays([*ids, *map(pa.array, (np.bincount(row, minlength=chunk.rows), np.bincount(row[head], minlength=chunk.rows), base, value))], names=part_names))
                n += chunk.rows
                if size > HELD or n > HELD // 16:
                    yield from out()
                    home, parts, asked, n, size = home + 1, [], {WORDS_OF: [], GRAMS_OF: []}, 0, 0
        if parts:
            yield from out()

    def finish(found: Iterator[tuple[int, blocks.Found]]) -> Iterator[pa.RecordBatch]:
        for _, parts in found:
            for _, (raw,) in parts[TEXTS]:
                (part,) = pa.ipc.open_stream(pa.py_buffer(raw.tobytes()))
                text, *sums = blocks.cat(parts, WORD_SUMS, KINDS[WORD_SUMS])
                gram_text, gained = blocks.cat(parts, GRAM_SUMS, KINDS[GRAM_SUMS])
                ids, numbers = part.columns[:3], [c.to_numpy() for c in part.columns[3:]]
                more = [np.bincount(text, x, part.num_rows) for x in sums]
                more[2] = more[2] + np.bincount(gram_text, gained, part.num_rows)
                known = numbers[0] + more[0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([*ids, pa.array(known), pa.array(np.full(part.num_rows, total, np.int64)), *(pa.array(a + b) for a, b in zip(numbers[1:], more[1:], strict=True))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    weight = F.log10((F.col("c") + 0.5) / F.lit(float(model.denominator))) - F.lit(float(model.cache.unknown))
    words = model.words.select("k", weight.alias("base"), (weight + F.col("fail")).alias("value"))
    part = F.pmod(F.xxhash64("text"), F.lit(ROUNDS))
    scored = []
    for turn in range(ROUNDS):
        asked = blocks.mapped(rows.where(part == turn), work).unionByName(table_blocks(words, WORD, ["k", "base", "value"], buckets))
        for grams in model.grams:
            asked = asked.unionByName(table_blocks(grams, VALUE, ["k", "value"], buckets))
        sums = blocks.reduced(asked, KINDS, _look_up)
        scored.append(stored(blocks.reduced(sums, KINDS, finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), f"scores-{turn}"))
    shared.destroy()
    dropped(*model.stored)
    return functools.reduce(DataFrame.unionByName, scored)
