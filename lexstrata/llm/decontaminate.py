"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. Training tokens stream through it and the
longest matching length is tracked at each word. A word is *hit* when it lies in a match of at
least ``window`` words, or in a whole item that is shorter. Runs of words that hold no pair of
neighbouring item words can't carry a match; numpy skips them before the automaton is entered.

Defined results: null and empty texts have no words and no hits; items without id or without words
are ignored; rows with repeated ids are scanned each for itself; extra columns are left alone; an
empty item table hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as bt
from .cluster import numbered, picked, text_rows

WINDOW = 10
#: Words of items in one automaton; a larger set of items is dealt over several, entered one after another.
SHARD_WORDS = 200_000


class SuffixAutomaton:
    """A generalised suffix automaton over word numbers, with the items that each state occurs in."""

    def __init__(self, items: list[tuple[object, list[int]]], window: int):
        self.window, self.link, self.length = window, [-1], [0]
        self.arcs: list[dict[int, int]] = [{}]
        paths = []
        for _, words in items:
            last, path = 0, []
            for w in words:
                last = self._extend(last, w)
                path.append(last)
            paths.append(path)
        self._mark(items, paths)
        self.pairs = sorted({a << 32 | b for _, words in items for a, b in zip(words, words[1:], strict=False)})
        self.shortest = min([window, *(len(words) for _, words in items)])

    def _new(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.arcs.append(arcs)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.arcs[q]))
        self.link[q] = copy
        while p >= 0 and self.arcs[p].get(w) == q:
            self.arcs[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.arcs[last].get(w)
        if q is not None:  # an earlier item holds this run already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.arcs[p]:
            self.arcs[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.arcs[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _mark(self, items: list[tuple[object, list[int]]], paths: list[list[int]]) -> None:
        """Of each state: the items of the window that ends there, and the short items that end there."""
        length, link, window = self.length, self.link, self.window
        at_window = [-1] * len(length)  # the suffix state that holds the last `window` words
        for s in sorted(range(len(length)), key=length.__getitem__):
            if length[s] >= window:
                at_window[s] = s if length[link[s]] < window else at_window[link[s]]
        found: dict[int, set] = {}
        short: dict[int, set] = {}
        for (item, words), path in zip(items, paths, strict=True):
            # a state split after the path was taken: walk again through the finished automaton
            state = 0
            for w in words:
                state = self.arcs[state][w]
                if at_window[state] >= 0:
                    found.setdefault(at_window[state], set()).add(item)
            if len(words) < window:
                short.setdefault(state, set()).add((len(words), item))
        self.windows = {s: frozenset(found[a]) for s, a in enumerate(at_window) if a in found}
        self.shorts: dict[int, tuple] = {}
        for s in sorted(range(len(length)), key=length.__getitem__):
            if more := (*short.get(s, ()), *self.shorts.get(link[s], ())):
                self.shorts[s] = more

    def scan(self, words: list[int], found: set) -> tuple[list[tuple[int, int]], int]:
        """Hit spans (half open, in order of their ends) and the longest match; adds the items to ``found``."""
        arcs, link, length, windows, shorts, window = self.arcs, self.link, self.length, self.windows, self.shorts, self.window
        state = run = longest = 0
        spans = []
        for i, w in enumerate(words):
            while (to := arcs[state].get(w)) is None and state:
                state = link[state]
                run = length[state]
            if to is None:
                run = 0
                continue
            state, run = to, run + 1
            longest = max(longest, run)
            if run >= window:
                spans.append((i + 1 - window, i + 1))
                found |= windows[state]
            for n, item in shorts.get(state, ()):
                if n <= run:
                    spans.append((i + 1 - n, i + 1))
                    found.add(item)
        return spans, longest


class Index:
    """The words of a shard of items, sorted by hash, and their automaton."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        texts = pa.array([t for _, t in items], pa.large_string())
        per_item: list[np.ndarray] = []
        for chunk in bt.chunks(texts):
            low = chunk.lowered()
            starts, ends, row = low.words(bt.ALNUM)
            h = low.hashes(starts, ends)
            cuts = np.searchsorted(row, np.arange(low.rows + 1))
            per_item += [h[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.words = np.unique(np.concatenate(per_item)) if per_item else np.zeros(0, np.uint64)
        numbered = [(i, np.searchsorted(self.words, h).tolist()) for (i, _), h in zip(items, per_item, strict=True) if len(h)]
        self.automaton = SuffixAutomaton(numbered, window)
        self.pairs = np.array(self.automaton.pairs, np.int64)

    def runs(self, ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of each maximal run of known word pairs that is long enough for a match."""
        if not len(ids):
            return ids, ids
        known = ids >= 0
        go_on = np.zeros(len(ids), bool)
        both = np.flatnonzero(known[:-1] & known[1:] & (row[:-1] == row[1:]))
        go_on[both[bt.find_sorted(self.pairs, ids[both] << 32 | ids[both + 1]) >= 0]] = True
        begins = known.copy()
        begins[1:] &= ~go_on[:-1]
        first, last = np.flatnonzero(begins), np.flatnonzero(known & ~go_on)
        long_enough = last - first + 1 >= self.automaton.shortest
        return first[long_enough], last[long_enough]


def build_indexes(items: DataFrame, window: int = WINDOW, id_column: str = "item_id", text_column: str = "text") -> list[Broadcast]:
    """Automata of all items, each of at most about ``SHARD_WORDS`` words, collected and broadcast shard by shard."""
    spark = items.sparkSession
    rows = items.select(F.col(id_column).alias("i"), F.coalesce(F.col(text_column), F.lit("")).alias("t")).where("i IS NOT NULL")
    size = rows.agg(F.sum(F.length("t") / 4)).first()[0] or 0
    shards = int(size // SHARD_WORDS) + 1
    out = []
    for k in range(shards):
        part = rows if shards == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k)
        out.append(spark.sparkContext.broadcast(Index([(r.i, r.t) for r in part.collect()], window)))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan_chunk(chunk: bt.Chunk, indexes: list[Broadcast]) -> tuple[np.ndarray, dict[int, list], dict[int, set], dict[int, int], np.ndarray, np.ndarray]:
    """Words of each row; by row the merged hit spans (word numbers in the chunk), items and longest match; byte bounds of words."""
    low = chunk.lowered()
    starts, ends, row = low.words(bt.ALNUM)
    h = low.hashes(starts, ends)
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    longest: dict[int, int] = {}
    for broadcast in indexes:
        index = broadcast.value
        ids = bt.find_sorted(index.words, h)
        for a, b in zip(*(x.tolist() for x in index.runs(ids, row)), strict=True):
            r = int(row[a])
            found: set = set()
            hit, most = index.automaton.scan(ids[a : b + 1].tolist(), found)
            longest[r] = max(longest.get(r, 0), most)
            if hit:
                spans.setdefault(r, []).extend((a + x, a + y) for x, y in hit)
                items.setdefault(r, set()).update(found)
        if len(indexes) > 1:
            broadcast.__dict__.pop("_value", None)  # one shard in memory at a time
    return np.bincount(row, minlength=chunk.rows), {r: _merged(s) for r, s in spans.items()}, items, longest, starts, ends


def _without(chunk: bt.Chunk, r: int, spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> str:
    """The text of a row without its spans."""
    parts, at = [], int(chunk.offsets[r])
    for a, b in spans:
        parts.append(chunk.buf[at : starts[a]].tobytes())
        at = int(ends[b - 1])
    return b"".join([*parts, chunk.buf[at : chunk.offsets[r + 1]].tobytes()]).decode()


def scan(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: words, hit words, matching items, longest match and the hit spans in bytes."""
    docs, items = picked(docs, id_column, text_column), picked(items, "item_id", "text")
    indexes = build_indexes(items, window)
    item_type = items.schema["item_id"].dataType
    rows = text_rows(docs, id_column, text_column)
    schema = T.StructType([
        T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(item_type)), T.StructField("longest_match", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_hit, longest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            ids: list[list] = [[] for _ in range(n)]
            cut: list[list] = [[] for _ in range(n)]
            for chunk in bt.chunks(bt.string_column(batch, text_column)):
                counts, spans, items_of, most, starts, ends = _scan_chunk(chunk, indexes)
                n_words[chunk.first : chunk.first + chunk.rows] = counts
                for r, m in most.items():
                    longest[chunk.first + r] = m if r in spans else 0
                for r, found in spans.items():
                    at, zero = chunk.first + r, int(chunk.offsets[r])
                    n_hit[at] = sum(b - a for a, b in found)
                    ids[at] = sorted(items_of[r], key=str)
                    cut[at] = [[int(starts[a]) - zero, int(ends[b - 1]) - zero] for a, b in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array(ids, pa.list_(_arrow(item_type))), pa.array(longest), pa.array(cut, pa.list_(pa.list_(pa.int64())))],
                names=schema.names,
            )

    return rows.mapInArrow(work, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def report(docs: DataFrame, items: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The digest rows of the contract: one per document."""
    ids = F.transform("item_ids", lambda x: x.cast("string"))
    return scan(docs, items, window=window).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest_match",
    )


def clean(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, max_coverage: float = 0.5, text_column: str = "text") -> DataFrame:
    """``docs`` without the spans that match items; a document of which more than ``max_coverage`` is hit goes entirely.
    Texts are scanned again after a cut until nothing matches.

    All columns of ``docs`` stay; ``n_chars``, where there is one, follows the new text.
    """
    indexes = build_indexes(picked(items, "item_id", "text"), window)
    rows = text_rows(numbered(docs), *[f"c{i}" for i in range(len(docs.columns))])
    place = docs.columns.index(text_column)
    has_length = "n_chars" in docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bt.string_column(batch, f"c{place}")
            keep = np.ones(batch.num_rows, bool)
            new: dict[int, str] = {}
            for chunk in bt.chunks(texts):
                counts, spans, _, _, starts, ends = _scan_chunk(chunk, indexes)
                for r, found in spans.items():
                    if sum(b - a for a, b in found) > max_coverage * counts[r]:
                        keep[chunk.first + r] = False
                    else:
                        new[chunk.first + r] = _without(chunk, r, found, starts, ends)
            seams = list(new)
            while seams:  # what a cut brings together can match again
                again = []
                for chunk in bt.chunks(pa.array([new[r] for r in seams], pa.large_string())):
                    _, spans, _, _, starts, ends = _scan_chunk(chunk, indexes)
                    for r, found in spans.items():
                        again.append(seams[chunk.first + r])
                        new[again[-1]] = _without(chunk, r, found, starts, ends)
                seams = again
            columns = list(batch.columns)
            if new:
                kind = columns[place].type
                values = columns[place].to_pylist()
                for r, text in new.items():
                    values[r] = text
                columns[place] = pa.array(values, kind)
                if has_length:
                    lengths = columns[docs_length].to_pylist()
                    for r, text in new.items():
                        lengths[r] = len(text)
                    columns[docs_length] = pa.array(lengths, columns[docs_length].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep))

    docs_length = docs.columns.index("n_chars") if has_length else -1
    return rows.mapInArrow(work, rows.schema).toDF(*docs.columns)


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
