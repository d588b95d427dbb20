"""Counts of n-grams that travel in blocks (A6-A8, C-4).

A task counts the n-grams of some two million words at a time and deals them to parts by the hashes of words. What it has for a
part is one row: the words that occur there, once, and the n-grams as columns of their places in that list, compressed. Words
themselves are compared wherever counts are put together; hashes only say which part a row goes to. A part's memory is that of its
distinct n-grams, so ``spark.sql.shuffle.partitions`` must follow the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOS = "<BOS>"
#: Words that are counted at once, fewer than 2^21: three of their numbers make one key. Rows that a part holds before it sums them.
WORDS, ROWS = (1 << 21) - 64, 1 << 22
#: Parts for each shuffle partition, bytes of a batch of blocks, rows of a batch of counts.
PARTS, BATCH, OUT = 2, 1 << 20, 1 << 14
#: Bits of the map of prefixes that are asked for; it only spares rows.
BITS = 1 << 23
SCHEMA = "part long, kind int, owner string, words int, n int, size int, text binary, ids binary"
#: Spark's own settings: a write removes its shuffle files when it ends; the bytes of a batch that Python gets; partitions that a
#: task writes at once, without sorting its rows by them.
CLEANUP, BATCH_KEY, WRITERS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.maxConcurrentOutputFileWriters"

#: Words, a column of their places for each word of the n-grams, how often each n-gram was seen.
Counts = tuple[pa.Array, list[np.ndarray], np.ndarray]


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Writes meanwhile leave no shuffle files, get small batches and don't sort by a few partitions."""
    wanted = {CLEANUP: "true", BATCH_KEY: str(BATCH), WRITERS: "32"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def summed(columns: list[np.ndarray], n: np.ndarray | None, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of ``columns`` (numbers below ``words``) in their order, and the sums of ``n`` (one a row without it)."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    bits = max(1, (words - 1).bit_length())
    if bits * len(columns) <= 63:
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key = key << bits | c
        if n is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        found, mask = key[first], (1 << bits) - 1
        columns = [(found >> bits * i & mask).astype(np.int32) for i in range(len(columns) - 1, -1, -1)]
    else:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        first = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))
        n, size = None if n is None else n[order], len(columns[0])
        columns, key = [c[first] for c in columns], np.empty(size)
    return columns, np.diff(np.append(first, len(key))) if n is None else np.add.reduceat(n, first)


def chunks(batches: Iterator[pa.RecordBatch], order: int, most: int = WORDS) -> Iterator[tuple[pa.Array, list[np.ndarray], np.ndarray, pa.Table]]:
    """Of some words at a time: the distinct ones, the n-grams as columns of their numbers, padded at a text's start, the row of each
    n-gram, and the rows (their last column, ``tokens``, left out). Texts of any length are cut, n-grams aren't."""

    def cut(held: list[pa.RecordBatch]) -> Iterator:
        tokens = [b.column(b.num_columns - 1) for b in held]
        flat, size = pa.concat_arrays([t.flatten() for t in tokens]), np.concatenate([pc.fill_null(pc.list_value_length(t), 0).to_numpy() for t in tokens])
        rows = pa.Table.from_batches(held).drop_columns("tokens")
        row, ends = np.repeat(np.arange(len(size)), size), np.cumsum(size)
        place = np.arange(len(flat)) - np.repeat(ends - size, size)
        for start in range(0, len(flat), most):
            end, before = min(start + most, len(flat)), max(0, start - order)
            coded = flat[before:end].dictionary_encode()
            ids, columns = coded.indices.to_numpy(), []
            for back in range(order, -1, -1):
                there = place[start:end] >= back
                column = np.full(end - start, len(coded.dictionary), np.int32)
                column[there] = ids[np.flatnonzero(there) + (start - back - before)]
                columns.append(column)
            yield pa.concat_arrays([coded.dictionary, pa.array([BOS], coded.dictionary.type)]), columns, row[start:end], rows

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column(batch.num_columns - 1).flatten())
        if size >= most:
            yield from cut(held)
            held, size = [], 0
    if size:
        yield from cut(held)


def hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def mixed(hashed: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """A hash of the words of ``columns`` together."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out ^ hashed[c]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _block(words: pa.Array, columns: list[np.ndarray], n: np.ndarray) -> tuple[int, int, int, bytes, bytes]:
    used, places = np.unique(np.concatenate(columns), return_inverse=True)
    own = words.take(pa.array(used))
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), "\n")[0].as_py().encode()  # no word holds a line feed
    places = places.reshape(len(columns), -1).astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
    places[0] = np.diff(places[0], prepend=places.dtype.type(0))
    return len(used), len(n), len(text), pa.compress(text, codec="zstd", asbytes=True), pa.compress(places.tobytes() + n.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)


def _counts(words: int, n: int, size: int, text: bytes, ids: bytes, width: int) -> Counts:
    raw = np.frombuffer(pa.decompress(text, decompressed_size=size, codec="zstd"), np.uint8)
    kind = np.dtype(np.uint16 if words <= 1 << 16 else np.uint32)
    body = np.frombuffer(pa.decompress(ids, decompressed_size=n * (width * kind.itemsize + 4), codec="zstd"), np.uint8)
    cut = n * width * kind.itemsize
    places = body[:cut].view(kind).reshape(width, n)
    breaks = np.flatnonzero(raw == 10)
    # what stands between line feeds
    offsets = np.concatenate([[0], breaks - np.arange(len(breaks)), [size - len(breaks)]]).astype(np.int32)
    own = pa.StringArray.from_buffers(words, pa.py_buffer(offsets), pa.py_buffer(raw[raw != 10]))
    return own, [np.cumsum(places[0], dtype=kind).astype(np.int32), *[p.astype(np.int32) for p in places[1:]]], body[cut:].view(np.uint32).astype(np.int64)


def united(blocks: list[Counts], *, ordered: bool = False) -> Counts:
    """The counts of all blocks together; ``ordered`` by the words themselves."""
    coded = pa.chunked_array([b[0] for b in blocks]).dictionary_encode().unify_dictionaries()
    words = coded.chunk(0).dictionary
    numbers = [c.indices.to_numpy() for c in coded.chunks]
    if ordered:
        order = pc.sort_indices(words)
        rank = np.empty(len(words), np.int32)
        rank[order.to_numpy()] = np.arange(len(words), dtype=np.int32)
        words, numbers = words.take(order), [rank[x] for x in numbers]
    columns = [np.concatenate([x[b[1][i]] for x, b in zip(numbers, blocks, strict=True)]) for i in range(len(blocks[0][1]))]
    return words, *summed(columns, np.concatenate([b[2] for b in blocks]), len(words))


def parts_of(spark: SparkSession) -> int:
    return PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(docs: DataFrame, kinds: list[tuple[int, slice]], parts: int, *, order: int = 2, by: str | None = None, home: Column | None = None) -> DataFrame:
    """Blocks of the n-grams of ``docs`` (columns text and ``by``, a string that isn't null), in tasks by part. For each of ``kinds``,
    (depth, words): those of depth + 1 words, dealt to ``parts`` by the hash of some of their words, and by ``home``, an integer
    that follows from ``by``."""
    from .ngrams import sequences

    most = WORDS
    named = docs.select("text", (F.col(by) if by else F.lit("")).alias("owner"), (F.lit(0) if home is None else home).cast("long").alias("home"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, columns, row, rows in chunks(batches, order, most):
            owners = rows["owner"].combine_chunks().dictionary_encode()
            names, owner = owners.dictionary.to_pylist(), owners.indices.to_numpy().astype(np.int32)
            homes = np.zeros(len(names), np.int64)
            homes[owner] = rows["home"].to_numpy()
            hashed, ready, size = hashes(words), [], 0
            for depth, chosen in kinds:
                (who, *found), n = summed([owner[row], *columns[order - depth :]], None, max(len(words), len(names)))
                # from 0 to parts - 1
                share = (mixed(hashed, found[chosen]) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
                part = homes[who] * parts + share.astype(np.int64)
                at = np.lexsort((part, who))
                who, part, n, found = who[at], part[at], n[at], [c[at] for c in found]
                cuts = [*np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (who[1:] != who[:-1]))).tolist(), len(part)]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    ready.append((int(part[i]), depth, names[who[i]], *_block(words, [c[i:j] for c in found], n[i:j])))
                    size += len(ready[-1][-1]) + len(ready[-1][-2])
                    if size > BATCH:
                        yield _batch(ready)
                        ready, size = [], 0
            if ready:
                yield _batch(ready)

    blocks = sequences(named, "owner", "home").mapInArrow(work, SCHEMA)
    return blocks.repartition("part").sortWithinPartitions("part", "owner", "kind")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "kind", "owner", "words", "n", "size", "text", "ids"])


def by_part(blocks: DataFrame, work: Callable[[int, int, str, Counts], Iterator[pa.RecordBatch]], schema: str, *, ordered: bool = False) -> DataFrame:
    """What ``work`` makes of the counts of each part, kind and owner."""
    most = ROWS

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, rows, least = None, [], 0, most
        for batch in batches:
            for r in batch.to_pylist():
                own = r["part"], r["kind"], r["owner"]
                if own != key:
                    if held:
                        yield from work(*key, united(held, ordered=ordered))
                    key, held, rows, least = own, [], 0, most
                held.append(_counts(r["words"], r["n"], r["size"], r["text"], r["ids"], r["kind"] + 1))
                rows += r["n"]
                if rows > least:
                    held = [united(held)]
                    rows = len(held[0][2])
                    least = max(most, 2 * rows)
        if held:
            yield from work(*key, united(held, ordered=ordered))

    return blocks.mapInArrow(each, schema)


def asked_transitions(docs: DataFrame, prefixes: DataFrame, *, order: int = 2, by: str) -> DataFrame:
    """The rows of :func:`~lexstrata.operators.ngrams.transitions` by one column (strings, none null) for ``prefixes`` (column
    prefix): one pass over the texts counts all depths. A map of hashes passes most others over; those that are left meet the
    prefixes themselves."""
    from .ngrams import sequences

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for prefix in batch.column(0).to_pylist():
                own = pa.array(prefix.split(" ") if prefix else [], pa.string())
                at = mixed(hashes(own), [np.array([i]) for i in range(len(own))])[0] % np.uint64(BITS) if len(own) else 0
                yield pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int32()), pa.array([int(at)], pa.int64())], names=["depth", "place"])

    wanted = prefixes.select("prefix").distinct()
    table = wanted.mapInArrow(places, "depth int, place long").distinct().toArrow()
    depth, place = table["depth"].to_numpy(), table["place"].to_numpy()
    maps = {}
    for d in range(order + 1):
        bits = np.zeros(BITS, bool)
        bits[place[depth == d]] = True
        maps[d] = np.packbits(bits, bitorder="little") if bits.any() else None
    most = WORDS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, columns, row, rows in chunks(batches, order, most):
            owners = rows[by].combine_chunks().dictionary_encode()
            owner, hashed = owners.indices.to_numpy().astype(np.int32)[row], hashes(words)
            for d in range(order, -1, -1):
                if maps[d] is None:
                    continue
                own = columns[order - d :]
                if d:
                    at = mixed(hashed, own[:-1]) % np.uint64(BITS)
                    there = np.flatnonzero(maps[d][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                else:
                    there = np.arange(len(row))
                (who, *found), n = summed([owner[there], *[c[there] for c in own]], None, max(len(words), len(owners.dictionary)))
                for i in range(0, len(n), OUT):
                    told = [words.take(pa.array(c[i : i + OUT])) for c in found]
                    prefix = pc.binary_join_element_wise(*told[:-1], " ") if d else pa.repeat(pa.scalar(""), len(told[0]))
                    yield pa.RecordBatch.from_arrays([owners.dictionary.take(pa.array(who[i : i + OUT])), pa.array(np.full(len(told[0]), d, np.int32)), prefix, told[-1], pa.array(n[i : i + OUT].astype(np.int64))], names=[by, "depth", "prefix", "target", "n"])

    counted = sequences(docs, by).mapInArrow(work, f"{by} string, depth int, prefix string, target string, n long")
    return counted.join(wanted, "prefix", "left_semi").groupBy(by, "depth", "prefix", "target").agg(F.sum("n").alias("n"))


def transitions_by_home(docs: DataFrame, home: Column, parts: int, *, order: int = 2, by: str) -> DataFrame:
    """The rows of :func:`~lexstrata.operators.ngrams.transitions` by one column (strings, none null), with ``home`` (an integer that
    follows from ``by``) as a column: one pass over the texts and one shuffle. N-grams of all ``order`` + 1 words are dealt by
    the last two, and so are those of every shorter prefix that they hold; single words are dealt by themselves."""

    def work(part: int, kind: int, owner: str, counts: Counts) -> Iterator[pa.RecordBatch]:
        words, columns, n = counts
        for depth in range(kind, min(kind, 1) - 1, -1):
            if depth < kind:
                columns, n = summed(columns[1:], n, len(words))
            for i in range(0, len(n), OUT):
                told = [words.take(pa.array(c[i : i + OUT])) for c in columns]
                size = len(told[0])
                fixed = [pa.array(np.full(size, x, np.int32)) for x in (part // parts, depth)]
                prefix = pc.binary_join_element_wise(*told[:-1], " ") if depth else pa.repeat(pa.scalar(""), size)
                yield pa.RecordBatch.from_arrays([fixed[0], pa.repeat(pa.scalar(owner), size), fixed[1], prefix, told[-1], pa.array(n[i : i + OUT].astype(np.int64))], names=["home", by, "depth", "prefix", "target", "n"])

    kinds = [(d, slice(-2, None)) for d in dict.fromkeys((order, 0))]
    return by_part(dealt(docs, kinds, parts, order=order, by=by, home=home), work, f"home int, {by} string, depth int, prefix string, target string, n long", ordered=True)


def symbol_wave(docs: DataFrame, *, order: int = 2) -> DataFrame:
    """(token, amplitude): what :func:`~lexstrata.operators.ngrams.symbol_energy` gives for all transitions of ``docs``. N-grams are
    dealt by prefix; what leaves a task are sums by word."""

    def work(part: int, kind: int, owner: str, counts: Counts) -> Iterator[pa.RecordBatch]:
        words, columns, n = counts
        prefix = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)))
        total = np.repeat(np.add.reduceat(n, prefix), np.diff(np.append(prefix, len(n))))
        energy = np.bincount(columns[-1], n / total, len(words))
        seen = np.bincount(columns[-1], n, len(words)) if kind == 1 else np.zeros(len(words))
        on = energy > 0
        for i in range(0, int(on.sum()), OUT):
            there = np.flatnonzero(on)[i : i + OUT]
            yield pa.RecordBatch.from_arrays([words.take(pa.array(there)), pa.array(energy[there]), pa.array(seen[there].astype(np.int64))], names=["token", "energy", "n"])

    blocks = dealt(docs, [(d, slice(0, d)) for d in range(order, 0, -1)], parts_of(docs.sparkSession), order=order)
    sums = by_part(blocks, work, "token string, energy double, n long").groupBy("token").agg(F.sum("energy").alias("energy"), F.sum("n").alias("n"))
    from ..sources.shared import stored

    sums = stored(sums, "energies")
    total = sums.agg(F.sum("n").alias("total"))
    whole = sums.join(F.broadcast(total)).select("token", (F.col("energy") + F.col("n") / F.col("total")).alias("energy"))
    norm = whole.agg(F.sqrt(F.sum(F.col("energy") * F.col("energy"))).alias("norm"))
    return whole.join(F.broadcast(norm)).select("token", (F.col("energy") / F.col("norm")).alias("amplitude"))
