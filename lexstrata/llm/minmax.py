"""Near-duplicates by min-max hashing: each permutation gives both its minimum and its maximum.

A document's set is its distinct word shingles. Half as many permutations as signature values are
evaluated; the values are banded four at a time. Equal sets are joined on a digest first, so copies
never meet in a band. In each bucket all documents are compared with its smallest id on their full
sets; where a bucket of three or more still spans several components, its members are compared with
each other in blocks, so no link that a bucket holds is lost and no list of all pairs is made.

Defined results: documents without words or text have an empty set and link with nothing; repeated
ids are one node and every row is returned; rows without id link with nothing and are kept; extra
columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .cluster import numbered, picked, stored, text_rows
from .graph import components

#: Row numbers within a chunk take so many bits; shingle hashes keep the rest.
ROW_BITS = 10
BAND_ROWS = 4
#: Candidate ids up to so many are sent to all executors; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
BLOCK = 256


def shingle_sets(chunk: bt.Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows (54 bits, sorted within a row), and the row of each."""
    low = chunk.lowered()
    starts, ends, row = low.words(bt.NOT_SPACE)
    h = low.hashes(starts, ends)
    g, first = bt.grams(h, row, size)
    keys = (row[first].astype(np.uint64) << np.uint64(64 - ROW_BITS)) | (g >> np.uint64(ROW_BITS))
    count = np.bincount(row, minlength=chunk.rows)
    for n in range(1, size):  # texts of fewer words are one shingle
        g, first = bt.grams(h, row, n)
        short = count[row[first]] == n
        keys = np.append(keys, (row[first[short]].astype(np.uint64) << np.uint64(64 - ROW_BITS)) | (bt.mix(g[short] + np.uint64(n)) >> np.uint64(ROW_BITS)))
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return keys & np.uint64((1 << 64 - ROW_BITS) - 1), (keys >> np.uint64(64 - ROW_BITS)).astype(np.int64)


def min_max(values: np.ndarray, bounds: np.ndarray, permutations: int) -> np.ndarray:
    """Signatures of non-empty sets: for each permutation its minimum and its maximum."""
    factors = np.random.default_rng(11).integers(1, 2**62, permutations, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    spread = bt.mix(values)
    out = np.empty((len(bounds), 2 * permutations), np.uint64)
    for j, a in enumerate(factors):
        p = spread * a
        np.minimum.reduceat(p, bounds, out=out[:, 2 * j])
        np.maximum.reduceat(p, bounds, out=out[:, 2 * j + 1])
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    n = signature.shape[1] // BAND_ROWS
    out = np.zeros((len(signature), n), np.uint64)
    for i in range(BAND_ROWS):
        out = bt.mix(out + signature[:, i::BAND_ROWS][:, :n])
    return bt.mix(out + np.arange(n, dtype=np.uint64)).astype(np.int64)


def signatures(docs: DataFrame, *, shingle: int, permutations: int, id_column: str, text_column: str) -> DataFrame:
    """(id, n, lo, hi, bands): size and 128-bit digest of each set and the hashes of its bands."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = text_rows(docs, id_column, text_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            lo, hi = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            bands = np.zeros((batch.num_rows, 2 * permutations // BAND_ROWS), np.int64)
            for chunk in bt.chunks(bt.string_column(batch, text_column)):
                values, row = shingle_sets(chunk, shingle)
                if not len(values):
                    continue
                bounds = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                at = chunk.first + row[bounds]
                n[at] = np.diff(np.append(bounds, len(values)))
                lo[at] = np.add.reduceat(bt.mix(values + np.uint64(1)), bounds)
                hi[at] = np.add.reduceat(bt.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds)
                bands[at] = _bands(min_max(values, bounds, permutations))
            width = bands.shape[1]
            offsets = np.append(0, np.cumsum(np.where(n > 0, width, 0))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[n > 0].ravel()))],
                names=["id", "n", "lo", "hi", "bands"],
            )

    return rows.mapInArrow(work, f"id {kind}, n long, lo long, hi long, bands array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, *, shingle: int, id_column: str, text_column: str) -> DataFrame:
    """(id, grams): the whole sets of the documents in ``ids``; one row for each of theirs."""
    kind = docs.schema[id_column].dataType.simpleString()
    wanted = ids.select(F.col("id").alias("wanted_id")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    some = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(wanted, F.col("id") == F.col("wanted_id"), "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in bt.chunks(bt.string_column(batch, "text")):
                values, row = shingle_sets(chunk, shingle)
                offsets = np.searchsorted(row, np.arange(chunk.rows + 1)).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows), grams], names=["id", "grams"])

    return text_rows(some, "id", "text").mapInArrow(work, f"id {kind}, grams array<long>")


def _verify_block(percent: int):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        """Links between members of different components of one bucket (or of two blocks of it), as far as they join components."""
        first, second = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        # an id of several texts has a row for each
        group = group.assign(n=group["grams"].map(len), digest=[hash(np.sort(g).tobytes()) for g in group["grams"]])
        group = group.drop_duplicates(["id", "digest"]).sort_values(["n", "id"])
        ids, sizes, block = group["id"].to_numpy(), group["n"].to_numpy(), group["block"].to_numpy()
        sets = [np.asarray(g) for g in group["grams"]]
        root = dict(zip(group["component"], group["component"], strict=True))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        own, out = group["component"].to_numpy(), []
        for a in range(len(ids)):
            most = int(np.searchsorted(sizes, sizes[a] * 100 / percent, "right"))
            for b in range(a + 1, most):
                if first != second and block[a] == block[b]:
                    continue
                x, y = find(own[a]), find(own[b])
                if x == y:
                    continue
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * common >= percent * (sizes[a] + sizes[b] - common):
                    root[max(x, y)] = min(x, y)
                    out.append((ids[a], ids[b]))
        return pd.DataFrame(out, columns=["u", "v"])

    return work


def clusters(docs: DataFrame, *, shingle: int = 5, percent: int = 80, permutations: int = 48, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: sets with a similarity of at least ``percent`` / 100 are linked."""
    docs = picked(docs, id_column, text_column)
    kind = docs.schema[id_column].dataType.simpleString()
    sig = stored(signatures(docs, shingle=shingle, permutations=permutations, id_column=id_column, text_column=text_column), "signatures")
    nodes = sig.where("n > 0 AND id IS NOT NULL")
    equal = nodes.groupBy("lo", "hi").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").drop("last")
    copies = stored(nodes.select("id", "lo", "hi").join(stored(equal, "equal-sets"), ["lo", "hi"]).where("id <> rep").select("id", "lo", "hi", "rep").distinct(), "copies")
    # an id of several texts is one node: it is linked with what each of its texts copies
    several = nodes.groupBy("id").agg(F.min(F.struct("lo", "hi")).alias("a"), F.max(F.struct("lo", "hi")).alias("b")).where("a <> b").select("id")
    own = copies.join(several, "id", "left_semi").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    # a copy is left out by its row: its id may have other texts; rows of one id in one band are one member
    banded = nodes.join(copies.select("id", "lo", "hi"), ["id", "lo", "hi"], "left_anti").select("id", "n", F.explode("bands").alias("band"))
    banded = banded.groupBy("id", "band").agg(F.max("n").alias("n"))
    who = [F.sum(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 31))).alias(f"who{salt}") for salt in (1, 2)]
    found = banded.groupBy("band").agg(F.min("id").alias("center"), F.max("id").alias("last"), F.count("*").alias("members"), *who).where("center <> last")
    # buckets with the same members count once
    buckets = stored(found.groupBy("center", "members", "who1", "who2").agg(F.min("band").alias("band")), "buckets")
    inside = stored(banded.join(buckets.select("band", "center", "members"), "band"), "bucket-members")
    pairs = stored(inside.where("id <> center").select("center", "id").distinct(), "pairs")
    sets = stored(full_sets(docs, pairs.select("id").unionByName(pairs.select(F.col("center").alias("id"))), shingle=shingle, id_column=id_column, text_column=text_column), "sets")
    both = pairs.join(sets.withColumnRenamed("grams", "a"), "id").join(sets.select(F.col("id").alias("center"), F.col("grams").alias("b")), "center")
    common = both.select("id", "center", (F.size("a") + F.size("b")).alias("total"), F.size(F.array_intersect("a", "b")).alias("common"))
    links = stored(common.where(f"100 * common >= {percent} * (total - common)").select(F.col("id").alias("u"), F.col("center").alias("v")).unionByName(own), "links")
    found = components(links)
    # what is left: buckets of three or more whose members aren't one component yet
    labelled = inside.where("members > 2").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = stored(labelled.select("band", "id", "n", "members", "component"), "labelled")
    split = labelled.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("band")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("int")
    left = labelled.join(stored(split, "split"), "band").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    more = left.join(sets, "id").select("band", "i", "j", "id", "n", "block", "component", "grams").groupBy("band", "i", "j").applyInPandas(_verify_block(percent), f"u {kind}, v {kind}")
    more = stored(more, "more-links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    found = stored(found, "components")
    out = sig.select("id", F.col("n").alias("n_shingles")).join(copies.groupBy("id").agg(F.min("rep").alias("rep")), "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    out = out.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("id", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", **settings) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that with the smallest id."""
    gone = clusters(docs, id_column=id_column, **settings).where("NOT kept").select(F.col("id").alias("gone")).distinct()
    rows = numbered(docs)
    return rows.join(gone, F.col(f"c{docs.columns.index(id_column)}") == F.col("gone"), "left_anti").toDF(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """The contract's rows: three-word shingles, linked at 85 per cent."""
    return clusters(docs, shingle=3, percent=85, permutations=40).withColumnRenamed("id", "doc_id")
