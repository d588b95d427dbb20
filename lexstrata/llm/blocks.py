"""Columns of numbers dealt to tasks in blocks.

A row of a shuffle holds not one key but a block of them: all keys that a task has for one bucket, as
raw columns. Spark deals the blocks by bucket and sorts them within a partition; Python then sees one
bucket at a time. There are some buckets for each shuffle partition, so a bucket's memory is bounded
by the partition size that ``spark.sql.shuffle.partitions`` gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as bt
from .cluster import bounded_batches

BUCKETS_A_PARTITION = 2
COLUMNS = 6
BATCH = 1 << 18
SCHEMA = "bucket long, kind int, n long, weight long, " + ", ".join(f"v{i} binary" for i in range(COLUMNS))
NAMES = ["bucket", "kind", "n", "weight", *(f"v{i}" for i in range(COLUMNS))]

#: Of one bucket, for each kind: the weight and the columns of every block.
Found = dict[int, list[tuple[int, list[np.ndarray]]]]


def bucket_count(spark: SparkSession) -> int:
    return BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch_of(buckets: np.ndarray, kind: int, cuts: np.ndarray, weights: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A block for each of ``buckets``: the parts of ``columns`` between its cuts."""
    n = len(buckets)
    arrays = [pa.array(buckets.astype(np.int64)), pa.array(np.full(n, kind, np.int32)), pa.array(np.diff(cuts).astype(np.int64)), pa.array(weights.astype(np.int64))]
    for c in columns:
        c = np.ascontiguousarray(c)
        arrays.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((cuts * c.itemsize).astype(np.int32)), pa.py_buffer(c)]))
    arrays += [pa.nulls(n, pa.binary())] * (COLUMNS - len(columns))
    return pa.RecordBatch.from_arrays(arrays, names=NAMES)


def dealt(kind: int, keys: np.ndarray, columns: list[np.ndarray], buckets: int, *, weigh: np.ndarray | None = None, weight: int = 0) -> pa.RecordBatch:
    """Blocks of ``columns`` by the bucket of ``keys``; a block's weight is the sum of ``weigh``, or ``weight``."""
    home = ((bt.mix(keys) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(home.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
    home = home[order]
    first = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(home) else np.zeros(0, np.int64)
    weights = np.add.reduceat(weigh[order], first) if weigh is not None and len(first) else np.full(len(first), weight)
    return batch_of(home[first], kind, np.append(first, len(home)), weights, [c[order] for c in columns])


def _by_bucket(batches: Iterator[pa.RecordBatch], kinds: dict[int, tuple]) -> Iterator[tuple[int, Found]]:
    current, found = None, {}
    for batch in batches:
        buckets, kind, weight = (batch.column(i).to_numpy() for i in (0, 1, 3))
        raw = []
        for c in batch.columns[4:]:
            offsets, data = c.buffers()[1:]
            raw.append((np.frombuffer(offsets, np.int32)[c.offset : c.offset + len(c) + 1].tolist() if offsets else [0] * (len(c) + 1), data))
        for i, (bucket, k, w) in enumerate(zip(buckets.tolist(), kind.tolist(), weight.tolist(), strict=True)):
            if bucket != current:
                if current is not None:
                    yield current, found
                current, found = bucket, {}
            columns = []
            for dtype, (offsets, data) in zip(kinds[k], raw, strict=False):
                size = offsets[i + 1] - offsets[i]
                columns.append(np.frombuffer(data, dtype, size // np.dtype(dtype).itemsize, offsets[i]) if size else np.zeros(0, dtype))
            found.setdefault(k, []).append((w, columns))
    if current is not None:
        yield current, found


def cat(found: Found, kind: int, dtypes: tuple) -> list[np.ndarray]:
    """The columns of all blocks of one kind, end to end."""
    blocks = found.get(kind)
    return [np.concatenate([b[1][i] for b in blocks]) for i in range(len(dtypes))] if blocks else [np.zeros(0, d) for d in dtypes]


def thin(work: Callable) -> Callable:
    """``work`` with its batches cut to ``BATCH`` bytes or a row: what JVM and Python hold of them at once is small."""

    def cut(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for batch in work(batches):
            rows = max(1, batch.num_rows * BATCH // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    return cut


def mapped(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The blocks that ``work`` makes of the batches of ``rows``."""
    return rows.mapInArrow(thin(work), SCHEMA)


def reduced(blocks: DataFrame, kinds: dict[int, tuple], work: Callable[[Iterator[tuple[int, Found]]], Iterator[pa.RecordBatch]], schema: str = SCHEMA) -> DataFrame:
    """What ``work`` makes of the buckets of each task; ``kinds`` has the column types of each kind of block."""
    bounded_batches(blocks.sparkSession)
    return blocks.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(thin(lambda batches: work(_by_bucket(batches, kinds))), schema)


class Outgoing:
    """Rows that a task has for other buckets, gathered until there are ``most`` of them."""

    def __init__(self, buckets: int, most: int):
        self.buckets, self.most, self.held, self.size = buckets, most, {}, 0

    def add(self, kind: int, keys: np.ndarray, columns: list[np.ndarray], weigh: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.held.setdefault(kind, []).append((keys, *columns, np.zeros(len(keys), np.int64) if weigh is None else weigh))
        self.size += len(keys)
        if self.size > self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        held, self.held, self.size = self.held, {}, 0
        for kind, parts in held.items():
            keys, *columns, weigh = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield dealt(kind, keys, columns, self.buckets, weigh=weigh)
