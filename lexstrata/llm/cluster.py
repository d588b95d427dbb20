"""Helpers that every operator of this subpackage shares: shared storage and clean column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Spark's own setting: a write removes its shuffle files when it ends.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    A machine-local folder is made only where the setting is absent, as in single-machine tests.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexstrata-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile removes its shuffle files when it ends."""
    before = spark.conf.get(CLEANUP_KEY, "false")
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_KEY, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage and survives lost executors. The shuffle
    files of the write are removed with its end, as nothing reads them again."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    with no_shuffle_left(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that :func:`stored` returned and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB at most, whatever the length of a row; every operator sets the same value."""
    spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def text_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """Only ``columns`` of ``docs``; also bounds the bytes of an Arrow batch, as texts can be long."""
    bounded_batches(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns of exactly these names, whatever else ``df`` holds (names that differ in case, repeated extra names)."""
    places = [df.columns.index(n) for n in names]
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{i}").alias(n) for i, n in zip(places, names, strict=True)])


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by place: no name of theirs can clash with one that an operator adds."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def filtered(docs: DataFrame, decide: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` for which ``decide`` gives True, with all their columns; ``decide`` sees columns named by place."""
    bounded_batches(docs.sparkSession)
    rows = numbered(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(decide(batch)))

    return rows.mapInArrow(work, rows.schema).toDF(*docs.columns)


def add_columns(schema: T.StructType, **extra: str) -> T.StructType:
    """``schema`` and further columns, given by DDL type."""
    fields = list(schema.fields)
    fields += [T.StructField(k, T._parse_datatype_string(v)) for k, v in extra.items()]
    return T.StructType(fields)


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the folds of the contracts."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))
