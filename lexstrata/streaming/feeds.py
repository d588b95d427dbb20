"""Streams: the change feed as a file stream, idempotent appends, conversation state (ST1-ST6)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path


def landed(df: DataFrame, files: int = 4) -> str:
    """A folder of the shared storage with ``df`` in a few files, for a file stream to read in batches."""
    path = fresh_path(df.sparkSession, "landed")
    df.repartition(files).write.parquet(path)
    return path


def append_stream(stream: DataFrame, table: str, checkpoint: str, *, key: list[str]) -> None:
    """ST2, ST3, ST6: takes up all available changes; a batch that was written before is replaced, rows that the table has are skipped."""

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(table)
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        older = [str(s.getPath()) for s in fs.listStatus(place) if s.getPath().getName() != f"batch={batch_id}"] if fs.exists(place) else []
        fresh = batch.dropDuplicates(key)
        if older:
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(*older).select(*key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replay(spark: SparkSession, source: str, schema, *, key: list[str], files_per_batch: int = 1) -> DataFrame:
    """ST1: a folder of Parquet files read as a stream in batches; returns the table that has come about."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    table = fresh_path(spark, "feed")
    append_stream(stream, table, fresh_path(spark, "feed-checkpoint"), key=key)
    return spark.read.schema(schema).parquet(f"{table}/*")


def session_state(spark: SparkSession, source: str, schema) -> DataFrame:
    """ST4: one state for each conversation (turns, last turn, characters), kept by the stream's state store.

    A key has one writer, so revisions need no compare-and-set.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        turns, last, chars = state.get if state.exists else (0, -1, 0)
        for rows in batches:
            turns += len(rows)
            last = max(last, int(rows["turn"].max()))
            chars += int(rows["text"].str.len().sum())
        state.update((turns, last, chars))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [turns], "last_turn": [last], "chars": [chars]})

    stream = spark.readStream.schema(schema).parquet(source)
    out = stream.groupBy("conv_id").applyInPandasWithState(update, "conv_id long, turns long, last_turn long, chars long", "turns long, last_turn long, chars long", "update", "NoTimeout")
    table = fresh_path(spark, "sessions")

    def take(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{table}/part={batch_id}")

    out.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", fresh_path(spark, "sessions-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    newest = spark.read.parquet(f"{table}/*")
    return newest.groupBy("conv_id").agg(*[F.max_by(c, "batch").alias(c) for c in ("turns", "last_turn", "chars")])


def event_windows(spark: SparkSession, source: str, schema, *, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums of events in tumbling windows with a watermark (an addition; the store has no event time)."""
    stream = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = stream.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    table = fresh_path(spark, "windows")

    def take(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{table}/part={batch_id}")

    counted.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", fresh_path(spark, "windows-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    newest = spark.read.parquet(f"{table}/*")
    return newest.groupBy("window", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
