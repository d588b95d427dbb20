"""Token counts kept up to date by signed changes.

A rollup lives in a folder: ``ledger/batch=<id>`` holds the newest state of each document that a
batch touched, ``deltas/batch=<id>`` what the batch adds to the totals of each source, language and
tokenizer version (deletes and revised counts subtract what the ledger had before). A batch counts
once its deltas are complete; committing the same id again changes nothing. Of several changes to
one document and tokenizer the one of the highest version holds, in a batch and across batches.

Defined results: changes without document id are ignored; null texts have no tokens; null sources
and languages are groups of their own; deletes of unknown documents change nothing; repeated rows
of one id and version count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as bt
from .cluster import fresh_path, picked, stored, text_rows
from .pieces import MODEL_PATH, PieceModel

WORDS, PIECES = "words-1", "piece-bpe-32k"
KEY = ["doc_id", "tokenizer"]
GROUP = ["source", "lang", "tokenizer"]
STATE = [*KEY, "source", "lang", "n_tokens", "version", "alive"]


def count_tokens(docs: DataFrame, *, version: int = 0, model_path: str = MODEL_PATH) -> DataFrame:
    """Insert changes (doc_id, tokenizer, source, lang, n_tokens, version, alive) for all documents and both tokenizers."""
    docs = picked(docs, "doc_id", "source", "lang", "text")
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "source", "lang")}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            words, pieces = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for chunk in bt.chunks(bt.string_column(batch, "text")):
                part = slice(chunk.first, chunk.first + chunk.rows)
                words[part] = np.bincount(chunk.lowered().words(bt.ALNUM)[2], minlength=chunk.rows)
                pieces[part] = np.diff(model.encode(chunk)[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words), pa.array(pieces)], names=["doc_id", "source", "lang", "words", "pieces"])

    counted = text_rows(docs, "doc_id", "source", "lang", "text").mapInArrow(work, f"doc_id {kinds['doc_id']}, source {kinds['source']}, lang {kinds['lang']}, words long, pieces long")
    each = F.inline(F.array(F.struct(F.lit(WORDS).alias("tokenizer"), F.col("words").alias("n_tokens")), F.struct(F.lit(PIECES).alias("tokenizer"), F.col("pieces").alias("n_tokens"))))
    return counted.select("doc_id", "source", "lang", each).select("doc_id", "tokenizer", "source", "lang", "n_tokens", F.lit(version).cast("long").alias("version"), F.lit(True).alias("alive"))


class TokenRollup:
    """Totals in a folder of the shared storage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, kind: str, batch: str) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/deltas")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName().partition("=")[2] for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(b for b in names if self._exists(self._path("deltas", b) + "/_SUCCESS"))

    def ledger(self) -> DataFrame | None:
        """The newest state of every document and tokenizer that committed batches touched."""
        done = self.batches()
        if not done:
            return None
        rows = self.spark.read.parquet(*[self._path("ledger", b) for b in done]).select(*STATE)
        return rows if len(done) == 1 else _newest(rows)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Takes up a batch of changes (the columns of ``STATE``); False if the batch had been committed."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError("a batch id holds letters, digits, dots, dashes and underscores")
        if batch in self.batches():
            return False
        new = _newest(changes.where("doc_id IS NOT NULL").select(*STATE))
        old = self.ledger()
        if old is not None:
            before = old.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in STATE[2:]])
            new = new.join(before, KEY, "left").where("old_version IS NULL OR version > old_version")
        else:
            kinds = dict(changes.dtypes)
            new = new.select("*", *[F.lit(None).cast(kinds[c]).alias(f"old_{c}") for c in STATE[2:]])
        touched = stored(new, "touched")
        touched.select(*STATE).write.mode("overwrite").parquet(self._path("ledger", batch))
        signed = F.array(
            F.when(F.col("alive"), F.struct("source", "lang", F.lit(1).alias("docs"), F.col("n_tokens").alias("tokens"))),
            F.when(F.col("old_alive"), F.struct(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.lit(-1).alias("docs"), (-F.col("old_n_tokens")).alias("tokens"))),
        )
        rows = touched.select("tokenizer", F.inline(F.array_compact(signed)))
        rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(self._path("deltas", batch))
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
        rows = self.spark.read.parquet(*[self._path("deltas", b) for b in self.batches()])
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")


def _newest(rows: DataFrame) -> DataFrame:
    """One row for each document and tokenizer: that of the highest version (of equal versions the largest row)."""
    last = F.max(F.struct("version", "alive", "n_tokens", "source", "lang")).alias("s")
    return rows.groupBy(*KEY).agg(last).select(*KEY, "s.source", "s.lang", "s.n_tokens", "s.version", "s.alive")


def moderated(counts: DataFrame, labels: DataFrame, *, version: int = 1) -> DataFrame:
    """Changes that follow from labels: documents of low quality are deleted, toxic ones move to source ``quarantine``."""
    each = picked(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    hit = counts.join(each.where("quality = 0 OR toxic = 1"), F.col("doc_id") == F.col("labelled"))
    return hit.select(*KEY, F.lit("quarantine").alias("source"), "lang", "n_tokens", F.lit(version).cast("long").alias("version"), F.coalesce(F.col("quality") != 0, F.lit(True)).alias("alive"))


def report(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, model_path: str = MODEL_PATH) -> DataFrame:
    """Totals after three commits: all documents, the changes that the labels ask for, and the same batch again."""
    rollup = TokenRollup(spark, fresh_path(spark, "rollup"))
    rollup.commit("documents", count_tokens(docs, model_path=model_path))
    for _ in range(2):
        rollup.commit("labels", moderated(rollup.ledger(), labels))
    return rollup.totals()
