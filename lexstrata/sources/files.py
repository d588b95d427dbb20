"""Readers and writers of documents and records (IO1-IO21, IO23, R4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that results depend on: field names of paired data, which information records must not hold.
FORBIDDEN = [
    "question", "questions", "answer", "answers", "response", "responses", "completion", "completions",
    "instruction", "instructions", "input_output", "qa", "qa_pairs", "dialogue", "chosen", "rejected",
]


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """IO1: one object a line; a byte-order mark and blank lines are passed over, broken lines are an error."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where("trim(value) <> ''")
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    parsed = lines.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """IO2: a list of documents, or an object that holds one under ``documents``."""
    whole = spark.read.text(path, wholetext=True)
    kind = f"array<struct<{schema}>>"
    wrapped = F.from_json("value", f"struct<documents:{kind}>")["documents"]
    listed = F.when(F.ltrim("value").startswith("{"), wrapped).otherwise(F.from_json("value", kind))
    return whole.select(F.inline(listed))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """IO3: each file is one document; its path is the source."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def pinned_parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """IO7-IO9: a table of exactly these columns, else an error."""
    df = spark.read.parquet(path)
    if sorted(df.columns) != sorted(columns):
        raise ValueError(f"{path} has columns {df.columns} instead of {columns}")
    return df.select(*columns)


def message_trees(spark: SparkSession, path: str, lang: str = "de") -> DataFrame:
    """IO10: gzip JSON lines of reviewed messages in one language."""
    kind = "message_id string, parent_id string, message_tree_id string, role string, lang string, text string, tree_state string, review_result boolean, review_count int, deleted boolean, synthetic boolean, rank int, created_date string, labels map<string,struct<value:double>>"
    return spark.read.schema(kind).json(path).where(F.col("lang") == lang)


def answer_spans(rows: DataFrame) -> DataFrame:
    """IO11, F18: one row for each answer of nested answer arrays, with its place in the context."""
    zipped = F.explode(F.arrays_zip(F.col("answers.text").alias("text"), F.col("answers.answer_start").alias("start")))
    flat = rows.select("id", "question", "context", zipped.alias("a")).select("id", "question", "context", F.col("a.text").alias("answer"), F.col("a.start").alias("start"))
    return flat.where(F.substr("context", F.col("start") + 1, F.length("answer")) == F.col("answer"))


def content_id(prompt: Column, text: Column, source: Column) -> Column:
    """IO5: ``text-`` and the head of the digest of the JSON list [prompt, text, source] with blanks after commas."""
    as_json = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[(.*)\]$", "$1")
    return F.concat(F.lit("text-"), F.substr(F.sha2(F.concat(F.lit("["), F.concat_ws(", ", as_json(prompt), as_json(text), as_json(source)), F.lit("]")), 256), F.lit(1), F.lit(24)))


def contract_violation(record_json: Column) -> Column:
    """IO6: why a JSON record isn't an information record; null if it is one."""
    keys = F.transform(F.coalesce(F.json_object_keys(record_json), F.array().cast("array<string>")), F.lower)
    text = F.get_json_object(record_json, "$.text")
    return (
        F.when(F.arrays_overlap(keys, F.array(*[F.lit(x) for x in FORBIDDEN])), "forbidden_field")
        .when(F.coalesce(F.get_json_object(record_json, "$.prompt"), F.lit("")) != "", "prompt")
        .when(F.coalesce(F.trim(text), F.lit("")) == "", "text")
    )


def write_jsonl(df: DataFrame, path: str, *, compression: str = "none", order: str | None = None) -> DataFrame:
    """IO17, IO18, IO23: JSON lines with sorted keys, and a receipt (path, bytes, sha256) for each file."""
    rows = df.select(*sorted(df.columns))
    (rows.repartitionByRange(order).sortWithinPartitions(order) if order else rows).write.option("compression", compression).json(path)
    return receipts(df.sparkSession, path)


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """IO23, A26: size and digest of every file of a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_csv(df: DataFrame, path: str) -> None:
    """IO21."""
    df.write.option("header", True).csv(path)


def cached(df: DataFrame, folder: str, key: str) -> DataFrame:
    """IO20, Y29: ``df`` from the folder's entry of this key, written first if there is none that is complete."""
    spark, path = df.sparkSession, f"{folder.rstrip('/')}/key={key}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
