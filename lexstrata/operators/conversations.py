"""Turns of conversations: pairs, chains, history budgets, carried subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, answer) of each assistant turn that follows a user turn."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("before", F.lag("role").over(by)).withColumn("prompt", F.lag("text").over(by))
    return rows.where("role = 'assistant' AND before = 'user'").select("conv_id", "turn", "prompt", F.col("text").alias("answer"))


def history(turns: DataFrame, budget: int) -> DataFrame:
    """The newest turns of each conversation whose bytes fit the budget."""
    by = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("used", F.sum(F.octet_length("text")).over(by)).where(F.col("used") <= budget)


def latest(turns: DataFrame) -> DataFrame:
    """The newest state of each conversation: its last turn and number of turns."""
    return turns.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.count("*").alias("turns"))


def carried(turns: DataFrame, marker: Column) -> DataFrame:
    """Each turn's own marker, else that of the last turn that had one, else ``-``."""
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("subject", F.coalesce(F.last(F.nullif(marker, F.lit("")), ignorenulls=True).over(by), F.lit("-")))


def repeated_trigrams(turns: DataFrame, least: int = 3) -> DataFrame:
    """Three-word runs that one turn repeats ``least`` times or more."""
    cut = lambda w: F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.concat_ws(" ", F.slice(w, i, 3))))
    runs = turns.select("conv_id", "turn", F.explode(X.bound(X.all_words(X.folded(F.col("text"))), cut)).alias("trigram"))
    return runs.groupBy("conv_id", "turn", "trigram").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def surface_flags(text: Column) -> Column:
    """What is wrong with the form of an answer."""
    flags = [(F.trim(text) == "", "empty"), (~F.rlike(text, F.lit("[.!?]$")), "unfinished"), (F.rlike(text, F.lit(r"^\p{Ll}")), "lowercase_start"), (F.contains(text, F.lit("�")), "bad_character"), (F.rlike(text, F.lit(r"(?i)\b(\p{L}+)( \1\b){2,}")), "token_loop")]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in flags]))


def assertions(text: Column) -> Column:
    """What a user says about themselves: (kind, value) of names, states and preferences."""
    found = [
        ("name", F.regexp_extract(text, r"(?i)\b(?:ich heiße|mein name ist)\s+(\p{Lu}[\p{L}-]*)", 1)),
        ("preference", F.regexp_extract(text, r"(?i)\bich (?:mag|liebe|bevorzuge)\s+([^.!?,]{2,60})", 1)),
        ("state", F.regexp_extract(text, r"(?i)\bich bin\s+([^.!?,]{2,60})", 1)),
    ]
    return F.array_compact(F.array(*[F.when(v != "", F.struct(F.lit(k).alias("kind"), F.trim(v).alias("value"))) for k, v in found]))
