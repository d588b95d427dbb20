"""The n-gram compiler: transitions, energies, decoding (A6-A10, A13-A14, W1, C-1 to C-6, G-1 to G-4, M9-M10)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import dropped, stored

BOS, EOS = "<BOS>", "<EOS>"
#: Prefixes that are looked up by pages of a sorted table; more of them are joined to the whole of it.
FEW = 512
#: Spark's own setting: longer lists are taken for the range from their least to their greatest value.
IN_KEY = "spark.sql.parquet.pushdown.inFilterThreshold"


def sequences(docs: DataFrame, *by: str) -> DataFrame:
    """(by..., tokens): compiler tokens, closed by the end token."""
    return docs.select(*by, F.concat(X.compiler_tokens(F.col("text")), F.array(F.lit(EOS))).alias("tokens"))


def transitions(docs: DataFrame, *, order: int = 2, by: tuple[str, ...] = (), prefixes: DataFrame | None = None) -> DataFrame:
    """A6, W1, C-4: (by..., depth, prefix, target, n) for every prefix of up to ``order`` tokens, padded at the start; ``by`` names the groups.
    With ``prefixes`` (column prefix) only those are counted.

    Most n-grams of three tokens or more are rare, so counting them in the tasks of the texts spares few rows: their rows are
    dealt by prefix and counted there, and whatever works by prefix (:func:`by_depth`) finds them in place. Pairs repeat, and
    many share a word: they are counted within tasks first and dealt by both words. Single words are sums of the pairs' counts.
    """
    names = [f"w{i}" for i in range(order + 1)]
    padded = sequences(docs, *by).select(*by, F.concat(F.array_repeat(F.lit(BOS), order), F.col("tokens")).alias("p"))
    out = pairs = None
    for depth in range(order, -1, -1):
        if depth == 0 and pairs is not None and prefixes is None:
            level = pairs.groupBy(*by, "target").agg(F.sum("n").alias("n")).select(*by, F.lit("").alias("prefix"), "target", "n")
        else:
            shifted = [F.slice("p", i + 1, F.size("p") - order) for i in range(order - depth, order + 1)]
            grams = padded.select(*by, F.inline(F.arrays_zip(*shifted))).toDF(*by, *names[order - depth :])
            grams = grams.select(*by, F.concat_ws(" ", *names[order - depth : order]).alias("prefix"), F.col(names[order]).alias("target"))
            if prefixes is not None:
                grams = grams.join(prefixes.select("prefix").distinct(), "prefix", "left_semi")
            level = (grams.repartition(*by, "prefix") if depth > 1 and prefixes is None else grams).groupBy(*by, "prefix", "target").agg(F.count("*").alias("n"))
        pairs = level if depth == 1 else pairs
        rows = level.select(*by, F.lit(depth).alias("depth"), "prefix", "target", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def by_depth(counts: DataFrame) -> list[DataFrame]:
    """``counts`` in parts by depth, which keep rows of a prefix together; the first part has the empty prefix."""
    return [counts.where(x) for x in ("depth = 0", "depth = 1", "depth = 2", "depth > 2")]


def _by_prefix():
    """Windows of a prefix. Rows are sorted by its hash first: a number of its own tells most prefixes apart, where the depth is the
    same for all rows of a part and the beginnings of prefixes are much alike."""
    return Window.partitionBy(F.xxhash64("prefix"), "prefix", "depth")


def probabilities(counts: DataFrame, *, ordered: bool = False) -> DataFrame:
    """N over the sum of its prefix. ``ordered`` sorts by prefix, which takes longer and lets files hold the rows in less room."""
    # the empty prefix is one row of totals for the whole vocabulary: it is sent along, so that no task gets all words
    empty, *longer = by_depth(counts)
    out = empty.join(F.broadcast(empty.agg(F.sum("n").alias("total")))).select("depth", "prefix", "target", "n", "total")
    total = F.sum("n").over(Window.partitionBy("depth", "prefix") if ordered else _by_prefix())
    for part in longer:
        out = out.unionByName(part.select("depth", "prefix", "target", "n", total.alias("total")))
    return out.withColumn("p", F.col("n") / F.col("total"))


def symbol_energy(counts: DataFrame) -> DataFrame:
    """Summed probabilities of each token over all prefixes, and its share of their norm."""
    energy = probabilities(counts).groupBy("target").agg(F.sum("p").alias("energy"))
    norm = energy.agg(F.sqrt(F.sum(F.col("energy") * F.col("energy"))).alias("norm"))
    return energy.join(F.broadcast(norm)).select("target", "energy", (F.col("energy") / F.col("norm")).alias("amplitude"))


def surface_mode(docs: DataFrame) -> DataFrame:
    """The most common spelling of each folded token; of equally common ones the first in order of document and place."""
    spelt = docs.select("doc_id", F.posexplode(X.all_words(F.col("text"))).alias("place", "form"))
    seen = spelt.groupBy(X.folded(F.col("form")).alias("token"), "form").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "place")).alias("first"))
    best = Window.partitionBy("token").orderBy(F.desc("n"), "first")
    return seen.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("token", "form", "n")


def context_form(docs: DataFrame) -> DataFrame:
    """The most common spelling of each token after the two before it; ties by spelling."""
    form = lambda w, i: X.folded(F.element_at(w, i))
    each = lambda w, i: F.struct(form(w, i - 2).alias("a"), form(w, i - 1).alias("b"), F.element_at(w, i).alias("form"))
    runs = lambda w: F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(3), F.size(w)), lambda i: each(w, i)))
    rows = docs.select(F.inline(X.bound(X.all_words(F.col("text")), runs)))
    # dealt once, as few runs of three repeat within a task; a form tells its token
    seen = rows.repartition("a", "b").groupBy("a", "b", "form").agg(F.count("*").alias("n")).select("a", "b", X.folded(F.col("form")).alias("token"), "form", "n")
    best = Window.partitionBy("a", "b", "token").orderBy(F.desc("n"), "form")
    return seen.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")


def interference_probability(amplitude: Column, p: Column, q: Column, *, phase: float, data_gain: float = 0.15, prompt_gain: float = 1.0) -> Column:
    """M9: the intensity of a real amplitude under two factors, in closed form."""
    import math

    return amplitude * amplitude * (1 + 2 * prompt_gain * math.cos(phase) * p + prompt_gain * prompt_gain * p * p) * (1 + data_gain * q) * (1 + data_gain * q)


def normalised(rows: DataFrame, intensity: str, *, by: list[str]) -> DataFrame:
    """Shares of the summed intensity, rounded half to even at twelve places; groups without intensity are dropped."""
    total = rows.groupBy(*by).agg(F.sum(intensity).alias("_total")).where("_total > 1e-24")
    return rows.join(total, by).withColumn("probability", F.bround(F.col(intensity) / F.col("_total"), 12)).drop("_total")


def top_transitions(counts: DataFrame, k: int = 3) -> DataFrame:
    """G-1: the ``k`` likeliest tokens after each prefix; ties by token."""
    best = _by_prefix().orderBy(F.desc("n"), "target")
    parts = [part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) for part in by_depth(counts)]
    return functools.reduce(DataFrame.unionByName, parts)


def decode_beam(prompts: DataFrame, counts: DataFrame, *, width: int = 4, steps: int = 12, order: int = 2) -> DataFrame:
    """G-3: the best continuation of each prompt (prompt_id, text) by beam search over a bounded working set.

    The working set of a prompt are the transitions that its words reach within ``steps``: it is found by
    joins, step by step, with at most ``width`` candidates for each prefix.
    """
    top = stored(top_transitions(probabilities(counts.where(F.col("depth") == order)), width).select("prefix", "target", F.log("p").alias("logp")), "top-transitions")
    tail = lambda c: F.concat_ws(" ", F.slice(F.split(c, " "), -order, order))
    padded = F.concat_ws(" ", F.concat(F.array_repeat(F.lit(BOS), order), X.compiler_tokens(F.col("text"))))
    beams = prompts.select("prompt_id", tail(padded).alias("prefix"), F.lit("").alias("out"), F.lit(0.0).alias("score"), F.lit(False).alias("done"))
    best = Window.partitionBy("prompt_id").orderBy(F.desc(F.bround("score", 12)), "out")
    for _ in range(steps):
        grown = beams.where("NOT done").join(top, "prefix").select("prompt_id", tail(F.concat_ws(" ", "prefix", "target")).alias("prefix"), F.when(F.col("target") == EOS, F.col("out")).otherwise(F.ltrim(F.concat_ws(" ", "out", "target"))).alias("out"), (F.col("score") + F.col("logp")).alias("score"), (F.col("target") == EOS).alias("done"))
        kept = grown.unionByName(beams.where("done")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= width).drop("rank")
        beams = stored(kept, "beams")
    final = Window.partitionBy("prompt_id").orderBy(F.desc("done"), F.desc(F.bround("score", 12)), "out")
    return beams.withColumn("rank", F.row_number().over(final)).where("rank = 1").select("prompt_id", F.col("out").alias("text"), "score", "done")


def sample_decode(prompts: DataFrame, counts: DataFrame, *, seed: int = 0, steps: int = 24, order: int = 2) -> DataFrame:
    """G-3 (sampling): one seeded continuation of each prompt over all transitions.

    The prompts' prefixes are joined with their transitions step by step; the target of a draw is the one
    in whose share of the prefix's occurrences a uniform number of prompt and step falls. Transitions are sorted by the prefix's hash
    in their files, and the hashes of up to ``FEW`` open prefixes stand in the plan, so that a step reads the pages that hold them.
    """
    spark = prompts.sparkSession
    # by the shuffle partition that prefixes are dealt to first, so that files hold ranges of keys that are apart
    key = F.pmod(F.hash("prefix"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))).cast("long") * (1 << 32) + F.hash("prefix")
    known = stored(counts.where(F.col("depth") == order).select(key.alias("key"), "prefix", "target", "n").sortWithinPartitions("key"), "transitions")
    padded = F.concat(F.array_repeat(F.lit(BOS), order), X.compiler_tokens(F.col("text")))
    rows = stored(prompts.select(F.monotonically_increasing_id().alias("row"), "prompt_id", F.concat_ws(" ", F.slice(padded, -order, order)).alias("prefix"), F.lit("").alias("out"), F.lit(False).alias("done")), "samples")
    up_to = Window.partitionBy("prefix").orderBy("target")
    in_before = spark.conf.get(IN_KEY)
    for step in range(steps):
        open_ = rows.where("NOT done")
        keys = open_.select(key.alias("key")).distinct().limit(FEW + 1).collect()
        if not keys:
            break
        near = known.where(F.col("key").isin([r["key"] for r in keys])) if len(keys) <= FEW else known
        spark.conf.set(IN_KEY, str(FEW))
        try:
            reached = stored(near.drop("key").join(open_.select("prefix").distinct(), "prefix", "left_semi").withColumn("below", F.sum("n").over(up_to) - F.col("n")), "reached")
        finally:
            spark.conf.set(IN_KEY, in_before)
        total = reached.groupBy("prefix").agg(F.sum("n").alias("total"))
        uniform = F.pmod(F.xxhash64(F.lit(seed), "prompt_id", F.lit(step)), F.lit(1 << 53)) / F.lit(float(1 << 53))
        drawn = open_.join(total, "prefix").withColumn("place", F.least(F.floor(uniform * F.col("total")), F.col("total") - 1))
        hit = drawn.join(reached, "prefix").where((F.col("place") >= F.col("below")) & (F.col("place") < F.col("below") + F.col("n"))).select("row", "target")
        more = rows.join(hit, "row", "left")
        ends = F.col("done") | F.col("target").isNull() | (F.col("target") == EOS)
        tail = F.concat_ws(" ", F.slice(F.split(F.concat_ws(" ", "prefix", "target"), " "), -order, order))
        rows = stored(more.select("row", "prompt_id", F.when(ends, F.col("prefix")).otherwise(tail).alias("prefix"), F.when(ends, F.col("out")).otherwise(F.ltrim(F.concat_ws(" ", "out", "target"))).alias("out"), ends.alias("done")), "samples")
        dropped(reached)
    return rows.select("prompt_id", F.col("out").alias("text"))


def group_fingerprint(docs: DataFrame, *, by: str) -> DataFrame:
    """A28, C-5: a digest of each group's token sequences by document, from two sums of row hashes: no group gathers in a task."""
    tokens = F.concat_ws(" ", F.concat(X.compiler_tokens(F.col("text")), F.array(F.lit(EOS))))
    parts = [F.sum(F.xxhash64(F.lit(salt), "doc_id", tokens).cast("decimal(38,0)")) for salt in ("a", "b")]
    return docs.groupBy(by).agg(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts], F.count("*").cast("string")), 256).alias("fingerprint"), F.count("*").alias("sequences"))


def changed_groups(now: DataFrame, before: DataFrame, *, by: str) -> DataFrame:
    """C-5: groups whose fingerprint isn't among the earlier ones: only these are compiled anew."""
    return now.join(before.select(by, "fingerprint"), [by, "fingerprint"], "left_anti").select(by)
