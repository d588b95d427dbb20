"""Retrieval over documents: term statistics, coverage, hashed vectors, BM25, sentence scores, selection.

Every search joins the postings of the queried terms only; the query side is a literal of a few
dozen rows, so it is broadcast, and the document side is aggregated before it is ranked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

BM25_K1, BM25_B = 1.2, 0.75
DIMENSIONS = 4096


def postings(docs: DataFrame, *, stopwords: list[str] | None = None) -> DataFrame:
    """A4: (doc_id, term, tf) of all folded words. Texts are dealt by id once; whatever goes by document finds its rows in place."""
    terms = docs.repartition("doc_id").select("doc_id", F.explode(X.search_tokens(F.col("text"), stopwords=stopwords)).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """A3: in how many documents each term occurs."""
    each = docs.select(F.explode(F.array_distinct(X.search_tokens(F.col("text")))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(docs: DataFrame, prompt: str) -> DataFrame:
    """The distinct terms of a prompt as rows: a few dozen at most."""
    return docs.sparkSession.range(1).select(F.explode(F.array_distinct(X.search_tokens(F.lit(prompt)))).alias("term"))


def embedding_scores(vectors: DataFrame, vec_id: int) -> DataFrame:
    """Every other row of ``vectors`` with ``score``, the cosine to one vector in double precision."""
    v = F.col("embedding").cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    asked = F.broadcast(vectors.where(F.col("vec_id") == vec_id).select(v.alias("q")))
    score = dot(v, F.col("q")) / F.sqrt(dot(v, v) * dot(F.col("q"), F.col("q")))
    return vectors.where(F.col("vec_id") != vec_id).join(asked).withColumn("score", F.round(score, 6)).drop("q")


def embedding_topk(vectors: DataFrame, vec_id: int, *, k: int = 20) -> DataFrame:
    """Nearest vectors of one vector by cosine, in double precision."""
    return embedding_scores(vectors, vec_id).select("vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(k)


def best_of_each(rows: DataFrame, group: str, k: int, *, salts: int = 64) -> DataFrame:
    """The ``k`` rows of each group with the highest ``score``, ties by ``id``; found first within salted parts of a group."""
    salt = F.pmod(F.xxhash64("id"), F.lit(salts))
    for keys in ([F.col(group), salt], [F.col(group)]):
        rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("_rank") <= k).drop("_rank")
    return rows


def char_ngrams(docs: DataFrame) -> DataFrame:
    """Q1: counts of the three- and four-character grams of ``^word$``."""
    words = docs.select(F.explode(X.search_tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("times"))
    framed = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    cut = lambda n: F.when(F.length(framed) >= n, F.transform(F.sequence(F.lit(1), F.length(framed) - (n - 1)), lambda i: F.substr(framed, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return words.select(F.explode(F.concat(cut(3), cut(4))).alias("gram"), "times").groupBy("gram").agg(F.sum("times").alias("times"))


def bucket_of(term: Column, dimensions: int = DIMENSIONS) -> Column:
    """A5: the bucket of a feature by the first 32 bits of its SHA-256 digest (built-in variant)."""
    return F.pmod(F.conv(F.substr(F.sha2(term, 256), F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(dimensions))


def bucket_histogram(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """How many buckets hold how many distinct terms."""
    terms = docs.select(F.explode(X.search_tokens(F.col("text"))).alias("term")).distinct()
    load = terms.groupBy(bucket_of(F.col("term"), dimensions).alias("bucket")).agg(F.count("*").alias("load"))
    return load.groupBy("load").agg(F.count("*").alias("buckets"))


def blake_slot(person: bytes = b"", dimensions: int = DIMENSIONS):
    """H2: bucket and sign of a feature by BLAKE2b-16: the first eight bytes (little-endian) and the ninth's last bit.

    ``person`` is the personalisation string of the store whose vectors are to be matched.
    """

    @F.pandas_udf("struct<bucket:bigint,sign:double>")
    def slot(feature: pd.Series) -> pd.DataFrame:
        found = [hashlib.blake2b(f.encode(), digest_size=16, person=person).digest() for f in feature]
        return pd.DataFrame({"bucket": [int.from_bytes(d[:8], "little") % dimensions for d in found], "sign": [1.0 if d[8] & 1 else -1.0 for d in found]})

    return slot


def hashed_vectors(docs: DataFrame, person: bytes = b"") -> DataFrame:
    """Sparse unit vectors (doc_id, bucket, weight): signed 1 + ln tf, summed by bucket."""
    # rows that come from Python are dealt again, once: sums by bucket and norms find them in place
    slots = postings(docs).select("doc_id", "tf", blake_slot(person)("term").alias("slot")).repartition("doc_id")
    summed = slots.groupBy("doc_id", F.col("slot.bucket").alias("bucket")).agg(F.sum(F.col("slot.sign") * (1 + F.log("tf"))).alias("w")).where("w <> 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return summed.select("doc_id", "bucket", (F.col("w") / norm).alias("weight"))


def interference_topk(docs: DataFrame, prompt: str, *, k: int = 10, least: float = 0.18) -> DataFrame:
    """Documents by the dot product of hashed unit vectors with the prompt's; also twice the score."""
    spark = docs.sparkSession
    asked = hashed_vectors(spark.createDataFrame([(-1, prompt)], "doc_id long, text string")).select("bucket", F.col("weight").alias("q"))
    score = hashed_vectors(docs).join(F.broadcast(asked), "bucket").groupBy("doc_id").agg(F.bround(F.sum(F.col("weight") * F.col("q")), 12).alias("score"))
    return score.where(F.col("score") >= least).orderBy(F.desc("score"), "doc_id").limit(k).withColumn("interference", 2 * F.col("score"))


def passages(docs: DataFrame, width: int = 4000) -> DataFrame:
    """(doc_id, passage, title, body) windows of each text."""
    title = F.substr(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(1), F.lit(200))
    return docs.select("doc_id", title.alias("title"), F.posexplode(X.passages(F.col("text"), width)).alias("passage", "body"))


def sentence_features(docs: DataFrame, target: str) -> DataFrame:
    """Q11, Q13: the linguistic part of a sentence's score (coverage, lede, length and tautology terms)."""
    wanted = X.term_set(F.lit(target))
    cut = docs.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("position", "sentence")).where(F.length("sentence").between(25, 460))
    terms = X.term_set(F.col("sentence"))
    shared = F.size(F.array_intersect(terms, wanted))
    coverage = shared / F.greatest(F.size(wanted), F.lit(1))
    n = F.length("sentence")
    # Fixed values that results depend on: the weights of the features.
    score = 2.20 * coverage + F.when(F.col("position") == 0, 0.85).otherwise(0.0) - 3.10 * X.tautology(terms, wanted)
    score = score - F.when(n < 45, 1.20 * (45 - n) / 45).when(n > 430, (n - 430) / 430).otherwise(0.0) - F.when(shared == 0, 1.50).otherwise(0.0)
    return cut.select("doc_id", "position", "sentence", F.round(score, 6).alias("score"))


def confidence(score: Column) -> Column:
    """The level of the best score."""
    return F.when(score >= 2.6, "hoch").when(score >= 0.85, "mittel").when(score.isNotNull(), "niedrig").otherwise("keine")


def mmr_select(candidates: DataFrame, *, group: str, limit: int = 4, lam: float = 0.72, novelty: float = 6.0) -> DataFrame:
    """Q14: per group ``limit`` rows that score well and differ: lam * score - (1 - lam) * novelty * largest cosine so far.

    ``candidates`` has (group, id, score, vector); each group is a working set of bounded size.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(rows["vector"].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        near, left, out = np.zeros(len(rows)), list(range(len(rows))), []
        while left and len(out) < limit:
            value = lam * rows["score"].to_numpy()[left] - (1 - lam) * novelty * near[left]
            best = left[int(np.argmax(value))]
            out.append((rows[group][best], rows["id"][best], len(out), float(value.max())))
            left.remove(best)
            near = np.maximum(near, np.abs(v @ v[best]))
        return pd.DataFrame(out, columns=[group, "id", "pick", "value"])

    kind = dict(candidates.dtypes)
    return candidates.groupBy(group).applyInPandas(pick, f"{group} {kind[group]}, id {kind['id']}, pick int, value double")


def budgeted(ranked: DataFrame, *, order: list[Column], size: Column, budget: int, group: list[str]) -> DataFrame:
    """Rows in order while their summed sizes stay within a budget; the first overflow ends it."""
    by = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(size).over(by)).where(F.col("used") <= budget)


def novelty(answers: DataFrame, corpus: DataFrame) -> DataFrame:
    """Answers whose collapsed text stands in no corpus text."""
    known = corpus.select(X.collapsed(F.lower("text")).alias("key")).distinct()
    return answers.withColumn("key", X.collapsed(F.lower("text"))).join(known, "key", "left_anti").drop("key")
