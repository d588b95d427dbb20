"""Scores of candidate sentences in full."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .retrieval import blake_slot, query_terms

# Fixed values that results depend on: the weights of the features.
WAVE, COVERAGE, DEFINITION, LEDE, TITLE, PROXIMITY = 1.35, 2.20, 1.90, 0.85, 1.45, 0.35
LIST_PAGE, DISAMBIGUATION, TAUTOLOGY, SHORT, NO_TARGET, LISTED = 1.60, 2.40, 3.10, 1.20, 1.50, 0.8
# Words that results depend on.
COPULAS = r"\b(?:ist|sind|war|waren|bedeutet|gilt als|bezeichnet|nennt)\b"
GENUS = r"\b(?:ein|eine|der|die|das)\b"
ALIASES = {
    "sci fi": "science fiction", "scifi": "science fiction", "sci-fi": "science fiction", "sciencefiction": "science fiction",
    "sf film": "science fiction film", "youtube": "youtube", "yt": "youtube", "youtu be": "youtube", "twitch tv": "twitch",
    "fb": "facebook", "insta": "instagram", "ki": "kuenstliche intelligenz", "ai": "artificial intelligence",
    "ml": "maschinelles lernen", "machine learning": "maschinelles lernen", "doku": "dokumentation", "handy": "smartphone",
    "pc": "personalcomputer", "tv": "fernsehen", "email": "elektronische post", "mail": "elektronische post",
    "whatsapp": "whatsapp", "amazon": "amazon", "ebay": "ebay", "bitcoin": "bitcoin",
}


def term_weights(candidates: DataFrame, wanted: list[str], *, expects_number: bool = False) -> DataFrame:
    """(term, weight) of the wanted terms by how few of the candidates (column text) hold them, within 0.15 and 2."""
    n = candidates.count()
    asked = candidates.sparkSession.range(1).select(F.explode(F.array_distinct(F.flatten(F.array(*[X.term_set(F.lit(w)) for w in wanted])))).alias("term"))
    held = candidates.select(F.explode(X.term_set(F.col("text"))).alias("term")).join(F.broadcast(asked), "term").groupBy("term").agg(F.count("*").alias("df"))
    n = max(1, n)
    weight = 0.25 + 1.75 * F.log(1.0 + F.lit(float(n)) / (1.0 + F.coalesce("df", F.lit(0)))) / F.log(F.lit(1.0 + n))
    if expects_number:
        weight = weight * F.when(F.rlike("term", F.lit(r"\d")), 1.6).otherwise(1.0)
    return asked.join(held, "term", "left").select("term", F.least(F.lit(2.0), F.greatest(F.lit(0.15), weight)).alias("weight"))


def wave_vectors(texts: DataFrame, weights: DataFrame, *, dimensions: int = 4096, person: bytes = b"") -> DataFrame:
    """Q12: (id, bucket, amplitude): unit vectors of weighted canonical words and of their three- and four-character grams.

    Words are hashed once each, not once for each place that they stand in.
    """
    words = texts.select("id", F.explode(F.transform(X.search_tokens(F.col("text")), X.canonical_term)).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
    framed = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    cut = lambda k: F.when(F.length(framed) >= k, F.transform(F.sequence(F.lit(1), F.length(framed) - (k - 1)), lambda i: F.substr(framed, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    distinct, half, slot = words.select("word").distinct(), dimensions // 2, blake_slot(person, dimensions // 2)
    own = distinct.join(F.broadcast(weights), distinct["word"] == weights["term"], "left").select("word", F.concat(F.lit("w:"), "word").alias("feature"), (F.lit(0.75**0.5) * F.coalesce("weight", F.lit(0.35))).alias("part"), F.lit(0).alias("shift"))
    grams = distinct.select("word", F.explode(F.concat(cut(3), cut(4))).alias("gram")).select("word", F.concat(F.lit("c:"), "gram").alias("feature"), F.lit(0.25**0.5).alias("part"), F.lit(half).alias("shift"))
    features = own.unionByName(grams).withColumn("slot", slot("feature")).select("word", (F.col("slot.bucket") + F.col("shift")).alias("bucket"), (F.col("slot.sign") * F.col("part")).alias("part"))
    summed = words.join(features, "word").groupBy("id", "bucket").agg(F.sum(F.col("n") * F.col("part")).alias("amplitude")).where("amplitude <> 0")
    norms = summed.groupBy("id").agg(F.sqrt(F.sum(F.col("amplitude") * F.col("amplitude"))).alias("norm"))
    return summed.join(norms, "id").select("id", "bucket", (F.col("amplitude") / F.col("norm")).alias("amplitude"))


def wave_scores(candidates: DataFrame, query: str, weights: DataFrame) -> DataFrame:
    """Q12: (id, wave): the squared cosine of each candidate (id, text) with the query."""
    spark = candidates.sparkSession
    asked = wave_vectors(spark.createDataFrame([(0, query)], "id long, text string"), weights).select("bucket", F.col("amplitude").alias("q"))
    dots = wave_vectors(candidates, weights).join(F.broadcast(asked), "bucket").groupBy("id").agg(F.sum(F.col("amplitude") * F.col("q")).alias("dot"))
    return candidates.select("id").join(dots, "id", "left").select("id", F.coalesce(F.col("dot") * F.col("dot"), F.lit(0.0)).alias("wave"))


def definition_level(sentence: Column, target_words: Column) -> Column:
    """How far a sentence is built as a definition of the target: 1 with an early copula and a class word after it, else 0.6 or 0."""
    low = F.lower(sentence)
    head = F.concat(F.lit(" "), F.array_join(F.slice(F.split(F.trim(low), r"\s+"), 1, 9), " "), F.lit(" "))
    named = F.exists(target_words, lambda w: F.startswith(F.substr(head, F.lit(2)), w) | F.contains(head, F.concat(F.lit(" "), w, F.lit(" "))))
    start = F.substr(low, F.lit(1), F.lit(180))
    at, word = F.regexp_instr(start, F.lit(COPULAS)), F.regexp_extract(start, COPULAS, 0)
    after = F.substr(low, at + F.length(word), F.lit(40))
    early = (at - 1) / F.greatest(F.length(low), F.lit(1)) < 0.25
    return F.when(~F.coalesce(named, F.lit(False)) | (at == 0), 0.0).when(early & F.rlike(after, F.lit(GENUS)), 1.0).otherwise(0.6)


def ambiguous(sentence: Column) -> Column:
    """pages of many meanings, enumerations and tables of contents."""
    low = F.lower(sentence)
    # The phrases that such pages hold.
    signals = [r"\b(?:steht für|begriffsklärung|begriffsklaerung|kann stehen)\b", r"\b(?:siehe auch|listet|countdown|im folgen)\b", r"^inhalt\b|\binhaltsverzeichnis\b", r"\bfolgende[n]? (?:person|begriff|eintrag|artikel|kapitel|version)"]
    out = F.rlike(sentence, F.lit(r":\s*$")) | (F.contains(sentence, F.lit(": ")) & (F.size(F.split(sentence, ", ")) > 7)) | F.rlike(sentence, F.lit(r"^\s*(?:\d+[.)]|[-*•])"))
    for s in signals:
        out = out | F.rlike(low, F.lit(s))
    return out


def list_page(title: Column) -> Column:
    """titles of lists and categories."""
    return F.rlike(F.trim(title), F.lit(r"(?i)^(?:liste|list|kategorie|sternbild|auszeichnung|begriffsklärung)"))


def sentence_scores(candidates: DataFrame, query: str, target: str, *, topics: tuple[str, ...] = (), kind: str = "definition", expects_number: bool = False) -> DataFrame:
    """Q13, K6: candidates (id, title, text, position) with wave and score, in order of score rounded to six places, then text."""
    weights = term_weights(candidates, [query, target, *topics], expects_number=expects_number)
    waves = wave_scores(candidates, query, weights)
    aim = " ".join([target or query, *topics])
    words, wanted, asked = X.surface_words(F.lit(aim)), X.term_set(F.array_join(X.surface_words(F.lit(aim)), " ")), X.term_set(F.lit(query))
    terms = F.array_union(X.term_set(F.col("text")), X.term_set(F.col("title")))
    shared = F.size(F.array_intersect(terms, wanted))
    name, folded_title, n = F.array_join(words, " "), X.folded(X.glyphs(F.col("title"))), F.length("text")
    titled = (name != "") & ((folded_title == name) | (F.contains(folded_title, name) & (F.length("title") < 42)))
    points = COVERAGE * shared / F.greatest(F.size(wanted), F.lit(1)) + DEFINITION * definition_level(F.col("text"), words)
    points += F.when(F.col("position") == 0, LEDE).otherwise(0.0) + F.when(titled, TITLE).otherwise(0.0)
    points -= F.when(list_page(F.col("title")), LIST_PAGE).otherwise(0.0) + F.when(ambiguous(F.col("text")), DISAMBIGUATION).otherwise(0.0)
    points -= TAUTOLOGY * X.tautology(X.term_set(F.col("text")), asked)
    points += PROXIMITY * X.title_proximity(F.col("title"), name)
    points += F.when((F.lit(kind) == "liste") & (F.size(F.split("text", ", ")) > 2), LISTED).otherwise(0.0)
    points -= F.when(n < 45, SHORT * (45 - n) / 45).when(n > 430, (n - 430) / 430).otherwise(0.0)
    points -= F.when((F.size(wanted) > 0) & (shared == 0), NO_TARGET).otherwise(0.0)
    return candidates.join(waves, "id").withColumn("score", F.round(WAVE * F.col("wave") + points, 6)).orderBy(F.desc("score"), "text")


def overlapping(docs: DataFrame, prompt: str, *, canonical: bool = False) -> DataFrame:
    """documents that share a word with the prompt (or, in the morphology mode, a canonical term)."""
    if canonical:
        return docs.where(F.arrays_overlap(X.content_terms(F.col("text")), X.content_terms(F.lit(prompt), query=True)))
    asked = [r["term"] for r in query_terms(docs, prompt).collect()]  # a row for each term of the prompt
    return docs.where(functools.reduce(operator.or_, X.holds(F.col("text"), asked), F.lit(False)))


def alias_expansions(prompt: Column) -> Column:
    """L4: the long forms of short names that stand in a prompt as words of their own, in order of the list."""
    low = F.lower(X.glyphs(prompt))
    hits = [F.when(F.rlike(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_-]){k}(?![\p{{L}}\p{{N}}_-])")), F.lit(v)) for k, v in ALIASES.items()]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def focus_terms(*parts: Column) -> Column:
    """Q16: the terms of over two characters of a context's focus and subject."""
    return F.filter(F.array_distinct(F.flatten(F.array(*[F.coalesce(X.term_set(p), F.array().cast("array<string>")) for p in parts]))), lambda t: F.length(t) > 2)


def unused(candidates: DataFrame, used: Column) -> DataFrame:
    """Q14, Q16: candidates (column text) that say something beyond the used terms."""
    return candidates.where(F.size(F.array_except(X.term_set(F.col("text")), used)) > 0)
