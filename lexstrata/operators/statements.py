"""From records to statements: subjects, mentions, facets, facts and questions about them (C-1 to C-3, C-6, J12-J15, A15-A17, L6-L7, L10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Fixed values that results depend on: verbs that join a subject and what is said of it; words that can't open a subject.
COPULA = "ist|sind|war|waren|bezeichnet|bedeutet|beschreibt|nennt|entspricht|misst|wird|werden|liegt|liegen|besteht|bestehen|gilt|gelten|hat|haben|is|are|was|were|means|est|sont|es|son"
NOT_SUBJECTS = "sie|ihre|ihrer|ihr|er|seine|seiner|es|dessen|diese|dieser|dazu|dabei|für|bei|mit|wenn|dann"


def records(docs: DataFrame) -> DataFrame:
    """C-1: (doc_id, title, body), the first of equal title and collapsed body."""
    split = docs.select("doc_id", X.title_of(F.col("text"), 100).alias("title"), X.body_of(F.col("text"), 100).alias("body"))
    key = F.xxhash64("title", X.collapsed(F.col("body")))
    first = split.groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id"))
    return split.join(first.select("doc_id"), "doc_id", "left_semi")


def subject(sentence: Column) -> Column:
    """What a sentence is about: up to eight words before its first copula, with a capital among them; else empty."""
    head = F.trim(F.regexp_extract(sentence, rf"(?i)^\s*(.+?)\s+(?:{COPULA})\b", 1))
    owner = F.regexp_extract(sentence, rf"(?i)\b(?:Einheit|Formel|Definition|Berechnung|Bedeutung)\s+(?:der|des|von)\s+(.+?)\s+(?:{COPULA})\b", 1)
    fine = (F.size(F.split(head, r"\s+")) <= 8) & ~F.rlike(head, F.lit(rf"(?i)^(?:{NOT_SUBJECTS})(\s|$)")) & F.rlike(head, F.lit(r"\p{Lu}"))
    return F.when(owner != "", X.concept(owner)).when(fine & (head != ""), X.concept(head)).otherwise(F.lit(""))


def statements(docs: DataFrame) -> DataFrame:
    """C-3, W2: (doc_id, position, sentence, subject, facets); a sentence without subject takes the last one, else the title's."""
    cut = records(docs).select("doc_id", "title", F.posexplode(X.sentences(F.col("body"))).alias("position", "sentence"))
    by = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.nullif(F.col("own"), F.lit("")), ignorenulls=True).over(by)
    named = cut.withColumn("own", subject(F.col("sentence"))).withColumn("subject", F.coalesce(carried, X.concept(F.col("title"))))
    return named.select("doc_id", "position", "sentence", "subject", X.statement_facets(F.col("sentence")).alias("facets"))


def concepts(docs: DataFrame) -> DataFrame:
    """C-2, A15: distinct concepts that titles and subjects name."""
    titles = records(docs).select(X.concept(F.col("title")).alias("concept"))
    return titles.union(statements(docs).select("subject")).where("concept <> ''").distinct()


def phrase_matches(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, phrase, first, last) where a phrase's words stand in a text; matches inside longer ones are dropped.

    Words are joined to phrases by their first word, so only places that can begin a phrase are compared.
    """
    listed = phrases.select("phrase", F.split("phrase", " ").alias("p")).withColumn("head", F.col("p")[0])
    tokens = docs.select("doc_id", F.transform(X.all_words(F.col("text")), X.folded).alias("w"))
    hits = tokens.select("doc_id", "w", F.posexplode("w").alias("first", "head")).join(F.broadcast(listed), "head")
    found = hits.where(F.slice("w", F.col("first") + 1, F.size("p")) == F.col("p")).select("doc_id", "phrase", "first", (F.col("first") + F.size("p") - 1).alias("last"))
    longer = found.select("doc_id", F.col("first").alias("a"), F.col("last").alias("b")).distinct()
    inside = (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("y.a") <= F.col("x.first")) & (F.col("y.b") >= F.col("x.last")) & (F.col("y.b") - F.col("y.a") > F.col("x.last") - F.col("x.first"))
    return found.alias("x").join(longer.alias("y"), inside, "left_anti")


def overlapping(spans: DataFrame, answers: DataFrame) -> DataFrame:
    """Sentence spans (doc_id, begin, end) that an answer span of the same document touches."""
    touch = (F.col("s.doc_id") == F.col("a.doc_id")) & (F.col("s.begin") < F.col("a.end")) & (F.col("s.end") > F.col("a.begin"))
    return spans.alias("s").join(answers.select("doc_id", "begin", "end").alias("a"), touch, "left_semi")


def vocabulary(docs: DataFrame) -> DataFrame:
    """Distinct tokens and the end token."""
    tokens = docs.select(F.explode(F.array_distinct(X.compiler_tokens(F.col("text")))).alias("token")).distinct()
    return tokens.union(docs.sparkSession.range(1).select(F.lit("<EOS>"))).distinct()


def remapped(edges: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by old token number (token_id) with the numbers of a new vocabulary (token, token_id)."""
    both = old.withColumnRenamed("token_id", "old_id").join(new.withColumnRenamed("token_id", "new_id"), "token")
    return edges.join(both.select("old_id", "new_id"), edges["token_id"] == F.col("old_id")).drop("token_id", "old_id").withColumnRenamed("new_id", "token_id")


def facts(statement_rows: DataFrame) -> DataFrame:
    """C-6, L10: (subject, verb, object) of statements that join two phrases by a copula."""
    parts = rf"^\s*.+?\s+({COPULA})\s+(.+?)[.!?]?\s*$"
    verb, rest = F.lower(F.regexp_extract("sentence", rf"(?i){parts}", 1)), F.regexp_extract("sentence", rf"(?i){parts}", 2)
    rows = statement_rows.select("doc_id", "position", "subject", verb.alias("verb"), X.concept(rest).alias("object"))
    return rows.where("subject <> '' AND verb <> '' AND object <> ''").dropDuplicates(["subject", "verb", "object"])


def bound_values(fact_rows: DataFrame, subject_name: str, verb: str | None = None) -> DataFrame:
    """The object of a subject, if exactly one is stated."""
    rows = fact_rows.where(F.col("subject") == subject_name)
    rows = rows.where(F.col("verb") == verb) if verb else rows
    return rows.select("subject", "object").distinct().groupBy("subject").agg(F.min("object").alias("object"), F.count("*").alias("n")).where("n = 1").drop("n")


def analyse(prompt: str, statement_rows: DataFrame, known: DataFrame) -> DataFrame:
    """Groups (subject, facet) that answer a prompt: its concepts include the subject, its facets the facet."""
    spark = statement_rows.sparkSession
    asked = phrase_matches(spark.createDataFrame([(0, prompt)], "doc_id long, text string"), known.select(F.col("concept").alias("phrase")))
    wanted = [f for f in spark.range(1).select(X.statement_facets(F.lit(prompt)).alias("f")).first()["f"] if f != "about"] or ["about", "definition"]
    groups = statement_rows.select("subject", F.explode("facets").alias("facet")).groupBy("subject", "facet").agg(F.count("*").alias("statements"))
    return groups.join(F.broadcast(asked.select(F.col("phrase").alias("subject")).distinct()), "subject").where(F.col("facet").isin(wanted))
