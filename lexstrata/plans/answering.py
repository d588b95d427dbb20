"""Queries over statements and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import statements as S
from .registered import query, table

PROMPT = "that this hand entre und tion"
PHRASES = ["of the", "and the", "the and the", "de la", "und die"]
FOLDED = r"list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: replace(lower(x), 'ß', 'ss'))"
PLAIN = r"regexp_extract_all(translate(replace(lower({}), 'ß', 'ss'), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy'), '[\p{{L}}\p{{N}}]+')"


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


@query(f"""WITH m AS (SELECT doc_id, phrase, i - 1 AS first, i + n - 2 AS last FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {FOLDED} AS w FROM documents)),
(SELECT phrase, len(string_split(phrase, ' ')) AS n FROM (SELECT unnest([{", ".join(repr(p) for p in PHRASES)}]) AS phrase)) WHERE w[i] = split_part(phrase, ' ', 1) AND array_to_string(list_slice(w, i, i + n - 1), ' ') = phrase)
SELECT doc_id, phrase, first, last FROM m x WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.doc_id = x.doc_id AND y.first <= x.first AND y.last >= x.last AND y.last - y.first > x.last - x.first)""")
def phrase_matches(spark: SparkSession, folder: str) -> DataFrame:
    """J13."""
    listed = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    return S.phrase_matches(docs(spark, folder), listed).select("doc_id", "phrase", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {PLAIN.format('text')} AS w FROM documents) WHERE len(list_intersect(w, ['etre', 'ung', 'hand'])) > 0 AND list_contains(w, 'que')")
def boolean_search(spark: SparkSession, folder: str) -> DataFrame:
    """Q5, Q7: documents with one of some words and all of others, without regard to accents."""
    return A.boolean_search(docs(spark, folder), any_of=["etre", "ung", "hand"], all_of=["que"])


@query(r"""SELECT token FROM (SELECT DISTINCT unnest(list_append(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '\d+(?:[.,]\d+)*|[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*|[^\p{L}\p{N}_\s]'), '<EOS>')) AS token FROM documents)""")
def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """A16."""
    return S.vocabulary(docs(spark, folder))


@query("""WITH e AS (SELECT doc_id, n_chars FROM documents), s AS (SELECT doc_id, i * 100 AS a, i * 100 + 100 AS b FROM (SELECT doc_id, unnest(range(0, n_chars // 100 + 1)) AS i FROM e))
SELECT s.doc_id, a AS "begin", b AS "end" FROM s JOIN e ON e.doc_id = s.doc_id WHERE a < n_chars // 2 + 150 AND b > n_chars // 2""")
def span_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of a hundred characters that a span in the middle of each text touches."""
    d = docs(spark, folder).select("doc_id", "n_chars")
    spans = d.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("n_chars div 100"))).alias("i")).select("doc_id", (F.col("i") * 100).alias("begin"), (F.col("i") * 100 + 100).alias("end"))
    asked = d.select("doc_id", F.expr("n_chars div 2").alias("begin"), F.expr("n_chars div 2 + 150").alias("end"))
    return S.overlapping(spans, asked)


@query()
def statement_rows(spark: SparkSession, folder: str) -> DataFrame:
    """C-1 to C-3, X10, X12, W2."""
    return S.statements(docs(spark, folder))


@query()
def concept_rows(spark: SparkSession, folder: str) -> DataFrame:
    """C-2, A15."""
    return S.concepts(docs(spark, folder))


@query()
def fact_rows(spark: SparkSession, folder: str) -> DataFrame:
    """C-6, L10."""
    return S.facts(S.statements(docs(spark, folder)))


@query()
def overlap_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Q10."""
    return A.overlap_ranking(docs(spark, folder), PROMPT)


@query()
def planned_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Q9."""
    return A.planned_ranking(docs(spark, folder), [["hand", "entre"], ["that", "und"]])


@query()
def working_set(spark: SparkSession, folder: str) -> DataFrame:
    """Q8, W11."""
    return A.working_set(docs(spark, folder), PROMPT, budget=12_000).select("doc_id", "passage", "bm25", "used")


@query()
def composed_answer(spark: SparkSession, folder: str) -> DataFrame:
    """Q11-Q15, A29."""
    return A.compose(docs(spark, folder), PROMPT)


@query()
def prompt_probes(spark: SparkSession, folder: str) -> DataFrame:
    """Q17."""
    return A.probes(docs(spark, folder), 25)


@query()
def echo_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each answer its prompt has."""
    from ..operators.conversations import pairs

    return pairs(table(spark, folder, "conversations")).select("conv_id", "turn", F.round(A.echo_share(F.col("answer"), F.col("prompt")), 6).alias("share"))
