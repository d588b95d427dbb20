"""Queries of corpus preparation, provenance and the document store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import etl as E
from ..operators import store as S
from .registered import query, quoted, table

WORD_LIST = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+')"
N_WORDS = "len(" + WORD_LIST.format("text") + ")"


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _marked(lang: str) -> str:
    return f"len(list_filter({WORD_LIST.format('text')}, lambda w: replace(lower(w), 'ß', 'ss') IN ({quoted(E.MARKERS[lang])})))"


PLAUSIBLE = "(" + N_WORDS + " > 0 AND coalesce(CASE lang " + " ".join(f"WHEN '{x}' THEN {_marked(x)} >= CASE WHEN {N_WORDS} < 15 THEN 1 ELSE 2 END" for x in E.MARKERS) + " END, false))"
REASON = rf"""CASE WHEN trim(text) = '' THEN 'invalid_source_fields' WHEN regexp_matches(text, '[#$%&*|]{{3}}| \| ') THEN 'empty_exported_field'
WHEN NOT regexp_matches(text, '[.!?]$') THEN 'opening_not_complete_prose' WHEN {N_WORDS} < 8 THEN 'too_few_words' WHEN NOT {PLAUSIBLE} THEN 'language_heuristic'
WHEN length(text) > 24000 THEN 'opening_too_long' WHEN length(text) < 120 THEN 'opening_too_short' ELSE 'accepted' END"""


@query("SELECT doc_id, 'text-' || substr(sha256('[\"\", \"' || text || '\", \"' || source || '\"]'), 1, 24) AS id FROM documents")
def content_id(spark: SparkSession, folder: str) -> DataFrame:
    """IO5, H1: ids from content (texts without characters that JSON escapes)."""
    listed = F.concat(F.lit('["", "'), "text", F.lit('", "'), "source", F.lit('"]'))
    return docs(spark, folder).select("doc_id", F.concat(F.lit("text-"), F.substr(F.sha2(listed, 256), F.lit(1), F.lit(24))).alias("id"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def exact_dedupe_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    """The first document of each text; the shuffle carries digests, not texts."""
    return E.first_wins(docs(spark, folder), F.sha2("text", 256))


@query(r"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY trim(regexp_replace(lower(text), '[ \t\r\n\f\x0B]+', ' ', 'g'))")
def normalized_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """X19, W4."""
    return E.first_wins(docs(spark, folder), F.sha2(X.collapsed(F.lower("text")), 256))


@query(f"SELECT reason, count(*) AS n FROM (SELECT {REASON} AS reason FROM documents) GROUP BY reason")
def reject_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """F8, F9, F23."""
    return E.reject_histogram(docs(spark, folder), E.document_reason(F.col("text"), F.col("lang")))


@query(f"SELECT doc_id FROM documents WHERE {REASON} = 'accepted'")
def accepted_documents(spark: SparkSession, folder: str) -> DataFrame:
    """F8: the documents that no rule rejects."""
    return docs(spark, folder).where(E.document_reason(F.col("text"), F.col("lang")).isNull()).select("doc_id")


@query()
def opening_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Reasons by folded paragraphs (one line is one paragraph here)."""
    reason = E.opening_reason(F.lit(""), F.col("text"), separator=r"\n")
    return docs(spark, folder).groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT lang, count(*) FILTER (WHERE {PLAUSIBLE}) AS plausible, count(*) AS n FROM documents GROUP BY lang")
def language_heuristic(spark: SparkSession, folder: str) -> DataFrame:
    """F14."""
    return docs(spark, folder).groupBy("lang").agg(F.count_if(E.plausible_language(F.col("text"), F.col("lang"))).alias("plausible"), F.count("*").alias("n"))


@query(r"""SELECT doc_id, NOT regexp_matches(text, '(?m)^\s*([-*•#]|\d+[.)])\s') AND len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '[.!?]["'')]?$'))) = 0 AS prose FROM documents""")
def plain_prose(spark: SparkSession, folder: str) -> DataFrame:
    """F15."""
    return docs(spark, folder).select("doc_id", E.plain_prose(F.col("text")).alias("prose"))


@query(r"""SELECT doc_id, count(*) FILTER (WHERE length(x) <= 90 AND NOT regexp_matches(x, '[.!?:]$') AND len(regexp_split_to_array(trim(x), '\s+')) <= 9) AS headings FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) GROUP BY doc_id""")
def heading_lines(spark: SparkSession, folder: str) -> DataFrame:
    """F20."""
    lines = docs(spark, folder).select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return lines.groupBy("doc_id").agg(F.count_if(E.heading_line(F.col("x"))).alias("headings"))


@query("SELECT doc_id, sha256('sample-1:' || doc_id) AS rank FROM documents ORDER BY rank, doc_id LIMIT 50")
def hash_rank_sample(spark: SparkSession, folder: str) -> DataFrame:
    """W5, K3."""
    return E.hash_sample(docs(spark, folder), "sample-1", 50).select("doc_id", "rank")


@query("""WITH r AS (SELECT doc_id, sha256('sample-2:' || doc_id) AS rank, lang = 'de' AS priority FROM documents),
h AS (SELECT * FROM r WHERE priority ORDER BY rank, doc_id LIMIT 20), g AS (SELECT * FROM r WHERE NOT priority ORDER BY rank, doc_id LIMIT 100)
SELECT doc_id, priority FROM (SELECT * FROM h UNION ALL SELECT * FROM g) ORDER BY priority DESC, rank, doc_id LIMIT 100""")
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """K4."""
    return E.stratified_sample(docs(spark, folder), F.col("lang") == "de", seed="sample-2", first=20, total=100).select("doc_id", "priority")


@query("""SELECT doc_id, place, CASE WHEN place <= 20 THEN 20 WHEN place <= 60 THEN 60 ELSE 100 END AS step FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('sample-3:' || doc_id), doc_id) AS place FROM documents) WHERE place <= 100""")
def nested_steps(spark: SparkSession, folder: str) -> DataFrame:
    """K5, U4."""
    return E.nested_steps(docs(spark, folder), "sample-3", [20, 60, 100]).select("doc_id", F.col("place").cast("long").alias("place"), "step")


@query(r"""SELECT doc_id FROM documents WHERE trim(regexp_replace(lower(text), '[ \t\r\n\f\x0B]+', ' ', 'g')) IN (SELECT trim(regexp_replace(lower(text), '[ \t\r\n\f\x0B]+', ' ', 'g')) FROM benchmark UNION ALL SELECT trim(regexp_replace(lower(text), '[ \t\r\n\f\x0B]+', ' ', 'g')) FROM documents WHERE doc_id % 100 = 7)""")
def leakage_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that equal a forbidden text (test items and a held-out hundredth of the documents)."""
    held = docs(spark, folder).where("doc_id % 100 = 7").select("text")
    return E.leaked(docs(spark, folder), table(spark, folder, "benchmark").select("text").unionByName(held)).select("doc_id")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))""")
def already_productive_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are new by id and by text."""
    d, labels = docs(spark, folder), table(spark, folder, "labels")
    return E.not_productive(d, labels, d.join(labels.select("doc_id"), "doc_id", "left_semi")).select("doc_id")


@query("SELECT d.doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(quality, 0) >= 0.5 AND coalesce(toxic, 0) <= 0.25")
def quality_filter(spark: SparkSession, folder: str) -> DataFrame:
    """thresholds on labels, absent ones as 0."""
    joined = docs(spark, folder).select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    out = joined.select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return out.where("quality >= 0.5 AND toxic <= 0.25")


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang")
def label_join_left(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and missing provenance rows by language."""
    labels = table(spark, folder, "labels").select("doc_id", F.lit(True).alias("has"))
    return docs(spark, folder).select("doc_id", "lang").join(labels, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("has").isNull()).alias("missing"))


@query("SELECT source, count(*) AS n_rows, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT text) AS texts FROM documents GROUP BY source")
def shard_stats(spark: SparkSession, folder: str) -> DataFrame:
    """A26."""
    return E.shard_stats(docs(spark, folder), "source")


@query(r"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'scheme' WHEN NOT regexp_matches(url, '^https?://([a-z0-9-]+\.)+[a-z]+(/|$)') THEN 'host' WHEN regexp_matches(url, '[?#]') THEN 'query' ELSE 'accepted' END AS reason FROM pages""")
def url_validation(spark: SparkSession, folder: str) -> DataFrame:
    """F8: why an address isn't taken as a source."""
    rule = E.first_reason((~F.rlike("url", F.lit("^https?://")), "scheme"), (~F.rlike("url", F.lit(r"^https?://([a-z0-9-]+\.)+[a-z]+(/|$)")), "host"), (F.rlike("url", F.lit("[?#]")), "query"))
    return table(spark, folder, "pages").select("page_id", F.coalesce(rule, F.lit("accepted")).alias("reason"))


@query("""WITH o AS (SELECT * FROM documents WHERE doc_id % 2 = 0), i AS (SELECT * FROM documents WHERE doc_id % 2 = 1)
SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.text = i.text AND o.source = i.source) OR doc_id <> min(doc_id) OVER (PARTITION BY text, source) THEN 'existing' ELSE 'added' END AS state FROM i""")
def append_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """The odd documents appended to the even ones."""
    d = docs(spark, folder)
    return S.append_split(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"))


@query("""SELECT DISTINCT d.doc_id FROM documents d JOIN documents o ON o.doc_id = d.doc_id + 1 WHERE d.text <> o.text OR d.source <> o.source""")
def id_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Ids whose content differs between two versions (the second is the first, shifted by one)."""
    d = docs(spark, folder).select("doc_id", "text", "source")
    return E.conflicts(d, d.withColumn("doc_id", F.col("doc_id") - 1), "text", "source")


@query("""(SELECT doc_id, lang, 'old' AS side FROM documents WHERE doc_id % 10 = 3 AND lang = 'de') UNION ALL (SELECT doc_id, 'xx' AS lang, 'new' AS side FROM documents WHERE doc_id % 10 = 3 AND lang = 'de')""")
def snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that differ between two snapshots, one of which has some languages changed."""
    old = docs(spark, folder).select("doc_id", "lang")
    new = old.withColumn("lang", F.when((F.col("doc_id") % 10 == 3) & (F.col("lang") == "de"), "xx").otherwise(F.col("lang")))
    return E.snapshot_diff(old, new)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 9000")
def change_feed(spark: SparkSession, folder: str) -> DataFrame:
    """F3, ST1: what came after a revision."""
    return table(spark, folder, "events").where("event_id > 9000").select("event_id", "user_id", "event_type")


@query()
def store_append(spark: SparkSession, folder: str) -> DataFrame:
    """Two appends to a store (the second repeats half of the first), then its statistics."""
    from ..sources.shared import fresh_path, stored

    store = S.DocumentStore(spark, fresh_path(spark, "store"))
    # of equal texts and sources the least id stays; digests are compared, and the rows of both appends are made once
    rows = docs(spark, folder).select("doc_id", "text", "source", S.digest().alias("digest"))
    first = rows.groupBy(F.col("digest").alias("_digest")).agg(F.min("doc_id").alias("_first"))
    rows = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_first")) & F.col("digest").eqNullSafe(F.col("_digest")), "left_semi")
    rows = stored(rows.select(F.col("doc_id").cast("string").alias("id"), "text", "source"), "rows")
    store.append(rows.where("cast(id AS long) % 2 = 0"))
    store.append(rows, expected_revision=1)
    return store.statistics()


@query("SELECT count(*) AS documents, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(strlen(text)) * 32 + count(*) * 4096 * 32 AS BIGINT) AS dense_bytes FROM documents")
def size_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """A2, Y2."""
    n, size = F.count("*"), F.sum(F.octet_length("text"))
    return docs(spark, folder).agg(n.alias("documents"), size.alias("bytes"), (size * 32 + n * 4096 * 32).alias("dense_bytes"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS provenance, (SELECT count(*) FROM conversations) AS turns, (SELECT count(*) FROM events) AS changes")
def store_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of all relations in one row."""
    one = lambda t, n: table(spark, folder, t).agg(F.count("*").alias(n))
    return one("documents", "documents").join(one("labels", "provenance")).join(one("conversations", "turns")).join(one("events", "changes"))


@query("""SELECT lang, quality, count(*) AS cases, CAST(sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS correct, round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, median(n_chars) AS median_chars FROM labels JOIN documents USING (doc_id) GROUP BY lang, quality""")
def retrieval_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, accuracy and median by group."""
    rows = table(spark, folder, "labels").join(docs(spark, folder).select("doc_id", "lang", "n_chars"), "doc_id")
    hit = (F.col("toxic") == 0).cast("int")
    return rows.groupBy("lang", "quality").agg(F.count("*").alias("cases"), F.sum(hit).alias("correct"), F.round(F.avg(hit), 6).alias("accuracy"), F.median("n_chars").alias("median_chars"))


@query("SELECT k, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of JSON properties."""
    return table(spark, folder, "events").select(F.explode(F.json_object_keys("props")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query()
def corpus_digest(spark: SparkSession, folder: str) -> DataFrame:
    """A27, V-5: an order-free digest of the corpus."""
    return E.corpus_digest(docs(spark, folder))


@query("SELECT source, n FROM (SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY source) WHERE langs >= 2 AND starts_with(source, 'src1')")
def prefix_filter(spark: SparkSession, folder: str) -> DataFrame:
    """sources of a prefix with several languages; the prefix reaches the scan."""
    rows = docs(spark, folder).where(F.col("source").startswith("src1"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs")).where("langs >= 2").select("source", "n")
