"""Queries over fields, contexts, sentence scores, curated titles and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import etl as E
from ..operators import fields as P
from ..operators import graph as G
from ..operators import ngrams as N
from ..operators import scoring as S
from ..operators import store as D
from ..sources.shared import fresh_path
from .models import COUNTS
from .registered import query, quoted, table
from .text_search import KEPT, PROMPT, STOP, WORDS

CURATED = [("NATION_1", "north"), ("NATION_2", "north"), ("NATION_14", "south"), ("NATION_3", "south"), ("ATLANTIS", "sea"), ("nation_5", "north")]
SPOKEN = WORDS.format("text")
ALPHA = r"'^\p{L}+$'"


@query(f"""WITH s AS (SELECT conv_id, turn, {SPOKEN} AS w FROM conversations), p AS (SELECT conv_id, turn, unnest(w) AS w, unnest(range(0, len(w))) AS i FROM s),
z AS (SELECT conv_id, turn, w, i, i + d AS j, abs(d) AS d FROM p, (SELECT unnest(range(-6, 7)) AS d) WHERE d <> 0),
c AS (SELECT x.w AS a, y.w AS b, sum(1.0 / (1 + x.d)) AS weight FROM z x JOIN p y ON x.conv_id = y.conv_id AND x.turn = y.turn AND y.i = x.j
WHERE x.w <> y.w AND regexp_matches(x.w, {ALPHA}) AND regexp_matches(y.w, {ALPHA}) AND x.w NOT IN ({STOP}) GROUP BY a, b)
SELECT a, b, round(weight / max(weight) OVER (PARTITION BY a) + 1e-10, 6) AS weight FROM c""")
def cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    """Words of turns that stand near each other."""
    turns = table(spark, folder, "conversations").select(X.all_words(X.folded(F.col("text"))).alias("t"))
    return P.cooccurrence(turns).withColumn("weight", F.round(F.col("weight") + 1e-10, 6))


FIELD = f"""SELECT conv_id, role, token, n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, role)) AS amplitude FROM (SELECT conv_id, role, token, CAST(count(*) AS DOUBLE) AS n
FROM (SELECT conv_id, role, unnest({SPOKEN}) AS token FROM conversations) WHERE token NOT IN ({STOP}) AND regexp_matches(token, '^([\\p{{L}}]+|[\\p{{Nd}}].*)$') GROUP BY conv_id, role, token)"""


@query(f"SELECT conv_id, role, token, round(amplitude, 9) AS amplitude FROM ({FIELD})")
def prompt_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Unit amplitudes of the words of each role in a conversation."""
    return P.prompt_field(table(spark, folder, "conversations"), "conv_id", "role").select("conv_id", "role", "token", F.round("amplitude", 9).alias("amplitude"))


@query(f"""WITH c AS (SELECT conv_id, token, sum(amplitude) AS amplitude FROM ({FIELD}) WHERE role IN ('user', 'assistant') GROUP BY conv_id, token),
u AS (SELECT conv_id, token, amplitude / sqrt(sum(amplitude * amplitude) OVER (PARTITION BY conv_id)) AS amplitude FROM c)
SELECT conv_id, token, round(amplitude, 9) AS amplitude, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(amplitude, 12) DESC, token) AS rank FROM u WHERE amplitude > 1e-8) WHERE rank <= 256""")
def context_modes(spark: SparkSession, folder: str) -> DataFrame:
    """G-4, K7: the context that a conversation keeps of what was asked and answered."""
    kept = P.strongest(P.context(table(spark, folder, "conversations"), "conv_id", "role", ("user", "assistant")), "conv_id")
    return kept.select("conv_id", "token", F.round("amplitude", 9).alias("amplitude"), F.col("rank").cast("long").alias("rank"))


@query()
def context_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each conversation's stored context keeps its bounds."""
    modes = P.prompt_field(table(spark, folder, "conversations"), "conv_id").groupBy("conv_id").agg(F.collect_list(F.struct("token", "amplitude")).alias("modes"))
    return modes.select("conv_id", P.valid_context(F.col("modes")).alias("valid"))


@query(f"""SELECT token, round(sum(share), 9) AS energy FROM (SELECT unnest(w) AS token, 1.0 / len(w) AS share FROM (SELECT {WORDS.format('text')} AS w FROM benchmark) WHERE len(w) > 0) GROUP BY token""")
def role_energy(spark: SparkSession, folder: str) -> DataFrame:
    """Energy that roles, here the items, spread over their words."""
    return P.role_energy(table(spark, folder, "benchmark").select(X.all_words(X.folded(F.col("text"))).alias("tokens"))).withColumn("energy", F.round("energy", 9))


@query(f"SELECT prefix, target, round(sqrt(n / sum(n) OVER (PARTITION BY depth, prefix)), 9) AS amplitude FROM ({COUNTS}) WHERE depth = 1")
def field_modes(spark: SparkSession, folder: str) -> DataFrame:
    """Amplitudes of the arcs after one token."""
    rows = N.probabilities(N.transitions(table(spark, folder, "documents"), order=2).where("depth = 1"))
    return P.field_modes(rows).select("prefix", "target", F.round("amplitude", 9).alias("amplitude"))


@query(f"""WITH w AS (SELECT term AS token, CAST(count(*) AS DOUBLE) AS amplitude FROM ({KEPT}) GROUP BY term), a AS (SELECT * FROM w WHERE token IN (SELECT unnest({WORDS.format('text')}) FROM benchmark))
SELECT token, round(0.15 * amplitude / (SELECT sqrt(sum(amplitude * amplitude)) FROM a), 9) AS amplitude FROM a""")
def mode_prior(spark: SparkSession, folder: str) -> DataFrame:
    """The prior of the items' words from the words of all documents."""
    wave = table(spark, folder, "documents").select(F.explode(X.search_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").cast("double").alias("amplitude"))
    active = table(spark, folder, "benchmark").select(F.explode(X.all_words(X.folded(F.col("text")))).alias("token"))
    return P.mode_prior(wave, active, 0.15).withColumn("amplitude", F.round("amplitude", 9))


@query()
def stable_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """H3: frequencies of the items' words."""
    words = table(spark, folder, "benchmark").select(F.explode(X.search_tokens(F.col("text"))).alias("token")).distinct()
    return words.select("token", P.stable_frequency()("token").alias("frequency"))


@query()
def readout_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Interference of document words with the items' words, computed in two ways."""
    rows = mode_prior(spark, folder).select("amplitude", F.col("amplitude").alias("p"))
    return P.readouts(rows, phase=0.3)


@query()
def context_spectra(spark: SparkSession, folder: str) -> DataFrame:
    """V-3, M5: sampled spectra of the conversations' contexts."""
    return P.spectrum(P.prompt_field(table(spark, folder, "conversations"), "conv_id"), "conv_id", points=16)


@query(f"SELECT doc_id, CAST(len(list_distinct(list_filter({WORDS.format('text')}, lambda w: w NOT IN ({STOP})))) AS BIGINT) AS n_words FROM documents")
def surface_words(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct written words of each document."""
    return table(spark, folder, "documents").select("doc_id", F.size(X.surface_words(F.col("text"))).cast("long").alias("n_words"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\d+(?:[.,]\d+)*|[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*|[^\p{L}\p{N}_\s]')) AS BIGINT) AS n_tokens FROM documents")
def composed_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Compiler tokens of texts brought to composed form."""
    return table(spark, folder, "documents").select("doc_id", F.size(X.compiler_tokens(F.col("text"), normal=False)).cast("long").alias("n_tokens"))


@query()
def sentence_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Where sentences stand in each document, and how many a reader would speak."""
    return table(spark, folder, "documents").select("doc_id", X.sentence_spans(F.col("text")).alias("spans"), F.size(X.spoken_sentences(F.col("text"))).alias("spoken"))


@query()
def rendered_text(spark: SparkSession, folder: str) -> DataFrame:
    """The compiler tokens of each document as text again."""
    return table(spark, folder, "documents").select("doc_id", X.rendered(X.compiler_tokens(F.col("text"))).alias("text"))


@query()
def relation_operands(spark: SparkSession, folder: str) -> DataFrame:
    """X11: concepts that named relations and units speak of, by sentence."""
    cut = table(spark, folder, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("position", "s"))
    return cut.select("doc_id", "position", X.relation_arguments(F.col("s")).alias("operands"), X.unit_owner(F.col("s")).alias("unit_owner")).where((F.size("operands") > 0) | (F.col("unit_owner") != ""))


FORMS = f"""SELECT DISTINCT conv_id, turn, f AS term FROM (SELECT conv_id, turn, unnest(list_concat(list_concat(w, list_transform(list_filter(w, lambda x: suffix(x, 's') AND length(x) > 3), lambda x: regexp_replace(x, 's$', ''))), list_transform(list_filter(w, lambda x: suffix(x, 'n') AND length(x) > 5), lambda x: regexp_replace(x, 'n$', '')))) AS f
FROM (SELECT conv_id, turn, list_filter({SPOKEN}, lambda x: length(x) >= 2) AS w FROM <rows>))"""


@query(f"""WITH n AS (SELECT count(*) AS n FROM conversations), c AS ({FORMS.replace('<rows>', 'conversations')}), q AS ({FORMS.replace('<rows>', f"(SELECT 1 AS conv_id, 1 AS turn, '{PROMPT}' AS text)")}),
d AS (SELECT q.term, count(c.term) AS df FROM q LEFT JOIN c ON c.term = q.term GROUP BY q.term)
SELECT term, round(least(2.0, greatest(0.15, 0.25 + 1.75 * ln(1.0 + n / (1.0 + df)) / ln(1.0 + n))), 9) AS weight FROM d, n""")
def term_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of a prompt's terms among all turns."""
    return S.term_weights(table(spark, folder, "conversations"), [PROMPT]).withColumn("weight", F.round("weight", 9))


@query()
def sentence_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Q12, Q13, K6: all sentences of the items, scored in full."""
    items = table(spark, folder, "benchmark").where("text IS NOT NULL")
    cut = items.select("item_id", X.title_of(F.col("text")).alias("title"), F.posexplode(X.sentences(F.col("text"))).alias("position", "text"))
    return S.sentence_scores(cut.select((F.col("item_id") * 10_000 + F.col("position")).alias("id"), "title", "text", "position"), "Was ist entre hand?", "entre hand")


@query(f"SELECT DISTINCT doc_id FROM ({KEPT}) WHERE term IN ('hand', 'entre')")
def overlap_guard(spark: SparkSession, folder: str) -> DataFrame:
    """documents that share a word with a prompt."""
    return S.overlapping(table(spark, folder, "documents"), "entre the hand").select("doc_id").distinct()


@query(f"SELECT n_nationkey, domain FROM nation JOIN (VALUES {', '.join(str(x) for x in CURATED)}) t(title, domain) ON n_name = title")
def curated_titles(spark: SparkSession, folder: str) -> DataFrame:
    """names that a curated list gives a domain."""
    return E.curated(table(spark, folder, "nation"), spark.createDataFrame(CURATED, "title string, domain string"), "n_name").select("n_nationkey", "domain")


@query("SELECT n_nationkey, n_name IN ('NATION_1', 'NATION_7') OR regexp_matches(n_name, '_2[0-9]$') AS priority FROM nation")
def priority_titles(spark: SparkSession, folder: str) -> DataFrame:
    """F25."""
    return table(spark, folder, "nation").select("n_nationkey", E.priority(F.col("n_name"), ["NATION_1", "NATION_7"], "_2[0-9]$").alias("priority"))


@query(f"""SELECT domain, count(*) FILTER (WHERE n_regionkey < 3) AS accepted, count(*) FILTER (WHERE n_regionkey >= 3) AS rejected, count(*) FILTER (WHERE n_name IS NULL) AS missing
FROM (VALUES {', '.join(str(x) for x in CURATED)}) t(title, domain) LEFT JOIN nation ON n_name = title GROUP BY domain""")
def curated_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What became of the curated names, by domain."""
    found = table(spark, folder, "nation").select(F.col("n_name").alias("title"), F.when(F.col("n_regionkey") >= 3, "region").alias("reason"))
    return E.outcomes(spark.createDataFrame(CURATED, "title string, domain string"), found)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text, source, sha256(text) AS digest FROM documents")
def provenance_rows(spark: SparkSession, folder: str) -> DataFrame:
    """documents with where they come from."""
    return E.provenance(table(spark, folder, "documents"), dataset="documents").select("id", "text", "source", F.col("provenance.text_sha256").alias("digest"))


@query("SELECT doc_id, length(json) AS n_chars FROM (SELECT doc_id, '{\"id\":\"' || doc_id || '\",\"source\":\"' || source || '\"}' AS json FROM documents)")
def metadata_packets(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions of documents as JSON."""
    return E.metadata_packets(table(spark, folder, "documents")).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query("SELECT conv_id, arg_min(text, struct_pack(l := length(text), turn := turn)) AS text, arg_min(turn, struct_pack(l := length(text), turn := turn)) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def shortest_answers(spark: SparkSession, folder: str) -> DataFrame:
    """K9: the shortest answer of each conversation."""
    return E.shortest_of_each(table(spark, folder, "conversations").where("role = 'assistant'"), "conv_id", "text", "turn")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def orphan_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels that would be left if all documents in English went."""
    return D.orphans(table(spark, folder, "labels"), table(spark, folder, "documents").where("lang <> 'en'"), "doc_id").select("doc_id", "quality", "toxic")


@query("SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def id_set_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that only documents or only labels have."""
    return E.same_ids(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN o.doc_id IS NULL THEN 'new' WHEN o.text = n.text AND o.source = n.source THEN 'existing' ELSE 'conflict' END AS state FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text, source FROM documents) n LEFT JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) o ON o.doc_id = n.doc_id) GROUP BY state")
def prepared_import(spark: SparkSession, folder: str) -> DataFrame:
    """Prepared records against those held: new, existing, in conflict."""
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    changed = d.withColumn("text", F.when(F.col("id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return E.prepared(changed, d.where("id % 2 = 0")).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS stamp FROM events")
def utc_stamps(spark: SparkSession, folder: str) -> DataFrame:
    """Times of events as text (times without a zone are taken as they are)."""
    return table(spark, folder, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("stamp"))


@query()
def inference_proofs(spark: SparkSession, folder: str) -> DataFrame:
    """N-2: proofs that suppliers belong to regions, with their edges and sources; the limit of one hop leaves them open."""
    nation, region, supplier = (table(spark, folder, t) for t in ("nation", "region", "supplier"))
    up = lambda d, child, parent: d.select(F.col(child).alias("subject"), F.lit("is_a").alias("predicate"), F.col(parent).alias("object"), F.concat(F.lit("edge:"), child).alias("source"))
    triples = up(nation.join(region, nation.n_regionkey == region.r_regionkey), "n_name", "r_name").unionByName(up(supplier.join(nation, supplier.s_nationkey == nation.n_nationkey), "s_name", "n_name"))
    asked = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey).select(F.col("s_name").alias("subject"), F.col("r_name").alias("target"))
    return G.infer(G.edges(triples), asked).unionByName(G.infer(G.edges(triples), asked, max_hops=1))


@query("""WITH d AS (SELECT DISTINCT text, coalesce(source, 'none') AS source FROM documents WHERE text IS NOT NULL), r AS (SELECT DISTINCT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT CAST(4 AS BIGINT) AS revision, count(*) FILTER (WHERE starts_with(source, 'src1')) AS archived, count(*) FILTER (WHERE NOT starts_with(source, 'src1')) + 1 AS retained, CAST(0 AS BIGINT) AS left_over, CAST(1 AS BIGINT) AS asked, (SELECT count(*) FROM r) AS relations FROM d""")
def store_migration(spark: SparkSession, folder: str) -> DataFrame:
    """D3, D4, N-3, Y5, Y16: a store that is filled, added to, given relations and a question, and parted from the documents of
    some sources; from its commit log."""
    store = D.DocumentStore(spark, fresh_path(spark, "store"))
    store.append(table(spark, folder, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("id"), "text", F.coalesce("source", F.lit("none")).alias("source")))
    store.add_one("one more document", "user")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    store.add_relations(nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("subject"), F.lit("is_a").alias("predicate"), F.col("r_name").alias("object"), F.lit("nation").alias("source")))
    store.record_query("How many?", '{"answer": 1}')
    store.migrate(F.startswith("source", F.lit("src1")))
    now, _ = store.changes_since(store.revision())
    counts = [store.archived().count(), store.documents().count(), D.unpaired_only(store.documents(), prior_source="src1").count(), store.history().count(), store.relations().count()]
    return spark.createDataFrame([(now, *counts)], "revision long, archived long, retained long, left_over long, asked long, relations long")
