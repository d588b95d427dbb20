"""Queries over n-grams, graphs, spectral codes, conversations and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import text as X
from ..operators import conversations as C
from ..operators import graph as G
from ..operators import ngrams as N
from ..operators import waves as W
from ..streaming import feeds
from .registered import query, table

TOKENS = r"list_append(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '\d+(?:[.,]\d+)*|[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*|[^\p{L}\p{N}_\s]'), '<EOS>')"
COUNTS = f"""SELECT depth, prefix, target, count(*) AS n FROM (SELECT d AS depth, array_to_string(list_slice(p, i - d, i - 1), ' ') AS prefix, p[i] AS target
FROM (SELECT p, d, unnest(range(3, len(p) + 1)) AS i FROM (SELECT list_concat(['<BOS>', '<BOS>'], {TOKENS}) AS p FROM documents), (SELECT unnest([0, 1, 2]) AS d))) GROUP BY depth, prefix, target"""


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


@query(f"SELECT depth, prefix, target, n, round(n / sum(n) OVER (PARTITION BY depth, prefix), 9) AS p FROM ({COUNTS})")
def ngram_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """A6, A7, W1, C-4."""
    return N.probabilities(N.transitions(docs(spark, folder)), ordered=True).select(F.col("depth").cast("long").alias("depth"), "prefix", "target", "n", F.round("p", 9).alias("p"))


@query(f"SELECT depth, prefix, target, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY depth, prefix ORDER BY n DESC, target) AS rank FROM ({COUNTS})) WHERE rank <= 3")
def transition_topk(spark: SparkSession, folder: str) -> DataFrame:
    """G-1: likeliest next tokens."""
    out = N.top_transitions(N.transitions(docs(spark, folder), order=2))
    return out.select(F.col("depth").cast("long").alias("depth"), "prefix", "target", "n", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH e AS (SELECT target, sum(p) AS energy FROM (SELECT target, n / sum(n) OVER (PARTITION BY depth, prefix) AS p FROM ({COUNTS})) GROUP BY target)
SELECT target, round(energy, 5) AS energy, round(energy / (SELECT sqrt(sum(energy * energy)) FROM e), 7) AS amplitude FROM e""")
def symbol_energy(spark: SparkSession, folder: str) -> DataFrame:
    """A8, A10."""
    return N.symbol_energy(N.transitions(docs(spark, folder))).select("target", F.round("energy", 5).alias("energy"), F.round("amplitude", 7).alias("amplitude"))


@query(r"""SELECT token, form, n FROM (SELECT token, form, n, row_number() OVER (PARTITION BY token ORDER BY n DESC, doc_id, place) AS r FROM (
SELECT replace(lower(form), 'ß', 'ss') AS token, form, count(*) AS n, min(doc_id) AS doc_id, min(place) FILTER (WHERE doc_id = first) AS place FROM (
SELECT *, min(doc_id) OVER (PARTITION BY form) AS first FROM (SELECT doc_id, unnest(w) AS form, unnest(range(0, len(w))) AS place FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM documents))) GROUP BY token, form)) WHERE r = 1""")
def surface_mode(spark: SparkSession, folder: str) -> DataFrame:
    """A13."""
    return N.surface_mode(docs(spark, folder))


@query(r"""SELECT a, b, token, form, n FROM (SELECT *, row_number() OVER (PARTITION BY a, b, token ORDER BY n DESC, form) AS r FROM (
SELECT replace(lower(w[i - 2]), 'ß', 'ss') AS a, replace(lower(w[i - 1]), 'ß', 'ss') AS b, replace(lower(w[i]), 'ß', 'ss') AS token, w[i] AS form, count(*) AS n
FROM (SELECT w, unnest(range(3, len(w) + 1)) AS i FROM (SELECT regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM documents)) GROUP BY a, b, token, form)) WHERE r = 1""")
def context_form(spark: SparkSession, folder: str) -> DataFrame:
    """A14."""
    return N.context_form(docs(spark, folder))


@query()
def group_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """A28, C-5: fingerprints of each source's token sequences."""
    return N.group_fingerprint(docs(spark, folder), by="source")


@query()
def decode_beam(spark: SparkSession, folder: str) -> DataFrame:
    """G-3: beam-decoded continuations of the first words of the test items."""
    items = table(spark, folder, "benchmark")
    prompts = items.select(F.col("item_id").alias("prompt_id"), F.concat_ws(" ", F.slice(F.split("text", " "), 1, 2)).alias("text"))
    return N.decode_beam(prompts, N.transitions(docs(spark, folder)), steps=6)


@query()
def decode_sample(spark: SparkSession, folder: str) -> DataFrame:
    """G-3: seeded samples from all transitions."""
    prompts = table(spark, folder, "benchmark").select(F.col("item_id").alias("prompt_id"), F.lit("").alias("text"))
    return N.sample_decode(prompts, N.transitions(docs(spark, folder)), seed=7)


EDGES = "SELECT DISTINCT 'supplier-' || s_suppkey AS subject, 'nation-' || s_nationkey AS object FROM supplier UNION SELECT 'nation-' || n_nationkey, 'region-' || n_regionkey FROM nation"


def _triples(spark: SparkSession, folder: str) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind + "-"), F.col(c).cast("string"))
    supplier = table(spark, folder, "supplier").select(name("supplier", "s_suppkey").alias("subject"), F.lit("is_a").alias("predicate"), name("nation", "s_nationkey").alias("object"), F.lit("supplier").alias("source"))
    nation = table(spark, folder, "nation").select(name("nation", "n_nationkey").alias("subject"), F.lit("is_a").alias("predicate"), name("region", "n_regionkey").alias("object"), F.lit("nation").alias("source"))
    return supplier.unionByName(nation)


@query(f"SELECT subject, object, min(source) AS source FROM (SELECT subject, object, split_part(subject, '-', 1) AS source FROM ({EDGES})) GROUP BY subject, object")
def edge_witness(spark: SparkSession, folder: str) -> DataFrame:
    """N-1, W7."""
    return G.edges(_triples(spark, folder))


@query(f"SELECT subject AS node FROM ({EDGES}) UNION SELECT object FROM ({EDGES})")
def graph_nodes_union(spark: SparkSession, folder: str) -> DataFrame:
    """U1."""
    return G.nodes(G.edges(_triples(spark, folder)))


@query(f"""WITH RECURSIVE e AS ({EDGES}), n AS (SELECT subject AS node FROM e UNION SELECT object FROM e),
r AS (SELECT node AS start, node, 0 AS hops FROM n UNION SELECT r.start, e.object, r.hops + 1 FROM r JOIN e ON e.subject = r.node WHERE r.hops < 4)
SELECT start, node, CAST(min(hops) AS BIGINT) AS hops FROM r GROUP BY start, node""")
def reachability(spark: SparkSession, folder: str) -> DataFrame:
    """N-2: every reachable pair with its shortest number of hops."""
    return G.reachable(G.edges(_triples(spark, folder)), max_hops=4).select("start", "node", F.col("hops").cast("long").alias("hops"))


@query(f"""WITH e AS ({EDGES}) SELECT 'supplier-' || s_suppkey AS subject, 'region-' || r AS target, n_regionkey = r AS proved, CASE WHEN n_regionkey = r THEN 'proved_by_transitivity' ELSE 'no_path' END AS reason
FROM supplier JOIN nation ON n_nationkey = s_nationkey, (SELECT r_regionkey AS r FROM region) WHERE r IN (SELECT n_regionkey FROM nation WHERE n_nationkey = n_nationkey)""")
def inference(spark: SparkSession, folder: str) -> DataFrame:
    """N-2: whether each supplier is in each region, with the reason."""
    sup = table(spark, folder, "supplier").select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("subject"))
    reg = table(spark, folder, "nation").select(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("target")).distinct()
    return G.infer(G.edges(_triples(spark, folder)), sup.join(F.broadcast(reg))).select("subject", "target", "proved", "reason")


@query("SELECT conv_id, turn, prompt, text AS answer FROM (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS prompt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND before = 'user'")
def parent_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """W9."""
    return C.pairs(table(spark, folder, "conversations"))


@query("""SELECT conv_id || ':' || turn AS message_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth FROM conversations""")
def parent_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Depth of each turn below its conversation's first turn, by joins up the chain."""
    t = table(spark, folder, "conversations")
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = t.select(name.alias("message_id"), F.when(F.col("turn") > 0, F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))).alias("parent_id"), F.col("conv_id").alias("message_tree_id"), "role")
    return G.parent_chains(rows).select("message_id", F.col("depth").cast("long").alias("depth"))


@query("SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 2000")
def history_budget(spark: SparkSession, folder: str) -> DataFrame:
    """W10, W11."""
    return C.history(table(spark, folder, "conversations"), 2000).select("conv_id", "turn", "used")


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, count(*) AS turns FROM conversations GROUP BY conv_id")
def conversation_revisions(spark: SparkSession, folder: str) -> DataFrame:
    """D5."""
    return C.latest(table(spark, folder, "conversations"))


@query(r"""SELECT conv_id, turn, coalesce(last_value(nullif(regexp_extract(text, '\p{Lu}\p{L}{9,}', 0), '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '-') AS subject FROM conversations""")
def subject_carry_forward(spark: SparkSession, folder: str) -> DataFrame:
    """The first long capitalised word of a turn, or that of an earlier turn."""
    own = F.regexp_extract("text", r"\p{Lu}\p{L}{9,}", 0)
    return C.carried(table(spark, folder, "conversations"), own).select("conv_id", "turn", "subject")


@query(r"""SELECT conv_id, turn, trigram, n FROM (SELECT conv_id, turn, array_to_string(list_slice(w, i, i + 2), ' ') AS trigram, count(*) AS n FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+') AS w FROM conversations)) GROUP BY conv_id, turn, trigram) WHERE n >= 2""")
def trigram_loops(spark: SparkSession, folder: str) -> DataFrame:
    """X28."""
    return C.repeated_trigrams(table(spark, folder, "conversations"), 2)


_RL = lambda x, p: f"regexp_matches({x}, '{p}')"
_COUNT = lambda x: f"len(string_split({x}, ' '))"


@query(f"""SELECT conv_id, turn, {L.kind_sql("p", _RL, _COUNT)} AS kind FROM (SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+'), ' ') AS p FROM conversations)""")
def intent_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """L1, L2."""
    return L.with_kind(table(spark, folder, "conversations")).select("conv_id", "turn", "kind")


@query()
def prompt_targets(spark: SparkSession, folder: str) -> DataFrame:
    """What each user turn asks about, its topics and parts."""
    users = table(spark, folder, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", L.target(F.col("text")).alias("target"), L.topics(F.col("text")).alias("topics"), L.sub_questions(F.col("text")).alias("parts"))


@query("SELECT doc_id, round(list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: (CAST('0x' || h AS INTEGER) - 127.5) / 127.5 * ((CAST('0x' || h AS INTEGER) - 127.5) / 127.5))), 6) AS energy FROM documents")
def byte_energy(spark: SparkSession, folder: str) -> DataFrame:
    """A11."""
    return docs(spark, folder).select("doc_id", F.round(W.byte_energy(F.col("text")), 6).alias("energy"))


@query("SELECT doc_id, greatest(strlen(text), 1) AS length, CAST(sum(greatest(strlen(text), 1)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_mode FROM documents")
def cumulative_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """W3."""
    return W.offsets(docs(spark, folder))


@query("""WITH e AS (SELECT doc_id, greatest(strlen(text), 1) AS length, sum(greatest(strlen(text), 1)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS end_mode FROM documents),
s AS (SELECT i AS point, CAST(floor(i * ((SELECT max(end_mode) FROM e) - 1) / 63.0) AS BIGINT) AS coordinate FROM (SELECT unnest(range(0, 64)) AS i))
SELECT point, coordinate, doc_id, CAST(coordinate - (end_mode - length) AS BIGINT) AS place FROM s JOIN e ON coordinate >= end_mode - length AND coordinate < end_mode""")
def coordinate_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """K10, J11."""
    return W.coordinate_lookup(docs(spark, folder), 64)


@query()
def physical_energy(spark: SparkSession, folder: str) -> DataFrame:
    """Energies of the codes of all texts; a text that is null counts as empty."""
    rows = docs(spark, folder).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", F.round(W.code_energy("text"), 4).alias("physical"), F.round(W.byte_energy(F.col("text")), 6).alias("energy"))


@query("SELECT doc_id, text AS decoded, true AS valid FROM documents")
def codec_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts encoded, turned by a phase, recovered and decoded."""
    packets = docs(spark, folder).select("doc_id", W.turned_back(F.col("text"), 1.25).alias("payload"), F.octet_length("text").alias("byte_length"), F.sha2("text", 256).alias("sha256"))
    return W.read(packets).select("doc_id", "decoded", "valid")


@query()
def wave_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """V-1: displacements at sixteen coordinates."""
    return W.snapshot(docs(spark, folder), seconds=0.5, points=16)


@query("""WITH i AS (SELECT p_partkey, p_size AS g, 1 + p_size / 50.0 AS s FROM part) SELECT p_partkey, round(s / sum(s) OVER (PARTITION BY g % 5), 9) AS probability FROM (SELECT p_partkey, g, (1 + g / 50.0) * (1 + g / 50.0) * (1 + 0.15 * 0.5) * (1 + 0.15 * 0.5) AS s FROM i)""")
def prob_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Intensities of parts by size, as probabilities in five groups."""
    rows = table(spark, folder, "part").select("p_partkey", (F.col("p_size") % 5).alias("g"), N.interference_probability(F.lit(1.0), F.col("p_size") / 50.0, F.lit(0.5), phase=0.0).alias("s"))
    return N.normalised(rows, "s", by=["g"]).select("p_partkey", F.round("probability", 9).alias("probability"))


@query(r"""WITH a AS (SELECT term AS symbol, count(*) AS amplitude FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents WHERE lang = 'en') GROUP BY term),
b AS (SELECT term AS symbol, count(*) AS amplitude FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents WHERE lang = 'fr') GROUP BY term)
SELECT round((SELECT sum(a.amplitude * b.amplitude) FROM a JOIN b USING (symbol)) / (sqrt((SELECT sum(amplitude * amplitude) FROM a)) * sqrt((SELECT sum(amplitude * amplitude) FROM b))), 8) AS resonance""")
def field_resonance(spark: SparkSession, folder: str) -> DataFrame:
    """How alike the word fields of two languages are."""
    field = lambda lang: docs(spark, folder).where(F.col("lang") == lang).select(F.explode(X.all_words(F.lower("text"))).alias("symbol")).groupBy("symbol").agg(F.count("*").cast("double").alias("amplitude"))
    return W.resonance(field("en"), field("fr")).select(F.round("resonance", 8).alias("resonance"))


@query("SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def conversation_state(spark: SparkSession, folder: str) -> DataFrame:
    """ST4: state of each conversation from a stream."""
    turns = table(spark, folder, "conversations")
    return feeds.session_state(spark, feeds.landed(turns), turns.schema)


@query("SELECT event_id, user_id, event_type, value FROM events")
def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """ST1-ST3: the events taken up by a stream."""
    events = table(spark, folder, "events")
    return feeds.replay(spark, feeds.landed(events), events.schema, key=["event_id"]).select("event_id", "user_id", "event_type", "value")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """An addition: tumbling windows over the events with a watermark."""
    events = table(spark, folder, "events")
    return feeds.event_windows(spark, feeds.landed(events), events.schema, late="3650 days")
