"""DuckDB SQL for the queries that SQL can express: plain definitions of the contracts, without the operators' methods."""

from __future__ import annotations

from .licenses import COVERAGE, LOWER, MERGE, PHRASES, TEMPLATES, UPPER, K

LOW = f"translate(coalesce({{}}, ''), '{UPPER}', '{LOWER}')"
ALNUM = r"regexp_extract_all(" + LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
PLAIN = r"regexp_extract_all(" + LOW + r", '[^\x20\x09-\x0D]+')"

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.vec_id),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(max(n), 0) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM r LEFT JOIN n ON x = vec_id GROUP BY vec_id"""

ITEMS = f"""WITH i AS (SELECT item_id, {ALNUM.format("text")} AS w FROM benchmark), d AS (SELECT doc_id, {ALNUM.format("text")} AS w FROM documents),
size AS (SELECT item_id, w, least(len(w), 10) AS k FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM size)),
pos AS (SELECT doc_id, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, s, k FROM pos JOIN win USING (k, g)),
word AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id),
run AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, item_id, diagonal, count(*) + 9 AS n FROM (SELECT DISTINCT pos.doc_id, w2.item_id, pos.s, pos.s - row_number() OVER (PARTITION BY pos.doc_id, w2.item_id, pos.s - w2.s ORDER BY pos.s) AS diagonal, pos.s - w2.s AS d
 FROM pos JOIN (SELECT item_id, s, array_to_string(list_slice(w, s, s + 9), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 8)) AS s FROM size WHERE k = 10)) w2 ON pos.k = 10 AND pos.g = w2.g) GROUP BY doc_id, item_id, diagonal, d) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(word.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items, sha256(coalesce(ids.ids, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated, coalesce(run.n, 0) AS longest_match
FROM d LEFT JOIN word ON word.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id LEFT JOIN run ON run.doc_id = d.doc_id"""

_NIBBLE = "(position(substr(h, CAST({} AS BIGINT), 1) IN '0123456789abcdef') - 1)"
_FIVE = f"(({_NIBBLE.format('(5 * i) // 4 + 1')} * 256 + {_NIBBLE.format('(5 * i) // 4 + 2')} * 16 + {_NIBBLE.format('(5 * i) // 4 + 3')}) // CAST(power(2, 7 - (5 * i) % 4) AS BIGINT)) % 32"
PAGES = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) || '00' AS h FROM pages), f AS (SELECT t, min(page_id) AS first FROM p GROUP BY t)
SELECT page_id, CAST(strlen(p.t) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({_FIVE} AS BIGINT) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error FROM p JOIN f ON f.t = p.t"""

SETS = f"""WITH RECURSIVE w AS (SELECT doc_id, {PLAIN.format("text")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id)
SELECT n.doc_id, n AS n_shingles, min(c) AS component_id, n.doc_id = min(c) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_GRAM = "array_to_string(list_slice(w, {0}, {0} + " + str(K - 1) + "), ' ')"
_PHRASES = ", ".join(f"({_q(label)}, {len(p)}, {_q(' '.join(p))})" for label, p in PHRASES.items())
LICENSES = f"""WITH d AS (SELECT doc_id, {ALNUM.format("text")} AS w FROM documents),
t AS (SELECT template, label, {ALNUM.format("body")} AS w FROM (VALUES {", ".join(f"({i}, {_q(a)}, {_q(b)})" for i, (a, b) in enumerate(TEMPLATES))}) v(template, label, body)),
tg AS (SELECT template, label, len(w) AS words, s - 1 AS place, {_GRAM.format("s")} AS g FROM (SELECT *, unnest(range(1, len(w) - {K - 2})) AS s FROM t)),
hits AS (SELECT doc_id, template, label, words, place, pos, pos - place AS diagonal FROM (SELECT doc_id, s - 1 AS pos, {_GRAM.format("s")} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {K - 2})) AS s FROM d WHERE len(w) >= {K})) JOIN tg USING (g)),
diag AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {MERGE} THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT doc_id, template, diagonal FROM hits)),
span AS (SELECT doc_id, template, diagonal, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM diag),
merged AS (SELECT doc_id, template, label, words, span, min(pos) AS first_word, max(pos) + {K - 1} AS last_word FROM hits JOIN span USING (doc_id, template, diagonal) GROUP BY ALL),
cover AS (SELECT doc_id, template, span, count(DISTINCT p) AS n FROM (SELECT doc_id, template, span, unnest(range(place, place + {K})) AS p FROM hits JOIN span USING (doc_id, template, diagonal)) GROUP BY ALL),
ok AS (SELECT * FROM (SELECT *, n / greatest(words, last_word - first_word + 1 - {2 * MERGE}) AS coverage FROM merged JOIN cover USING (doc_id, template, span)) WHERE coverage >= {COVERAGE}),
best AS (SELECT * FROM (SELECT *, max(coverage) OVER (PARTITION BY doc_id ORDER BY first_word RANGE BETWEEN {K} PRECEDING AND {K} FOLLOWING) AS rival FROM ok) WHERE coverage >= rival),
found AS (SELECT doc_id, max(coverage) AS coverage, min(first_word) AS span_first, max(last_word) AS span_last FROM best GROUP BY doc_id),
base AS (SELECT doc_id, label, s - 1 AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d), (VALUES {_PHRASES}) p(label, n, phrase) WHERE w[s] = split_part(phrase, ' ', 1) AND array_to_string(list_slice(w, s, s + n - 1), ' ') = phrase),
b AS (SELECT doc_id, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM best) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(b.n, 0) AS n_base, b.first_word, b.last_word, coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
greatest(coalesce(coverage, 0.0), CASE WHEN b.n > 0 THEN 1.0 ELSE 0.0 END) AS score, span_first, span_last
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id"""

PHRASES_SQL = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOW.format("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f AS (SELECT lang, m, g, count(*) AS f FROM (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))) AS g FROM w, (VALUES (1), (2), (3), (4)) v(m) WHERE len(w) >= m) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, g, f AS a, string_split(g, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
cut AS (SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
 JOIN f x ON x.lang = c.lang AND x.g = array_to_string(list_slice(c.w, 1, c.k), ' ') JOIN f y ON y.lang = c.lang AND y.g = array_to_string(list_slice(c.w, c.k + 1, c.m), ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (SELECT lang, g, max(a) AS a FROM (SELECT lang, a, unnest(list_concat(list_transform(range(1, m), lambda i: array_to_string(list_slice(w, i, i + 1), ' ')), CASE WHEN m = 4 THEN [array_to_string(list_slice(w, 1, 3), ' '), array_to_string(list_slice(w, 2, 4), ' ')] ELSE [] END)) AS g FROM c WHERE m > 2) GROUP BY lang, g)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, best.a DESC, best.g) AS rank, best.g AS phrase, best.a, l, r, n, score FROM best JOIN n ON n.lang = best.lang LEFT JOIN longer ON longer.lang = best.lang AND longer.g = best.g
WHERE longer.a IS NULL OR 100 * CAST(longer.a AS HUGEINT) < 80 * CAST(best.a AS HUGEINT) QUALIFY rank <= 2000"""

ORACLES: dict[str, str] = {"op3_vectors": VECTORS, "op4_decontaminate": ITEMS, "op6_warc": PAGES, "op7_minmax": SETS, "op8_licenses": LICENSES, "op12_phrases": PHRASES_SQL}
