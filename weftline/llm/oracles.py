"""Reference SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from .chat import TURN_END, TURN_START
from .decontam import WINDOW
from .embeddings import COSINE
from .linededup import MIN_SITES
from .mixing import CAP, SHARE, SLICE_ROWS, WEIGHTS
from .suffixes import SPAN

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"

DECONTAM = f"""
WITH items AS (SELECT cast(item_id AS varchar) AS item, {words('text', ALNUM)} AS w FROM benchmark),
sized AS (SELECT item, w, least({WINDOW}, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {words('text', ALNUM)} AS w FROM documents),
spread AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n),
hits AS (SELECT s.r, s.i, s.n, b.item FROM (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM spread) s JOIN windows b ON s.n = b.n AND s.win = b.win),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r),
runs AS (SELECT r, min(i) - 1 AS a, max(i + n) - 1 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i, n ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN i > coalesce(max(i + n) OVER (PARTITION BY r ORDER BY i, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS fresh FROM (SELECT DISTINCT r, i, n FROM hits))) GROUP BY r, g),
texts AS (SELECT r, '[' || string_agg('{{"start":' || a || ',"end":' || b || '}}', ',' ORDER BY a) || ']' AS spans FROM runs GROUP BY r)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated, t.spans AS hit_spans
FROM docs d LEFT JOIN covered c ON d.r = c.r LEFT JOIN named m ON d.r = m.r LEFT JOIN texts t ON d.r = t.r"""

MIXING = f"""
WITH slim AS (SELECT row_number() OVER () AS r, doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS bigint) AS size, coalesce(md5(text), '') AS tie FROM documents),
own AS (SELECT source, count(*) AS n, cast(sum(size) AS bigint) AS source_size FROM slim GROUP BY source),
weighed AS (SELECT *, [{', '.join(f'{w}::double' for w in WEIGHTS)}][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)}) + 1] AS weight, source_size * {CAP}::double AS lim, sum(source_size) OVER () * {SHARE}::double AS total FROM own),
ranked AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped, sum(weight) OVER (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM weighed),
levels AS (SELECT arg_min((total - stopped) / rest, stopped) AS level FROM ranked WHERE (total - stopped) / rest * weight <= lim),
targets AS (SELECT source, source_size, coalesce(least(lim, level * weight), lim) AS target FROM ranked, levels),
classed AS (SELECT *, floor(sqrt(size::double) * 2) AS class FROM slim),
counted AS (SELECT *, ceil(count(*) OVER (PARTITION BY source, class) / {SLICE_ROWS}::double)::bigint AS slices FROM classed),
sliced AS (SELECT *, ('0x' || substr(md5(concat_ws(':', doc_id::varchar, tie)), 1, 8))::bigint % slices AS slice FROM counted),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class DESC, slice, size DESC, doc_id ASC NULLS LAST, tie) AS k FROM sliced),
rated AS (SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate, ('0x' || substr(md5(concat_ws(':', '0', p.source)), 1, 8))::bigint / 4294967296.0::double AS shift FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, cast(floor(rate * k + shift) - floor(rate * (k - 1) + shift) AS bigint) AS copies, cast((floor(rate * k + shift) - floor(rate * (k - 1) + shift)) * size AS bigint) AS taken, source FROM rated"""

SUFFIXES = f"""
WITH docs AS (SELECT doc_id, text, dense_rank() OVER (ORDER BY doc_id, text) AS d, row_number() OVER () AS r, {words('text', SPACED)} AS w FROM documents),
spread AS (SELECT r, d, i, array_to_string(w[i : i + {SPAN - 1}], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - {SPAN} + 2)) AS i FROM docs WHERE len(w) >= {SPAN})),
shared AS (SELECT win FROM spread GROUP BY win HAVING count(DISTINCT d) > 1),
starts AS (SELECT s.r, s.i - 1 AS a, CASE WHEN s.i - lag(s.i) OVER (PARTITION BY s.r ORDER BY s.i) <= {SPAN} THEN 0 ELSE 1 END AS fresh FROM spread s JOIN shared h ON s.win = h.win),
runs AS (SELECT r, min(a) AS a, max(a) + {SPAN} AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY a ROWS UNBOUNDED PRECEDING) AS g FROM starts) GROUP BY r, g)
SELECT x.doc_id, y.a AS start_word, y.b AS end_word, cast(len(x.w) AS bigint) AS n_words, cast(sum(y.b - y.a) OVER (PARTITION BY y.r) AS bigint) AS n_repeated FROM runs y JOIN docs x ON x.r = y.r"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT m.vec_id, (SELECT count(*) FROM pairs p WHERE p.a = m.vec_id) AS n_links, c.component AS component_id, m.vec_id = c.component AS kept, m.label FROM embeddings m JOIN (SELECT a, min(b) AS component FROM reach GROUP BY a) c ON m.vec_id = c.a"""

CHAT = f"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n, '{TURN_START}' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '{TURN_END}' || chr(10) AS piece,
  coalesce(role, '<null>') || ':' || length(coalesce(role, '')) || ':' || coalesce(text, '<null>') || ':' || length(coalesce(text, '')) AS k FROM conversations),
prefixes AS (SELECT conv_id, n, string_agg(k, '|') OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS p, string_agg(piece, '') OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS text, count(*) OVER (PARTITION BY conv_id) AS size FROM turns),
maximal AS (SELECT * FROM prefixes w WHERE n = size AND NOT EXISTS (SELECT 1 FROM prefixes q WHERE q.n = w.n AND q.p = w.p AND q.n < q.size))
SELECT conv_id, n AS n_turns, text FROM (SELECT *, row_number() OVER (PARTITION BY n, p ORDER BY conv_id ASC NULLS LAST) AS first FROM maximal) WHERE first = 1"""

TRIMMED = "trim(translate(x, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' ')"
LINES = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS ls, coalesce(('0x' || substr(md5(source), 1, 15))::bigint, -1) AS site FROM documents),
lines AS (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs),
keyed AS (SELECT r, i, {TRIMMED.replace('x,', 'ls[i],')} AS line FROM lines),
texts AS (SELECT min(r) AS r, min(site) AS site FROM docs WHERE text IS NOT NULL GROUP BY text),
gone AS (SELECT line FROM texts JOIN keyed USING (r) WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
hit AS (SELECT k.r, k.i FROM keyed k JOIN gone g ON k.line = g.line),
kept AS (SELECT l.r, string_agg(l.ls[l.i], chr(10) ORDER BY l.i) FILTER (h.i IS NULL) AS text, count(h.i) AS n_removed FROM lines l LEFT JOIN hit h ON l.r = h.r AND l.i = h.i GROUP BY l.r)
SELECT d.doc_id, coalesce(len(d.ls), 0)::int AS n_lines, coalesce(k.n_removed, 0)::int AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text FROM docs d LEFT JOIN kept k ON d.r = k.r"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontam": DECONTAM, "op4_mixing": MIXING, "op5_suffixes": SUFFIXES, "op6_embeddings": EMBEDDINGS, "op9_chat": CHAT, "op10_line_dedup": LINES}
