"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array_dedup": OP2, "op3_line_dedup": op3(), "op4_exact_dedup": OP4, "op6_ngram_jaccard_join": OP6, "op7_chat_formatting": OP7, "op8_exact_top_k": OP8, "op9_lm_scoring": OP9}


def op3(min_words: int = 8) -> str:
    """Runs of every number of lines, first places by their texts. A longer repeated run with the words is a union of runs of at most ``min_words`` lines with them."""
    parts, hits = [], []
    for size in range(1, min_words + 1):
        texts = " || chr(10) || ".join(f"lead(line, {i}) OVER d" for i in range(size))
        total = " + ".join(f"lead(words, {i}) OVER d" for i in range(size))
        parts.append(f"w{size} AS (SELECT doc_id, n, {texts} AS run, {total} AS total FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY n))")
        parts.append(f"h{size} AS (SELECT doc_id, n FROM (SELECT doc_id, n, total, row_number() OVER (PARTITION BY run ORDER BY doc_id, n) AS copy FROM w{size} WHERE run IS NOT NULL AND total >= {min_words}) WHERE copy > 1)")
        hits.append(f"SELECT doc_id, n + i AS n FROM h{size}, range({size}) r(i)")
    return rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), w AS (
  SELECT doc_id, place, line, len(list_filter(regexp_split_to_array(line, '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS words FROM l
), n AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n FROM w WHERE words > 0
), {", ".join(parts)}, gone AS (
  SELECT DISTINCT doc_id, n FROM ({" UNION ALL ".join(hits)})
), m AS (
  SELECT w.doc_id, w.place, w.line, n.n, g.n IS NOT NULL AS covered
  FROM w LEFT JOIN n ON w.doc_id = n.doc_id AND w.place = n.place LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.n = g.n
), o AS (
  SELECT *, covered AND NOT coalesce(lag(covered) OVER (PARTITION BY doc_id, n IS NULL ORDER BY place), false) AS opens FROM m
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (covered) AS n_removed, count(*) FILTER (opens) AS n_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT covered), '')) AS kept_sha256
FROM o GROUP BY doc_id
"""


OP4 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

# Counts of all documents (n1, n2, n3) and of the own one (o1, o2, o3); c1 and c2 are the contexts'.
OP9 = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents)
), p AS (SELECT doc_id, i, w1, lag(w1) OVER d AS w2, lag(w1, 2) OVER d AS w3 FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
g AS (
  SELECT *, count(*) OVER (PARTITION BY w1) AS n1, count(*) OVER (PARTITION BY w2, w1) AS n2, count(*) OVER (PARTITION BY w3, w2, w1) AS n3,
    count(*) OVER (PARTITION BY doc_id, w1) AS o1, count(*) OVER (PARTITION BY doc_id, w2, w1) AS o2, count(*) OVER (PARTITION BY doc_id, w3, w2, w1) AS o3, count(*) OVER () AS n, count(*) OVER (PARTITION BY doc_id) AS o FROM p
), c AS (SELECT *, lag(n1) OVER d AS c1, lag(n2) OVER d AS c2, lag(o1) OVER d AS co1, lag(o2) OVER d AS co2 FROM g WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
s AS (
  SELECT doc_id, ln(CASE WHEN w3 IS NOT NULL THEN n3 / c2 WHEN w2 IS NOT NULL THEN 0.4 * n2 / c1 ELSE 0.4 * 0.4 * n1 / n END) AS v,
    ln(CASE WHEN w3 IS NOT NULL AND n3 > o3 THEN (n3 - o3) / (c2 - co2) WHEN w2 IS NOT NULL AND n2 > o2 THEN 0.4 * (n2 - o2) / greatest(1, c1 - co1) ELSE 0.4 * 0.4 * greatest(1, n1 - o1) / greatest(1, n - o) END) AS r FROM c
), d AS (SELECT doc_id, count(*) AS n_words, sum(v) AS log_score, avg(v) AS mean_score, avg(r) AS rest_score FROM s GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(log_score, 0.0), 3) AS log_score, round(mean_score, 3) AS mean_score, round(rest_score, 3) AS rest_score FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id
"""

# Bytes as pairs of hexadecimal digits.
OP2 = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS i FROM b)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS copy FROM w) WHERE copy > 1),
o AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS opens FROM f),
g AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY doc_id, span),
k AS (SELECT s.doc_id, s.a, s.z, substr(b.h, 2 * coalesce(lag(s.z) OVER q, 0) + 1, 2 * (s.a - coalesce(lag(s.z) OVER q, 0))) AS before
  FROM s JOIN b ON s.doc_id = b.doc_id WINDOW q AS (PARTITION BY s.doc_id ORDER BY s.a)),
c AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(before, '' ORDER BY a) AS kept, max(z) AS z FROM k GROUP BY doc_id)
SELECT b.doc_id, (length(b.h) // 2)::BIGINT AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN c.doc_id IS NULL THEN b.h ELSE c.kept || substr(b.h, 2 * c.z + 1) END)) AS kept_sha256
FROM b LEFT JOIN c ON b.doc_id = c.doc_id
"""

OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n, string_agg(s, chr(10) ORDER BY s) AS every FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE common * 5 >= 4 * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a),
m AS (SELECT doc_id, min(reach) AS class_id FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a),
e AS (SELECT every, min(doc_id) AS copy_id FROM n GROUP BY every)
SELECT m.doc_id, m.class_id, coalesce(e.copy_id, m.doc_id) AS copy_id, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM m LEFT JOIN n ON m.doc_id = n.doc_id LEFT JOIN e ON n.every = e.every LEFT JOIN k ON m.doc_id = k.doc_id
"""

# A turn's text by the template has its marks' 22 characters and two line ends besides the escaped role and text.
OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, length(regexp_replace(replace(replace(r, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) AS nr, length(regexp_replace(t, '<(\\*)\|', '<\\\1|', 'g')) AS nt FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256, coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (r = 'assistant'), '')) AS loss_sha256, sum(24 + nr + nt)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
