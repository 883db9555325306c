"""The queries of this package: one per operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from notelab.llm.archives import op3_arc_to_warc
from notelab.llm.conversations import op13_conversation_repair
from notelab.llm.crosstok import op11_cross_tokenizer
from notelab.llm.decontam import op4_decontaminate
from notelab.llm.embeddup import op2_embedding_near_dedup
from notelab.llm.jaccard import op8_ngram_jaccard
from notelab.llm.langid import op5_language_id
from notelab.llm.linedup import op9_line_dedup
from notelab.llm.mixing import op6_mix_sources
from notelab.llm.packing import op12_best_fit_packing
from notelab.llm.quality import op7_quality
from notelab.llm.substring import op10_substring_dedup
from notelab.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_arc_to_warc": op3_arc_to_warc,
    "op4_decontaminate": op4_decontaminate,
    "op5_language_id": op5_language_id,
    "op6_mix_sources": op6_mix_sources,
    "op7_quality": op7_quality,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_line_dedup": op9_line_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_cross_tokenizer": op11_cross_tokenizer,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_conversation_repair": op13_conversation_repair,
}

_WORDS = r"[^\x20\x09-\x0D]+"

ORACLE: dict[str, str] = {
    "op2_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) s FROM v),
l AS (SELECT a.vec_id a, b.vec_id b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.95),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.vec_id),
c AS (SELECT vec_id, min(r) component_id FROM reach GROUP BY vec_id),
n AS (SELECT a vec_id, count(*) n_links FROM l GROUP BY a)
SELECT x.vec_id, coalesce(n.n_links, 0) n_links, c.component_id, x.vec_id = c.component_id kept
FROM embeddings x JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op3_arc_to_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) b FROM pages),
d AS (SELECT page_id, octet_length(b) n, sha1(b) h FROM p),
t AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END top FROM d)
SELECT page_id, n payload_bytes, h payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END record_type,
  CASE WHEN top <> page_id THEN top END refers_to FROM t""",
    "op8_ngram_jaccard": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) g FROM w),
e AS (SELECT doc_id, unnest(g) h FROM s),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 90 * (len(x.g) + len(y.g) - c)),
k AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT k.b, reach.r FROM reach JOIN k ON k.a = reach.doc_id),
c AS (SELECT doc_id, min(r) component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(g) n_shingles, component_id FROM s JOIN c USING (doc_id)""",
    "op9_line_dedup": f"""
WITH q AS (SELECT doc_id, text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]+$', '')), lambda x: x <> '') l FROM documents),
e AS (SELECT doc_id, unnest(l) line, unnest(range(1, len(l) + 1)) i FROM q),
p AS (SELECT *, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) two, len(regexp_extract_all(line, '{_WORDS}')) >= 50 long_line FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY two ORDER BY doc_id, i) > 1 AND two IS NOT NULL later2,
  row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AND long_line later1 FROM p),
g AS (SELECT *, later1 OR later2 OR coalesce(lag(later2) OVER (PARTITION BY doc_id ORDER BY i), false) gone FROM f),
a AS (SELECT doc_id, count(*) n, count(*) FILTER (gone) r, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) t FROM g GROUP BY doc_id)
SELECT q.doc_id, len(l) n_lines, coalesce(r, 0) n_removed, CASE WHEN coalesce(r, 0) = 0 THEN text ELSE coalesce(t, '') END AS text FROM q LEFT JOIN a USING (doc_id)""",
    "op10_substring_dedup": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') w FROM documents),
e AS (SELECT doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) i, len(w) n FROM w),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) i, unnest(list_transform(range(1, len(w) - 33), lambda j: md5(array_to_string(w[j:j + 34], ' ')))) h FROM w WHERE len(w) >= 35),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) > 1 again FROM s),
c AS (SELECT e.doc_id, e.word, e.i, coalesce(bool_or(again) OVER (PARTITION BY e.doc_id ORDER BY e.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) gone
  FROM e LEFT JOIN t ON t.doc_id = e.doc_id AND t.i = e.i),
a AS (SELECT doc_id, count(*) n, count(*) FILTER (gone) r, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) k FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w) n_words, coalesce(r, 0) n_removed, sha256(coalesce(k, '')) kept_sha256 FROM w LEFT JOIN a USING (doc_id)""",
    "op13_conversation_repair": """
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
c AS (SELECT conv_id, turn, role, text, xor(list_reduce(range(8 * octet_length(k)), lambda acc, i:
    CASE WHEN xor(acc, CASE WHEN i % 8 = 0 THEN CAST(('0x' || hex(k)[2 * (i // 8) + 1:2 * (i // 8) + 2]) AS BIGINT) ELSE 0 END) & 1 = 1
      THEN xor(xor(acc, CASE WHEN i % 8 = 0 THEN CAST(('0x' || hex(k)[2 * (i // 8) + 1:2 * (i // 8) + 2]) AS BIGINT) ELSE 0 END) >> 1, 3988292384)
      ELSE xor(acc, CASE WHEN i % 8 = 0 THEN CAST(('0x' || hex(k)[2 * (i // 8) + 1:2 * (i // 8) + 2]) AS BIGINT) ELSE 0 END) >> 1 END, 4294967295), 4294967295) % 20 AS z FROM d),
e AS (SELECT conv_id, turn, CASE WHEN z = 4 THEN 'user' ELSE role END AS role, CASE z WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN z = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE z <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM e),
f AS (SELECT conv_id, turn, role, text, i, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '-' END AS ini,
    CASE WHEN t = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN t[-1] IN ('.', '!', '?') THEN 'none' ELSE 'truncated' END AS fault FROM o),
g AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM f),
a AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
ins(p, q, line) AS (VALUES (0, 2, 'user:'), (1, 2, 'user:'), (2, 3, 'assistant:'), (3, 2, 'user:')),
pre(p, q, letters, cost, lines) AS (SELECT DISTINCT p, p, '', 0, CAST([] AS VARCHAR[]) FROM ins UNION ALL SELECT p, q, 'I', 2, [line] FROM ins UNION ALL SELECT x.p, y.q, 'II', 4, [x.line, y.line] FROM ins x JOIN ins y ON x.q = y.p),
keep(q, ini, s) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
m AS (SELECT p, p AS s, '-' AS ini, 'D' AS letters, 3 AS cost, CAST([] AS VARCHAR[]) AS lines, '' AS role FROM (SELECT DISTINCT p FROM ins)
  UNION ALL SELECT pre.p, keep.s, keep.ini, pre.letters || 'K', pre.cost, pre.lines, '' FROM pre JOIN keep ON keep.q = pre.q
  UNION ALL SELECT pre.p, ins.q, '-', pre.letters || 'R', pre.cost + 2, pre.lines, ins.line FROM pre JOIN ins ON ins.p = pre.q),
r(conv_id, i, s, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, struct_pack(cost := 0, audit := '', lines := CAST([] AS VARCHAR[])) FROM f
  UNION ALL
  SELECT r.conv_id, f.i, m.s, min(struct_pack(cost := r.best.cost + m.cost + CASE WHEN f.fault = 'truncated' AND m.letters <> 'D' THEN 1 ELSE 0 END, audit := r.best.audit || m.letters,
      lines := r.best.lines || m.lines || CASE WHEN m.letters = 'D' THEN CAST([] AS VARCHAR[]) WHEN m.role <> '' THEN [m.role || f.text] ELSE [f.role || ':' || f.text] END))
  FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1 JOIN m ON m.p = r.s AND (m.ini = '-' OR m.ini = f.ini) AND (m.letters = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY r.conv_id, f.i, m.s),
w AS (SELECT r.conv_id, min(struct_pack(cost := r.best.cost + pre.cost, audit := r.best.audit || pre.letters, lines := r.best.lines || pre.lines)) AS b
  FROM r JOIN a ON a.conv_id IS NOT DISTINCT FROM r.conv_id AND a.n = r.i JOIN pre ON pre.p = r.s AND pre.q IN (0, 3) GROUP BY r.conv_id)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(w.b.cost, 0) AS BIGINT) AS cost, coalesce(w.b.audit, '') AS audit, sha256(coalesce(array_to_string(w.b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM x.conv_id""",
}
