"""DuckDB SQL for the registered queries, where SQL can express them."""

from __future__ import annotations

from revdiff.llm import chat, licenses

WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH docs AS (SELECT row_number() OVER () r, doc_id, source, coalesce(text, '') text FROM documents),
w AS (
  SELECT r, unnest(ws) word, generate_subscripts(ws, 1) i
  FROM (SELECT r, regexp_extract_all(text, '{WORD}') ws FROM docs)
),
g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, word, w2, w3) c
  FROM (SELECT r, i, word, lead(word) OVER o w2, lead(word, 2) OVER o w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i))
  WHERE w3 IS NOT NULL
),
rep AS (
  SELECT r, count(DISTINCT i + k) n_repeat_words FROM (SELECT r, i, unnest([0, 1, 2]) k FROM g WHERE c > 1) GROUP BY r
),
n AS (SELECT r, count(*) n_words, sum(length(word)) word_chars FROM w GROUP BY r),
ln AS (
  SELECT r, doc_id, source, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) norm
  FROM (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
dup AS (SELECT r, sum(c - 1) n_dup_lines FROM (SELECT r, line, count(*) c FROM ln GROUP BY r, line) GROUP BY r),
common AS (SELECT source, norm FROM ln GROUP BY source, norm HAVING count(DISTINCT doc_id) > 10),
removed AS (
  SELECT r, sum(len(regexp_extract_all(norm, '{WORD}'))) common_words FROM ln JOIN common USING (source, norm) GROUP BY r
),
base AS (
  SELECT doc_id, coalesce(n_words, 0) n_words, coalesce(word_chars, 0)::BIGINT word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(n_dup_lines, 0)::BIGINT n_dup_lines,
    coalesce(n_repeat_words, 0) n_repeat_words, coalesce(common_words, 0)::BIGINT common_words
  FROM docs LEFT JOIN n USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN removed USING (r)
),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM base)
SELECT *, NOT base_failed AND n_words - common_words >= 50 AND n_words - common_words >= 0.5 * n_words kept FROM judged
"""

MIX = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT size,
    ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT ticket
  FROM documents
),
s AS (SELECT source, sum(size)::BIGINT words, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 weight FROM d GROUP BY source),
o AS (
  SELECT *, sum(words) OVER ()::BIGINT total, sum(weight) OVER ()::BIGINT weights,
    coalesce(sum(3 * words) OVER before, 0)::BIGINT stopped, coalesce(sum(weight) OVER before, 0)::BIGINT stopped_weight
  FROM s WINDOW before AS (ORDER BY 3 * words / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
cut AS (
  SELECT stopped, stopped_weight FROM o WHERE 3 * words * (weights - stopped_weight) > (total - stopped) * weight ORDER BY stopped LIMIT 1
),
t AS (
  SELECT o.source, words, CASE
    WHEN (SELECT count(*) FROM cut) = 0 OR o.stopped < cut.stopped THEN (3 * words)::DOUBLE
    ELSE ((total - cut.stopped) * weight)::DOUBLE / (weights - cut.stopped_weight)::DOUBLE END target
  FROM o LEFT JOIN cut ON true
),
f AS (SELECT *, floor(target + 0.5)::BIGINT flow FROM t),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ticket, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT start FROM d)
SELECT doc_id, size, words source_size, target,
  CASE WHEN words = 0 THEN 0 ELSE flow // words * size + greatest(0, least(flow % words - start, size)) END::BIGINT taken
FROM c JOIN f ON c.source IS NOT DISTINCT FROM f.source
"""

def _chat() -> str:
    def escaped(c):
        out = f"replace({c}, chr(92), chr(92) || chr(92))"
        for x in chat.CONTROL:
            out = f"replace({out}, '{x}', '{x[0]}' || chr(92) || '{x[1:]}')"
        return out

    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
g AS (
  SELECT conv_id, count(*) n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{chat.TRAINED}'), '') loss,
    sum(length({escaped("role")}) + length({escaped("text")}) + {len("<||>") + 1 + len(chat.END)})::BIGINT formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) turns_sha256, length(loss) loss_chars, sha256(loss) loss_sha256, formatted_chars FROM g
"""


TOP_K = """
WITH v AS (
  SELECT vec_id id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
),
s AS (
  SELECT q.id query_id, c.id vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT score
  FROM v q, v c WHERE q.id % 50 = 0 AND c.id <> q.id
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER rank FROM s) WHERE rank <= 5
"""

EXACT = """
SELECT doc_id, max(doc_id) OVER w keep_id, count(*) OVER w group_size, row_number() OVER (w ORDER BY doc_id DESC NULLS LAST) = 1 kept, sha256(norm) text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""

SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ts FROM documents
),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term FROM benchmark
),
c AS (SELECT count(*) FILTER (WHERE len(ts) > 0) n_docs, sum(len(ts))::BIGINT terms FROM d),
m AS (SELECT r, doc_id, 50 + (50 * len(ts) * n_docs) // terms m FROM d, c WHERE len(ts) > 0),
tf AS (SELECT r, term, count(*) tf FROM (SELECT r, unnest(ts) term FROM d) SEMI JOIN i USING (term) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT w FROM (SELECT term, count(*) df FROM tf GROUP BY term), c),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT score
  FROM tf JOIN w USING (term) JOIN m USING (r) JOIN i USING (term) GROUP BY item_id, r, doc_id
)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER rank FROM s WHERE score > 0) WHERE rank <= 50
"""

SQL = {"op11_exact_dedup": EXACT, "op12_bag_search": SEARCH, "op7_top_k": TOP_K, "op6_chat_trees": _chat(), "op9_license_scan": licenses.scan_sql("documents"), "op2_source_mix": MIX, "op10_quality_rules": QUALITY}
