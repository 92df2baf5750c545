"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op10_exact_dedup"] = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), ranked AS (
  SELECT doc_id, body,
         row_number() OVER (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST) AS place,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM texts
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256
FROM ranked
"""

# Digests do not depend on the marks; formatted_chars does: 12 + role + 1 + text + 11 per turn,
# and the escapes: 4 more characters per ampersand, 3 more per opener.
ORACLE["op7_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), placed AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + length(text) + 4 * (length(text) - length(replace(text, '&', '')))
           + 3 * ((length(text) - length(replace(text, '<|', ''))) // 2))::BIGINT AS formatted_chars,
       bool_and(((before IS NULL AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user')
                 OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user'))
                AND (after IS NOT NULL OR role <> 'system')) IS TRUE AS valid
FROM placed GROUP BY conv_id
"""

ORACLE["op11_phrase_mining"] = r"""
WITH pieces AS (
  SELECT lang, row_no, generate_subscripts(cut, 1) AS piece_no, unnest(cut) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS row_no,
               regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\x0A-\x0D]') AS cut
        FROM documents)
), cut AS (
  SELECT lang, row_no, piece_no, generate_subscripts(own, 1) AS place, unnest(own) AS w1
  FROM (SELECT lang, row_no, piece_no, regexp_extract_all(piece, '[^\x20\x09]+') AS own FROM pieces)
), runs AS (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3
  FROM cut WINDOW p AS (PARTITION BY row_no, piece_no ORDER BY place)
), f1 AS (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (
  SELECT lang, w1, w2, max(f) AS longest
  FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL
), found AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r,
         (1000000::HUGEINT * f2.f * f2.f) // (x.f::HUGEINT * y.f) AS score
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  LEFT JOIN longer h ON h.lang = f2.lang AND h.w1 = f2.w1 AND h.w2 = f2.w2
  WHERE h.longest IS NULL OR 100 * h.longest < 50 * f2.f
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)
  FROM (SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a,
               x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
               (1000000::HUGEINT * f3.f * f3.f) // (x.f::HUGEINT * yz.f) AS s1,
               (1000000::HUGEINT * f3.f * f3.f) // (xy.f::HUGEINT * z.f) AS s2
        FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f1 z ON z.lang = f3.lang AND z.w1 = f3.w3
        JOIN f2 xy ON xy.lang = f3.lang AND xy.w1 = f3.w1 AND xy.w2 = f3.w2
        JOIN f2 yz ON yz.lang = f3.lang AND yz.w1 = f3.w2 AND yz.w2 = f3.w3)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM found
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN (SELECT lang, count(*) AS n FROM cut GROUP BY ALL) USING (lang) WHERE rank <= 2000
"""

# A row goes into what is left of its source's budget, in the order of hashes, if it fits; a row
# that does not fit bounds the size of all later ones, and ends the source where little is left.
ORACLE["op12_source_mixing"] = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 20) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT (1.5 * (SELECT sum(source_size) FROM sources)::DOUBLE
          - coalesce(sum(2 * s.source_size) FILTER (2.0 * s.source_size / s.weight < q.ratio), 0)::DOUBLE)
         / (sum(s.weight) FILTER (2.0 * s.source_size / s.weight >= q.ratio))::DOUBLE AS level, q.ratio
  FROM sources s, (SELECT DISTINCT 2.0 * source_size / weight AS ratio FROM sources) q GROUP BY q.ratio
), level AS (SELECT coalesce(arg_min(level, ratio) FILTER (level <= ratio), 0.0) AS level FROM levels),
planned AS (
  SELECT source, source_size, least(weight * level, 2.0 * source_size)::DOUBLE AS target FROM sources, level
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM planned
), queue AS (
  SELECT z.*, row_number() OVER (PARTITION BY source ORDER BY key) AS at FROM sized z
), walk AS (
  SELECT source, 0::BIGINT AS at, floor(target - whole * source_size)::BIGINT AS room,
         floor(target - whole * source_size)::BIGINT AS fits, false AS chosen, target
  FROM budgets
  UNION ALL
  SELECT w.source, q.at, CASE WHEN q.size <= w.fits AND q.size <= w.room THEN w.room - q.size ELSE w.room END,
         CASE WHEN q.size <= w.fits AND q.size > w.room
              THEN CASE WHEN w.room > 0.0005 * w.target THEN w.room ELSE -1 END ELSE w.fits END,
         q.size <= w.fits AND q.size <= w.room, w.target
  FROM walk w JOIN queue q ON q.source IS NOT DISTINCT FROM w.source AND q.at = w.at + 1
)
SELECT q.doc_id, q.size, b.source_size, b.target, (q.size * (b.whole + w.chosen::BIGINT))::BIGINT AS taken
FROM queue q JOIN budgets b ON b.source IS NOT DISTINCT FROM q.source
JOIN walk w ON w.source IS NOT DISTINCT FROM q.source AND w.at = q.at
"""

ORACLE["op13_ranked_search"] = r"""
WITH postings AS (
  SELECT row_no, doc_id, term, count(*) AS tf
  FROM (SELECT row_no, doc_id, unnest(regexp_extract_all(body, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS row_no, doc_id,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
              FROM documents))
  GROUP BY ALL
), sizes AS (SELECT row_no, sum(tf)::BIGINT AS n FROM postings GROUP BY row_no),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
held AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
queries AS (
  SELECT DISTINCT item_no, item_id, unnest(regexp_extract_all(body, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS item_no, item_id,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
        FROM benchmark)
), scored AS (
  SELECT item_no, item_id, p.doc_id, p.row_no,
         sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)::DOUBLE))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM queries JOIN postings p USING (term) JOIN held USING (term) JOIN sizes USING (row_no), corpus
  GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
