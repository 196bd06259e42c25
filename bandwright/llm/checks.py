"""Check SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), learned AS (
  SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn, role, text)
                           FILTER (role = 'assistant'), '') AS loss,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns,
         count(*) AS n_turns,
         sum(length('<s>[INST] ') + length(' [/INST] ') + length(' </s>')
             + length(regexp_replace(role, '(\\*)(</?s>|\[/?INST\])', '\\\1\2', 'g'))
             + length(regexp_replace(text, '(\\*)(</?s>|\[/?INST\])', '\\\1\2', 'g'))) AS formatted
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, turns AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars
FROM learned
"""

WARC = r"""
WITH hashed AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, upper(sha1(coalesce(html, ''))) AS hex,
         sha256(regexp_replace(coalesce(url, ''), '[\r\n]+', ' ', 'g') || chr(10)
                || sha256(coalesce(html, ''))) AS content
  FROM pages
), firsts AS (
  SELECT payload, any_value(hex) AS hex, min(page_id) AS first_id,
         min(content) FILTER (page_id IS NULL) AS first_content
  FROM hashed GROUP BY payload
), digits AS (
  SELECT payload, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, 1 + 10 * (k // 8), 10))::BIGINT >> (5 * (7 - k % 8))) & 31)::INT,
           1), '' ORDER BY k) AS digest
  FROM firsts, range(32) r(k) GROUP BY payload
), typed AS (
  SELECT *, CASE WHEN page_id IS NULL THEN first_id IS NULL AND content = first_content
                 ELSE page_id = first_id END AS own
  FROM hashed JOIN firsts USING (payload)
)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN NOT own THEN first_id END AS refers_to
FROM typed JOIN digits USING (payload)
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, 'null')) AS place,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), stops AS (
  SELECT *, source_size * 3 AS cap, (source_size * 3) / weight AS ratio FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
            / (sum(weight) OVER ()
               - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS level
  FROM stops
), targets AS (
  SELECT *, (SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio) AS water FROM levels
), placed AS (
  SELECT doc_id, size, source_size, weight,
         CASE WHEN ratio < water THEN cap::DOUBLE ELSE weight * water END AS target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), passed AS (
  SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE floor(target / source_size) END::BIGINT AS passes
  FROM placed
), counted AS (
  SELECT *, target - passes * source_size AS rest,
         passes + (size > 0 AND before * 2 + size <= (target - passes * source_size) * 2)::INT AS times
  FROM passed
), shares AS (
  SELECT *, least(coalesce((before + size / 2) / nullif(passes * source_size + rest, 0), 0.0), 1.0)::DOUBLE AS q
  FROM counted
)
SELECT doc_id, size, source_size, target, (size * times)::BIGINT AS taken,
       CASE WHEN times > 0 THEN round(CASE weight
         WHEN 1 THEN CASE WHEN q < 1 THEN q * 2 / (1.5 + sqrt(2.25 - q * 2)) ELSE 1 END
         WHEN 2 THEN CASE WHEN q < 1 THEN q ELSE 1 END
         ELSE CASE WHEN q < 0.3125 THEN q * 2 / (0.25 + sqrt(0.0625 + q * 3))
              WHEN q < 1 THEN 0.5 + (q - 0.3125) * 2 / (1.0 + sqrt(1.0 + (q - 0.3125) * 3))
              ELSE 1 END
       END::DOUBLE, 6) END AS first_position
FROM shares
"""


# All pairs: for small tables only, as components are by closure.
NEAR_VECTORS = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        AND len([x for x in embedding if x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), components AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM components LEFT JOIN counts USING (vec_id)
"""

JACCARD = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])
                 END AS s
  FROM worded
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
                                     AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), components AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN components USING (doc_id)
"""

FILL_IN_MIDDLE = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex
  FROM documents
), cut AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
         ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2,
         ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4
  FROM drawn
), placed AS (
  SELECT *, len(units)::BIGINT AS n, h1 % (len(units) + 1) AS a, h2 % (len(units) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                   OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix,
         array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(units[greatest(a, b) + 1:], '') AS suffix
  FROM placed
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_near_dedup": NEAR_VECTORS,
        "op4_ngram_jaccard_join": JACCARD,
        "op6_chat_formatting": CHAT,
        "op7_warc": WARC,
        "op10_mixing": MIXING,
        "op11_fill_in_middle": FILL_IN_MIDDLE,
    }
