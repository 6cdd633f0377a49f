"""The same results in SQL of a second engine, where SQL can express them."""

from __future__ import annotations

# The blanks of the contracts.
_BLANKS = r"[\x20\x09-\x0D]"

_OP2 = rf"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '{_BLANKS}', '', 'g') AS plain
  FROM documents
),
placed AS (
  SELECT doc_id, plain,
         first_value(doc_id) OVER (PARTITION BY plain ORDER BY length(raw) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY plain) AS group_size
  FROM rows
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM placed
"""

_OP8 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^{_BLANKS}+', ''), '{_BLANKS}+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
marked AS (
  SELECT k.*, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# The nodes of every tree, level by level; the trees' roots are the leaves of one more tree. A row's path holds
# what stands before and behind it on each level. crc32 is counted bit by bit.
_OP11 = """
WITH RECURSIVE plain AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS id, CAST(n_chars AS VARCHAR) AS size,
         list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
                                    lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INT), 1)) AS BIGINT)),
                     lambda crc, byte: list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), xor(crc, byte)),
                     CAST(4294967295 AS BIGINT)) AS crc
  FROM documents
),
texts AS (
  SELECT *, CASE WHEN xor(crc, 4294967295) % 3 = 0
                 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS altered
  FROM plain
),
leaves AS (
  SELECT doc_id, lang,
         sha256(concat(coalesce(strlen(id) || ':' || id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                       coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(size) || ':' || size, '-'),
                       coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
         sha256(concat(coalesce(strlen(id) || ':' || id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                       coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(size) || ':' || size, '-'),
                       coalesce(strlen(altered) || ':' || altered, '-'))) AS altered_leaf
  FROM texts
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
),
nodes AS (
  SELECT 0 AS level, lang, place, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT level + 1, lang, place // 8, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 7) // 8
  FROM nodes WHERE n > 1 GROUP BY level, lang, place // 8
),
around AS (
  SELECT *, coalesce(string_agg(node, '' ORDER BY place) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(node, '' ORDER BY place) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM nodes WINDOW run AS (PARTITION BY level, lang, place // 8 ORDER BY place)
),
subroots AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM nodes WHERE n = 1
),
tops AS (
  SELECT 0 AS level, place, subroot AS node, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 7) // 8
  FROM tops WHERE n > 1 GROUP BY level, place // 8
),
above AS (
  SELECT *, coalesce(string_agg(node, '' ORDER BY place) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(node, '' ORDER BY place) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM tops WINDOW run AS (PARTITION BY level, place // 8 ORDER BY place)
),
steps AS (
  SELECT p.lang, p.place, a.level, a.before, a.after FROM placed p
  JOIN around a ON a.lang IS NOT DISTINCT FROM p.lang AND a.place = p.place // CAST(pow(8, a.level) AS BIGINT) AND a.n > 1
  UNION ALL
  SELECT p.lang, p.place, 1000 + a.level, a.before, a.after FROM placed p
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
  JOIN above a ON a.place = s.place // CAST(pow(8, a.level) AS BIGINT) AND a.n > 1
),
paths AS (
  SELECT lang, place, list(before ORDER BY level) AS befores, list(after ORDER BY level) AS afters,
         string_agg(before || after, '' ORDER BY level) AS proof
  FROM steps GROUP BY lang, place
),
folded AS (
  SELECT p.*, s.subroot, (SELECT node FROM tops WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(range(1, coalesce(len(befores), 0) + 1),
                     lambda node, i: sha256(befores[CAST(i AS BIGINT)] || node || afters[CAST(i AS BIGINT)]), altered_leaf) AS folded_root
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN paths t ON t.lang IS NOT DISTINCT FROM p.lang AND t.place = p.place
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

_OP12 = """
WITH whole AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.place <> q.place
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

# Two rounds of assignment and new entries, then the last assignment; part, entry and axis count from 0.
_NEAREST = """
  SELECT row, part, entry, away FROM (
    SELECT c.row, c.part, b.entry, CAST(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: (c.v[i] - b.v[i]) * (c.v[i] - b.v[i]))) AS BIGINT) AS away,
           row_number() OVER (PARTITION BY c.row, c.part ORDER BY away, b.entry) AS place
    FROM cut c JOIN {book} b USING (part))
  WHERE place = 1
"""
_MEANS = """
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM {book} b LEFT JOIN (
    SELECT part, entry, list(total ORDER BY axis) AS v FROM (
      SELECT part, entry, axis, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS total
      FROM (SELECT n.part, n.entry, unnest(c.v) AS x, generate_subscripts(c.v, 1) AS axis FROM {near} n JOIN cut c USING (row, part))
      GROUP BY part, entry, axis)
    GROUP BY part, entry) m USING (part, entry)
"""
_OP13 = f"""
WITH whole AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS row, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
cut AS (
  SELECT row, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS v
  FROM (SELECT row, v, unnest(range(16)) AS part FROM whole)
),
book_0 AS (SELECT part, row AS entry, v FROM cut WHERE row < 64),
near_0 AS ({_NEAREST.format(book="book_0")}),
book_1 AS ({_MEANS.format(book="book_0", near="near_0")}),
near_1 AS ({_NEAREST.format(book="book_1")}),
book_2 AS ({_MEANS.format(book="book_1", near="near_1")}),
near_2 AS ({_NEAREST.format(book="book_2")}),
coded AS (
  SELECT row, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(away) AS BIGINT) AS error FROM near_2 GROUP BY row
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book_2) AS codebooks_sha256
FROM coded JOIN whole USING (row)
"""


def oracle_queries() -> dict[str, str]:
    return {"op2_exact_dedup": _OP2, "op8_line_dedup": _OP8, "op11_merkle_manifest": _OP11, "op12_exact_topk": _OP12, "op13_vector_codes": _OP13}
