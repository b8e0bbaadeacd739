"""DuckDB twins of the queries that SQL can express on whole tables."""

OP8 = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, max(k) AS n FROM t GROUP BY 1),
p AS (SELECT a.conv_id AS chosen_id, b.conv_id AS rejected_id, least(a.n, b.n) AS n
      FROM n a JOIN n b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 2 = 0),
d AS (SELECT p.chosen_id, min(x.k) AS k FROM p JOIN t x ON x.conv_id = p.chosen_id JOIN t y ON y.conv_id = p.rejected_id AND y.k = x.k
      WHERE x.role <> y.role OR x.text <> y.text GROUP BY 1),
c AS (SELECT p.chosen_id, p.rejected_id, CAST(coalesce(d.k - 1, p.n) AS INTEGER) AS n_common FROM p LEFT JOIN d USING (chosen_id)),
s AS (SELECT *, '<|' || role || '|>' || chr(10) || text || chr(10) AS said, length(role) + 5 AS head, length(role) + 6 + length(text) AS size FROM t),
side AS (
  SELECT c.chosen_id, s.conv_id, s.k, s.k <= c.n_common AS common, s.said,
         CASE WHEN s.role = 'assistant' AND s.k > c.n_common THEN
           coalesce(sum(s.size) FILTER (s.k > c.n_common) OVER w, 0) + s.head END AS a, length(s.text) AS len
  FROM c JOIN s ON s.conv_id IN (c.chosen_id, c.rejected_id)
  WINDOW w AS (PARTITION BY s.conv_id ORDER BY s.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT conv_id,
         coalesce(string_agg(said, '' ORDER BY k) FILTER (common), '') AS prompt,
         coalesce(string_agg(said, '' ORDER BY k) FILTER (NOT common), '') AS rest,
         coalesce(string_agg(a || '-' || (a + len), ',' ORDER BY k) FILTER (a IS NOT NULL), '') AS loss
      FROM side GROUP BY 1)
SELECT c.chosen_id, c.rejected_id, c.n_common, x.prompt, x.rest AS chosen, y.rest AS rejected, x.loss AS chosen_loss, y.loss AS rejected_loss
FROM c JOIN g x ON x.conv_id = c.chosen_id JOIN g y ON y.conv_id = c.rejected_id
"""

# A repeat of more than 100 words is a window of 101 words found twice.
OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i : i + 4]) AS c FROM i),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM g, range(5) x(k) WHERE c > 1 GROUP BY 1),
j AS (SELECT d.r, d.w, unnest(range(1, len(d.w) - 99)) AS i FROM d JOIN p USING (r) WHERE p.n > 100 AND len(d.w) > 101),
q AS (SELECT r, count(*) > count(DISTINCT w[i : i + 100]) AS long FROM j GROUP BY 1),
l AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(q.long, false) AS long
      FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r) LEFT JOIN l USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR long) AS kept FROM s
"""

# CRC-32 byte by byte: eight steps of its reflected polynomial.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)), lambda v, i: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))))"""

OP11 = rf"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 20 AS base, CAST({_CRC32} AS BIGINT) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT h.c, 0 AS own, t.k, t.role, t.text FROM h JOIN t ON t.c = h.base AND t.k <= h.h
  UNION ALL SELECT h.c, 1, t.k, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.k > h.h),
g AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY own, k) AS pos, len(list_filter(regexp_split_to_array(text, '[ 	-
]+'), lambda x: x <> '')) AS words FROM r),
l AS (SELECT h.c, coalesce(list(md5(g.role || chr(10) || length(g.role) || chr(10) || g.text) ORDER BY g.pos) FILTER (g.pos IS NOT NULL), []) AS said, coalesce(list(g.words ORDER BY g.pos) FILTER (g.pos IS NOT NULL), []) AS words FROM h LEFT JOIN g USING (c) GROUP BY 1),
p AS (SELECT c, d, md5(array_to_string(said[1:d], ',')) AS key, CASE WHEN d > 0 THEN md5(array_to_string(said[1 : d - 1], ',')) END AS parent, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, d = len(said) AS ends
      FROM (SELECT *, unnest(range(0, len(said) + 1)) AS d FROM l)),
n AS (SELECT key, d, any_value(parent) AS parent, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(words) AS saved, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS sha FROM p GROUP BY 1, 2),
k AS (SELECT parent AS key, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
x AS (SELECT n.*, coalesce(k.n, 0) AS children FROM n LEFT JOIN k USING (key)),
s AS (SELECT p.key, sum(CASE WHEN x.children = 0 THEN 1 ELSE 0 END) AS leaves, sum(x.saved) AS saved FROM x JOIN p ON p.c = x.c AND p.d <= x.d GROUP BY 1)
SELECT x.c AS conv_id, x.d AS depth, u.c AS parent_conv_id, x.n AS n_convs, x.children AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, x.sha AS ends_sha256
FROM x JOIN s USING (key) LEFT JOIN n u ON u.key = x.parent
"""

_TERMS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(m) AS m, term, count(*) AS tf
      FROM (SELECT r, doc_id, 100 - 25 + (25 * len(w)::BIGINT * n) // l AS m, unnest(w) AS term FROM d, c) GROUP BY r, term),
t AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), c),
i AS (SELECT k, any_value(item_id) AS item_id, term, count(*) AS times FROM (SELECT k, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS k, item_id, {_TERMS} AS w FROM benchmark)) GROUP BY k, term),
s AS (SELECT k, r, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM i JOIN t USING (term) JOIN p USING (term) GROUP BY k, r)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""

OP13 = r"""
WITH l AS (
  SELECT r, doc_id, line, i, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
x AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.first AS gone FROM l LEFT JOIN k USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY r
"""

SQL: dict[str, str] = {"op7_repetition": OP7, "op8_preference": OP8, "op11_trie": OP11, "op12_search": OP12, "op13_lines": OP13}
