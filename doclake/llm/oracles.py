"""SQL twins (DuckDB) of the corpus queries that SQL can express."""

from __future__ import annotations

from doclake.llm import quality_rules as q

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = rf"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '{_NOT_WORD}'), lambda x: x <> '') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '{_NOT_WORD}'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT *, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM split, sizes WHERE len(w) >= k)),
hits AS (SELECT r, g.k, i, item_id FROM grams g JOIN windows USING (gram)),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AS contaminated
FROM split LEFT JOIN covered c USING (r) LEFT JOIN named m USING (r)"""


def _lacks(column: str, characters: str) -> str:
    return f"(length({column}) - length(translate({column}, '{characters}', '')))"


_PHRASES = " OR ".join(f"contains(low, '{p}')" for p in q.BOILERPLATE)

OP4 = rf"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT doc_id, r, t, list_filter(string_split_regex(t, '{q.SPACE_RUN}'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM texts),
triples AS (
  SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM split WHERE len(w) >= 3)),
twice AS (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM triples) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM twice GROUP BY r),
lines AS (
  SELECT r, line, lower(line) AS low, len(list_filter(string_split_regex(line, '{q.SPACE_RUN}'), lambda x: x <> '')) AS n
  FROM (SELECT r, unnest(l) AS line FROM split)),
lost AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n FROM lines
  WHERE {_lacks('line', '#*$%&<>')} * 100 > n * {q.SYMBOL_PERCENT}
     OR ({_lacks('line', '|»›•·')} >= {q.NAVIGATION_MIN} AND {_lacks('line', '|»›•·')} * 100 > n * {q.NAVIGATION_PERCENT})
     OR (n >= {q.SHOUTING_MIN_WORDS} AND {_lacks('line', '!')} * 100 >= n * {q.SHOUTING_PERCENT} AND low <> line AND upper(line) = line)
     OR (n <= {q.BOILERPLATE_MAX_WORDS} AND length(line) <= {q.BOILERPLATE_MAX_CHARS} AND ({_PHRASES}))
     OR (n >= {q.PUNCTUATION_MIN_WORDS} AND NOT regexp_matches(line, '\p{{P}}'))
  GROUP BY r),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST({_lacks('t', q.SYMBOLS)} AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS lost_words
  FROM split LEFT JOIN repeats USING (r) LEFT JOIN lost USING (r)),
judged AS (
  SELECT *, n_words < {q.MIN_WORDS} OR n_repeat_words * 100 > n_words * {q.MAX_REPEATED_PERCENT} AS base_failed FROM counts)
SELECT *, NOT base_failed AND lost_words * 100 <= n_words * {q.MAX_LOST_PERCENT} AS kept FROM judged"""


#: CRC-32 of a decimal, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

OP11 = f"""
WITH numbered AS (
  SELECT conv_id AS c, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(turn ORDER BY i) AS turns, {_CRC} % 6 AS h FROM numbered GROUP BY c),
rebuilt AS (
  SELECT own.c, list_concat(list_slice(coalesce(b.turns, []), 1, own.h), list_slice(own.turns, own.h + 1, len(own.turns))) AS turns
  FROM own LEFT JOIN own b ON b.c = own.c - own.c % 100),
prefixes AS (
  SELECT c, d, len(turns) AS n, turns, md5(to_json(list_slice(turns, 1, d))) AS key,
         CASE WHEN d > 0 THEN md5(to_json(list_slice(turns, 1, d - 1))) END AS above
  FROM (SELECT *, unnest(generate_series(0, len(turns))) AS d FROM rebuilt)),
nodes AS (
  SELECT key, any_value(above) AS above, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(turns) AS turns,
         any_value(CASE WHEN d > 0 THEN length(turns[d].t) ELSE 0 END) AS chars,
         string_agg(CASE WHEN d = n THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends
  FROM prefixes GROUP BY key),
children AS (SELECT above AS key, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
weights AS (
  SELECT turns, depth, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * chars AS saved
  FROM nodes LEFT JOIN children USING (key)),
sums AS (
  SELECT md5(to_json(list_slice(turns, 1, k))) AS key, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(generate_series(0, depth)) AS k FROM weights) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
       CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.above = p.key LEFT JOIN children c ON c.key = n.key JOIN sums s ON s.key = n.key"""

OP12 = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a, usable b WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scored WHERE same AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER near AS INTEGER) AS rank, n.id AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
WINDOW near AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER near <= 10"""


def all_oracles() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op4_quality_rules": OP4, "op11_prefix_trie": OP11, "op12_hard_negatives": OP12}
