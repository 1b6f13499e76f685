"""SQL for the operators that general SQL can express. Learned models, compression, tokenizers, hashes of Spark's own
and balanced shards cannot be; those are tested against brute force, round trips and held-out accuracy."""

QUALITY_RULES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
found AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, least(5, lead(i, 1, i + 5) OVER (PARTITION BY doc_id ORDER BY i) - i) AS n FROM found),
rep AS (SELECT doc_id, sum(n) AS n FROM covered GROUP BY doc_id),
base AS (
  SELECT w.doc_id, w.w, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
    length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(dup.n_lines, 0) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    length(w.text) - length(regexp_replace(w.text, '\p{Lu}', '', 'g')) AS capitals,
    length(w.text) - length(regexp_replace(w.text, '\p{L}', '', 'g')) AS letters,
    len(list_filter(w.w, lambda x: suffix(x, '!!'))) AS bangs
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words
    OR word_chars > 20 * n_words OR 10 * bangs > 3 * n_words OR 10 * capitals > 4 * letters OR 2 * letters < word_chars) AS kept
FROM judged
"""

JACCARD_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * both_have >= 90 * (a.n + b.n - both_have)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.y) AS component_id
FROM documents d JOIN reach ON d.doc_id = reach.x LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, w, d, unnest(range(1, len(w) - d + 2)) AS i FROM w, range(1, 6) AS r(d) WHERE len(w) >= d),
f AS (SELECT lang, d, array_to_string(w[i:i + d - 1], ' ') AS phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS p FROM f WHERE d >= 2),
cuts AS (SELECT c.*, unnest(range(1, d)) AS k FROM c),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cuts.k, x.a AS l, y.a AS r, n.n,
    (1000 * cuts.a::HUGEINT * n.n::HUGEINT // (x.a::HUGEINT * y.a::HUGEINT))::BIGINT AS score
  FROM cuts JOIN n ON n.lang = cuts.lang
  JOIN f x ON x.lang = cuts.lang AND x.d = k AND x.phrase = array_to_string(p[1:k], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.d = cuts.d - k AND y.phrase = array_to_string(p[k + 1:], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(p[i:i + s - 1], ' ') AS phrase, a AS longer
  FROM (SELECT lang, p, a, s, unnest(range(1, d - s + 2)) AS i FROM c, range(2, 5) AS q(s) WHERE s < d)),
alone AS (SELECT * FROM weakest t WHERE NOT EXISTS (SELECT 1 FROM inside s WHERE s.lang = t.lang AND s.phrase = t.phrase AND 100 * longer >= 100 * t.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM alone QUALIFY rank <= 2000
"""

PREFIX_TRIE = r"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) AS t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
turns AS (
  SELECT conv_id AS c, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(t ORDER BY i) AS ts FROM turns GROUP BY c),
h AS (
  SELECT c, ts, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1]))) % 4 AS h
  FROM own, crc),
whole AS (
  SELECT h.c, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN own b ON b.c = h.c - h.c % 20),
placed AS (SELECT c, ts, len(ts) AS whole_depth, unnest(range(0, len(ts) + 1)) AS depth FROM whole),
members AS (SELECT c, depth, ts[1:depth] AS node, whole_depth FROM placed),
nodes AS (
  SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN whole_depth = depth THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM members GROUP BY node, depth),
children AS (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
valued AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children,
    (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(node[depth].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes LEFT JOIN children USING (node, depth)),
ups AS (SELECT node, n_children, saved, unnest(range(0, depth + 1)) AS up FROM valued),
totals AS (SELECT node[1:up] AS node, up AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM ups GROUP BY ALL)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM valued v JOIN totals USING (node, depth) LEFT JOIN nodes p ON p.depth = v.depth - 1 AND p.node = v.node[1:v.depth - 1]
"""

ORACLES = {
    "op1_quality_rules": QUALITY_RULES, "op3_ngram_jaccard_join": JACCARD_JOIN, "op11_phrase_collocations": PHRASES, "op13_prefix_trie": PREFIX_TRIE,
}
