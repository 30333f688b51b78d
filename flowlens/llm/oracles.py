"""DuckDB SQL for the operators of this subpackage that SQL can express."""

from __future__ import annotations

#: A-Z lower-cased, other letters as they are.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 from its definition: the table of bytes, then a fold over a string's bytes. Near words are found by leaving one letter out.
SPELLING = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (
  SELECT run, doc_id || ':' || run AS s, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(range(0, strlen(s)), lambda i: ('0x' || substr(hex(s), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS h
  FROM runs, crc),
spelt AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS gap FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.gap = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.gap = b.word),
best AS (
  SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM near),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM best WHERE k = 1) b ON w.word = b.word),
chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.next = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON f.word = c.word WHERE c.next IS NULL
"""

PHRASES = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
listed AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words FROM pieces),
grams AS (
  SELECT lang, size, gram, count(*) AS n
  FROM (
    SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda k: array_to_string(words[k : k + size - 1], ' '))) AS gram
    FROM listed, (SELECT unnest([1, 2, 3]) AS size))
  GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n FROM grams WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, gram AS phrase, n AS a, string_split(gram, ' ') AS w FROM grams WHERE size >= 2 AND n >= 10),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM candidates)),
scored AS (
  SELECT c.lang, phrase, a, k, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS score
  FROM cuts c JOIN grams x ON c.lang = x.lang AND c.head = x.gram JOIN grams y ON c.lang = y.lang AND c.tail = y.gram),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored) WHERE place = 1),
longer AS (
  SELECT lang, part, max(a) AS over
  FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS part FROM candidates WHERE len(w) = 3)
  GROUP BY ALL),
kept AS (
  SELECT s.* FROM lowest s LEFT JOIN longer o ON s.lang = o.lang AND s.phrase = o.part WHERE o.over IS NULL OR 100 * o.over < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT p.lang, rank, phrase, a, l, r, t.n::BIGINT AS n, score::BIGINT AS score FROM ranked p JOIN totals t ON p.lang = t.lang WHERE rank <= 2000
"""
