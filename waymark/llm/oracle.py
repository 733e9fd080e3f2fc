"""SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
#: crc32 of the bytes of a text, by a table of 256 numbers that the query makes itself
_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc(text: str) -> str:
    code = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex({text}), (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295] || {code}, lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::INT])), 4294967295)"


ORACLE = {
    "op1_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         regexp_replace(replace(text, '\', '\\'), '<(turn>|text>|part>|/turn>)', '<\\\1', 'g') AS safe,
         regexp_replace(replace(role, '\', '\\'), '<(turn>|text>|part>|/turn>)', '<\\\1', 'g') AS safe_role
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(safe) + CASE WHEN before = role THEN 6 ELSE 20 + length(safe_role) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op9_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
k AS (SELECT p.doc_id, p.i, sha256(array_to_string(w.ws[p.i : p.i + 34], ' ')) AS h FROM p JOIN w USING (doc_id)),
twice AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM k JOIN twice USING (h)),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.j) AS text
  FROM each e ANTI JOIN covered c ON e.doc_id = c.doc_id AND e.j = c.j GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op10_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_FOLDED)} AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, link.b FROM r JOIN link ON link.a = r.c)
SELECT s.doc_id, len(any_value(sh))::BIGINT AS n_shingles, min(r.c) AS component_id
FROM s JOIN r USING (doc_id) GROUP BY s.doc_id""",
    "op11_exact_dedup": r"""
WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256)""",
    "op12_importance_resampling": f"""
WITH {_TABLE},
texts AS (SELECT 0 AS part, doc_id, {_FOLDED} AS text FROM documents UNION ALL SELECT 1, NULL, {_FOLDED} FROM benchmark),
w AS (SELECT part, doc_id, list_filter(regexp_split_to_array(text, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM texts),
l AS (SELECT part, doc_id, len(ws) AS n_words, ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) AS fs FROM w),
f AS (SELECT part, doc_id, unnest(fs) AS f FROM l),
b AS (SELECT f, {_crc("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM f), crc),
n AS (SELECT b, count(*) FILTER (part = 0) AS s, count(*) FILTER (part = 1) AS t FROM f JOIN b USING (f) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000.0::DOUBLE)
        / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000.0::DOUBLE))))::BIGINT AS gain FROM n),
d AS (SELECT doc_id, sum(gain)::BIGINT AS total, count(*) AS k FROM f JOIN b USING (f) JOIN g USING (b) WHERE part = 0 GROUP BY doc_id),
e AS (
  SELECT doc_id, n_words, len(fs)::BIGINT AS n_features, coalesce((total - ((total % k) + k) % k) // k, 0)::BIGINT AS weight,
    ('0x' || substr(sha256(concat('7:', doc_id)), 1, 8))::BIGINT AS h
  FROM l LEFT JOIN d USING (doc_id) WHERE part = 0),
v AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM e),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 25 * count(*) OVER () // 100 AS most FROM v WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= most THEN r END AS rank FROM v LEFT JOIN r USING (doc_id)""",
    "op13_spelling_variants": f"""
WITH RECURSIVE {_TABLE},
x AS (SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
o AS (SELECT run, n, {_crc("concat(doc_id, ':', run)")} AS h FROM (SELECT doc_id, run, count(*) AS n FROM x GROUP BY 1, 2), crc),
w AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
    sum(n)::BIGINT AS n FROM o GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
        FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM w)),
pair AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN w b ON a.d = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN w b ON a.d = b.word),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM pair),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form,
    CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word AND r = 1),
path AS (
  SELECT word, word AS place, 0 AS steps FROM forms
  UNION ALL SELECT path.word, form, steps + 1 FROM path JOIN forms ON forms.word = path.place WHERE form IS NOT NULL),
ends AS (SELECT word, arg_max(place, steps) AS root FROM path GROUP BY 1)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN ends USING (word)""",
}
