"""DuckDB SQL for the training-data queries that SQL can express, written on its own, not from the operators' code."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_STOP = ", ".join(f"'{w}'" for w in sorted(set((
    "a al an and are as at au auf avec be by con das de del der des die du ein eine el elle en es est et for from für "
    "il im in is ist it la las le les lo los mit nicht no of on or para par por pour que qui se sich sur su that the "
    "this to un una une und von was with y zu dans den").split())))

QUALITY = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
lines AS (SELECT doc_id, text, w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
often AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM grams JOIN often USING (doc_id, g), (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
s AS (SELECT lines.doc_id, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(l) AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets
  FROM lines LEFT JOIN covered ON covered.doc_id = lines.doc_id),
v AS (SELECT *, coalesce(chars, 0) AS word_chars, greatest(n_words, 1) AS nw, greatest(n_lines, 1) AS nl, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 10 AND word_chars / nw BETWEEN 2 AND 15 AND n_symbols / nw <= 0.3
  AND (n_words < 50 OR n_stop / nw >= 0.02) AND (n_lines < 8 OR (n_dup_lines / nl <= 0.3 AND n_ellipsis / nl <= 0.3 AND n_bullets / nl <= 0.9)) AS kept
FROM v
"""

_FIELD = r"""["'']?\x20*[:=]\x20*["'']?"""
_KEYWORDS = r"(?i:password|passwd|secret|token|api_?key)"
_MIXED = "[0-9][^A-Za-z]*[A-Za-z]|[A-Za-z][^0-9]*[0-9]|[a-z][A-Z]"
_SCHEME = "(?:^|[^A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://"
#: Name, pattern, group of the value (0: the whole match).
_SECRET_PATTERNS = (
    ("assign", _KEYWORDS + _FIELD + "([A-Za-z0-9+/_.=-]+)", 1), ("access", "AKIA[A-Z0-9]+", 0), ("hex", "[0-9a-f]+", 0),
    ("login", "(?i:user_?name|login|client_?id|account_?id)" + _FIELD + "([A-Za-z0-9@+/_.=-]+)", 1),
    ("bare_key", "[A-Za-z0-9+/]+", 0), ("endpoint", "(?i:endpoint|hostname|server_?url)" + _FIELD + "([A-Za-z0-9:/_.-]+)", 1),
    ("account", "(?i:user(?:_?id)?|uid|e_?mail|account(?:_?name)?|access_?key(?:_?id)?|key_?id)" + _FIELD + "([A-Za-z0-9@+/_.=-]+)", 1),
    ("key_field", "(?i:secret_?(?:access_?)?key|private_?key|account_?key|auth_?key|pass_?phrase|pass|pwd)" + _FIELD + "([A-Za-z0-9+/_.=-]+)", 1),
    ("host", "(?i:host|server|ur[il])" + _FIELD + "([A-Za-z0-9:/_.-]+)", 1), ("url", _SCHEME + "([A-Za-z0-9_.-]+)", 1),
    ("url_login", _SCHEME + r"""[^@\s/:?#"''<>]*:([^@\s/?#"''<>]+)@[A-Za-z0-9_.-]+""", 1))
_FOUND_SECRETS = "\n  UNION ALL ".join(
    f"SELECT row_no, '{n}' AS p, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {g}) AS v, string_split_regex(text, '{p}') AS gaps FROM t"
    for n, p, g in _SECRET_PATTERNS)
SECRETS = rf"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_FOUND_SECRETS}),
each_match AS (SELECT row_no, p, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(v) AS v, unnest(gaps[:len(m)]) AS gap FROM found WHERE len(m) > 0),
placed AS (SELECT row_no, p, m, v, sum(length(gap) + length(m)) OVER (PARTITION BY row_no, p ORDER BY i)::BIGINT AS e FROM each_match),
-- a url's match begins with the character before it; its port belongs to it
cut AS (SELECT row_no, p, v, e - length(m) + CASE WHEN p IN ('url', 'url_login') AND NOT regexp_matches(m, '^[A-Za-z]') THEN 1 ELSE 0 END AS s,
    e + CASE WHEN p = 'url' THEN length(regexp_extract(substr(text, e + 1), '^:[0-9]+')) ELSE 0 END AS e, m,
    CASE WHEN p IN ('url', 'bare_key') THEN substr(text, e + 1, CASE WHEN p = 'url' THEN length(text) ELSE 1 END) END AS rest FROM placed JOIN t USING (row_no)),
parts AS (
  SELECT row_no, s, e,
    CASE WHEN p = 'assign' AND length(v) >= 12 THEN 0 WHEN p = 'access' AND length(m) >= 18 THEN 1 WHEN p = 'hex' AND length(m) >= 16 THEN 2
      WHEN p = 'login' AND length(v) >= 3 THEN 3 WHEN p = 'bare_key' AND length(m) = 40 AND rest <> '=' AND regexp_matches(m, '{_MIXED}') THEN 4
      WHEN p = 'assign' AND length(v) >= 6 AND regexp_matches(v, '{_MIXED}') THEN 5 WHEN p = 'endpoint' AND length(v) >= 4 THEN 6
      WHEN p = 'account' AND length(v) >= 3 THEN 7 WHEN p = 'key_field' AND length(v) >= 6 AND regexp_matches(v, '{_MIXED}') THEN 8 WHEN p = 'host' AND length(v) >= 3 THEN 9
      WHEN p = 'url' AND length(v) >= 3 AND NOT regexp_matches(rest, '^(:[^@\s/?#"''<>]*)?@')
        AND regexp_matches(rest, '^[^\s"''<>]*[?&;#][A-Za-z0-9_.-]*(?i:password|passwd|secret|token|key|pass|pwd)=') THEN 10
      WHEN p = 'url_login' THEN 11 END AS kind FROM cut),
roles AS (SELECT *, CASE WHEN kind IN (1, 3, 7) THEN 'identifier' WHEN kind IN (6, 9, 10) THEN 'endpoint' ELSE 'secret' END AS role, kind IN (0, 1, 2, 11) AS strong FROM parts WHERE kind IS NOT NULL),
reported AS (
  SELECT row_no, s, e, kind FROM roles WHERE strong
  UNION SELECT a.row_no, a.s, a.e, a.kind FROM roles a JOIN roles b ON a.row_no = b.row_no AND NOT a.strong AND (a.role = 'secret') <> (b.role = 'secret')
    AND b.s - a.e <= 256 AND a.s - b.e <= 256 AND (b.s >= a.e OR b.e <= a.s)),
named AS (SELECT *, ['assign', 'access', 'hex', 'login', 'bare_key', 'short_secret', 'endpoint', 'account', 'key_field', 'host', 'url', 'url_login'][kind + 1]
    || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS shown FROM reported),
per_doc AS (SELECT row_no, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
  coalesce(string_agg(shown, ',' ORDER BY s, kind) FILTER (kind <= 2), '') AS base, string_agg(shown, ',' ORDER BY s, kind) AS spans FROM named GROUP BY row_no)
SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN per_doc ON per_doc.row_no = t.row_no
"""

VECTORS = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.e, r.e) AS BIGINT) AS score FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND len(q.e) = len(r.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

URLS = r"""
WITH rules(h, p, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT page_id, h || p AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS n
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT parts.page_id, host, path, rule, coalesce(action, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits ON fits.page_id = parts.page_id AND fits.n = 1
"""

CHATS = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
sized AS (SELECT *, len(regexp_extract_all(text, '<\||</?s>|<</?SYS>>|\[/?INST\]')) + length(text) + len(regexp_extract_all(text, '\\')) AS text_size,
  len(regexp_extract_all(role, '<\||</?s>|<</?SYS>>|\[/?INST\]')) + length(role) + len(regexp_extract_all(role, '\\')) AS role_size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_size + role_size + length('<|role|><|text|><|end|>'))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

NEAR = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') || ' ' || len(w) FROM t WHERE len(w) BETWEEN 1 AND 4)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, a FROM both_ways UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = other),
least AS (SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id)
SELECT t.doc_id, coalesce(sizes.n, 0) AS n_shingles, coalesce(component, t.doc_id) AS component_id, coalesce(component, t.doc_id) = t.doc_id AS kept
FROM t LEFT JOIN sizes ON sizes.doc_id = t.doc_id LEFT JOIN least ON least.doc_id = t.doc_id
"""

MIX = """
WITH RECURSIVE numbered AS MATERIALIZED (SELECT row_number() OVER () AS row_no, * FROM documents),
n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, CAST(1 AS DOUBLE) / (SELECT count(*) FROM n) * CAST((SELECT count(*) FROM documents) AS DOUBLE) / n AS rate FROM n),
d AS MATERIALIZED (SELECT numbered.*, rate, CAST('0x' || substr(md5('17:1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM numbered JOIN rates ON numbered.source IS NOT DISTINCT FROM rates.source),
draws(row_no, u, rate, p, c, k) AS (SELECT row_no, u, rate, exp(-rate), exp(-rate), 0 FROM d
  UNION ALL SELECT row_no, u, rate, p * rate / (k + 1), c + p * rate / (k + 1), k + 1 FROM draws WHERE u >= c),
counts AS (SELECT row_no, max(k) AS n FROM draws GROUP BY row_no)
SELECT doc_id, text, lang, source, n_chars, rate, CAST(copy AS INTEGER) AS copy, md5('17:order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) || ':' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM (SELECT d.*, unnest(range(1, counts.n + 1)) AS copy FROM d JOIN counts USING (row_no))
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS size, sha1(html) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first FROM h GROUP BY hex)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h.hex, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM h JOIN f USING (hex)
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row_no, doc_id, {_TERMS} AS w FROM documents),
q AS MATERIALIZED (SELECT row_number() OVER () AS item_no, item_id, {_TERMS} AS w FROM benchmark),
corpus AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
asked AS MATERIALIZED (SELECT item_no, item_id, term, count(*) AS times FROM (SELECT item_no, item_id, unnest(w) AS term FROM q) GROUP BY ALL),
tf AS MATERIALIZED (SELECT row_no, doc_id, n, term, count(*) AS tf FROM (SELECT row_no, doc_id, len(w) AS n, unnest(w) AS term FROM d) SEMI JOIN asked USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM df, corpus),
scores AS (SELECT item_no, item_id, row_no, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term), corpus GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

SPELLING = r"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS times FROM (SELECT doc_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t),
encoded AS (SELECT run, times, hex(encode(id || ':' || run)) AS h FROM runs),
hashed AS (SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS crc FROM encoded, crc_table),
kept AS (SELECT times, CASE WHEN crc % 199 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, 2 + crc % length(run)) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM kept WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
shorter AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM shorter WHERE rest IN (SELECT word FROM words) UNION SELECT rest, word FROM shorter WHERE rest IN (SELECT word FROM words)),
ranked AS (SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place
  FROM near JOIN words o ON o.word = other),
judged AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN ranked ON ranked.word = words.word AND place = 1),
walk(word, last, form) AS (SELECT word, word, form FROM judged UNION ALL SELECT walk.word, judged.word, judged.form FROM walk JOIN judged ON judged.word = walk.form)
SELECT judged.word, judged.form, walk.last AS root, n, n_near, form_n FROM judged JOIN walk ON walk.word = judged.word AND walk.form IS NULL
"""

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
_ADDRESS = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
_PLACED = "\n  UNION ALL ".join(
    f"SELECT row_no, {kind} AS kind, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS gaps FROM t"
    for kind, p in ((0, _EMAIL), (1, _ADDRESS), (2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]"), (-1, "[A-Za-z0-9_@.+/-]+")))


def _round(i: int) -> str:
    """One round: patterns trusted for a kind by the scores so far, then instances accepted by these patterns."""
    before = f"LEFT JOIN accepted{i - 1} a ON a.instance = g.instance" if i > 1 else "LEFT JOIN (SELECT '' AS instance, 0 AS kind, 0 AS score WHERE false) a ON a.instance = g.instance"
    return f"""
trusted{i} AS MATERIALIZED (SELECT pattern, kind, sum(score)::BIGINT // (any_value(fillers) + 1) AS confidence
  FROM (SELECT pattern, fillers, CASE WHEN seed >= 0 THEN seed ELSE a.kind END AS kind, CASE WHEN seed >= 0 THEN 1000000 ELSE a.score END AS score FROM graph g {before})
  WHERE kind IS NOT NULL GROUP BY pattern, kind HAVING sum(score) >= 3000000 AND sum(score)::BIGINT // (any_value(fillers) + 1) >= 600000),
votes{i} AS (SELECT instance, kind, sum(round(-ln(1 - confidence / 1000000) * 1000000)::BIGINT)::BIGINT AS doubt FROM graph JOIN trusted{i} USING (pattern) WHERE seed < 0 GROUP BY ALL),
accepted{i} AS MATERIALIZED (SELECT instance, kind, round((1 - exp(-doubt / 1000000)) * 1000000)::BIGINT AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY doubt DESC, kind) AS place FROM votes{i} WHERE doubt >= 1386294) WHERE place = 1),"""


PRIVATE = rf"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_PLACED}),
each_match AS (SELECT row_no, kind, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(gaps[:len(m)]) AS gap FROM found WHERE len(m) > 0),
placed AS (SELECT row_no, kind, m, sum(length(gap) + length(m)) OVER (PARTITION BY row_no, kind ORDER BY i)::BIGINT AS e, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM each_match),
base AS MATERIALIZED (SELECT row_no, kind, m, e - length(m) AS s, e FROM placed WHERE kind = 0
  OR kind = 1 AND len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(x, 4) AS INT) > 255)) = 0
  OR kind = 2 AND length(digits) BETWEEN 13 AND 19
    AND list_sum(list_transform(range(length(digits)), lambda i: CAST(substr(reverse(digits), i + 1, 1) AS INT) * (1 + i % 2) - 9 * CAST(i % 2 = 1 AND CAST(substr(reverse(digits), i + 1, 1) AS INT) > 4 AS INT))) % 10 = 0
  OR kind = 3 AND length(digits) BETWEEN 9 AND 15),
tokens AS (SELECT row_no, regexp_replace(rtrim(m, '.-/+'), '^[./-]+', '') AS m, e - length(m) + length(rtrim(m, '.-/+')) AS e FROM placed WHERE kind = -1),
slots AS MATERIALIZED (SELECT row_no, kind, m, s, e FROM base
  UNION ALL SELECT row_no, -1, m, e - length(m), e FROM tokens
  WHERE (length(regexp_replace(m, '[^0-9]', '', 'g')) >= 5 OR regexp_matches(m, '[A-Za-z0-9]@[A-Za-z0-9]')) AND length(m) <= 64
    AND NOT EXISTS (SELECT 1 FROM base WHERE base.row_no = tokens.row_no AND base.s < tokens.e AND tokens.e - length(tokens.m) < base.e)),
around AS (SELECT slots.*, translate(m, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS instance,
    list_transform(regexp_extract_all(substr(text, greatest(0, s - 80) + 1, least(s, 80)), '[^\x20\x09-\x0D]+')[-2:],
      lambda w: regexp_replace(translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g')) AS b,
    regexp_replace(translate(regexp_extract(substr(text, e + 1, 40), '[^\x20\x09-\x0D]+'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS a
  FROM slots JOIN t USING (row_no)),
seen AS MATERIALIZED (SELECT row_no, kind, s, e, instance, b[1] || ' ' || b[2] || ' _' AS pattern FROM around WHERE len(b) = 2
  UNION ALL SELECT row_no, kind, s, e, instance, b[-1] || ' _' FROM around WHERE len(b) > 0 AND right(b[-1], 1) IN (':', '=', '#')
  UNION ALL SELECT row_no, kind, s, e, instance, b[-1] || ' _ ' || a FROM around WHERE len(b) > 0 AND a <> ''),
edges AS MATERIALIZED (SELECT pattern, instance, max(kind) AS seed FROM seen GROUP BY ALL),
graph AS MATERIALIZED (SELECT *, fillers FROM edges JOIN (SELECT pattern, count(*) AS fillers FROM edges GROUP BY pattern HAVING count(*) >= 3) USING (pattern)),{"".join(_round(i) for i in (1, 2, 3))}
spans AS (SELECT row_no, kind, s, e FROM base
  UNION SELECT row_no, accepted3.kind + 4, s, e FROM seen JOIN accepted3 USING (instance) JOIN trusted3 ON trusted3.pattern = seen.pattern AND trusted3.kind = accepted3.kind WHERE seen.kind = -1),
named AS (SELECT *, ['email', 'ip', 'card', 'phone', 'context_email', 'context_ip', 'context_card', 'context_phone'][kind + 1] || ':' || s || ':' || e AS shown FROM spans),
per_row AS (SELECT row_no, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind = 3) AS n3, count(*) FILTER (kind > 3) AS nc,
  string_agg(shown, ',' ORDER BY kind, s) FILTER (kind < 4) AS base, string_agg(shown, ',' ORDER BY kind, s) AS spans FROM named GROUP BY row_no)
SELECT doc_id, coalesce(n0, 0) AS n_email, coalesce(n1, 0) AS n_ip, coalesce(n2, 0) AS n_card, coalesce(n3, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(nc, 0) AS n_context FROM t LEFT JOIN per_row USING (row_no)
"""

ORACLES = {
    "op2_quality_rules": QUALITY, "op3_secret_scan": SECRETS, "op4_vector_search": VECTORS, "op5_url_filter": URLS,
    "op6_chat_format": CHATS, "op8_near_dup": NEAR, "op9_source_mix": MIX, "op10_warc": WARC,
    "op11_lexical_search": LEXICAL, "op12_private_data": PRIVATE, "op13_spelling_variants": SPELLING,
}
