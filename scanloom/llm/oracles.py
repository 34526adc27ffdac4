"""DuckDB SQL of the queries that SQL can express."""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def key(line: str) -> str:
    return f"translate(trim({line}, {_BLANKS}), {_LOWER})"


OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
lines AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
full_lines AS (SELECT *, {key('line')} AS k, len({_WORDS.replace("coalesce(text, '')", 'line')}) AS n FROM lines WHERE trim(line, {_BLANKS}) <> ''),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY 1),
shared AS (SELECT host, k FROM full_lines GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 10),
lost AS (SELECT doc_id, sum(n) AS n FROM full_lines JOIN shared USING (host, k) GROUP BY 1),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) t(j) GROUP BY 1),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS shared_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, shared_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - shared_words) >= 30 * n_words AS kept
FROM m
"""

OP9 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
keyed AS (SELECT doc_id, line, pos, {key('line')} AS k FROM lines),
owner AS (SELECT k, min(doc_id) AS o FROM keyed WHERE length(k) >= 10 GROUP BY 1),
marked AS (SELECT keyed.*, coalesce(o < doc_id, false) AS lost FROM keyed LEFT JOIN owner USING (k)),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '') AS t FROM marked GROUP BY 1)
SELECT doc_id, n_lines, n_dropped, sha256(t) AS kept_sha256 FROM kept
"""

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"(list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT ELSE (2 * c::INT) // 10 + (2 * c::INT) % 10 END)) % 10 = 0)"
_CODE = "replace(m, ' ', '')"
_MOD97 = f"""(list_reduce(list_concat([0], list_transform(string_split(substring({_CODE}, 5) || substring({_CODE}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)),
  lambda a, b: ((CASE WHEN b < 10 THEN a * 10 ELSE a * 100 END) + b) % 97) = 1)"""
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", "x"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda p: p::HUGEINT)) <= 255", "x"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}", "x"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15", "x"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|( [A-Z0-9]{4}){2,7}( [A-Z0-9]{1,3})?)\b", _MOD97, "x"),
    ("national_id", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "substring(m, 1, 3) NOT IN ('000', '666') AND m[1] <> '9' AND substring(m, 5, 2) <> '00' AND substring(m, 8, 4) <> '0000'"
     " AND regexp_matches(lower(substring(t, greatest(1, s + 1 - 40), least(s, 40))), 'ssn|social security|national id|tax id')", "x"),
)


def _pii(k: int, kind: str, pattern: str, valid: str) -> str:
    return f"""SELECT doc_id, s, {k} AS k, '{kind}' AS kind, s + length(m) AS e FROM (
  SELECT doc_id, t, m[i] AS m, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s
  FROM (SELECT doc_id, t, m, string_split_regex(t, '{pattern}') AS g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m FROM d) WHERE len(m) > 0)) WHERE {valid}"""


_ONE = "kind || ':' || s || ':' || e"
OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_pii(k, kind, pattern, valid) for k, (kind, pattern, valid, _) in enumerate(_KINDS))}),
per_doc AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in ("email", "ip", "card", "phone"))},
  coalesce(string_agg({_ONE}, ',' ORDER BY s, k) FILTER (k < 4), '') AS base, string_agg({_ONE}, ',' ORDER BY s, k) AS spans FROM spans GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in ("email", "ip", "card", "phone"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per_doc USING (doc_id)
"""

OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
first AS (SELECT t, min(doc_id) AS o FROM d GROUP BY 1),
f AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
    len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, o < d.doc_id AS e
  FROM d JOIN first USING (t) LEFT JOIN labels ON d.doc_id = labels.doc_id),
m AS (SELECT part, good, toxic, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS failed FROM f),
letters AS (SELECT unnest(string_split('ABCDE', '')) AS x, unnest(range(5)) AS k),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, s::INT AS step, 1 << (ascii(filter_order[s]) - 65) AS me,
    coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::BIGINT AS before
  FROM orders, range(1, 6) t(s)),
cells AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY 1, 2),
one AS (SELECT part, filter_order, step, me,
    sum(CASE WHEN failed & (before | me) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failed & before = 0 AND failed & me > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed & before > 0 AND failed & me > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = me THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed & before = 0 AND failed & me > 0 THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN failed & before = 0 AND failed & me > 0 THEN x ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, me))::BIGINT AS shapley
FROM one
"""

_CUT_AT = r"[.,;:!?\n\x0b\x0c\r]"
OP12 = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '{_CUT_AT}')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(w) >= k)),
total AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
inner_ AS (SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, f FROM (SELECT lang, w, f, k, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) t(m) WHERE m < k)),
absorbed AS (SELECT lang, phrase, max(f) AS f FROM inner_ GROUP BY 1, 2),
kept AS (SELECT c.lang, c.k, c.phrase, c.f AS a, c.w FROM c LEFT JOIN absorbed x ON c.lang = x.lang AND c.phrase = x.phrase WHERE c.k >= 2 AND (x.f IS NULL OR 100 * x.f < 100 * c.f)),
cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS h, array_to_string(w[j + 1:k], ' ') AS t FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
s AS (SELECT u.lang, u.phrase, a, l.f AS l, r.f AS r, n, j, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts u JOIN c l ON u.lang = l.lang AND u.h = l.phrase JOIN c r ON u.lang = r.lang AND u.t = r.phrase JOIN total n ON u.lang = n.lang),
least AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op1_quality_rules": OP1, "op8_pii": OP8, "op9_line_dedup": OP9, "op11_filter_audit": OP11, "op12_phrases": OP12}
