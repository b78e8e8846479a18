"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from catalith.llm.quality_rules import LOSE, MEASURES, PRIOR, TWO_SIDED

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


def _split(column: str) -> str:
    return rf"list_filter(string_split_regex({column}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _pii() -> str:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
        "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    }
    found = " UNION ALL ".join(
        f"SELECT place, '{kind}' AS kind, {order} AS ord, generate_subscripts(m, 1) AS k, "
        f"unnest(m) AS found, unnest(p[:len(m)]) AS piece, unnest(p[2:len(m) + 1]) AS after FROM ("
        f"SELECT place, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d)"
        for order, (kind, pattern) in enumerate(patterns.items())
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
placed AS (
  SELECT *, regexp_replace(found, '[^0-9]+', '', 'g') AS digits, replace(found, ' ', '') AS bare,
    length(piece) + coalesce(sum(length(piece) + length(found)) OVER (
      PARTITION BY place, kind ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM found),
good AS (
  SELECT place, kind, ord, s::BIGINT AS s, (s + length(found))::BIGINT AS e FROM placed
  WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(found, '.'),
      lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(left(ltrim(p, '0'), 3) AS INT), 0) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(
      range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN digits[length(digits) + 1 - i]::INT
        ELSE (digits[length(digits) + 1 - i]::INT * 2) % 10 + digits[length(digits) + 1 - i]::INT // 5 END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
    WHEN 'iban' THEN length(bare) BETWEEN 15 AND 34
      AND (CASE WHEN piece = '' THEN s = 0 ELSE NOT regexp_matches(right(piece, 1), '[A-Za-z0-9]') END)
      AND NOT regexp_matches(left(after, 1), '[A-Za-z0-9]')
      AND list_reduce(list_transform(string_split(bare[5:] || bare[:4], ''),
        lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END),
        lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1
    ELSE (CASE WHEN piece = '' THEN s = 0 ELSE NOT regexp_matches(right(piece, 1), '[0-9-]') END)
      AND NOT regexp_matches(left(after, 1), '[0-9-]')
      AND regexp_matches(lower(right(piece, 40)), 'ssn|social security|tax id') END)
SELECT doc_id,
  count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
  count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord), '') AS spans
FROM d LEFT JOIN good USING (place) GROUP BY place, doc_id"""


_DECONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS place, doc_id,
    regexp_extract_all({_lowered("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id,
    regexp_extract_all({_lowered("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p + 1:p + n], ' ') AS g FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS p
    FROM i WHERE len(w) > 0)),
hits AS (
  SELECT place, p, x.n, item_id FROM (
    SELECT place, w, n, unnest(range(0, len(w) - n + 1)) AS p
    FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n) x
  JOIN windows ON windows.n = x.n AND g = array_to_string(w[p + 1:p + x.n], ' ')),
words AS (
  SELECT place, count(DISTINCT spot) AS n_hit FROM (
    SELECT place, unnest(range(p, p + n)) AS spot FROM hits) GROUP BY place),
items AS (
  SELECT place, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM hits GROUP BY place)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (place) LEFT JOIN items USING (place)"""


def _quality() -> str:
    values = ", ".join(f"('{name}', {name})" for name in MEASURES)
    def rank(side: str) -> str:
        return (
            f"floor((coalesce(sum(n) OVER {side}, 0)::DOUBLE + "
            f"(coalesce(sum(n_lang) OVER {side}, 0)::DOUBLE / (sum(n_lang) OVER g)::DOUBLE + "
            f"coalesce(sum(n_all) OVER {side}, 0)::DOUBLE / (sum(n_all) OVER g)::DOUBLE) * {PRIOR / 2}) / "
            f"((sum(n) OVER g)::DOUBLE + {PRIOR}) * 1000000)::BIGINT"
        )

    two_sided = ", ".join(f"'{name}'" for name in TWO_SIDED)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS place, doc_id, lang, source, coalesce(text, '') AS t,
    {_split("coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT place, p, array_to_string(w[p + 1:p + 5], ' ') AS g
  FROM (SELECT place, w, unnest(range(0, len(w) - 4)) AS p FROM d WHERE len(w) >= 5)),
repeats AS (
  SELECT place, count(DISTINCT spot) AS n_repeat_words FROM (
    SELECT place, unnest(range(p, p + 5)) AS spot FROM (
      SELECT place, p FROM windows QUALIFY count(*) OVER (PARTITION BY place, g) > 1)) GROUP BY place),
base AS (
  SELECT place, doc_id, lang, source, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS caps,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeats USING (place)),
counted AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
measured AS (
  SELECT *,
    CASE WHEN n_words > 0 THEN n_symbols * 10000 // n_words ELSE 0 END AS symbol_rate,
    CASE WHEN word_chars > 0 THEN caps * 10000 // word_chars ELSE 0 END AS caps_rate,
    CASE WHEN len(lines) > 0 THEN n_dup_lines * 10000 // len(lines) ELSE 0 END AS dup_line_rate,
    CASE WHEN n_words > 0 THEN n_repeat_words * 10000 // n_words ELSE 0 END AS repeat_rate,
    CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS word_length
  FROM counted),
long AS (SELECT place, doc_id, lang, source, base_failed, measure, v FROM measured,
  LATERAL (VALUES {values}) AS x(measure, v)),
placed AS (
  SELECT place, doc_id, lang, source, measure,
    greatest(length(bin(v)) - 5, 0) * 16 + (v >> greatest(length(bin(v)) - 5, 0)::INT) AS bucket
  FROM long WHERE NOT base_failed),
sketch AS (SELECT lang, source, measure, bucket, count(*) AS n FROM placed GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, g.measure, a.bucket, coalesce(s.n, 0) AS n, a.n_all,
    coalesce((SELECT sum(x.n) FROM sketch x WHERE x.lang IS NOT DISTINCT FROM g.lang
      AND x.measure = g.measure AND x.bucket = a.bucket), 0) AS n_lang
  FROM (SELECT DISTINCT lang, source, measure FROM sketch) g
  JOIN (SELECT measure, bucket, sum(n) AS n_all FROM sketch GROUP BY ALL) a ON a.measure = g.measure
  LEFT JOIN sketch s ON s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source
    AND s.measure = g.measure AND s.bucket = a.bucket),
ranked AS (
  SELECT lang, source, measure, bucket, {rank("below")} AS below, {rank("above")} AS above FROM grid
  WINDOW g AS (PARTITION BY lang, source, measure),
    below AS (PARTITION BY lang, source, measure ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    above AS (PARTITION BY lang, source, measure ORDER BY bucket ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
ranks AS (
  SELECT place, doc_id, p.measure, side, CASE side WHEN 'below' THEN below ELSE above END AS rank
  FROM placed p JOIN ranked r ON r.lang IS NOT DISTINCT FROM p.lang AND r.source IS NOT DISTINCT FROM p.source
    AND r.measure = p.measure AND r.bucket = p.bucket, (VALUES ('below'), ('above')) x(side)
  WHERE side = 'below' OR p.measure IN ({two_sided})),
good AS (SELECT * FROM ranks WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
farthest AS (
  SELECT measure, side, min(rank) AS farthest FROM (
    SELECT measure, side, rank, count(*) OVER (PARTITION BY measure, side) AS total,
      count(*) OVER (PARTITION BY measure, side) - count(*) OVER (
        PARTITION BY measure, side ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lost
    FROM good) WHERE lost * 10000 <= total * {LOSE} GROUP BY measure, side),
outside AS (SELECT DISTINCT place FROM ranks JOIN farthest USING (measure, side) WHERE rank > farthest)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND outside.place IS NULL AS kept
FROM measured LEFT JOIN outside USING (place)"""


_JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_split(_lowered("text"))} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3
      THEN list_transform(range(1, len(w) - 1), lambda p: array_to_string(w[p:p + 2], ' '))
      ELSE [array_to_string(w, ' ')] END) AS g FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS b FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)"""


def _plain(url: str) -> str:
    host = f"regexp_replace(regexp_replace({_host(url)}, ':(80|443)$', ''), '^(www|m|mobile|amp)\\.([^.]+\\.)', '\\2')"
    query = f"regexp_extract({_rest(url)}, '(?s)^[^?#]*\\?([^#]*)', 1)"
    asked = (
        f"list_sort(list_filter(string_split({query}, '&'), lambda p: p <> '' AND "
        "NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)')))"
    )
    return (
        f"CASE WHEN {_host(url)} <> '' THEN {host} || regexp_replace({_path(url)}, '/+$', '') || "
        f"CASE WHEN len({asked}) > 0 THEN '?' || array_to_string({asked}, '&') ELSE '' END END"
    )


def _rest(url: str) -> str:
    return f"CASE WHEN strpos({url}, '://') > 0 THEN {url}[strpos({url}, '://') + 3:] ELSE '' END"


def _host(url: str) -> str:
    return f"translate(regexp_extract({_rest(url)}, '(?s)^[^/?#]*'), '{_UPPER}', '{_LOWER}')"


def _path(url: str) -> str:
    return f"regexp_extract({_rest(url)}, '(?s)^[^/?#]*([^?#]*)', 1)"


def _urls() -> str:
    rule = (
        "(SELECT arg_max(struct_pack(r := r.host || r.path, a := r.action), length(r.host || r.path)) "
        "FROM rules r WHERE ({h} = r.host OR ends_with({h}, '.' || r.host)) AND starts_with({p}, r.path))"
    )
    return rf"""
WITH RECURSIVE rules(action, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
tags AS (
  SELECT url AS source, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<link\b[^>]*>'),
      lambda t: regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical\b')),
      lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<meta\b[^>]*>'),
      lambda t: regexp_matches(t, '(?i)http-equiv\s*=\s*["'']?refresh\b')),
      lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS target FROM pages),
named AS (
  SELECT * FROM (SELECT source, CASE WHEN strpos(target, '://') > 0 THEN target
    WHEN starts_with(target, '//') THEN 'http:' || target
    WHEN starts_with(target, '/') THEN regexp_extract(source, '(?s)^.*?://[^/?#]*') || target END AS target
  FROM tags) WHERE source IS NOT NULL AND target IS NOT NULL),
ends AS (SELECT {_plain("source")} AS u, {_plain("target")} AS v FROM named),
links AS (SELECT u, v FROM ends WHERE u <> v UNION SELECT v, u FROM ends WHERE u <> v),
reached AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u),
classes AS (SELECT u, least(u, min(v)) AS alias_of FROM reached GROUP BY u),
addresses AS (
  SELECT page_id, url, {_host("url")} AS host, {_path("url")} AS path, {_plain("url")} AS plain FROM pages
  UNION ALL SELECT NULL, u, {_host("u")}, {_path("u")}, {_plain("u")} FROM (
    SELECT source AS u FROM named UNION ALL SELECT target FROM named)),
judged AS (
  SELECT a.*, {rule.format(h="a.host", p="a.path")} AS rule, coalesce(c.alias_of, a.plain) AS alias_of
  FROM addresses a LEFT JOIN classes c ON c.u = a.plain),
carried AS (
  SELECT alias_of, min(rule.a) AS action FROM judged WHERE rule IS NOT NULL AND alias_of IS NOT NULL GROUP BY alias_of)
SELECT page_id, host, path, rule.r AS rule, coalesce(rule.a, action, 'allow') AS verdict, alias_of
FROM judged LEFT JOIN carried USING (alias_of) WHERE page_id IS NOT NULL"""


def _escaped(column: str) -> str:
    return rf"replace(replace(replace({column}, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')"


_CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r)),
loss AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(length(learned))::BIGINT AS loss_chars,
  sha256(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(length('### ') + length(replace({_escaped("role")}, ':', '\:')) + length(': ') + length({_escaped("text")})
    + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM loss GROUP BY conv_id"""


def _filter_audit() -> str:
    before = "len(list_filter(range(1, step), lambda k: CASE o[k] {tests} END)) > 0"
    tests = " ".join(f"WHEN '{letter}' THEN {letter}" for letter in "ABCDE")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_split("t")} AS w, doc_id > min(doc_id) OVER (PARTITION BY t) AS twin FROM d),
said AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B,
    100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) AS C,
    regexp_matches(t, '[#$%&*|]') AS D, coalesce(twin, false) AS E,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN said USING (doc_id)),
counted AS (SELECT part, A, B, C, D, E, good, toxic, count(*) AS n FROM flags GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, s AS step, o[s] AS filter FROM orders, range(1, 6) r(s)),
applied AS (
  SELECT part, o, step, filter, n, good, toxic, CASE filter {tests} END AS fails,
    {before.format(tests=tests)} AS gone, A::INT + B::INT + C::INT + D::INT + E::INT AS failed
  FROM counted, steps),
told AS (
  SELECT part, o AS filter_order, step::INT AS step, filter,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails AND failed = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM applied GROUP BY part, o, step, filter)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM told"""


_LINE_DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT place, doc_id, string_split(t, chr(10)) AS l FROM d),
lines AS (
  SELECT place, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key
  FROM lines),
judged AS (
  SELECT *, length(key) >= 10 AND coalesce(doc_id > min(doc_id) OVER (PARTITION BY key),
    min(doc_id) OVER (PARTITION BY key) IS NOT NULL) AS dropped
  FROM keyed)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY place"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pii": _pii(),
        "op2_decontamination": _DECONTAMINATION,
        "op3_quality_rules": _quality(),
        "op4_ngram_jaccard": _JACCARD,
        "op7_url_filters": _urls(),
        "op8_chat_formatting": _CHAT,
        "op12_filter_audit": _filter_audit(),
        "op13_line_dedup": _LINE_DEDUP,
    }
