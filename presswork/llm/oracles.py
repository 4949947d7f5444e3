"""SQL of the corpus queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from presswork.llm.licences import known_texts

ORACLES = {}

ORACLES["op1_mix_sources"] = """
WITH sizes AS (
  SELECT source, coalesce(sum(length(text)), 0) AS n_chars,
         CASE source WHEN 'src0' THEN 4.0::DOUBLE WHEN 'src1' THEN 2.0 WHEN 'src2' THEN 2.0 ELSE 1.0 END AS weight
  FROM documents GROUP BY source
), total AS (
  SELECT sum(n_chars)::DOUBLE AS chars, sum(weight) FILTER (WHERE n_chars > 0) AS w FROM sizes
), rates AS (
  SELECT source, CASE WHEN n_chars > 0 THEN weight / w * chars / n_chars ELSE 0 END AS rate
  FROM sizes, total
), parts AS (
  SELECT source, greatest(ceil(rate / 16), 1)::BIGINT AS parts, rate / greatest(ceil(rate / 16), 1) AS mean
  FROM rates
), steps AS (
  SELECT source, k, sum(CASE WHEN mean > 0 THEN exp(-mean + k * ln(mean) - lgamma(k + 1)) WHEN k = 0 THEN 1 ELSE 0 END)
         OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM parts, range(80) AS r(k)
), lists AS (
  SELECT source, list(cdf ORDER BY k) AS cdf FROM steps GROUP BY source
), keyed AS (
  SELECT d.*, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS key FROM documents d
), drawn AS (
  SELECT k.*, (
    SELECT sum(len(list_filter(l.cdf, lambda c: c <= ('0x' || substr(md5('7/' || k.key || '/' || i), 1, 13))::BIGINT / 4503599627370496.0)))
    FROM range(1, p.parts + 1) AS r(i)) AS n
  FROM keyed k JOIN parts p ON k.source IS NOT DISTINCT FROM p.source
  JOIN lists l ON l.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, text, lang, source, n_chars, copy,
       ('0x' || substr(md5('7/order/' || key || '/' || copy), 1, 13))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(1, n::BIGINT + 1)) AS copy FROM drawn)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SPELLINGS = [
    ("licenc", "licens"),
    ("sub licens", "sublicens"),
    ("authoris", "authoriz"),
    ("organis", "organiz"),
    ("favour", "favor"),
    ("merchantib", "merchantab"),
    ("non commercial", "noncommercial"),
    (" version ", " v"),
]
_NOT_HOLDERS = (
    "notices?|holders?|owners?|licen[sc]es?|laws?|statements?|interests?|protection|"
    "infringements?|materials?|works?|year|and|or|in|to|on|of|for|is|are|as|that|which|has|"
    "permissions?|disclaimers?|treaty|rights?"
)


def _is_statement(line: str) -> str:
    """Whether a line in lower case is a copyright statement."""
    start = "^[^a-z0-9©(]*"
    sure = (
        r"copyright[^a-z0-9]*(?:\(c\)|©[^a-z0-9]{0,9}[a-z]|[0-9]{4}|yyyy\b)"
        r"|\(c\)[^a-z0-9]*(?:copyright[^a-z0-9]*)?[0-9]{4}|©|all rights reserved[^a-z0-9]*$"
    )
    named = rf"{start}copyright[ \t]+"
    return (
        f"(regexp_matches({line}, '{start}(?:{sure})') OR (regexp_matches({line}, '{named}[a-z0-9]')"
        rf" AND NOT regexp_matches({line}, '{named}(?:{_NOT_HOLDERS})\b')))"
    )


def _lines(text: str) -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"string_split(translate({text}, {letters}), chr(10))"


def _canonical(text: str) -> str:
    rest = f"list_transform({_lines(text)}, lambda l: CASE WHEN {_is_statement('l')} THEN '' ELSE l END)"
    return _joined_words(f"array_to_string({rest}, chr(10))")


def _stated(text: str) -> str:
    """Lines of notices that stand behind copyright statements."""
    tail = r"(?:\bthis (?:work|software) is )?\b(?:licen[sc]ed|released|distributed) under\b[^\n]*"
    found = f"list_filter({_lines(text)}, lambda l: {_is_statement('l')})"
    tails = f"list_transform({found}, lambda l: regexp_extract(l, '{tail}', 0))"
    joined = _joined_words(f"coalesce(array_to_string({tails}, chr(10)), '')")
    return f"list_filter(string_split({joined}, chr(10)), lambda l: l <> '')"


def _joined_words(out: str) -> str:
    out = rf"regexp_replace({out}, '[^a-z0-9\n\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')"
    for spelling, one in _SPELLINGS:
        out = f"replace({out}, '{spelling}', '{one}')"
    out = rf"trim(regexp_replace({out}, ' ?\n ?', chr(10), 'g'), ' ')"
    return rf"regexp_replace(regexp_replace({out}, '\n+', chr(10), 'g'), '^\n|\n$', '', 'g')"


def _on_one_line(form: str) -> str:
    out = f"replace({form}, chr(10), ' ')"
    for spelling, one in _SPELLINGS:
        if " " in spelling:
            out = f"replace({out}, '{spelling}', '{one}')"
    return out


ORACLES["op3_licence_scan"] = f"""
WITH listed(licence, text) AS (
  VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in known_texts())}
), known AS (
  SELECT sha256({_on_one_line(_canonical("text"))}) AS digest, min(licence) AS licence
  FROM listed GROUP BY 1
), forms AS (
  SELECT row_number() OVER () AS row, doc_id, {_canonical("coalesce(text, '')")} AS form,
         {_stated("coalesce(text, '')")} AS stated FROM documents
), lines AS (
  SELECT row, sha256(unnest(list_concat(string_split(form, chr(10)), stated))) AS digest FROM forms
), named AS (
  SELECT row, count(*) AS n_notices,
         array_to_string(list_sort(list_distinct(list(licence))), ',') AS notices
  FROM lines JOIN known USING (digest) GROUP BY row
), whole AS (
  SELECT row, doc_id, sha256({_on_one_line("form")}) AS digest FROM forms
)
SELECT doc_id, digest, licence, coalesce(n_notices, 0)::BIGINT AS n_notices, notices
FROM whole LEFT JOIN known USING (digest) LEFT JOIN named USING (row)
"""

ORACLES["op6_fixity"] = r"""
WITH written AS (
  SELECT page_id,
    concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Target-URI: ',
      regexp_replace(coalesce(url, ''), '[\r\n]', '', 'g'), chr(13), chr(10),
      'WARC-Record-ID: <urn:md5:', md5(concat(coalesce(url, ''), chr(10), coalesce(html, ''))), '>',
      chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ',
      strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''),
      chr(13), chr(10), chr(13), chr(10)) AS record
  FROM pages
), marked AS (
  SELECT *, md5(concat(coalesce(page_id::VARCHAR, ''), chr(10), record)) AS mark FROM written
), dealt AS (
  SELECT *, ('0x' || substr(mark, 1, 12))::BIGINT
            % (SELECT greatest(1, (count(*) + 511) // 512) FROM pages)::BIGINT AS file
  FROM marked
), kept AS (
  SELECT page_id, file, record, ('0x' || substr(md5(record), 1, 12))::BIGINT AS number,
    coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, mark
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM dealt
)
SELECT file, "offset", CASE WHEN number % 193 = 0 THEN 'missing' ELSE 'changed' END AS status,
  sha256(record) AS left_digest,
  CASE WHEN number % 193 <> 0 THEN sha256(record || '?') END AS right_digest, 1::BIGINT AS copies, page_id
FROM kept WHERE number % 193 = 0 OR number % 97 = 0
"""

def _value(tag: str, name: str) -> str:
    """SQL of an attribute's value in a tag."""
    pattern = rf"""(?is)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    groups = " || ".join(f"regexp_extract({tag}, '{pattern}', {i})" for i in (1, 2, 3))
    return f"trim({groups}, ' ')"


def _references(value: str) -> str:
    for names, character in [
        ("quot|#34|#x22", '"'), ("apos|#39|#x27", "''"), ("lt|#60|#x3c", "<"), ("gt|#62|#x3e", ">"),
        ("sol|#47|#x2f", "/"), ("quest|#63|#x3f", "?"), ("equals|#61|#x3d", "="), ("colon|#58|#x3a", ":"),
        ("amp|#38|#x26", "&"),
    ]:
        value = f"regexp_replace({value}, '(?i)&(?:{names});', '{character}', 'g')"
    return value


def _resolved(target: str, base: str) -> str:
    origin = f"regexp_extract({base}, '(?s)^([^/?#]*://[^/?#]*)', 1)"
    path = f"coalesce(nullif(regexp_extract({base}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), ''), '/')"
    return f"""CASE
      WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {target}
      WHEN starts_with({target}, '//') THEN regexp_extract({base}, '(?s)^([^/?#]*:)//', 1) || {target}
      WHEN starts_with({target}, '/') THEN {origin} || {target}
      WHEN starts_with({target}, '?') THEN {origin} || {path} || {target}
      WHEN starts_with({target}, '#') THEN {base}
      ELSE {origin} || regexp_replace({path}, '[^/]*$', '') || {target} END"""


def _no_dots(path: str) -> str:
    parts = f"string_split(regexp_replace({path}, '(/[.][.]?)\\z', '\\1/'), '/')"
    return f"""CASE WHEN regexp_matches({path}, '/[.][.]?(/|\\z)') THEN array_to_string(list_reduce(
      list_transform({parts}, lambda p: [p]), lambda kept, p: CASE WHEN p[1] = '.' THEN kept
        WHEN p[1] = '..' THEN kept[1:greatest(len(kept) - 1, 1)] ELSE kept || p END), '/') ELSE {path} END"""


ORACLES["op10_url_filter"] = (
    r"""
WITH RECURSIVE parts AS (
  SELECT row_number() OVER () AS row, page_id, url, html,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), bases AS (
  SELECT row, url, html, """
    + _references(_value("regexp_extract(html, '(?is)<base\\b[^>]*>')", "href"))
    + r""" AS href FROM parts
), based AS (
  SELECT row, url, html, CASE WHEN coalesce(href, '') = '' THEN url ELSE """
    + _resolved("href", "url")
    + r""" END AS base FROM bases
), tags AS (
  SELECT row, url, base, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM based
), targets AS (
  SELECT row, url, base, CASE
      WHEN regexp_matches(tag, '(?is)^<link\b') AND regexp_matches("""
    + _value("tag", "rel")
    + r""", '(?is)(^|\s)canonical(\s|$)') THEN """
    + _references(_value("tag", "href"))
    + r"""
      WHEN regexp_matches(tag, '(?is)^<meta\b') AND lower("""
    + _value("tag", "http-equiv")
    + r""") = 'refresh' THEN """
    + _references(
        f"regexp_extract({_value('tag', 'content')}, "
        + r"""'(?is)\burl\s*=\s*["'']?\s*([^"''\s]+)', 1)"""
    )
    + r"""
    END AS target
  FROM tags
), raw_links AS (
  SELECT url AS a, """
    + _resolved("target", "base")
    + r""" AS b FROM targets WHERE target <> ''
), urls AS (
  SELECT DISTINCT u, regexp_replace(trim(u, ' '), '(?s)#.*$', '') AS bare
  FROM (SELECT a AS u FROM raw_links UNION SELECT b FROM raw_links UNION SELECT url FROM parts)
), pathed AS (
  SELECT *, regexp_extract(bare, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM urls
), plain AS (
  SELECT u, CASE WHEN contains(bare, '://') THEN
      translate(regexp_extract(bare, '(?s)^([^/?#]*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      || '://' || translate(regexp_extract(bare, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      || coalesce(nullif("""
    + _no_dots("path")
    + r""", ''), '/')
      || regexp_extract(bare, '(?s)(\?.*)$', 1) END AS node
  FROM pathed
), links AS (
  SELECT x.node AS a, y.node AS b FROM raw_links l JOIN plain x ON l.a = x.u JOIN plain y ON l.b = y.u
  WHERE x.node <> y.node
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT a AS node, a AS other FROM both_ways
  UNION
  SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.other = w.a
), judged AS (
  SELECT n.node, (SELECT max_by(r.verdict, length(r.host || r.path)) FROM rules r
    WHERE (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)) AS direct
  FROM (SELECT DISTINCT node, regexp_extract(node, '(?s)^.*?://([^/?#]*)', 1) AS host,
          regexp_extract(node, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM reach) n
), aliases AS (
  SELECT r.node FROM reach r JOIN judged j ON r.other = j.node
  GROUP BY r.node HAVING bool_or(coalesce(j.direct = 'block', false)) AND NOT bool_or(coalesce(j.direct = 'allow', false))
), ruled AS (
  SELECT p.row, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
         max_by(r.verdict, length(r.host || r.path)) AS direct
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.row
)
SELECT p.page_id, p.host, p.path, rule,
  CASE WHEN direct IS NOT NULL THEN direct WHEN a.node IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  (direct IS NULL AND a.node IS NOT NULL) AS passed_on
FROM parts p LEFT JOIN plain n ON p.url = n.u LEFT JOIN aliases a ON n.node = a.node LEFT JOIN ruled USING (row)
"""
)

ORACLES["op11_filter_audit"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first
  FROM texts
), failed AS (
  SELECT part, doc_id,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM words
), marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), letters(f, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, l.bit,
    (SELECT coalesce(sum(p.bit), 0) FROM letters p WHERE position(p.f IN filter_order) < step)::INT AS before
  FROM orders, range(1, 6) AS r(step), letters l WHERE l.f = substr(filter_order, step::INT, 1)
), counted AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""

ORACLES["op12_source_divergence"] = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(text, '') AS text
  FROM documents
), groups AS (
  SELECT DISTINCT lang, source FROM texts
), words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM texts
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, l.v,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
    (1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v))::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), scaled AS (
  SELECT *, (1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v))::HUGEINT AS p FROM shares
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM scaled a JOIN scaled b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
  FROM scaled WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
