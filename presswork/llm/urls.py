"""URL filters with redirect equivalence.

A rule names a host (with all its subdomains) and a path prefix; the longest fitting rule
decides. Pages that no rule fits take part in a second step: URLs that a page declares to
be the same as itself (canonical links, refresh redirects, or given redirect pairs) form
connected components, and a block on any URL of a component blocks its undecided aliases,
unless a rule explicitly allows one of its URLs: an explicit allow goes before a block that
has only been passed on. Everything else is allowed.

Only DataFrame operations are used. Rules are a short list and become one expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.components import components
from presswork.session import stored

MAX_RULES = 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """Lower-case host; empty if the URL is null or has no ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fitting(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule; allow goes first among equals."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow")):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; a last one leaves its slash."""
    parts = F.split(F.regexp_replace(path, r"/\.{1,2}\z", "$0/"), "/")
    none = F.array().cast("array<string>")

    def add(kept: Column, part: Column) -> Column:
        # The first part is empty, before the first slash, and stays.
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(part == ".", kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    dotted = F.regexp_like(path, F.lit(r"/\.{1,2}(/|\z)"))
    return F.when(dotted, F.array_join(F.aggregate(parts, none, add), "/")).otherwise(path)


def plain_url(url: Column) -> Column:
    """The URL as a node: scheme and host in lower case, no fragment, no dot segments, ``/``
    for no path."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^([^/?#]*?)://", 1)
    query = F.regexp_extract(bare, r"(?s)(\?.*)$", 1)
    path = path_of(bare)
    return F.when(
        F.contains(bare, F.lit("://")),
        F.concat(
            F.translate(head, _UPPER, _LOWER),
            F.lit("://"),
            host_of(bare),
            F.when(path == "", F.lit("/")).otherwise(_without_dots(path)),
            query,
        ),
    )


def _absolute(target: Column, base: Column) -> Column:
    """A link target against a base URL; dot segments stay for ``plain_url``."""
    origin = F.regexp_extract(base, r"(?s)^([^/?#]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)^([^/?#]*:)//", 1)
    path = path_of(base)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    return (
        F.when(F.regexp_like(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, target))
        .when(F.startswith(target, F.lit("/")), F.concat(origin, target))
        .when(F.startswith(target, F.lit("?")), F.concat(origin, path, target))
        .when(F.startswith(target, F.lit("#")), base)
        .otherwise(F.concat(origin, F.regexp_replace(path, r"[^/]*$", ""), target))
    )


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute: quoted either way or bare; empty if it is not there."""
    pattern = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.trim(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]))


# Character references that occur in addresses, the ampersand last.
ENTITIES = [
    (r"(?i)&(?:quot|#34|#x22);", '"'),
    (r"(?i)&(?:apos|#39|#x27);", "'"),
    (r"(?i)&(?:lt|#60|#x3c);", "<"),
    (r"(?i)&(?:gt|#62|#x3e);", ">"),
    (r"(?i)&(?:sol|#47|#x2f);", "/"),
    (r"(?i)&(?:quest|#63|#x3f);", "?"),
    (r"(?i)&(?:equals|#61|#x3d);", "="),
    (r"(?i)&(?:colon|#58|#x3a);", ":"),
    (r"(?i)&(?:amp|#38|#x26);", "&"),
]


def _decoded(value: Column) -> Column:
    for pattern, character in ENTITIES:
        value = F.regexp_replace(value, pattern, character)
    return value


def declared_base(html: Column, url: Column) -> Column:
    """What relative targets of a page refer to: its first ``base href``, else its URL."""
    tag = F.regexp_extract(html, r"(?is)<base\b[^>]*>", 0)
    href = _decoded(_attribute(tag, "href"))
    return F.when(F.coalesce(href, F.lit("")) == "", url).otherwise(_absolute(href, url))


def declared_targets(html: Column) -> Column:
    """Canonical link and refresh targets that a page's mark-up names, references decoded.

    ``canonical`` may stand anywhere in ``rel``.
    """
    links = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    canonical = F.filter(
        links, lambda t: F.regexp_like(_attribute(t, "rel"), F.lit(r"(?is)(^|\s)canonical(\s|$)"))
    )
    hrefs = F.transform(canonical, lambda t: _decoded(_attribute(t, "href")))
    metas = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    refresh = F.filter(
        metas, lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh"
    )
    moved = F.transform(
        refresh,
        lambda t: _decoded(
            F.regexp_extract(_attribute(t, "content"), r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s]+)", 1)
        ),
    )
    return F.filter(F.concat(hrefs, moved), lambda x: (x != "") & x.isNotNull())


def judge_pages(
    pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, passed_on.

    ``pages`` has page_id, url and html; ``redirects`` may give pairs (from_url, to_url).
    rule is the longest fitting rule or null, passed_on tells that the verdict is a block
    of an alias. A null url has an empty host and path and no alias, null html declares
    nothing, repeated rows come out as often. No links or no rows are no special case.
    """
    target = F.explode(F.coalesce(declared_targets(F.col("html")), F.array().cast("array<string>")))
    base = declared_base(F.col("html"), F.col("url"))
    declared = pages.select("url", base.alias("base"), target.alias("target")).select(
        plain_url(F.col("url")).alias("a"),
        plain_url(_absolute(F.col("target"), F.col("base"))).alias("b"),
    )
    if redirects is not None:
        declared = declared.unionByName(
            redirects.select(
                plain_url(F.col("from_url")).alias("a"), plain_url(F.col("to_url")).alias("b")
            )
        )
    edges = stored(
        declared.filter("a is not null and b is not null and a <> b").distinct(), "url-links"
    )
    # Components run on short digests, so long URLs are moved once.
    roots = components(edges.select(F.md5("a").alias("u"), F.md5("b").alias("v")))
    members = roots.unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )
    urls = edges.select(F.explode(F.array("a", "b")).alias("url")).distinct()
    _, direct = _fitting(rules, host_of(F.col("url")), path_of(F.col("url")))
    decided = urls.select(F.md5("url").alias("node"), direct.alias("direct"))
    grouped = members.join(decided, "node")
    blocked = (
        grouped.groupBy("root")
        .agg(
            F.max(F.coalesce(F.col("direct") == "block", F.lit(False))).alias("any_block"),
            F.max(F.coalesce(F.col("direct") == "allow", F.lit(False))).alias("any_allow"),
        )
        .filter("any_block and not any_allow")
    )
    aliases = members.join(blocked, "root", "left_semi").select(
        "node", F.lit(True).alias("passed_on")
    )
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = _fitting(rules, host, path)
    # Pages without a URL are no node; they are dealt out instead of meeting in one task.
    no_node = F.concat(F.lit("-"), F.pmod(F.xxhash64("page_id", "html"), F.lit(4096)).cast("string"))
    own = pages.select(
        "page_id",
        host.alias("host"),
        path.alias("path"),
        rule.alias("rule"),
        verdict.alias("direct"),
        F.coalesce(F.md5(plain_url(F.col("url"))), no_node).alias("node"),
    )
    passed = F.col("direct").isNull() & F.coalesce("passed_on", F.lit(False))
    return own.join(aliases, "node", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("direct", F.when(passed, F.lit("block")), F.lit("allow")).alias("verdict"),
        passed.alias("passed_on"),
    )
