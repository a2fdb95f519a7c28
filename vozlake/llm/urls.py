"""URL rules with redirect equivalence: a block reaches every alias of a blocked address.

Aliases are the connected components over redirect edges (``<meta http-equiv=refresh>``) and canonical-link edges
(``<link rel=canonical>``) of the pages, and any edges given besides. Addresses are nodes in a normal form: no scheme, fragment,
``www.`` or ``m.`` before the host, tracking parameter, dot segment or final slash, which are aliases by themselves.

Every canonical and refresh tag of a page counts. A link is resolved as a browser does: against the page's address, or the page's
first ``<base href>``, with ``.`` and ``..`` folders worked off.

A page's own rule decides first, so an explicit allow takes precedence over any blocked alias. A page without a rule is blocked if
a blocked address (a page or the end of an edge) is in its component, else it is allowed. Everything is DataFrame operations.

Rows: a null url, or one without ``://``, has an empty host and path, no rule and no alias; keys may repeat or be null; a null html has
no links; an empty table gives no rows; other columns are ignored. Empty links, those to a place in the page itself and those of
another scheme are ignored; a tag ends at the next ``>`` and is ignored if a ``<`` comes before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vozlake.durable import cut
from vozlake.llm.components import components

#: (verdict, host, path); a list of rules is a parameter of a few hundred entries at most
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
MAX_RULES = 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_ORIGIN = r"(?s)^(.*?://[^/?#]*)"
_TRACKING = r"(?i)(?:^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _ADDRESS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null; of two as long, an allow comes first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    chosen = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return none if chosen is None else chosen.otherwise(none)


def without_dots(url: Column) -> Column:
    """The address with the ``.`` and ``..`` segments of its path worked off; the work grows with length times ``..`` segments."""
    # a final dot segment names a folder
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/(\.\.?)\z", "/$1/"), r"/\.(?=/)", "")
    worked = F.aggregate(F.split(path, r"/\.\.(?=/)"), F.lit(""), lambda done, piece: F.concat(
        F.substring(done, F.lit(1), F.length(done) - F.length(F.substring_index(done, "/", -1)) - 1), piece))
    origin, tail = F.regexp_extract(url, _ORIGIN, 1), F.regexp_extract(url, r"(?s)^[^?#]*(.*)", 1)
    return F.when(path_of(url).rlike(r"/\.\.?(?:/|\z)"), F.concat(origin, worked, tail)).otherwise(url)


def normal_form(url: Column) -> Column:
    """The node of an address, or null without ``://``."""
    plain = without_dots(url)
    host, path = F.regexp_replace(host_of(plain), r"^(?:www|m)\.", ""), F.regexp_replace(path_of(plain), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1), _TRACKING, "")
    query = F.regexp_replace(query, "^&+", "")
    return F.when(url.contains("://"), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def resolve(link: Column, base: Column) -> Column:
    """The address that a link on a page leads to; null if it leads nowhere else or to another scheme."""
    scheme, origin, path = F.regexp_extract(base, r"(?s)^(.*?:)//", 1), F.regexp_extract(base, _ORIGIN, 1), path_of(base)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)))
    folder = F.when(folder == "", "/").otherwise(folder)
    whole = (
        F.when((link == "") | link.startswith("#"), F.lit(None).cast("string"))
        .when(link.rlike("(?i)^https?://"), link).when(link.startswith("//"), F.concat(scheme, link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("/"), F.concat(origin, link)).when(link.startswith("?"), F.concat(origin, path, link))
        .otherwise(F.concat(origin, folder, link))
    )
    return without_dots(whole)


def _value(tag: Column, name: str) -> Column:
    """What follows ``name=`` in a tag, quoted or not, with its ampersands decoded."""
    pattern = rf"""(?is)[\s"';/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>]+))"""
    return F.trim(F.regexp_replace(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]), "(?i)&(?:amp|#38|#x26);", "&"))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) addresses: one row per canonical link or refresh of a page."""
    page, body = F.col(url), F.col(html).cast("string")
    tags = pages.filter(body.rlike(r"(?i)canonical|http-equiv") & page.contains("://")).select(
        page.alias("src"), F.regexp_extract_all(body, F.lit(r"(?is)<(?:link|meta|base)\b[^<>]*>"), F.lit(0)).alias("_tags"))

    def values(pattern: str, name: str) -> Column:
        return F.transform(F.filter("_tags", lambda tag: tag.rlike(pattern)), lambda tag: _value(tag, name))

    canonical = values(r"""(?is)^<link\b.*[\s"'/]rel\s*=\s*(?:["'][^"'>]*)?\bcanonical\b""", "href")
    refresh = values(r"""(?is)^<meta\b.*[\s"'/]http-equiv\s*=\s*["']?refresh\b""", "url")
    base = resolve(F.get(values(r"""(?is)^<base\b.*[\s"'/]href\s*=""", "href"), 0), F.col("src"))
    found = tags.select("src", F.coalesce(base, "src").alias("_base"), F.explode(F.concat(canonical, refresh)).alias("_link"))
    return found.select("src", resolve(F.col("_link"), F.col("_base")).alias("dst")).filter(F.col("dst").isNotNull())


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, edges: DataFrame | None = None,
          key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, host, path, rule and verdict of every page; ``edges`` (src, dst) are further redirects, as addresses."""
    found = links(pages, url, html)
    if edges is not None:
        found = found.unionByName(edges.select("src", "dst"))
    ends = cut(found.select("src", "dst", normal_form(F.col("src")).alias("a"), normal_form(F.col("dst")).alias("b")), "links")
    aliases = components(ends, "a", "b")

    def ruled(address: Column) -> Column:
        return best_rule(host_of(address), path_of(address), rules)

    judged = cut(pages.select(
        F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
        ruled(F.col(url)).alias("_best"), normal_form(F.col(url)).alias("_node")), "judged")
    blocked = judged.select("_node", F.col("_best.verdict").alias("_v"))
    for address, node in (("src", "a"), ("dst", "b")):
        blocked = blocked.unionByName(ends.select(F.col(node).alias("_node"), ruled(F.col(address))["verdict"].alias("_v")))
    blocked = blocked.filter((F.col("_v") == "block") & F.col("_node").isNotNull()).select("_node").distinct()

    def with_component(df: DataFrame) -> DataFrame:
        named = aliases.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        return df.join(named, "_node", "left").withColumn("_component", F.coalesce("_component", "_node"))

    barred = with_component(blocked).select("_component", F.lit(True).alias("_barred")).distinct()
    # only pages that have no rule look for blocked aliases
    free = with_component(judged.filter(F.col("_best").isNull())).join(barred, "_component", "left")
    final = F.when(F.col("_barred"), "block").otherwise("allow")
    return judged.filter(F.col("_best").isNotNull()).select(
        key, "host", "path", F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("verdict")
    ).unionByName(free.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), final.alias("verdict")))
