"""URL filter with redirect equivalence (operator 1).

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest
rule string wins, allow before block among equals. Redirect and canonical-link edges make urls aliases of each
other: distributed connected components over these edges carry a rule's block to every alias, also to and from
targets that are not rows themselves. An url that a rule fits keeps that rule's verdict, so an explicit allow
takes precedence over a block that its aliases bring; every other url is allowed.

Aliases are compared without scheme and fragment, hosts lower-cased, dot segments resolved. Edges come from
``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` outside comments and scripts, in any order of attributes and
over line ends, relative to the page or its ``<base>``, or from the caller as (from_url, to_url). A tag ends at its
first ``>``.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed; null
or empty html has no edges; repeated rows are judged alike, one result each; links to the page itself, to
nothing or to other schemes without a host are no edges; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table
from .components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that are written into the plan as one expression; longer lists are joined by host.
INLINE_RULES = 256

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
_TAG = r"(?i)<(?:link|meta|base)\b[^>]*>"
_ATTRIBUTE = r"""[^\s"'<>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
_REFRESH = r"""(?is)^[\s\d.]*[;,\s]\s*(?:url\s*=\s*)?["']?([^"']*)"""
#: Over how many tasks the rows of one url spread when they meet their alias.
SALTS = 8


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _without_dots(path: Column) -> Column:
    """A path whose segments . and .. are resolved; a last one leaves its slash."""
    parts = F.split(path, "/")
    stay = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    done = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), stay)
    open_end = F.element_at(parts, -1).isin(".", "..")
    return F.when(path.contains("/."), F.concat(F.array_join(done, "/"), F.when(open_end, "/").otherwise(""))).otherwise(path)


def alias_key(url: Column) -> Column:
    """Host, path and query, by which aliases are compared; null where there is no host."""
    path, query = path_of(url), F.regexp_extract(url, r"://[^/?#]*[^?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path == "", F.lit("/")).otherwise(_without_dots(path)), query))


def _fits(host: Column, path: Column, rule_host, rule_path) -> Column:
    rule_host, rule_path = (F.lit(x) if isinstance(x, str) else x for x in (rule_host, rule_path))
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def with_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds rule (its string) and action to rows with host and path; both null where no rule fits."""
    if any(action not in ("allow", "block") for _, _, action in rules):
        raise ValueError("an action is allow or block")
    ordered = sorted({(h.lower(), p, a) for h, p, a in rules}, key=lambda r: (-len(r[0] + r[1]), r[2], r[0]))
    if len(ordered) <= INLINE_RULES:
        rule = action = None
        for h, p, a in ordered:
            hit = _fits(F.col("host"), F.col("path"), h, p)
            rule = F.when(hit, h + p) if rule is None else rule.when(hit, h + p)
            action = F.when(hit, a) if action is None else action.when(hit, a)
        none = F.lit(None).cast("string")
        return urls.select("*", (none if rule is None else rule).alias("rule"), (none if action is None else action).alias("action"))
    table = urls.sparkSession.createDataFrame(ordered, "rule_host string, rule_path string, action string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    places = urls.select("host", "path").distinct()
    found = (
        places.select("host", "path", F.explode(suffixes).alias("rule_host")).join(table, "rule_host").where(F.startswith("path", "rule_path"))
        .groupBy("host", "path").agg(F.max(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), (F.col("action") == "allow").alias("a"), F.concat("rule_host", "rule_path").alias("rule"), "action")).alias("best"))
    )
    return urls.join(found, ["host", "path"], "left").select(*urls.columns, "best.rule", "best.action")


def _attribute(attributes: Column, name: str) -> Column:
    """The value of a tag's first attribute of this name, with its quotes if it has some; null if there is none."""
    found = F.filter(attributes, lambda x: F.lower(F.rtrim(F.substring_index(x, "=", 1))) == name)
    return F.ltrim(F.regexp_extract(F.get(found, F.lit(0)), r"(?s)^[^=]*=\s*(.*)$", 1))


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, """^["']|["']$""", "")


def _with_resolved(rows: DataFrame, target: str, base: str, name: str) -> DataFrame:
    """rows with a link's absolute url; null for none, for one into its own page, and for other schemes without a host.

    Step by step, so that no expression stands in the plan more often than it is written here.
    """
    rows = rows.withColumn("_to", F.replace(F.btrim(F.translate(target, "\t\r\n", "")), F.lit("&amp;"), F.lit("&")))
    rows = rows.withColumns({"_origin": F.regexp_extract(base, r"^([^:]*://[^/?#]*)", 1), "_path": F.regexp_extract(base, r"^[^:]*://[^/?#]*([^?#]*)", 1)})
    to, origin, folder = F.col("_to"), F.col("_origin"), F.regexp_extract("_path", r"^(.*/)", 1)
    found = (
        F.when((to == "") | to.startswith("#"), None).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(F.lit("https:"), to)).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(to.startswith("/"), F.concat(origin, to)).when(to.startswith("?"), F.concat(origin, F.col("_path"), to)).otherwise(F.concat(origin, F.coalesce(F.nullif(folder, F.lit("")), F.lit("/")), to))
    )
    return rows.withColumn(name, found).drop("_to", "_origin", "_path")


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(from_url, to_url): canonical links and refreshes of each page, with relative targets resolved."""
    page = pages.select(F.col(url).alias("from_url"), F.col(html).alias("html")).where(F.col("from_url").contains("://") & F.col("html").rlike(r"(?i)canonical|refresh"))
    found = page.select("from_url", F.regexp_extract_all(F.regexp_replace("html", _HIDDEN, " "), F.lit(_TAG), F.lit(0)).alias("tags")).where(F.size("tags") > 0)
    parsed = F.transform("tags", lambda x: F.struct(F.lower(F.substr(x, F.lit(2), F.lit(4))).alias("kind"), F.regexp_extract_all(x, F.lit(_ATTRIBUTE), F.lit(0)).alias("attributes")))
    tags = found.select("from_url", parsed.alias("tags"))
    base = F.get(F.filter(F.transform(F.filter("tags", lambda x: x["kind"] == "base"), lambda x: _attribute(x["attributes"], "href")), lambda x: x.isNotNull()), F.lit(0))
    based = _with_resolved(tags.withColumn("base_href", _bare(base)), "base_href", "from_url", "resolved")
    tag = based.select("from_url", F.coalesce("resolved", "from_url").alias("base"), F.explode("tags").alias("tag")).where("tag.kind in ('link', 'meta')")
    wanted = tag.select("from_url", "base", "tag.kind", *[_bare(_attribute(F.col("tag.attributes"), x)).alias(x.replace("-", "_")) for x in ("rel", "href", "http-equiv", "content")])
    canonical = (F.col("kind") == "link") & F.col("rel").rlike(r"(?i)(^|\s)canonical(\s|$)")
    refresh = (F.col("kind") == "meta") & F.col("http_equiv").rlike(r"(?i)^\s*refresh\s*$")
    target = F.when(canonical, F.col("href")).when(refresh, F.regexp_extract("content", _REFRESH, 1))
    links = wanted.select("from_url", "base", target.alias("target")).where("target is not null")
    return _with_resolved(links, "target", "base", "to_url").select("from_url", "to_url").where("to_url is not null")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], links: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, alias_blocked (an alias, not the url's own rule, brings a block)."""
    links = page_links(pages, url_col, html_col) if links is None else links
    url = F.col(url_col)
    salt = F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int").alias("salt")
    judged = with_rules(pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), alias_key(url).alias("alias"), salt), rules)
    edges = links.select(alias_key(F.col("from_url")).alias("u"), alias_key(F.col("to_url")).alias("v"))
    member = components(edges)
    full = F.concat(F.lit("://"), F.col("node"))
    ruled = with_rules(member.select("node", "root", host_of(full).alias("host"), path_of(full).alias("path")), rules)
    blocked = ruled.where("action = 'block'").select("root").distinct()
    hits = ruled.where("action is null").join(blocked, "root", "left_semi").select(F.col("node").alias("alias"), F.lit(True).alias("hit"))
    aliases = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # urls without a host have no alias; so that they do not meet in one task each gets a key that no alias has
    keyed = judged.withColumn("alias", F.coalesce("alias", F.concat(F.lit("/"), F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))))))
    out = keyed.join(aliases, ["alias", "salt"], "left")
    inherited = F.col("action").isNull() & F.col("hit").isNotNull()
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("hit"), "block"), F.lit("allow")).alias("verdict"), inherited.alias("alias_blocked"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def _sql_attribute(name: str) -> str:
    """A grammar of whole tags: attributes up to the one wanted, then its value with its quotes."""
    value = """("[^"]*"|''[^'']*''|[^\\s"''>]+)"""
    other = """[^\\s"''<>/=]+(?:\\s*=\\s*(?:"[^"]*"|''[^'']*''|[^\\s"''>]+))?"""
    found = f"regexp_extract(tag, '(?is)^<[a-z]+\\b(?:[\\s/]+{other})*?[\\s/\"'']+{name}\\s*=\\s*{value}', 1)"
    return f"CASE WHEN {found} <> '' THEN regexp_replace(regexp_replace({found}, '^[\"'']', ''), '[\"'']$', '') END"


def _sql_resolved(target: str, base: str) -> str:
    to = f"replace(trim(translate({target}, chr(9) || chr(10) || chr(13), ''), ' '), '&amp;', '&')"
    origin, path = f"regexp_extract({base}, '^([^:]*://[^/?#]*)', 1)", f"regexp_extract({base}, '^[^:]*://[^/?#]*([^?#]*)', 1)"
    return f"""CASE
    WHEN {to} = '' OR starts_with({to}, '#') THEN NULL
    WHEN regexp_matches({to}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {to}
    WHEN starts_with({to}, '//') THEN 'https:' || {to}
    WHEN regexp_matches({to}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with({to}, '/') THEN {origin} || {to}
    WHEN starts_with({to}, '?') THEN {origin} || {path} || {to}
    ELSE {origin} || coalesce(nullif(regexp_extract({path}, '^(.*/)', 1), ''), '/') || {to} END"""


OP1_SQL = rf"""
WITH RECURSIVE tags AS (
  SELECT rid, url, nth, tag FROM (SELECT rid, url, unnest(t) AS tag, generate_subscripts(t, 1) AS nth FROM (
    SELECT row_number() OVER () AS rid, url, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', ' ', 'g'), '(?i)<(?:link|meta|base)\b[^>]*>') AS t FROM pages WHERE contains(url, '://')))
), bases AS (
  SELECT rid, arg_min({_sql_attribute("href")}, nth) AS base FROM tags WHERE regexp_matches(tag, '(?i)^<base') AND {_sql_attribute("href")} IS NOT NULL GROUP BY rid
), targets AS (
  SELECT url, coalesce({_sql_resolved("base", "url")}, url) AS base, CASE
    WHEN regexp_matches(tag, '(?i)^<link') AND list_contains(regexp_split_to_array(lower({_sql_attribute("rel")}), '\s+'), 'canonical') THEN {_sql_attribute("href")}
    WHEN regexp_matches(tag, '(?i)^<meta') AND lower(trim({_sql_attribute("http-equiv")})) = 'refresh' THEN regexp_extract({_sql_attribute("content")}, '(?is)^[\s\d.]*[;,\s]\s*(?:url\s*=\s*)?["'']?([^"'']*)', 1) END AS target
  FROM tags LEFT JOIN bases USING (rid)
), links AS (
  SELECT url AS a, {_sql_resolved("target", "base")} AS b FROM targets
), split AS (
  SELECT url, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '://[^/?#]*[^?#]*([^#]*)', 1) AS query
  FROM (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT b FROM links) x(url) WHERE url IS NOT NULL)
), parsed AS (
  SELECT *, CASE WHEN path = '' THEN '/' WHEN NOT contains(path, '/.') THEN path ELSE
    array_to_string(list_reduce(list_transform(string_split(path, '/'), lambda s: [s]), lambda done, s: CASE s[1] WHEN '.' THEN done WHEN '..' THEN done[:greatest(len(done) - 1, 1)] ELSE done || s END), '/')
    || CASE WHEN regexp_matches(path, '/\.\.?$') THEN '/' ELSE '' END END AS straight FROM split
), rules(host, path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), nodes AS (
  SELECT url, any_value(p.host) AS host, any_value(p.path) AS path, any_value(CASE WHEN p.host <> '' THEN p.host || straight || query END) AS alias,
    arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.action, length(r.host || r.path)) AS action
  FROM parsed p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY url
), edges AS (
  SELECT x.alias AS u, y.alias AS v FROM links JOIN nodes x ON x.url = links.a JOIN nodes y ON y.url = links.b WHERE x.alias <> y.alias
), both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges
), reach(s, t) AS (SELECT u, v FROM both_ways UNION SELECT s, v FROM reach JOIN both_ways ON t = u
), alias_rules AS (
  SELECT t, arg_max(r.action, length(r.host || r.path)) AS action FROM (SELECT DISTINCT t, regexp_extract(t, '^([^/?#]*)', 1) AS host, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM reach) n
  JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path) GROUP BY t
), inherited AS (SELECT DISTINCT s FROM reach JOIN alias_rules USING (t) WHERE action = 'block')
SELECT p.page_id, coalesce(r.host, '') AS host, coalesce(r.path, '') AS path, r.rule,
  coalesce(r.action, CASE WHEN r.alias IN (SELECT s FROM inherited) THEN 'block' END, 'allow') AS verdict
FROM pages p LEFT JOIN nodes r ON p.url = r.url
"""
