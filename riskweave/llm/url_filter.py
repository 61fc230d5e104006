"""URL filters over redirect equivalence classes.

Host and path rules judge urls; the longest rule that fits wins. URLs that stand
for the same page are aliases: those tied by redirects, refresh headers and
canonical links, whichever page states them. Aliases are the connected
components of those edges, between addresses (urls without fragment, with scheme
and host in lower case, without default port and never without path). A url
without a rule takes the decision of its aliases: allow where one of them is
explicitly allowed, else block where one is blocked, else allow.

Scale: html is read once, for its links; what is shuffled are urls. Decisions
are combined per component before the shuffle; the join back may be skewed by a
large component and is left to adaptive execution. Rules are joined on host
suffixes and broadcast while within BROADCAST_ROWS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import ascii_lower, broadcast_if, materialise, table
from riskweave.llm.components import components

BROADCAST_ROWS = 200_000
# The rules of the query contract.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
# Quotes count after an equals sign only; possessive, so that long tags need no stack.
TAG = r"""(?i)<(?:link|meta)[\s/](?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
ATTRIBUTE = r"""([^\s=>"'/]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)"""
REFRESH = r"""(?is)^[\s0-9.]*+[;,]?\s*+url\s*+=\s*+(?:"([^"]*+)|'([^']*+)|([^"'].*+))"""


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What two writings of a url have in common: no fragment, lower-case scheme and host, no default port, a path; null without "://"."""
    scheme = ascii_lower(F.regexp_extract(url, r"^\s*(.*?)://", 1))
    port = F.when(scheme == "http", ":80").when(scheme == "https", ":443").otherwise("")
    host = F.when((port != "") & F.endswith(host_of(url), port), F.substr(host_of(url), F.lit(1), F.length(host_of(url)) - F.length(port))).otherwise(host_of(url))
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    query = F.regexp_extract(_after(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host, path, query))


def links_of(html: Column) -> Column:
    """Targets of all canonical links and refreshes, as they are written."""

    def target(tag: Column) -> Column:
        names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 1), lambda x: ascii_lower(x))
        values = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 2)

        def value(name: str) -> Column:
            raw = F.get(values, (F.array_position(names, name) - 1).cast("int"))
            return F.replace(F.regexp_replace(raw, r"""^(["'])(.*)\1$""", "$2"), F.lit("&amp;"), F.lit("&"))

        canonical = F.array_contains(F.split(ascii_lower(value("rel")), r"\s+"), "canonical") & ascii_lower(tag).startswith("<link")
        refresh = (F.trim(ascii_lower(value("http-equiv"))) == "refresh") & ascii_lower(tag).startswith("<meta")
        content = F.concat(*[F.regexp_extract(value("content"), REFRESH, i) for i in (1, 2, 3)])
        return F.trim(F.when(canonical, value("href")).when(refresh, content))

    found = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TAG), 0), target)
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != "")))


def resolved(target: Column, page: Column) -> Column:
    """target as seen from a page; targets with a scheme stay."""
    scheme, place = F.regexp_extract(page, "^[^:/?#]+:", 0), F.regexp_extract(page, "^[^:/?#]+://[^/?#]*", 0)
    folder = F.regexp_extract(path_of(page), "^(.*/)?", 0)
    path = F.regexp_extract(target, "^[^?#]*", 0)
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    up = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.lit(1), F.size(done) - 1))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    steps = F.array_join(F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), up), "/")
    rest = F.regexp_extract(target, "[?#].*$", 0)
    inside = F.when(path == "", F.concat(place, path_of(page), rest)).otherwise(F.concat(place, steps, rest))
    return F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target).when(target.startswith("//"), F.concat(scheme, target)).when(place != "", inside)


def fit_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """urls (key, host, path; key unique) with the rule and action that fit, if one does: key, rule, action."""
    rows = [(host, path, action, host + path) for host, path, action in rules]
    listed = urls.sparkSession.createDataFrame(rows, "rule_host string, rule_path string, action string, rule string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    at = urls.where(F.col("host") != "").select("key", "path", F.explode(suffixes).alias("suffix"))
    fitting = at.join(broadcast_if(listed, len(rows), BROADCAST_ROWS), (F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
    best = F.max(F.struct(F.length("rule").alias("length"), (F.col("action") == "allow").alias("first"), "rule", "action"))
    return fitting.groupBy("key").agg(best.alias("best")).select("key", "best.rule", "best.action")


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, component.

    pages has page_id, url, html; redirects (optional) has source, target urls.
    Null urls and urls without "://": empty host and path, no rule, no aliases,
    allowed. Null html has no links; html of any length is searched whole.
    Repeated pages and null page_ids are judged row by row; of rules of the same
    length (ties) allow wins. Empty tables give empty results; other columns are
    ignored, whatever their names.
    """
    read = materialise(
        pages.select(
            F.monotonically_increasing_id().alias("key"), F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("node"),
            F.transform(links_of(F.col("html")), lambda x: resolved(x, F.col("url"))).alias("targets"),
        ),
        "urls",
    )
    ends = read.where(F.size("targets") > 0).select("node", F.explode("targets").alias("target"))
    ends = ends.select(F.col("node").alias("u"), address(F.col("target")).alias("v"), F.col("target").alias("url"))
    if redirects is not None:
        ends = ends.unionByName(redirects.select(address(F.col("source")).alias("u"), address(F.col("target")).alias("v"), F.col("target").alias("url")))
        ends = ends.unionByName(redirects.select(address(F.col("target")).alias("u"), address(F.col("source")).alias("v"), F.col("source").alias("url")))
    ends = materialise(ends, "url-edges")
    classes = components(ends.select("u", "v")).select(F.col("node").alias("c_node"), "component")

    ruled = materialise(fit_rules(read.select("key", "host", "path"), rules).withColumnRenamed("key", "r_key"), "url-rules")
    judged = read.join(ruled, F.col("key") == F.col("r_key"), "left").select("page_id", "host", "path", "node", "rule", "action")
    # Targets that are no pages themselves are judged as well.
    outside = ends.where(F.col("v").isNotNull()).select(F.col("v").alias("node"), "url").distinct().select(F.col("url").alias("key"), "node", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    targets = outside.join(fit_rules(outside.select("key", "host", "path").distinct(), rules).withColumnRenamed("key", "r_key"), F.col("key") == F.col("r_key")).select("node", "action")
    placed = judged.join(classes, F.col("node") == F.col("c_node"), "left").withColumn("component", F.coalesce("component", "node"))
    voices = judged.where(F.col("action").isNotNull() & F.col("node").isNotNull()).select("node", "action").unionByName(targets)
    voices = voices.groupBy("node").agg(F.max((F.col("action") == "allow").cast("int")).alias("allows"), F.max((F.col("action") == "block").cast("int")).alias("blocks"))
    voices = voices.join(classes, F.col("node") == F.col("c_node"), "left").groupBy(F.coalesce("component", "node").alias("class")).agg(F.max("allows").alias("allows"), F.max("blocks").alias("blocks"))
    # Only pages without a rule look to their class; those with one keep it.
    asking = placed.join(voices, (F.col("component") == F.col("class")) & F.col("action").isNull(), "left")
    verdict = F.when(F.col("action").isNotNull(), F.col("action")).when(F.col("allows") == 1, "allow").when(F.col("blocks") == 1, "block").otherwise("allow")
    return asking.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component")


def op8_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages")).drop("component")


OP8_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS key, page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), tags AS (
  SELECT key, url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)[\s/](?:[^>=]+|=\s*(?:"[^"]*"|''[^'']*'')?)*>')) AS tag FROM cut WHERE html IS NOT NULL AND url IS NOT NULL
), attributes AS (
  SELECT key, url, lower(regexp_extract(tag, '^<([a-zA-Z]+)', 1)) AS kind,
    list_transform(regexp_extract_all(tag, '([^\s=>"''/]+)\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1), lambda x: lower(x)) AS names,
    list_transform(regexp_extract_all(tag, '([^\s=>"''/]+)\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 2), lambda x: replace(regexp_replace(x, '^("(.*)"|''(.*)'')$', '\2\3', 's'), '&amp;', '&')) AS vals
  FROM tags
), named AS (
  SELECT key, url, kind, vals[list_position(names, 'rel')] AS rel, vals[list_position(names, 'href')] AS href, vals[list_position(names, 'http-equiv')] AS equiv, vals[list_position(names, 'content')] AS content FROM attributes
), targets AS (
  SELECT DISTINCT key, url, trim(CASE WHEN kind = 'link' AND list_contains(regexp_split_to_array(lower(rel), '\s+'), 'canonical') THEN href
    WHEN kind = 'meta' AND trim(lower(equiv)) = 'refresh' THEN regexp_extract(content, '(?is)^[\s0-9.]*[;,]?\s*url\s*=\s*(?:"([^"]*)|''([^'']*)|([^"''].*))', 1) || regexp_extract(content, '(?is)^[\s0-9.]*[;,]?\s*url\s*=\s*(?:"([^"]*)|''([^'']*)|([^"''].*))', 2) || regexp_extract(content, '(?is)^[\s0-9.]*[;,]?\s*url\s*=\s*(?:"([^"]*)|''([^'']*)|([^"''].*))', 3) END) AS target
  FROM named
), bases AS (
  SELECT key, url, target, regexp_extract(url, '^[^:/?#]+:', 0) AS scheme, regexp_extract(url, '^[^:/?#]+://[^/?#]*', 0) AS place, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS base_path, regexp_extract(target, '^[^?#]*', 0) AS path
  FROM targets WHERE target <> ''
), steps AS (
  SELECT *, CASE WHEN path LIKE '/%' THEN path ELSE CASE WHEN regexp_extract(base_path, '^(.*/)?', 0) = '' THEN '/' ELSE regexp_extract(base_path, '^(.*/)?', 0) END || path END AS whole FROM bases
), resolved AS (
  SELECT url AS source, CASE
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN target WHEN starts_with(target, '//') THEN scheme || target WHEN place = '' THEN NULL
    WHEN path = '' THEN place || base_path || regexp_extract(target, '[?#].*$', 0)
    ELSE place || array_to_string(list_reduce(list_transform(string_split(whole, '/'), lambda x: [x]), lambda done, x: CASE WHEN x[1] = '..' THEN done[1:greatest(1, len(done) - 1)] WHEN x[1] = '.' THEN done ELSE done || x END), '/') || regexp_extract(target, '[?#].*$', 0)
  END AS target FROM steps
), written AS (
  SELECT url FROM cut UNION SELECT source FROM resolved UNION SELECT target FROM resolved
), split AS (
  SELECT url, lower(regexp_extract(url, '^\s*(.*?)://', 1)) AS scheme, substr(url, strpos(url, '://') + 3) AS rest FROM written WHERE strpos(url, '://') > 0
), parts AS (
  SELECT url, scheme, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query FROM split
), addresses AS (
  SELECT url, host, path, scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(host, ':443$', '') ELSE host END || CASE WHEN path = '' THEN '/' ELSE path END || query AS node FROM parts
), rules(rule_host, rule_path, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT url, node, rule_host || rule_path AS rule, action
  FROM addresses JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(rule_host || rule_path) DESC, action) = 1
), ways AS (
  SELECT a.node AS u, b.node AS v FROM resolved r JOIN addresses a ON r.source = a.url JOIN addresses b ON r.target = b.url WHERE a.node <> b.node
  UNION SELECT b.node, a.node FROM resolved r JOIN addresses a ON r.source = a.url JOIN addresses b ON r.target = b.url WHERE a.node <> b.node
), reach(node, seen) AS (SELECT u, u FROM ways UNION SELECT r.node, w.v FROM reach r JOIN ways w ON r.seen = w.u),
voices AS (
  SELECT node, bool_or(action = 'allow') AS allows, bool_or(action = 'block') AS blocks
  FROM (SELECT a.node, b.action FROM addresses a JOIN best b USING (node) UNION SELECT r.node, b.action FROM reach r JOIN best b ON r.seen = b.node) GROUP BY node
)
SELECT c.page_id, coalesce(a.host, '') AS host, coalesce(a.path, '') AS path, b.rule,
  CASE WHEN b.action IS NOT NULL THEN b.action WHEN v.allows THEN 'allow' WHEN v.blocks THEN 'block' ELSE 'allow' END AS verdict
FROM cut c LEFT JOIN addresses a ON c.url = a.url LEFT JOIN best b ON c.url = b.url LEFT JOIN voices v ON a.node = v.node
"""
