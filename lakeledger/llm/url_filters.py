"""URL filters: host and path rules, carried over redirect and canonical-link edges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .support import cut, quoted, text_or_empty, unused, without

#: Rules that may be literals of the plan; a longer list is a table.
MOST_LITERALS = 100
ADDED = ("host", "path", "rule", "verdict")

_TAG = r"(?is)<{tag}\b(?=[^>]*\b{key}\s*=\s*[\"']?{value}\b)[^>]*\b{wanted}"
_CANONICAL = _TAG.format(tag="link", key="rel", value="canonical", wanted=r"href\s*=\s*[\"']?([^\"'\s>]+)")
_REFRESH = _TAG.format(tag="meta", key="http-equiv", value="refresh", wanted=r"content\s*=\s*[\"'][^\"'>]*?url\s*=\s*([^\"'\s>]+)")


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or # (or the end), A-Z lower-cased; empty without ://."""
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_filter(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] | DataFrame,
    url: str = "url",
    html: str | None = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict (``allow`` or ``block``).

    ``rules``: (host, path, verdict), a list or a table with these columns, of any length. A rule fits its host and all subdomains of it, if the path starts with the rule's;
    the longest one that fits decides (of equally long ones the one that blocks). ``rule`` is its host and path joined.
    In a table a null path is empty, and a row without host or verdict is no rule. Lists of more than MOST_LITERALS rules
    become a table. Tables are joined by equality, see ``_best_rules``.

    A URL that no rule fits is blocked if it is an alias of a URL that a rule blocks. Aliases are the connected
    components over redirects and canonical links: HTML refreshes and canonical links found in ``html``, and the rows
    (from, to) of ``redirects`` if given. A URL that a rule allows stays allowed whatever its aliases are, and so does
    one without an edge. Nodes are URLs without fragment, with scheme and host in lower case; a relative target is
    resolved against its page.

    A null or malformed URL has an empty host and path, no rule, no alias, and is allowed. Null HTML has no edges.
    Repeated rows and URLs are judged alike. Columns named like an added one are replaced. Built-in functions only.
    Blocked components are joined by URL; the join's page side can be split where one URL is very frequent.
    """
    if not isinstance(rules, DataFrame) and len(rules) > MOST_LITERALS:
        rules = pages.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")
    source_url, source_html = unused(pages, "url_", "html_")
    pages = pages.withColumn(source_url, quoted(url).cast("string"))
    pages = pages.withColumn(source_html, text_or_empty(html) if html else F.lit(""))
    passed = [quoted(name) for name in without(pages, *ADDED, source_url, source_html).columns]
    node, own, blocked_node = unused(pages, "node_", "own_", "blocked_node_")

    judged = _judged(pages.withColumn(node, _node(quoted(source_url))), source_url, rules, own)
    edges = _edges(pages.select(F.col(source_url).alias("url"), F.col(source_html).alias("html")))
    if redirects is not None:
        start, end = (quoted(name).cast("string") for name in redirects.columns[:2])
        edges = edges.unionByName(redirects.select(_node(start).alias("a"), _node(end).alias("b")))
    roots = connected_components(edges.where("a <> b and a <> '' and b <> ''"))

    # every URL of a component counts, whether it is a page or only a link's target
    blocks = _judged(roots, "node", rules, "own").where("own.verdict = 'block'").select(F.col("root").alias("bad")).distinct()
    blocked = roots.join(blocks, roots.root == blocks.bad, "left_semi").select(F.col("node").alias(blocked_node))
    found = judged.join(blocked, F.col(node) == F.col(blocked_node), "left")
    method = F.when(F.col(blocked_node).isNotNull(), "block").otherwise("allow")
    return found.select(
        *passed,
        url_host(quoted(source_url)).alias("host"),
        url_path(quoted(source_url)).alias("path"),
        F.col(own)["rule"].alias("rule"),
        F.coalesce(F.col(own)["verdict"], method).alias("verdict"),
    )


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _match(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the rule that decides, else null."""

    def fits(rule: tuple[str, str, str]) -> Column:
        inside = (host == rule[0]) | host.endswith("." + rule[0])
        return inside & path.startswith(rule[1]) if rule[1] else inside

    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0] + r[1]))
    kind = "struct<rule: string, verdict: string>"
    values = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")).cast(kind) for h, p, v in ordered]
    nothing = F.lit(None).cast(kind)
    return reduce(lambda rest, x: F.when(fits(x[0]), x[1]).otherwise(rest), reversed(list(zip(ordered, values))), nothing)


def _judged(df: DataFrame, url: str, rules: Sequence[tuple[str, str, str]] | DataFrame, name: str) -> DataFrame:
    """``df`` with a column struct(rule, verdict) of the rule that decides on its column ``url``, else null."""
    host, path = url_host(quoted(url)), url_path(quoted(url))
    if not isinstance(rules, DataFrame):
        return df.withColumn(name, _match(host, path, rules))
    own_host, own_path, best_host, best_path = unused(df, "host_of_", "path_of_", "best_host_", "best_path_")
    df = df.withColumns({own_host: host, own_path: path})
    best = _best_rules(df.select(F.col(own_host).alias("host"), F.col(own_path).alias("path")), rules)
    best = best.select(F.col("host").alias(best_host), F.col("path").alias(best_path), F.col("best").alias(name))
    met = df.join(best, (F.col(own_host) == F.col(best_host)) & (F.col(own_path) == F.col(best_path)), "left")
    return met.drop(own_host, own_path, best_host, best_path)


def _best_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, best): the rule that decides on each distinct host and path that a rule fits.

    A host is exploded into its suffixes behind dots, these meet the lengths of paths that rules of that host have, and
    the prefixes of those lengths meet the rules. Rows grow with distinct URLs times the lengths that fit, at most the
    length of the path for each suffix, and not with the number of rules.
    """
    table = rules.select(*[F.col(name).cast("string") for name in ("host", "path", "verdict")])
    table = table.where("host is not null and verdict is not null").withColumn("path", F.coalesce("path", F.lit("")))
    order = F.struct((F.col("verdict") != "block").alias("later"), F.col("verdict"))
    table = table.groupBy(F.col("host").alias("suffix"), F.col("path").alias("start")).agg(F.min(order)["verdict"].alias("verdict"))
    lengths = table.select("suffix", F.length("start").alias("length")).distinct()

    labels = F.split("host", r"\.", -1)
    places = F.sequence(F.lit(1), F.size(labels))
    suffixes = F.transform(places, lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    parts = urls.distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    starts = parts.join(lengths, "suffix").where(F.col("length") <= F.length("path"))
    starts = starts.withColumn("start", F.substring("path", F.lit(1), F.col("length")))
    rule = F.concat("suffix", "start")
    rank = F.struct((-F.length(rule)).alias("size"), (F.col("verdict") != "block").alias("later"), rule.alias("rule"), "verdict")
    best = starts.join(table, ["suffix", "start"]).groupBy("host", "path").agg(F.min(rank).alias("r"))
    return best.select("host", "path", F.struct(F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")).alias("best"))


def _node(url: Column) -> Column:
    """The URL without fragment, scheme and host in lower case; empty for null and without ://."""
    scheme = _ascii_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    slash = F.when(rest.rlike("^/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), url_host(url), slash)).otherwise(F.lit(""))


def _edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page and the target of each of its canonical links and refreshes."""
    lower = F.lower("html")
    nothing = F.array().cast("array<string>")
    links = F.concat(
        F.when(lower.contains("canonical"), F.regexp_extract_all("html", F.lit(_CANONICAL), F.lit(1))).otherwise(nothing),
        F.when(lower.contains("refresh"), F.regexp_extract_all("html", F.lit(_REFRESH), F.lit(1))).otherwise(nothing),
    )
    targets = pages.select("url", F.explode(F.array_distinct(F.filter(links, lambda x: x != ""))).alias("link"))
    link = F.regexp_replace("link", "&amp;", "&")
    base = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*(/[^?#]*/|/)", 1)
    whole = (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract("url", r"(?s)^(.*?:)//", 1), link))
        .when(link.startswith("/"), F.concat(base, link))
        .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )
    return targets.select(_node(F.col("url")).alias("a"), _node(whole).alias("b"))
