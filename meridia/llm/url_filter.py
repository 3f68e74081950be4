"""URL filter with redirect equivalence, in DataFrame functions only.

URLs that a redirect or a canonical link connects are aliases of one another: the links
are edges, and distributed connected components (partial minima and joins, nothing
collected) give the classes. URLs that differ only in the case of scheme or host, or in
what follows a #, are one alias. A rule decides the URLs it fits. A class is allowed if an
allow rule fits one of its URLs, else blocked if a block rule does; that decision reaches
the aliases that no rule fits. What neither reaches is allowed.

A rule is a host and the start of a path; it fits the host and its subdomains; of those
that fit, the longest wins; of rules of one length, allow.

Defined cases: a null URL, or one without ``://``, has empty host and path, no rule and no
aliases, and is allowed; a null html has no links; repeated rows each get the same answer;
an empty href is no edge; a page linked to itself only has no aliases; links in comments
do not count; no pages: no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import connected_components, materialise, skew_join

#: (verdict, rule): a host, then the start of the path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_COMMENT = r"(?s)<!--.*?-->"
_TAG = r"""(?is)<(?:link|meta)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_BASE = r"""(?is)<base\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_REFRESH = r"""(?is)^\s*[0-9.]+\s*[;,]\s*url\s*=\s*["']?([^"'\s]+)"""


def rest_of(url: Column) -> Column:
    """What follows the first ://; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the rule that wins; null if none fits."""
    order = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(order):
        at, start = rule.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def without_dots(path: Column) -> Column:
    """path, which starts with a slash, without its . and .. segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p == ".", done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(p))),
    )
    open_end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(kept, open_end), "/")


def resolve(base: Column, to: Column) -> Column:
    """The URL that to, as it stands on the page base, leads to. Targets of a scheme without
    :// and relative ones on a base without it are null."""
    scheme = F.regexp_extract(base, r"^(.*?)://", 1)
    path, tail = F.regexp_extract(to, r"^[^?#]*", 0), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path_of(base), r"^.*/", 0)
    full_path = F.when(path.startswith("/"), without_dots(path)).otherwise(without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), path)))
    query = F.regexp_extract(rest_of(base), r"^[^?#]*(\?[^#]*)?", 1)
    own = F.concat(path_of(base), F.when(to.startswith("#"), query).otherwise(F.lit("")))
    on_host = F.concat(scheme, F.lit("://"), host_of(base), F.when(path == "", own).otherwise(full_path), tail)
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), to))
        .when(scheme == "", F.lit(None))
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), F.regexp_extract(to, r"^//[^/?#]*", 0), without_dots(F.regexp_extract(to, r"^//[^/?#]*([^?#]*)", 1)), tail))
        .otherwise(on_host)
    )


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not, its ends trimmed; empty without one."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.trim(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]))


def canonical(url: Column) -> Column:
    """The name of a URL's alias: scheme and host in lower case, without fragment. Null
    where there is no ://."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    rest = rest_of(url)
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*([^#]*)", 1)
    return F.when(rest.isNotNull(), F.concat(scheme, F.lit("://"), host_of(url), tail))


def html_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's URL and where its canonical links and refresh redirects lead.

    Only pages whose markup holds one of the two words are taken apart. A relative
    target is resolved on the page's base element, if it has one, else on its URL."""
    low = F.lower(F.col("html"))
    marked = pages.where(F.col("url").isNotNull() & (low.contains("canonical") | low.contains("refresh")))
    plain = marked.select("url", F.regexp_replace("html", _COMMENT, " ").alias("html"))
    base = attribute(F.regexp_extract("html", _BASE, 0), "href")
    based = plain.withColumn("base", F.when(base == "", F.col("url")).otherwise(F.coalesce(resolve(F.col("url"), base), F.col("url"))))
    tags = based.select("url", "base", F.explode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    is_canonical = F.array_contains(F.split(F.lower(attribute(tag, "rel")), r"\s+"), "canonical")
    is_refresh = F.lower(attribute(tag, "http-equiv")) == "refresh"
    target = F.when(is_canonical, attribute(tag, "href")).when(is_refresh, F.regexp_extract(attribute(tag, "content"), _REFRESH, 1))
    found = tags.select("url", "base", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("to")).where("to <> ''")
    return found.select(F.col("url").alias("a"), resolve(F.col("base"), F.col("to")).alias("b")).where("b is not null")


def alias_classes(edges: DataFrame) -> DataFrame:
    """(alias, component) of every URL on an edge (a, b), by its canonical name."""
    pair = edges.select(canonical(F.col("a")).alias("a"), canonical(F.col("b")).alias("b"))
    pair = materialise(pair.where("a is not null and b is not null and a <> b").distinct())
    named = pair.select(F.col("a").alias("alias")).unionByName(pair.select(F.col("b").alias("alias"))).distinct()
    ids = materialise(named.withColumn("node", F.monotonically_increasing_id()))
    by_a = skew_join(pair.withColumnRenamed("a", "alias"), ids, ["alias"], "inner").select(F.col("node").alias("x"), F.col("b").alias("alias"))
    numbered = skew_join(by_a, ids, ["alias"], "inner").select("x", F.col("node").alias("y"))
    return ids.join(connected_components(numbered, "x", "y"), "node").select("alias", "component")


def judge(pages: DataFrame, edges: DataFrame, rules=RULES) -> DataFrame:
    """pages' page_id with host, path, rule and verdict; edges are (a, b) of URLs."""
    url = F.col("url").cast("string")
    judged = pages.select("page_id", canonical(url).alias("alias"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    alias = F.col("alias")
    members = alias_classes(edges).withColumn("verdict", rule_of(host_of(alias), path_of(alias), rules)["verdict"])
    # an allow rule on any alias takes precedence over block rules
    classes = members.groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allows"), F.max(F.col("verdict") == "block").alias("blocks"))
    reached = F.when(F.coalesce("allows", F.lit(False)), "allow").when(F.coalesce("blocks", F.lit(False)), "block")
    spread = skew_join(members.select("alias", "component"), classes, ["component"], "inner").select("alias", reached.alias("reached"))
    out = skew_join(judged, spread, ["alias"], "left")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "reached", F.lit("allow")).alias("verdict"))


def judge_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    return judge(pages.select("page_id", "url"), html_edges(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))), rules)
