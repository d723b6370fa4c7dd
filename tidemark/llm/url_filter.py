"""URL filter: host and path rules, spread over redirects and canonical links.

A rule is a host with a path prefix and fits the host with all its subdomains; of the rules that
fit a URL the longest decides. Pages without a rule take the verdict of their equivalence
class: the connected components over redirects and canonical links. A class that
holds an explicitly allowed URL is allowed; else it is blocked where any URL of it is
blocked; else it is allowed. A URL's own rule always comes first.

Edges come from the pages themselves (``<link rel=canonical>``, ``<meta http-equiv=refresh>``)
and, where given, from a table of redirects. Links are decoded (character references), resolved against the page
or its ``<base href>``, and compared in a normal form: scheme and host in lower case, no default port, no
fragment, no dot segments, ``/`` for an empty path; percent escapes and the order of a query stay as
written. Nodes are 64-bit hashes of it. Only URLs with an edge take part in the components, whose hubs are combined
before the shuffle. A table of rules of any size is joined on the suffixes of the host.

Null URLs, and such without ``://``, have an empty host and path, fit no rule and are allowed. Null or empty html
declares no edge, links of other kinds (``mailto:``) are none. Repeated rows are judged each on its
own, an empty table gives an empty result. ``judge`` reads the columns it names and ignores all others.
"""

from __future__ import annotations

import html as entities

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import arrow, keep

#: Fixed values: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_IN_PLAN = 200  # rules up to here are an expression, more are a table to join; the results are the same


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # shorter ones first, so that a longer one ends up outside; of equal length allow comes first
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[1] == "allow", r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host_ == name) | F.endswith(host_, F.lit("." + name))) & F.startswith(path_, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def joined_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct hosts and paths that some row of ``rules`` (rule, verdict) fits.

    A host has one suffix per label. Each asks only for beginnings of its path of those lengths that rules of
    this suffix have, so a URL sends at most labels x lengths rows, whatever the number of rules.
    """
    slash = F.instr("rule", "/")
    cut = rules.where("rule is not null and verdict is not null").select(
        "rule", "verdict", F.when(slash > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")).alias("suffix"),
        F.when(slash > 0, F.expr("substr(rule, instr(rule, '/'))")).otherwise("").alias("start"))
    lengths = cut.select("suffix", F.length("start").alias("len")).distinct()
    labels = F.split("host", r"\.")
    asked = (urls.select("host", "path").distinct()
             .withColumn("suffix", F.explode(F.transform(
                 F.sequence(F.lit(1), F.size(labels)),
                 lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
             .join(lengths, "suffix").where(F.length("path") >= F.col("len"))
             .withColumn("start", F.col("path").substr(F.lit(1), F.col("len"))))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("a"), "rule", "verdict"))
    return (asked.join(cut, ["suffix", "start"]).groupBy("host", "path").agg(best.alias("r"))
            .select("host", "path", "r.rule", "r.verdict"))


def with_rule(urls: DataFrame, rules=RULES) -> DataFrame:
    """Rows with ``host`` and ``path``, and their ``rule`` and ``own`` verdict; rules as pairs or as a table."""
    if not isinstance(rules, DataFrame):
        rules = list(rules)
        if len(rules) <= _IN_PLAN:
            rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
            return urls.withColumns({"rule": rule, "own": verdict})
        rules = urls.sparkSession.createDataFrame(rules, "rule string, verdict string")
    found = joined_rules(urls, rules).withColumnRenamed("verdict", "own")
    return urls.join(found, ["host", "path"], "left")


def canonical(url: Column) -> Column:
    """The form in which URLs are compared; without ``://`` it is the text before its fragment."""
    whole = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
    scheme, site = F.lower(F.regexp_extract(url, whole, 1)), F.lower(F.regexp_extract(url, whole, 2))
    rest, query = F.regexp_extract(url, whole, 3), F.regexp_extract(url, whole, 4)
    port = F.when(scheme == "http", F.regexp_replace(site, r":(80)?$", "")).when(
        scheme == "https", F.regexp_replace(site, r":(443)?$", "")).otherwise(site)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), port, _without_dots(rest), query)).otherwise(
        F.regexp_extract(url, r"(?s)^([^#]*)", 1))


def _without_dots(path_: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    parts = F.slice(F.split(path_, "/"), 2, F.size(F.split(path_, "/")))

    def step(kept: Column, part: Column) -> Column:
        return (F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
                .when(part == ".", kept).otherwise(F.concat(kept, F.array(part))))

    walked = F.aggregate(parts, F.array().cast("array<string>"), step)
    # a last segment of dots names the folder it leads to
    ended = F.when(path_.rlike(r"/\.\.?$"), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return (F.when(path_ == "", "/").when(path_.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(ended, "/")))
            .otherwise(path_))


def absolute(base: Column, link: Column) -> Column:
    """A link as seen from the page at ``base``; null where it leads to no page of a site."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
            .when(F.startswith(link, F.lit("/")), F.concat(site, link))
            .when(F.startswith(link, F.lit("?")), F.concat(page, link))
            .when((link == "") | F.startswith(link, F.lit("#")), base)
            .otherwise(F.concat(folder, F.when(F.endswith(folder, F.lit("/")), "").otherwise("/"), link)))


@arrow("string")
def _decoded(links: pa.Array) -> pa.Array:
    return pa.array([x if x is None or "&" not in x else entities.unescape(x) for x in links.to_pylist()], pa.string())


def _attribute(tag: Column, name: str) -> Column:
    forms = (rf"""(?is)\b{name}\s*=\s*"([^"]*)\"""", rf"""(?is)\b{name}\s*=\s*'([^']*)'""",
             rf"""(?is)\b{name}\s*=\s*([^\s"'>]+)""")
    return F.coalesce(*(F.nullif(F.regexp_extract(tag, form, 1), F.lit("")) for form in forms))


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of the redirects and canonical links that pages declare."""
    tags = F.concat(
        F.filter(F.regexp_extract_all("html", F.lit(r"(?is)(<link\b[^>]*>)"), 1),
                 lambda t: t.rlike(r"""(?is)\brel\s*=\s*["']?\s*canonical\b""")),
        F.filter(F.regexp_extract_all("html", F.lit(r"(?is)(<meta\b[^>]*>)"), 1),
                 lambda t: t.rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b""")))
    tag = F.col("tag")
    refresh = F.regexp_extract(tag, r"""(?is)\burl\s*=\s*["']?([^"'>]+)""", 1)
    link = F.coalesce(_attribute(tag, "href"), F.nullif(refresh, F.lit("")))
    declared = (pages.where("url is not null and html is not null")
                .select("url", _attribute(F.regexp_extract("html", r"(?is)(<base\b[^>]*>)", 1), "href").alias("base"),
                        F.explode(tags).alias("tag"))
                .select("url", "base", link.alias("link")).where("link is not null"))

    def clean(c: str) -> Column:
        return F.trim(F.regexp_replace(_decoded(F.col(c)), r"[\t\r\n]", ""))

    seen = declared.select("url", clean("base").alias("base"), clean("link").alias("link"))
    base = F.coalesce(absolute(F.col("url"), F.col("base")), F.col("url"))
    return (seen.select(F.col("url").alias("src"), absolute(base, F.col("link")).alias("dst"))
            .where("dst is not null"))


def _node(url: Column) -> Column:
    return F.xxhash64(canonical(url))


def class_verdicts(edges: DataFrame, urls: DataFrame, rules=RULES) -> DataFrame:
    """(node, spread) of every URL with an edge: what its class says.

    ``urls`` holds further URLs with rules; those of the edges themselves count anyway.
    """
    both = keep(edges.where("src is not null and dst is not null")
                .select(canonical(F.col("src")).alias("src"), canonical(F.col("dst")).alias("dst")))
    classes = keep(components(both.select(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b"))))
    named = both.select(F.explode(F.array("src", "dst")).alias("url")).distinct().unionByName(urls.select("url"))
    parts = named.select(_node(F.col("url")).alias("id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    # only what stands in a class needs its rules looked up
    ruled = (with_rule(parts.join(classes.select("id"), "id", "left_semi"), rules)
             .select("id", F.col("own").alias("v")).where("v is not null").distinct())
    says = (classes.join(ruled, "id").groupBy("component")
            .agg(F.when(F.max(F.col("v") == "allow"), "allow").otherwise("block").alias("spread")))
    return classes.join(says, "component").select(F.col("id").alias("node"), "spread")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Pages (with page_id, url, html) and their host, path, rule and verdict.

    ``redirects`` (src, dst) adds edges; ``rules`` are pairs (rule, verdict) or a table of them.
    """
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst"))
    spread = keep(class_verdicts(edges, pages.select("url").where("url is not null"), rules))
    own = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
                       _node(F.col("url")).alias("node"))
    return with_rule(own, rules).join(spread, "node", "left").select(
        "page_id", "url", "host", "path", "rule", F.coalesce("own", "spread", F.lit("allow")).alias("verdict"))


def report(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url", "html")).drop("url")
