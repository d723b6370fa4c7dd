"""URL filter: links in all their spellings, classes against union-find, rules as a table, odd rows."""

import random
import re
from urllib.parse import urljoin

from tidemark.llm import url_filter

PAGES = "page_id long, url string, html string"
LINK = '<link rel="canonical" href="{}">'


def verdicts(spark, pages, **options):
    df = spark.createDataFrame(pages, PAGES)
    return {r.page_id: r.verdict for r in url_filter.judge(df, **options).collect()}


REACHED = [
    ("http://B.org/p/../q", "http://b.org/q"), ("HTTP://b.ORG:80/q", "http://b.org/q"),
    ("//b.org/./q#part", "http://b.org/q"), ("http://b.org", "http://b.org/"), ("http://b.org?x=1", "http://b.org/?x=1"),
    ("?k=1", "http://a.net/d/e?k=1"), ("../f/.", "http://a.net/f/"), ("../../../g", "http://a.net/g"),
    ("/h&#47;i&quest;a&equals;1&amp;b=2", "http://a.net/h/i?a=1&b=2"), ("s\n t", "http://a.net/d/s t"),
    ("https://b.org:443/x", "https://b.org/x"), ("https://b.org:80/x", "https://b.org:80/x")]
#: a link, and a page that it does not reach
MISSED = [("mailto:x@b.org", "http://a.net/d/mailto:x@b.org"), ("javascript:go()", "http://a.net/d/go()"),
          ("#part", "http://a.net/d/"), ("http://c.org/q", "http://b.org/q"), ("x", "http://a.net/x")]


def test_links_reach_their_pages(spark):
    pages, rules = [], []
    for i, (link, page) in enumerate(REACHED + MISSED):
        # each case has sites of its own
        here = [re.sub(r"(?i)\b([ab])\.(net|org)", rf"\g<1>{i}.\2", x) for x in ("http://a.net/d/e", link, page)]
        pages += [(2 * i, here[0], LINK.format(here[1])), (2 * i + 1, here[2], None)]
        rules.append((f"a{i}.net/d/e", "block"))
    # a rule of the page with its query fits the path, whatever the class says
    want = {k: "block" if k % 2 == 0 or k < 2 * len(REACHED) else "allow" for k in range(len(pages))}
    assert verdicts(spark, pages, rules=rules) == want


def test_links_start_from_the_base_of_their_page(spark):
    pages = [(1, "http://a.net/d/e", "<base href='/z/'>" + LINK.format("y")), (2, "http://a.net/z/y", None),
             (3, "http://a.net/d/y", None)]
    assert verdicts(spark, pages, rules=[("a.net/d/e", "block")]) == {1: "block", 2: "block", 3: "allow"}


def test_normal_form_of_resolved_links(spark):
    rng = random.Random(4)
    bases = ["http://a.net", "http://a.net/", "http://a.net/b/c/d", "http://a.net/b/c/?q=/x/y"]
    cases = [(b, "/".join(rng.choice(["..", ".", "a", "b.c", "...", ".d"]) for _ in range(rng.randint(1, 6))) + e)
             for b in bases for e in ("", "/", "?u=../v") for _ in range(12)]
    df = spark.createDataFrame([(b, x, urljoin(b, x)) for b, x in cases], "base string, link string, want string")
    rows = df.select("base", "link", "want", url_filter.canonical(url_filter.absolute(df.base, df.link)).alias("got"))
    assert [r for r in rows.collect() if r.got != r.want] == []


def test_classes_of_a_random_graph(spark):
    rng = random.Random(8)
    rules = [("net/", "block"), ("ok.net/", "allow"), ("org/keep", "allow")]
    urls = [f"http://{rng.choice(['a.com', 'b.net', 'ok.net', 'c.org', 'd.com', 'e.com'])}/{rng.choice(['keep', 'x', 'x', 'x'])}{i}"
            for i in range(600)]
    pairs = [(rng.choice(urls), rng.choice(urls)) for _ in range(330)] + [(urls[i], urls[0]) for i in range(30)] + [(None, urls[1])]
    declared = dict(rng.sample(pairs[:-1], 120))
    pages = [(i, u, LINK.format(declared[u]) if u in declared else "") for i, u in enumerate(urls)]
    root = {u: u for u in urls}

    def find(u):
        while root[u] != u:
            u = root[u]
        return u

    for a, b in pairs[:-1]:
        root[find(a)] = find(b)

    def own(u):
        h, _, p = u.split("://")[1].partition("/")
        fits = [r for r in rules if ("." + h).endswith("." + r[0].split("/")[0]) and ("/" + p).startswith("/" + r[0].split("/")[1])]
        return max(fits, key=lambda r: len(r[0]))[1] if fits else None

    says = {}
    for u in urls:
        says.setdefault(find(u), set()).add(own(u))
    want = {i: own(u) or ("allow" if "allow" in says[find(u)] else "block" if "block" in says[find(u)] else "allow")
            for i, u in enumerate(urls)}
    assert len(set(want.values())) == 2
    edges = spark.createDataFrame(pairs, "src string, dst string")
    assert verdicts(spark, pages, redirects=edges, rules=rules) == want
    table = spark.createDataFrame(rules, "rule string, verdict string")
    assert verdicts(spark, pages, redirects=edges, rules=table) == want


def test_rules_as_a_table(spark):
    rng = random.Random(3)
    rules = sorted({("".join(rng.choice(["a.", "b.", "c."]) for _ in range(rng.randint(0, 2))) + rng.choice(["x", "y"])
                     + rng.choice(["", "/", "/p", "/p/q", "/é"]), rng.choice(["allow", "block"])) for _ in range(60)})
    urls = [f"http://{''.join(rng.choice(['a.', 'b.', 'A.']) for _ in range(rng.randint(0, 4)))}{rng.choice(['x', 'y', 'xx', ''])}"
            f"{rng.choice(['', '/', '/p', '/pq', '/p/q/r', '/é', '?p'])}" for _ in range(300)] + [None, "", "x/p"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES)
    table = spark.createDataFrame([*rules, (None, "block")], "rule string, verdict string")
    got = [{tuple(r) for r in url_filter.judge(df, rules=x).collect()} for x in (rules, table)]
    assert got[0] == got[1] and len({r[4] for r in got[0]}) > 10


def test_odd_rows_and_names(spark):
    rows = [(1, None, None), (1, None, None), (2, "", ""), (3, "http://b.net/" + "a/../" * 2000, "x" * 200_000),
            (4, "http://c.org/", LINK.format("http://b.net/" + "/" * 3) * 2)]
    extra = "rule string, own string, node long, host string, src string, verdict string"
    df = spark.createDataFrame([(*r, "u", "u", 5, "u", "u", "u") for r in rows], f"{PAGES}, {extra}")
    got = sorted((r.page_id, r.verdict) for r in url_filter.judge(df).collect())
    assert got == [(1, "allow"), (1, "allow"), (2, "allow"), (3, "block"), (4, "block")]
    assert url_filter.report(spark.createDataFrame([], PAGES)).collect() == []
    assert url_filter.report(spark.createDataFrame([], PAGES)).columns == ["page_id", "host", "path", "rule", "verdict"]
