"""Main text: page shapes, the tree against a plain version of a small host, odd rows and names."""

import math
from collections import Counter

import pytest

from tidemark.llm import site_tree

PAGES = "page_id long, url string, html string"
TEXT = "<h1>Head</h1><p>The story of the day, told at some length.</p><p>And its end.</p>"
WANT = "Head\nThe story of the day, told at some length.\nAnd its end."


@pytest.mark.parametrize("page", [
    f'<body class="page no-sidebar"><article>{TEXT}</article>',
    f'<html class="no-touch search"><body class="right-sidebar"><div>{TEXT}</div></html>',
    f'<article class="post has-comments">{TEXT}</article><div class="comments"><p>me too</p></div>',
    f'<div class="m">{TEXT}</div><div class="related"><article><p>A teaser</p></article></div>',
    f'<div class="layout-with-sidebar"><main class="widget">{TEXT}</main><div class="sidebar-left">links</div></div>',
    f'<div id="search"><div class="t">{TEXT}</div></div><nav>a</nav>',
    f'<div id="search"><article>{TEXT}</article></div><div class="ad">Buy</div>',
    f'<article>{TEXT}<article class="comment">me</article></article>',
    f'<main><div>{TEXT}</div></main><div><p>unmarked</p></div>'])
def test_page_shapes(page):
    assert site_tree.main_text(page) == WANT


def test_teasers_do_not_switch_off_the_rest():
    page = f"<div>{TEXT}</div><article>First teaser</article><article>Second teaser</article>"
    assert site_tree.main_text(page) == WANT + "\nFirst teaser\nSecond teaser"
    assert site_tree.main_text(f"<div>{TEXT}</div><article>A teaser</article>") == WANT + "\nA teaser"


def test_a_short_article_beside_a_long_advert():
    assert site_tree.main_text('<div class="ad">' + "Buy this. " * 50 + "</div><article><p>So</p></article>") == "So"
    assert site_tree.main_text('<div class="ad">Buy this.</div><article><p></p></article>') == ""


def host_of_pages():
    """Twenty pages without any article tag: a slogan and a notice repeat, one block varies a little."""
    return [(i, f"http://h.net/{i}", f"<body><div class=top><p>Our slogan</p></div><div class=m><p>Text {i} of page {i}</p>"
             f"<p>{'unique ' * i}</p></div><div class=tips><p>Tip {i % 2}</p></div>") for i in range(20)]


def plain_worth(pages):
    """node -> what its branch is worth, by the definition, with every page in memory."""
    shapes, texts, parent = {}, {}, {}
    for page in pages:
        blocks, elements = site_tree.walk(page)
        for node, up, shape in set(elements):
            shapes.setdefault(node, []).append(shape)
            parent[node] = up
        for node, text in {(b.node, b.text) for b in blocks if not b.noise}:
            texts.setdefault(node, Counter())[text] += 1

    def worth(node):
        m = max(len(shapes[node]), max(texts.get(node, {}).values(), default=0))
        below = [worth(c) for c in parent if parent[c] == node]
        if node in texts:
            below.append(1 - sum(map(math.log, texts[node].values())) / len(texts[node]) / math.log(m))
        n = len(shapes[node])
        spread = sum(k / n * math.log(n / k) for k in Counter(shapes[node]).values()) / math.log(m)
        return max(site_tree.GAMMA * max(below, default=0), (1 - site_tree.GAMMA) * spread)

    return {n: worth(n) for n in parent}


def test_tree_against_a_plain_one(spark):
    rows = host_of_pages()
    worth = plain_worth([r[2] for r in rows])
    df = spark.createDataFrame(rows, PAGES)
    for least in (0.05, site_tree.LEAST_IMPORTANCE, 0.3, 0.5):
        cut = [set(r.cut) for r in site_tree.branches_to_cut(df, least).collect()]
        assert (cut or [set()]) == [{n for n, w in worth.items() if w < least}]


def test_the_tree_cuts_what_repeats(spark):
    rows = host_of_pages() + [(90, "http://other.net", host_of_pages()[3][2])]
    got = {r.page_id: r.text for r in site_tree.report(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3].startswith("Text 3 of page 3\nunique unique unique") and "slogan" not in got[3]
    assert got[90].startswith("Our slogan\n")


def test_odd_rows_and_names(spark):
    long = "<p>" + "word " * 60_000 + "</p>"
    rows = [(1, None, None), (2, "x", ""), (2, "x", ""), (3, "http://a.net", long), (4, "http://a.net", "<div>" * 300 + "deep")]
    df = spark.createDataFrame([(*r, 7, "s", "t", "h", 5) for r in rows],
                               f"{PAGES}, cut int, site string, Site_ string, host string, text int")
    out = site_tree.extract(df)
    assert out.columns == [*df.columns, "main_text"]
    got = {r.page_id: r for r in out.collect()}
    assert got[1].main_text == got[2].main_text == "" and got[4].main_text == "deep"
    assert got[3].main_text == ("word " * 60_000).strip() and (got[3].cut, got[3].site, got[3].text) == (7, "s", 5)
    assert out.count() == 5
    assert site_tree.report(spark.createDataFrame([], PAGES)).collect() == []
