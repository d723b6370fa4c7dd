"""Spelling variants against the definition: all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import spelling

ODD = [None, "", " \n", "x", "é ü", "a" * 200_000, "Straße×Straße÷ÀÿŸ", "naïveté " * 7]


def plain_words(rows):
    count = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def edits(w, letters):
    out = {w[:i] + w[i + 1:] for i in range(len(w))}
    out |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
    out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    return out - {w}


def plain_groups(n, ratio=5):
    letters = set("".join(n))
    near = {w: edits(w, letters) & n.keys() for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def told(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_report_follows_the_definition(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    words = base + [spell for w in base for spell in rng.sample(sorted(edits(w, "abcé")), 6)]
    weight = [rng.choice((1, 1, 2, 30, 200)) for _ in words]
    rows = [(i, " ".join(rng.choices([w.upper() if rng.random() < .1 else w for w in words], weight, k=300))) for i in range(120)]
    rows += [(None, rows[0][1]), (3, rows[3][1])] + [(900 + i, t) for i, t in enumerate(ODD)]
    n = plain_words(rows)
    assert len(n) > 200
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string").repartition(3)
    got, want = told(spelling.report(df)), plain_groups(n)
    assert got == want and sum(v[0] is not None for v in want.values()) > 30
    assert spelling.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("symbols", [1, 2, 5, None])
def test_any_alphabet_gives_the_same_groups(spark, symbols):
    rng = random.Random(12)
    words = {"".join(rng.choice("abß漢") for _ in range(rng.randint(1, 5))) for _ in range(250)}
    n = {w: rng.choice((1, 2, 4, 16, 64, 256)) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert told(spelling.group(df, 2, symbols)) == plain_groups(n, 2)


def test_roots_take_as_many_rounds_as_a_chain_needs(spark):
    chain = ["aaaaaaa" + "b" * i for i in range(8)]
    n = {w: 5 * 5**i for i, w in enumerate(chain)}
    got = told(spelling.group(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert all(v[1] == chain[-1] for v in got.values()) and got == plain_groups(n)
    with pytest.raises(ValueError):
        spelling.group(spark.createDataFrame([], "word string, n long"), 1)


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """Spark sizes exploded neighbourhoods like the words they came from, and would send them through the driver."""
    plans, keep = [], spelling.keep

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(spelling, "keep", kept)
    n = {"aaaaaaa" + "b" * i: 5 * 5**i for i in range(8)}
    df = spelling.group(spark.createDataFrame(list(n.items()), "word string, n long"))
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) == 5 and not any("Broadcast" in p for p in plans)
    assert told(df) == plain_groups(n)
