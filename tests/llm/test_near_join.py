"""The similarity join against all pairs, on planted and on given texts."""

import os
import random

import pytest

from tidemark.llm import near_join


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    """doc -> (class, copies, links to other sets, documents of these sets)."""
    sets = {i: shingles(t) for i, t in docs}
    by_set = {}
    for i, s in sets.items():
        if s:
            by_set.setdefault(s, []).append(i)
    keys = list(by_set)
    near = {s: [o for o in keys if o != s and min(len(o), len(s)) >= 0.8 * max(len(o), len(s))
                and len(o & s) >= 0.8 * len(o | s)] for s in keys}
    label = {}
    for s in keys:
        if s not in label:
            todo, found = [s], {s}
            while todo:
                for o in near[todo.pop()]:
                    if o not in found:
                        found.add(o)
                        todo.append(o)
            least = min(i for o in found for i in by_set[o])
            label |= {o: least for o in found}
    return {i: (label[s], len(by_set[s]), len(near[s]), sum(len(by_set[o]) for o in near[s])) if s else (i, 1, 0, 0)
            for i, s in sets.items()}


def joined(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = near_join.report(df).collect()
    assert len(rows) == len(docs)
    return {r.doc_id: (r.class_id, r.copies, r.n_links, r.n_linked_docs) for r in rows}


@pytest.mark.parametrize("small", [near_join.SMALL, 40])  # with 40, buckets are split over several levels
def test_planted_groups(spark, monkeypatch, small):
    monkeypatch.setattr(near_join, "SMALL", small)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 200))) for _ in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(20, 90))) for _ in range(150)]
    base = [rng.choice(words) for _ in range(150)]
    for _ in range(200):  # one large group of near copies
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    texts += [texts[0]] * 30 + [texts[1].upper(), "a b", "A  b\n", "a b c", "", None, " \n", "x"]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    assert joined(spark, docs) == brute(docs)


def test_given_documents(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are not here")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(path).select("doc_id", "text").collect()]
    assert joined(spark, docs) == brute(docs)


def test_no_rows_and_repeated_ids(spark):
    assert joined(spark, []) == {}
    text = "one two three four five six"
    df = spark.createDataFrame([(None, text), (None, text), (7, text), (7, text)], "doc_id long, text string")
    rows = near_join.report(df).collect()
    assert sorted((r.doc_id or 0, r.class_id, r.copies) for r in rows) == [(0, 7, 4), (0, 7, 4), (7, 7, 4), (7, 7, 4)]


def test_one_of_each_class_stays(spark):
    a, b = "a b c d e f g h i j k l m n o p", "q r s t u v w"
    df = spark.createDataFrame([(1, a, 5), (2, a, 6), (3, b, 7), (4, None, 8), (5, "", 9)],
                               "doc_id long, text string, key long")
    out = near_join.drop_near_copies(df)
    assert out.columns == df.columns
    rows = sorted(r.doc_id for r in out.collect())
    assert rows in ([1, 3, 4, 5], [2, 3, 4, 5])
