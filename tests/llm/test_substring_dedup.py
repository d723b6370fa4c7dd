"""Removal of repeated passages against the definition: every window, every earlier place."""

import hashlib
import random
import re

import pytest

from tidemark.llm import substring_dedup as sd

ODD = [None, "", " \n\t\x0b", "x", "é ü x", "a" * 200_000, "word " * 400]


def plain(rows, window):
    """(doc_id, n_words, n_removed, sha256, stretches) by the definition."""
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    rank = lambda d: 2**63 - 1 if d is None else d
    first = {}
    for d, w in texts:
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            first[key] = min(first.get(key, (2**64, 0)), (rank(d), s))
    out = []
    for d, w in texts:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (rank(d), s):
                gone.update(range(s, s + window))
        rest = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(rest.encode()).hexdigest(), rest, sorted(gone)))
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def told(df):
    return sorted(map(str, ((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())))


@pytest.mark.parametrize("window,batch,part", [(20, 1_500_000, 64 << 20), (5, 60, 300), (4, 1, 100), (2, 500, 2000)])
def test_against_the_definition(spark, monkeypatch, window, batch, part):
    monkeypatch.setattr(sd, "BATCH_WORDS", batch)
    monkeypatch.setattr(sd, "_SMALL_PART_BYTES", part)
    rng = random.Random(window)
    vocabulary = [f"w{i}" for i in range(3 * window)] + ["é", "Zoo", "zoo"]
    word = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [word(rng.randint(window - 1, 4 * window)) for _ in range(6)]
    rows = []
    for d in range(60):
        text = word(rng.randint(0, 2 * window))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(passages) + word(rng.randint(0, window))
        rows.append((d * 7 - 50, rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(-400, rows[5][1]), (None, rows[6][1]), (None, rows[7][1])]
    rows += [(rows[8][0], rows[8][1]), (rows[9][0], rows[10][1]), (2000, "same " * 100), (2001, "same " * 90)]
    rows += [(3000 + i, t) for i, t in enumerate(ODD)]
    want = plain(rows, window)
    assert told(sd.report(frame(spark, rows), window, 1 << 20)) == sorted(map(str, (w[:4] for w in want)))
    stretches = {}
    for r in sd.repeats(frame(spark, rows), window).collect():
        stretches.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
    gone = {}
    for w in want:
        if w[5]:
            gone.setdefault(w[0], set()).update(w[5])
    assert stretches == gone


def test_other_columns_empty_tables_and_untouched_texts(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"a  b {passage}", "x", 5, 1), (2, f"{passage}\nc", "y", 9, 2), (3, "as  it\nis", "z", 7, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n_chars long, row int")
    out = sd.remove(df.withColumn("late", df.row), 20)
    assert out.columns == [*df.columns, "late"]
    got = {r.doc_id: (r.text, r.key, r.n_chars, r.row) for r in out.collect()}
    assert got == {1: (rows[0][1], "x", len(rows[0][1]), 1), 2: ("c", "y", 1, 2), 3: ("as  it\nis", "z", 9, 3)}
    assert sd.remove(df.limit(0)).count() == sd.report(df.limit(0)).count() == sd.repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sd.report(df, 1)
