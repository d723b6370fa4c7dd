"""The backoff model against a plain one, and that its probabilities sum to one."""

import math
import random
import zlib
from collections import Counter

import pytest

from tidemark.llm import katz


def tokens(text):
    return [w for w in (text or "").lower().split()] + ["</s>"]


def plain(docs):
    """Scores of (id, text) rows from dictionaries, following the definition."""
    def train(i):
        return i is None or zlib.crc32(str(i).encode()) % 7 != 2
    uni, pair, ctx = Counter(), Counter(), Counter()
    for i, text in docs:
        if train(i):
            before = "<s>"
            for t in tokens(text):
                uni[t] += 1
                pair[before, t] += 1
                ctx[before] += 1
                before = t

    def table(counts):
        seen = Counter(counts.values())
        return katz.discounts([seen[r] if r else 0 for r in range(katz.K + 2)])
    d1, d2 = table(uni), table(pair)
    less = lambda c, d: c - katz.TAIL if c > katz.K else c * d[c]
    n = sum(uni.values())
    kept = sum(less(c, d1) for c in uni.values())
    unseen = max(1 - kept / n, 1 / (n + 1))
    p1 = lambda w: (1 - unseen) * less(uni[w], d1) / kept if w in uni else unseen

    def alpha(h):
        own = [(w, c) for (a, w), c in pair.items() if a == h]
        return (1 - sum(less(c, d2) for _, c in own) / ctx[h]) / (1 - sum(p1(w) for w, _ in own))

    def p2(h, w):
        if (h, w) in pair:
            return less(pair[h, w], d2) / ctx[h]
        return (alpha(h) if h in ctx else 1.0) * p1(w)
    out = []
    for i, text in docs:
        own = tokens(text)
        out.append((i, not train(i), len(own), sum(t in uni for t in own), n,
                    sum(math.log10((uni[t] + 1) / (n + len(uni) + 1)) for t in own),
                    sum(math.log10(p2(h, w)) for h, w in zip(["<s>", *own], own))))
    for h in list(ctx)[:20]:
        assert sum(p2(h, w) for w in uni) + p2(h, "never seen") == pytest.approx(1)
    return out


@pytest.mark.parametrize("held", [50, 10**6])
def test_scores_equal_the_definition(spark, monkeypatch, held):
    monkeypatch.setattr(katz, "HELD", held)
    monkeypatch.setattr(katz, "HEAVY", 1 / 20)
    rng = random.Random(held)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["The", "the", "é", "x" * 300]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(80)]
    docs += [(3, docs[3][1]), (None, "the end"), (90, None), (91, ""), (9, "  \t\n"), (92, "the " * 500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r) for r in katz.report(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    want = plain(docs)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:])


def test_no_training_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.report(empty).collect() == []
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = katz.report(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, 0.0)
