import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import overlap, quantiles
from tidemark.functions.overlap import overlapping_pairs
from tidemark.functions.quantiles import exact_quantiles
from tidemark.functions.sampling import bottom_k, hash_key

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0] * 50, [1.0] * 30 + [1e12], [-1e308, 1e308, 0.0],
    [0.1 + i * 1e-17 for i in range(40)], [1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 0)] * 5,
    list(np.random.default_rng(3).lognormal(3, 2, 3000)),
])
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = exact_quantiles(df, ["x"], PROBS)["x"]
    want = [float(np.quantile(np.array(values), p)) for p in PROBS] if max(map(abs, values)) < 1e300 \
        else None
    if want:
        assert got == pytest.approx(want, rel=1e-12)
    assert got[0] == min(values) and got[-1] == max(values)


@pytest.mark.parametrize("name,draw", [
    ("heavy tail", lambda g: np.exp(g.pareto(0.3, 30_000).clip(0, 600))), ("ties", lambda g: g.integers(0, 3, 30_000).astype(float)),
    ("two far clusters", lambda g: np.where(g.random(30_000) < .5, g.random(30_000) * 1e-12, 1e12 + g.random(30_000)))])
def test_quantiles_scan_the_rows_twice_whatever_their_distribution(spark, monkeypatch, name, draw):
    values = draw(np.random.default_rng(5))
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            scans.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(quantiles, "ACCURACY", 500)
    df = spark.createDataFrame([(float(v),) for v in values], "x double").mapInArrow(counted, "x double")
    got = exact_quantiles(df, ["x"], PROBS)["x"]
    assert got == pytest.approx([float(np.quantile(values, p)) for p in PROBS], rel=1e-12)
    assert scans.value == 2 * len(values)


def test_quantiles_of_several_columns_skip_non_numbers(spark):
    df = spark.createDataFrame([(1.0, float("nan"), None), (2.0, float("inf"), None), (3.0, 7.0, None)],
                               "a double, b double, c double")
    assert exact_quantiles(df, ["a", "b", "c"], [0.5]) == {"a": [2.0], "b": [7.0], "c": None}


@pytest.mark.parametrize("k", [0, 1, 50, 499, 500, 900])
def test_bottom_k_is_exact(spark, k):
    df = spark.range(500).withColumn("key", hash_key(42, [F.col("id").cast("string")]))
    want = sorted(r.key for r in df.collect())[:k]
    assert sorted(r.key for r in bottom_k(df, "key", k).collect()) == want


def random_sets(seed, hot):
    rng = random.Random(seed)
    sets = {}
    for i in range(40):
        tokens = {f"t{rng.randrange(12)}" for _ in range(rng.randrange(1, 6))}
        if rng.random() < hot:
            tokens |= {"HOT", "HOT2"} if rng.random() < .5 else {"HOT"}
        sets[f"s{i:02d}"] = tokens
    return sets


@pytest.mark.parametrize("block", [3, 2_000])
@pytest.mark.parametrize("c", [2, 3])
def test_overlap_equals_brute_force(spark, monkeypatch, c, block):
    monkeypatch.setattr(overlap, "BLOCK", block)
    sets = random_sets(c, .8)
    df = spark.createDataFrame([(s, t) for s, ts in sets.items() for t in ts],
                               "set_id string, token string")
    want = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2)
            if len(sets[a] & sets[b]) >= c}
    got = {(r.a, r.b): r.shared for r in overlapping_pairs(df, None, c).collect()}
    assert got == want

    other = random_sets(c + 7, .7)
    df2 = spark.createDataFrame([(s, t) for s, ts in other.items() for t in ts],
                                "set_id string, token string")
    want = {(a, b): len(sets[a] & other[b]) for a in sets for b in other
            if a != b and len(sets[a] & other[b]) >= c}
    got = {(r.a, r.b): r.shared for r in overlapping_pairs(df, df2, c).collect()}
    assert got == want


@pytest.mark.parametrize("block", [3, 2_000])
@pytest.mark.parametrize("k", [1, 7, 40, 5_000])
def test_widest_overlaps_equal_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(overlap, "BLOCK", block)
    monkeypatch.setattr(overlap, "_FINE", 4)
    rng = random.Random(k)
    sides = []
    for _ in range(2):
        sides.append({f"s{i:02d}": {f"t{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(1, 30))}
                      for i in range(30)})
    sides[0]["s00"] = sides[1]["s07"] = {f"t{i}" for i in range(30)}
    one, two = (spark.createDataFrame([(s, t) for s, ts in x.items() for t in ts], "set_id string, token string")
                for x in sides)

    def widest(pairs, least):
        rows = [(a, b, len(x & y)) for (a, x), (b, y) in pairs if a != b and len(x & y) >= least]
        return sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[:k]

    for least in (1, 9):
        got = [tuple(r) for r in overlap.top_overlaps(one, None, k, least).collect()]
        assert got == widest(combinations(sorted(sides[0].items()), 2), least)
        got = [tuple(r) for r in overlap.top_overlaps(one, two, k, least).collect()]
        assert got == widest([(a, b) for a in sides[0].items() for b in sides[1].items()], least)
    if k == 1:
        found, bound = overlap.candidates(one, None, k)
        assert found.count() < 30 * 29 / 20 and found.agg(F.min("shared")).first()[0] >= bound > 1


def test_overlap_totals_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", 7)
    sets, other = random_sets(5, .8), random_sets(6, .8)
    one, two = (spark.createDataFrame([(s, t) for s, ts in x.items() for t in ts], "set_id string, token string") for x in (sets, other))
    want = {}
    for a, b in combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        for s in (a, b) if n >= 2 else ():
            pairs, _, total, widest = want.get(s, (0, 0, 0, 0))
            want[s] = pairs + 1, 0, total + n, max(widest, n)
    assert {r[0]: tuple(r[1:]) for r in overlap.overlap_totals(one, None, 2).collect()} == want
    want = {}
    for a in sets:
        for b in other:
            n = len(sets[a] & other[b])
            for s, is_a in ((a, 1), (b, 0)) if a != b and n >= 2 else ():
                as_a, as_b, total, widest = want.get(s, (0, 0, 0, 0))
                want[s] = as_a + is_a, as_b + 1 - is_a, total + n, max(widest, n)
    assert {r[0]: tuple(r[1:]) for r in overlap.overlap_totals(one, two, 2).collect()} == want


def test_blocks_grow_before_there_are_more_of_them(spark, monkeypatch):
    """What is shuffled follows the number of blocks: 60 sets are not sent 12 times where larger blocks hold them."""
    import pyarrow as pa

    def one(group):
        yield pa.RecordBatch.from_arrays([pa.array([group.a.size])], names=["n"])

    sets = {f"s{i:02d}": {"HOT", "HOT2", f"t{i % 7}"} for i in range(60)}
    df = spark.createDataFrame([(s, t) for s, ts in sets.items() for t in ts], "set_id string, token string")
    want = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2)}
    for most, entries, blocks in ((30, 1_000, 4), (10, 1_000, 6), (30, 20, 9), (1, 1, 12)):
        for name, value in (("BLOCK", 5), ("FEW", 4), ("MOST", most), ("ENTRIES", entries)):
            monkeypatch.setattr(overlap, name, value)
        assert overlap._met(df, None, 2, one, "n long").count() <= blocks * (blocks + 1) // 2
        assert {(r.a, r.b): r.shared for r in overlapping_pairs(df, None, 2).collect()} == want
    assert [overlap._blocks(n, 0) for n in (0, 1, 5, 6)] == [1, 1, 1, 2]


@pytest.mark.parametrize("cells, dense", [(4_000_000, 512), (7, 2), (50, 0)])
def test_products_of_blocks_equal_the_plain_product(monkeypatch, cells, dense):
    import numpy as np
    from tidemark.functions import blocks
    monkeypatch.setattr(blocks, "CELLS", cells)
    monkeypatch.setattr(blocks, "DENSE", dense)
    rng = np.random.default_rng(3)
    full = [np.where(rng.random((n, 40)) < .3, rng.integers(1, 9, (n, 40)), 0).astype(float) for n in (23, 31)]
    full[0][:, :5], full[1][:, 5:8] = 0, 0
    sides = [blocks.Entries(len(x), *np.nonzero(x), x[np.nonzero(x)]) for x in full]
    got = np.concatenate([piece for _, piece in blocks.products(*sides, np.float64)])
    assert (got == full[0] @ full[1].T).all()
    none = blocks.Entries(2, np.zeros(0, int), np.zeros(0, int))
    assert not np.concatenate([piece for _, piece in blocks.products(sides[0], none)]).any()
