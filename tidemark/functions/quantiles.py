"""Exact quantiles in two scans, without bringing a column into one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here a mergeable sketch
(``approx_percentile``, whose rank error is bounded whatever the distribution) gives two values that bracket each
quantile in one scan. A second scan counts what lies below each bracket and stores the values inside, equal ones
as one row with their number: some ``2 * MARGIN / ACCURACY`` of the rows at most, and a value that repeats is one row. The ranks
are then found on that small table, by counting bins between its smallest and largest candidate until
few enough values are left.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stored import stored

ACCURACY = 10_000
#: Brackets reach as many times the sketch's error to both sides.
MARGIN = 2
BINS = 1024
_REGIONS = 1 << 20


def exact_quantiles(df: DataFrame, columns: list[str],
                    probs: list[float]) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles per column; None for a column without numbers.

    NaN, infinities and nulls do not count as values.
    """
    if not columns:
        return {}
    wide = df.select(*(_finite(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)))
    reach = MARGIN / ACCURACY
    asked = [x for p in probs for x in (max(p - reach, 0.0), min(p + reach, 1.0))]
    sketch = wide.agg(*(x for i in range(len(columns)) for x in (
        F.count(f"c{i}").alias(f"n{i}"), F.min(f"c{i}").alias(f"lo{i}"), F.max(f"c{i}").alias(f"hi{i}"),
        F.percentile_approx(f"c{i}", asked, ACCURACY).alias(f"q{i}")))).first()

    wanted: dict[int, list[tuple[int, int, float]]] = {}
    brackets: dict[tuple[int, float, float], list[tuple[int, int]]] = defaultdict(list)
    for i in range(len(columns)):
        n, low, high = sketch[f"n{i}"], sketch[f"lo{i}"], sketch[f"hi{i}"]
        wanted[i] = []
        for k, p in enumerate(probs if n else []):
            place = p * (n - 1)
            ranks = math.floor(place), min(math.floor(place) + 1, n - 1)
            wanted[i].append((*ranks, place - ranks[0]))
            few = n <= ACCURACY  # then all values are fewer than a bracket's share of many
            a = low if few or asked[2 * k] <= reach else sketch[f"q{i}"][2 * k]
            b = high if few or asked[2 * k + 1] >= 1 - reach else sketch[f"q{i}"][2 * k + 1]
            brackets[i, a, b] += [(i, r) for r in ranks]
    found = _ranked(wide, brackets)
    missing = defaultdict(list)  # none, as the sketch's error is bounded
    for key in (key for keys in brackets.values() for key in keys if key not in found):
        missing[key[0], sketch[f"lo{key[0]}"], sketch[f"hi{key[0]}"]].append(key)
    found |= _ranked(wide, missing)
    return {
        c: ([found[i, a] + (found[i, b] - found[i, a]) * f for a, b, f in wanted[i]]
            if wanted[i] else None)
        for i, c in enumerate(columns)}


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def _ranked(wide: DataFrame, brackets: dict) -> dict[tuple[int, int], float]:
    """Values of ranks that lie in their bracket (column, low, high); others are left out."""
    if not brackets:
        return {}
    # Brackets of a column that overlap become one; regions 2j lie before the j-th, 2j + 1 are inside.
    inside: dict[int, list[tuple[float, float]]] = defaultdict(list)
    for i, low, high in sorted(brackets):
        own = inside[i]
        if own and low <= own[-1][1]:
            own[-1] = own[-1][0], max(high, own[-1][1])
        else:
            own.append((low, high))
    slots = []
    for i, own in inside.items():
        value, region = F.col(f"c{i}"), F.when(F.lit(False), 0)
        for j, (low, high) in enumerate(own):
            region = region.when(value < low, 2 * j).when(value <= high, 2 * j + 1)
        slots.append(F.when(value.isNotNull(), F.struct(
            F.lit(i).alias("i"), region.otherwise(2 * len(own)).alias("region"), value.alias("v"))))
    table = stored(wide.select(F.explode(F.filter(F.array(*slots), lambda s: s.isNotNull())).alias("s"))
                   .groupBy((F.col("s.i") * _REGIONS + F.col("s.region")).alias("r"),
                            F.when(F.col("s.region") % 2 == 1, F.col("s.v")).alias("v"))
                   .agg(F.count("*").alias("n")))
    sizes = {row["r"]: row for row in table.groupBy("r").agg(
        F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    found, open_ranks = {}, {}
    for (i, low, high), keys in brackets.items():
        j = next(j for j, (a, b) in enumerate(inside[i]) if a <= low <= b)
        r = i * _REGIONS + 2 * j + 1
        below = sum(row["n"] for k, row in sizes.items() if i * _REGIONS <= k < r)
        for key in keys:
            if r in sizes and below <= key[1] < below + sizes[r]["n"]:
                open_ranks[key] = (r, sizes[r]["lo"], sizes[r]["hi"], below)
    while open_ranks:
        for key, (_, low, high, _) in list(open_ranks.items()):
            if low == high:
                found[key] = low
                del open_ranks[key]
        if open_ranks:
            open_ranks = _narrow(table, open_ranks)
    return found


def _narrow(table: DataFrame, open_ranks: dict) -> dict:
    """One round on the stored values: the bin of each open rank, by its own smallest and largest value."""
    ranges = list(dict.fromkeys(open_ranks.values()))
    value, slots = F.col("v"), []
    for k, (r, low, high, _) in enumerate(ranges):
        # Halving first keeps the spread finite for any pair of doubles. Both ends have bins of
        # their own, so that every round parts them.
        share = (value / 2 - low / 2) / F.lit(high / 2 - low / 2)
        inner = F.least(F.greatest(F.floor(share * BINS).cast("int"), F.lit(0)), F.lit(BINS - 1))
        slot = F.when(value == low, -1).when(value == high, BINS).otherwise(inner)
        slots.append(F.when((F.col("r") == r) & (value >= low) & (value <= high),
                            F.struct(F.lit(k).alias("k"), slot.alias("bin"), "v", "n")))
    rows = (table.select(F.explode(F.filter(F.array(*slots), lambda s: s.isNotNull())).alias("s"))
                 .groupBy("s.k", "s.bin")
                 .agg(F.sum("s.n").alias("n"), F.min("s.v").alias("lo"), F.max("s.v").alias("hi"))
                 .orderBy("k", "bin").collect())
    bins = defaultdict(list)
    for row in rows:
        bins[row["k"]].append(row)
    narrowed = {}
    for key, of in open_ranks.items():
        start = of[3]
        for b in bins[ranges.index(of)]:
            if key[1] < start + b["n"]:
                narrowed[key] = (of[0], b["lo"], b["hi"], start)
                break
            start += b["n"]
    return narrowed
