"""Sliding and running totals per key that stay exact and spread a hot key.

A plain ``RANGE BETWEEN ...`` window puts one key into one task and re-adds its whole
frame for every row. Here rows are first folded to one *point* per (key, instant), with
partial aggregation before the shuffle, and time is cut into blocks. A total at an
instant is then

    blocks wholly inside the span  (a window over block totals, few rows per key)
  + points of its own block up to the instant
  + points of the oldest, partly covered block from the start of the span on

so the work of a key is spread over (key, block) partitions, every running frame grows by
one row at a time, and nothing is ever subtracted: sums carry no cancellation error.
All totals of a key use the same blocks, so any number of them is one pass over the points.

That costs several rows per point. For keys known to have few rows ``framed`` reads plain frames instead: one
exchange and one order for all totals, nothing to split, and frames no longer than the few rows of the key.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stands for "no timestamp"; sorts after every real instant.
NO_TIME = 9_223_372_036_854_775_807
# Sorts ahead of every real instant.
_AHEAD = -NO_TIME


def instant(ts: str) -> Column:
    """Microseconds of a timestamp column, ``NO_TIME`` for null."""
    return F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(NO_TIME))


def _block(t: Column, width: int) -> Column:
    """Number of the block of an instant; rows without one are a block of their own."""
    return F.when(t == NO_TIME, F.lit(NO_TIME)).otherwise(F.floor((t - F.pmod(t, F.lit(width))) / width))


def totals(pts: DataFrame, spans: dict[str, tuple[str, int]], sums: dict[str, tuple[str, bool]],
           width: int, asked: str) -> DataFrame:
    """Totals for each point (one row per ``_k, _t``) with ``asked`` > 0.

    ``spans``: name -> (measure, span), the total over the closed span [t - span, t], a whole
    number of blocks. ``sums``: name -> (measure, before), the total over all instants up to t,
    or the strictly earlier ones. Points without an instant are peers of each other
    only in spans, and come last in sums.
    """
    if any(span % width for _, span in spans.values()):
        raise ValueError("a span must be a whole number of blocks")
    kinds = dict(pts.dtypes)
    measure = {name: m for name, (m, _) in {**spans, **sums}.items()}
    t = F.col("_t")

    def zero(name: str) -> Column:
        return F.lit(0).cast(kinds[measure[name]])

    blocks = Window.partitionBy("_k").orderBy("_b")
    ahead = {name: F.sum(m).over(blocks.rangeBetween(1 - span // width, -1)) if span > width else zero(name)
             for name, (m, span) in spans.items()}
    ahead |= {name: F.sum(m).over(blocks.rowsBetween(Window.unboundedPreceding, -1))
              for name, (m, _) in sums.items()}
    # Reads ``asked`` as the rows below do, so that Spark sees one exchange of points and not two.
    earlier = (pts.where(F.col(asked) >= 0).groupBy("_k", _block(t, width).alias("_b"))
                  .agg(*[F.sum(m).alias(m) for m in sorted(set(measure.values()))])
                  .select("_k", F.lit(_AHEAD).alias("_t"), "_b", F.lit(False).alias("_own"),
                          *[F.coalesce(ahead[n], zero(n)).alias(n) for n in measure],
                          *[zero(n).alias(f"_tail_{n}") for n in spans]))

    def leg(at: Column, own: Column, leaving: int | None) -> Column:
        return F.struct(
            at.alias("_t"), _block(at, width).alias("_b"), own.alias("_own"),
            *[(F.col(m) if leaving is None else zero(n)).alias(n) for n, m in measure.items()],
            *[(F.col(m) if span == leaving else zero(n)).alias(f"_tail_{n}")
              for n, (m, span) in spans.items()])

    legs = [leg(t, F.col(asked) > 0, None)]
    for span in sorted({span for _, span in spans.values()}):
        counts = reduce(or_, [F.col(m) != 0 for m, own in spans.values() if own == span])
        legs.append(F.when((t != NO_TIME) & counts,
                           leg(F.least(t, F.lit(NO_TIME - span)) + F.lit(span), F.lit(False), span)))
    both = (pts.select("_k", F.explode(F.array(*legs)).alias("_e")).where(F.col("_e").isNotNull())
               .select("_k", "_e.*").unionByName(earlier))
    part = Window.partitionBy("_k", "_b")
    up_to = part.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = part.orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    from_on = (part.orderBy(F.col("_t").desc())
                   .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = {n: F.sum(n).over(up_to) + F.sum(f"_tail_{n}").over(from_on) for n in spans}
    # what leaves a span at the same instant adds nothing to a running sum
    found |= {n: F.coalesce(F.sum(n).over(before), zero(n)) if strict else F.sum(n).over(up_to)
              for n, (_, strict) in sums.items()}
    return (both.select("_k", "_t", "_own", *[found[n].alias(n) for n in measure])
                .where("_own").drop("_own"))


def framed(legs: DataFrame, spans: dict[str, tuple[str, int]], sums: dict[str, tuple[str, bool]],
           partners: dict[str, int]) -> DataFrame:
    """The totals of ``totals``, from plain frames, for each instant of a row (``_k, _t, _ask, _p``) with ``_ask`` > 0.

    ``partners``: name -> span, the number of different ``_p`` in [t - span, t] at rows with ``_ask`` > 0. A frame is
    added up again for each row, so that only keys of few rows may come here.
    """
    kinds, key = dict(legs.dtypes), Window.partitionBy("_k").orderBy("_t")
    start = Window.unboundedPreceding
    found = {n: F.sum(m).over(key.rangeBetween(-span, 0)) for n, (m, span) in spans.items()}
    found |= {n: F.coalesce(F.sum(m).over(key.rangeBetween(start, -1 if strict else 0)), F.lit(0).cast(kinds[m]))
              for n, (m, strict) in sums.items()}
    asks = F.col("_ask") > 0
    seen = F.when(asks & (F.col("_t") != NO_TIME), F.col("_p"))
    found |= {n: F.size(F.collect_set(seen).over(key.rangeBetween(-span, 0))).cast("long")
              for n, span in partners.items()}
    asked = F.max(F.when(asks, F.col("_t"))).over(key.rowsBetween(start, -1))
    return (legs.select("_k", "_t", (asks & (asked.isNull() | (asked < F.col("_t")))).alias("_own"),
                        *[found[n].alias(n) for n in found])
                .where("_own").drop("_own"))


def sittings(df: DataFrame, key: str, partner: str, ts: str, span: int, width: int) -> DataFrame:
    """(_k, _t, n) whose running sum of n is the number of partners seen in [t - span, t].

    A partner counts from an event until one span after it. Events of one pair closer than
    a span merge into one sitting, so the distinct count is the number of open sittings: a
    running sum of +1 at each opening and -1 just past each closing. Inside a block events
    are always closer than a span, so a pair shrinks to its first and last instant per
    block before anything is ordered.
    """
    # Pairs in one order whichever end is the key: both ends of a transfer then share scan and exchange.
    ends = sorted([key, partner])
    rows = df.select(*(F.col(c).alias(f"_{c}") for c in ends), instant(ts).alias("_t"))
    ends = [f"_{c}" for c in ends]
    per_block = (rows.where(F.col("_t") != NO_TIME)
                     .groupBy(*ends, _block(F.col("_t"), width).alias("_b"))
                     .agg(F.min("_t").alias("_first"), F.max("_t").alias("_last")))
    pair = Window.partitionBy(*ends).orderBy("_b")
    edges = per_block.select(
        F.col(f"_{key}").alias("_k"), "_first", "_last",
        (F.col("_first") - F.lag("_last").over(pair)).alias("_gap_before"),
        (F.lead("_first").over(pair) - F.col("_last")).alias("_gap_after"))
    opens = F.when(F.col("_gap_before").isNull() | (F.col("_gap_before") > span),
                   F.struct(F.col("_first").alias("t"), F.lit(1).cast("long").alias("d")))
    closes = F.when(F.col("_gap_after").isNull() | (F.col("_gap_after") > span),
                    F.struct((F.col("_last") + F.lit(span + 1)).alias("t"),
                             F.lit(-1).cast("long").alias("d")))
    return (edges.select("_k", F.explode(F.array(opens, closes)).alias("_e")).where(F.col("_e").isNotNull())
                 .select("_k", F.col("_e.t").alias("_t"), F.col("_e.d").alias("n")))


def attach(df: DataFrame, key: str, ts: str, found: DataFrame) -> DataFrame:
    """Put per-(key, instant) values back on the rows."""
    named = found.withColumnRenamed("_k", "_fk").withColumnRenamed("_t", "_ft")
    rows = df.withColumn("_at", instant(ts))
    return (rows.join(named, (rows[key] == named["_fk"]) & (rows["_at"] == named["_ft"]), "left")
                .drop("_fk", "_ft", "_at"))
