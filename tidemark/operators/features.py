"""Behavioural features of a transaction, from what its accounts did just before it."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from math import gcd
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rolling
from tidemark.functions.columns import clean, cross_border, number
from tidemark.policy import (FEATURE_FAMILIES, INTEGER_FEATURES, MODEL_FAMILIES,
                             PATTERN_FAMILIES, FeaturePolicy)
from tidemark.schema import require_columns

DERIVED = sorted({f for fs in FEATURE_FAMILIES.values() for f in fs})
_US = 1_000_000
_MEASURES = {"_n": "long", "_near": "long", "_sum": "double", "_credit": "double", "_open": "long"}


def canonical_input(df: DataFrame) -> DataFrame:
    """Rows ready for features: stale derived columns gone, accounts and amounts clean."""
    df = df.drop(*DERIVED)
    if "amount_paid" not in df.columns and "amount" in df.columns:
        df = df.withColumnRenamed("amount", "amount_paid")
    require_columns(df.columns, ["timestamp", "from_account", "to_account", "amount_paid"],
                    "feature engineering")
    kind = dict(df.dtypes)
    stamp = (F.col("timestamp") if kind["timestamp"].startswith("timestamp")
             else F.try_to_timestamp("timestamp"))
    return df.withColumns({
        "timestamp": stamp,
        "from_account": clean("from_account"),
        "to_account": clean("to_account"),
        "amount_paid": F.col("amount_paid").try_cast("double"),
    })


def selected_families(patterns: list[str] | None = None, *,
                      with_model_features: bool = False) -> list[str]:
    """Families a set of patterns needs, in declaration order; None means all."""
    wanted = set(FEATURE_FAMILIES) if patterns is None else {
        family for p in patterns for family in PATTERN_FAMILIES.get(p, ["behavioral_features"])}
    if with_model_features:
        wanted |= set(MODEL_FAMILIES)
    return [family for family in FEATURE_FAMILIES if family in wanted]


def add_families(df: DataFrame, families: Iterable[str], *, row_key: str | None = None,
                 policy: FeaturePolicy = FeaturePolicy()) -> DataFrame:
    families = list(dict.fromkeys(families))
    unknown = sorted(set(families) - set(FEATURE_FAMILIES))
    if unknown:
        raise ValueError(f"unknown feature families: {', '.join(unknown)}")
    return add_features(df, {f for family in families for f in FEATURE_FAMILIES[family]},
                        row_key=row_key, policy=policy)


def features_for(df: DataFrame, patterns: list[str] | None = None, *,
                 with_model_features: bool = False, row_key: str | None = None) -> DataFrame:
    return add_families(df, selected_families(patterns, with_model_features=with_model_features),
                        row_key=row_key)


def add_features(df: DataFrame, wanted: Iterable[str], *, row_key: str | None = None,
                 policy: FeaturePolicy = FeaturePolicy()) -> DataFrame:
    """Add the wanted feature columns.

    There is one plan at every size: per side of the transfer, points and blocks (``rolling``) that spread one
    busy account over many tasks, plain frames for the accounts of few rows, met by the rows in one join.
    ``row_key`` orders simultaneous rows of an account for ``amount_deviation``; without it
    a hash of the row does.
    """
    wanted = set(wanted)
    rows = canonical_input(df)
    if wanted - {"cross_border_flag"}:
        rows = _look_back(rows, wanted, row_key, policy)
    if "cross_border_flag" in wanted:
        rows = rows.withColumn("cross_border_flag", cross_border(rows))
    filled = {}
    for name in DERIVED:
        if name in wanted:
            if name in INTEGER_FEATURES:
                filled[name] = F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long"))
            else:
                filled[name] = number(rows, name)
    return rows.withColumns(filled) if filled else rows


def _row_order(df: DataFrame, row_key: str | None) -> Column:
    return F.col(row_key) if row_key else F.xxhash64(*[F.col(c) for c in df.columns])


def _look_back(rows: DataFrame, wanted: set[str], row_key: str | None,
               policy: FeaturePolicy) -> DataFrame:
    """Totals per side, met by the rows in one join per side."""
    result = rows
    for key, found in _sides(rows, wanted, policy).items():
        result = rolling.attach(result, key, "timestamp", found)
    if "amount_deviation" in wanted:
        result = _finish_deviation(result, _row_order(rows, row_key))
    return result


def _width(policy: FeaturePolicy) -> int:
    """The block that all spans are whole numbers of."""
    return gcd(policy.week_s, policy.hour_s, policy.inflow_s, policy.fan_s) * _US


def _busy(rows: DataFrame, policy: FeaturePolicy) -> DataFrame:
    """Accounts that are cut into blocks: at most two of every ``whole_rows`` rows, so a broadcast."""
    ends = rows.select(F.explode(F.array("from_account", "to_account")).alias("_busy"))
    counts = ends.groupBy("_busy").agg(F.count(F.lit(1)).alias("_rows"))
    share = counts.agg(F.sum("_rows")).scalar() * policy.whole_share
    return F.broadcast(counts.where((F.col("_rows") > policy.whole_rows) | (F.col("_rows") > share)).select("_busy"))


def _ends(rows: DataFrame, paying: bool, paid: bool) -> DataFrame:
    """A row for each of the ends of a transfer that a side's totals are taken from: account, partner, whether it pays."""
    def end(key: str, partner: str, pays: bool) -> Column:
        return F.struct(F.col(key).alias("_k"), rolling.instant("timestamp").alias("_t"), F.lit(pays).alias("_pays"),
                        F.col(partner).alias("_p"), F.col("amount_paid").alias("_amount"))

    sides = [end("from_account", "to_account", True)] if paying else []
    if paid:
        sides.append(end("to_account", "from_account", False))
    one = sides[0] if len(sides) == 1 else F.explode(F.array(*sides))
    return rows.select(one.alias("_e")).select("_e.*")


def _sides(rows: DataFrame, wanted: set[str], policy: FeaturePolicy) -> dict[str, DataFrame]:
    """Totals of the sides that features are wanted of, by account column."""
    if not wanted & (_SENDER | _RECEIVER):
        return {}
    busy = _busy(rows, policy)
    out = {}
    for key, partner, side in (("from_account", "to_account", _sender_side(wanted, policy)),
                               ("to_account", "from_account", _receiver_side(wanted, policy))):
        asks, measures, spans, sums, opened = side
        spans = {n: (m, span * _US) for n, (m, span) in spans.items() if n in wanted}
        opened = [n for n in opened if n in wanted]
        if not spans and not sums and not opened:
            continue
        used = sorted({m for m, _ in [*spans.values(), *sums.values()]})
        pays = key == "from_account"
        ends = _ends(rows, paying=pays, paid=not pays or "recent_inflow_24h" in wanted)
        marked = ["_k", "_t", asks.cast("int").alias("_ask"), *[measures[m].cast(_MEASURES[m]).alias(m) for m in used]]
        counted = ends.select(*marked, "_p").where(reduce(or_, [F.col(m) != 0 for m in used], F.col("_ask") > 0))
        few = counted.join(busy, F.col("_k") == F.col("_busy"), "left_anti")
        found = rolling.framed(few, spans, sums, {n: policy.fan_s * _US for n in opened})
        pts = counted.drop("_p").join(busy, F.col("_k") == F.col("_busy"), "left_semi")
        if opened:
            own = rows.join(busy, F.col(key) == F.col("_busy"), "left_semi")
            changes = rolling.sittings(own, key, partner, "timestamp", policy.fan_s * _US, _width(policy))
            pts = (pts.withColumn("_open", F.lit(0).cast("long"))
                      .unionByName(changes.select("_k", "_t", F.lit(0).alias("_ask"), F.col("n").alias("_open"),
                                                  *[F.lit(0).cast(_MEASURES[m]).alias(m) for m in used])))
            used, sums = [*used, "_open"], sums | {n: ("_open", False) for n in opened}
        pts = pts.groupBy("_k", "_t").agg(F.max("_ask").alias("_ask"), *[F.sum(m).alias(m) for m in used])
        out[key] = found.unionByName(rolling.totals(pts, spans, sums, _width(policy), "_ask"))
    return out


_SENDER = {"txn_count_7d", "rolling_sum_7d", "near_threshold_count", "velocity_1hr", "recent_inflow_24h",
           "fan_out_count", "amount_deviation"}
_RECEIVER = {"fan_in_sum_48h", "fan_in_count"}
_Side = tuple[Column, dict[str, Column], dict[str, tuple[str, int]], dict[str, tuple[str, bool]], list[str]]


def _sender_side(wanted: set[str], policy: FeaturePolicy) -> _Side:
    """Which ends ask, their measures, and the spans, sums and counts of partners."""
    pays, amount = F.col("_pays"), F.coalesce("_amount", F.lit(0.0))
    near = (F.col("_amount") >= policy.near_low) & (F.col("_amount") < policy.near_high)
    measures = {"_n": pays, "_sum": F.when(pays, amount).otherwise(0.0),
                "_near": F.when(pays & near, 1).otherwise(0),
                "_credit": F.when(~pays & (F.col("_t") != rolling.NO_TIME), amount).otherwise(0.0)}
    spans = {"txn_count_7d": ("_n", policy.week_s), "rolling_sum_7d": ("_sum", policy.week_s),
             "near_threshold_count": ("_near", policy.week_s), "velocity_1hr": ("_n", policy.hour_s),
             "recent_inflow_24h": ("_credit", policy.inflow_s)}
    sums = {"_prior_sum": ("_sum", True), "_prior_n": ("_n", True)} if "amount_deviation" in wanted else {}
    return pays, measures, spans, sums, ["fan_out_count"]


def _receiver_side(wanted: set[str], policy: FeaturePolicy) -> _Side:
    paid = ~F.col("_pays")
    measures = {"_sum": F.when(paid, F.coalesce("_amount", F.lit(0.0))).otherwise(0.0)}
    return paid, measures, {"fan_in_sum_48h": ("_sum", policy.fan_s)}, {}, ["fan_in_count"]


def _deviation(amount: Column, mean: Column) -> Column:
    ratio = F.try_divide(F.abs(amount - mean), F.abs(mean))
    value = F.when(F.isnan(ratio) | (ratio == float("inf")), F.lit(0.0)).otherwise(ratio)
    return F.coalesce(value, F.lit(0.0))


def _finish_deviation(df: DataFrame, order: Column) -> DataFrame:
    """Sums over strictly earlier instants are attached; add earlier rows of the same one."""
    same = (Window.partitionBy("from_account", rolling.instant("timestamp")).orderBy(order)
                  .rowsBetween(Window.unboundedPreceding, -1))
    amount = F.coalesce(F.col("amount_paid"), F.lit(0.0))
    df = df.withColumns({
        "_tie_sum": F.coalesce(F.sum(amount).over(same), F.lit(0.0)),
        "_tie_n": F.count(F.lit(1)).over(same),
    })
    mean = F.try_divide(F.coalesce("_prior_sum", F.lit(0.0)) + F.col("_tie_sum"),
                        F.coalesce("_prior_n", F.lit(0)) + F.col("_tie_n"))
    return (df.withColumn("amount_deviation", _deviation(amount, mean))
              .drop("_prior_sum", "_prior_n", "_tie_sum", "_tie_n"))
