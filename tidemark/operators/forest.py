"""Isolation forest: trees grown in parallel tasks, scores in vectorised batches."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import number
from tidemark.functions.quantiles import exact_quantiles
from tidemark.functions.sampling import bottom_k, hash_key
from tidemark.functions.stored import stored
from tidemark.policy import MODEL_FEATURES

NODE_SCHEMA = ("tree int, node int, feature int, split double, low int, high int, "
               "path double")


def feature_matrix(df: DataFrame, features: list[str] = MODEL_FEATURES) -> DataFrame:
    """The model features as clean doubles (absent, NaN and infinite count as zero)."""
    cleaned = {}
    for f in features:
        value = number(df, f)
        cleaned[f] = F.when(F.abs(value) == float("inf"), F.lit(0.0)).otherwise(value)
    return df.withColumns(cleaned)


def normal_baseline(knowledge: DataFrame) -> DataFrame:
    """Unlabelled calibration rows, shaped for feature engineering."""
    rows = knowledge.where(F.col("is_laundering") == 0)
    if "amount_paid" not in rows.columns:
        rows = rows.withColumnRenamed("amount", "amount_paid")
    return rows.drop("is_laundering", "laundering_type")


def _mean_depth(n: np.ndarray | float) -> np.ndarray:
    """Average path of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    deep = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * deep - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def train_nodes(baseline: DataFrame, *, trees: int = 200, sample: int = 256, seed: int = 42,
                features: list[str] = MODEL_FEATURES, row_key: str | None = None) -> DataFrame:
    """Nodes of all trees (``NODE_SCHEMA``).

    The rows with the smallest hashes, at most trees x sample of them, are dealt out so
    that every tree grows on its own sample; a baseline too small for that is dealt again
    under another hash. The shuffle carries those few rows only. ``row_key`` should be
    unique: without it equal rows share a hash and are drawn together.
    """
    key = F.col(row_key) if row_key else F.xxhash64(*baseline.columns)
    x = feature_matrix(baseline.withColumn("_id", key), features).select("_id", *features)
    total = x.count()
    if total < 2:
        raise ValueError("the forest needs at least two rows")
    size = min(sample, total)
    keyed = x.withColumn("_h", hash_key(seed, [F.col("_id").cast("string")]))
    pool = bottom_k(keyed, "_h", min(total, trees * size))
    per_deal = min(total, trees * size) // size
    deals = -(-trees // per_deal)
    dealt = pool.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    order = Window.partitionBy("_deal").orderBy(F.xxhash64("_deal", "_h"), "_h")
    placed = (dealt.withColumn("_place", F.floor((F.row_number().over(order) - 1) / size))
                   .where(F.col("_place") < per_deal)
                   .withColumn("tree", (F.col("_deal") * per_deal + F.col("_place")).cast("int"))
                   .where(F.col("tree") < trees))
    limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        return _grow_tree(tree, rows[features].to_numpy(), limit,
                          np.random.default_rng([seed, tree]))

    return placed.select("tree", *features).groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def _grow_tree(tree: int, x: np.ndarray, limit: int, rng: np.random.Generator) -> pd.DataFrame:
    nodes = []
    waiting = [(np.arange(len(x)), 0)]
    while len(nodes) < len(waiting):
        rows, depth = waiting[len(nodes)]
        part = x[rows]
        spread = np.ptp(part, axis=0) if len(rows) else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(usable) == 0:
            nodes.append((tree, len(nodes), -1, 0.0, -1, -1,
                          depth + float(_mean_depth(len(rows)))))
            continue
        f = int(rng.choice(usable))
        at = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        below = part[:, f] <= at
        nodes.append((tree, len(nodes), f, at, len(waiting), len(waiting) + 1, 0.0))
        waiting += [(rows[below], depth + 1), (rows[~below], depth + 1)]
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "low", "high", "path"])


@dataclass(frozen=True)
class Forest:
    """Fitted trees (at most trees x 2 x sample nodes) and the training score range."""

    features: tuple[str, ...]
    feature: np.ndarray
    split: np.ndarray
    low: np.ndarray
    high: np.ndarray
    path: np.ndarray
    depth_norm: float
    raw_min: float = 0.0
    raw_max: float = 0.0
    outlier_from: float = 1.0


def fit_forest(baseline: DataFrame, *, trees: int = 200, sample: int = 256, seed: int = 42,
               contamination: float = 0.001,
               features: list[str] = MODEL_FEATURES, row_key: str | None = None) -> Forest:
    """Grow the trees, then take score range and outlier limit from the whole baseline."""
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination must be in (0, 0.5]")
    size = min(sample, baseline.count())
    nodes = train_nodes(baseline, trees=trees, sample=sample, seed=seed,
                        features=features, row_key=row_key).toPandas()
    width = int(nodes["node"].max()) + 1

    def table(name: str, fill, kind) -> np.ndarray:
        out = np.full((trees, width), fill, dtype=kind)
        out[nodes["tree"], nodes["node"]] = nodes[name]
        return out

    forest = Forest(tuple(features), table("feature", -1, np.int32), table("split", 0, float),
                    table("low", 0, np.int32), table("high", 0, np.int32),
                    table("path", 0, float), float(_mean_depth(size)))
    scored = stored(raw_scores(baseline, forest).select("_raw"))  # the quantiles scan it twice
    low, limit, high = exact_quantiles(scored, ["_raw"], [0.0, 1 - contamination, 1.0])["_raw"]
    return Forest(**{**forest.__dict__, "raw_min": low, "raw_max": high, "outlier_from": limit})


def raw_scores(df: DataFrame, forest: Forest) -> DataFrame:
    """Add ``_raw``: 2 ** -(mean path / expected path), near 1 for isolated rows."""
    held = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def raw(*columns: pd.Series) -> pd.Series:
        f = held.value
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for t in range(len(f.feature)):
            node = np.zeros(len(x), dtype=np.int32)
            moving = rows if f.feature[t, 0] >= 0 else rows[:0]
            while len(moving):
                at = node[moving]
                left = x[moving, f.feature[t, at]] <= f.split[t, at]
                node[moving] = np.where(left, f.low[t, at], f.high[t, at])
                moving = moving[f.feature[t, node[moving]] >= 0]
            total += f.path[t, node]
        return pd.Series(2.0 ** -(total / len(f.feature) / max(f.depth_norm, 1e-12)))

    names = list(forest.features)
    clean = feature_matrix(df.withColumns({f"_m_{c}": number(df, c) for c in names}),
                           [f"_m_{c}" for c in names])
    return (clean.withColumn("_raw", raw(*[F.col(f"_m_{c}") for c in names]))
                 .drop(*[f"_m_{c}" for c in names]))


def score_forest(df: DataFrame, forest: Forest) -> DataFrame:
    """Add ``iso_score`` and ``ml_score`` in 0..1 and ``anomaly_label``."""
    span = forest.raw_max - forest.raw_min
    scaled = (F.col("_raw") - forest.raw_min) / F.lit(span) if span > sys.float_info.epsilon else F.lit(0.0)
    return (raw_scores(df, forest)
            .withColumn("ml_score", F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0)))
            .withColumn("iso_score", F.col("ml_score"))
            .withColumn("anomaly_label", (F.col("_raw") > forest.outlier_from).cast("int"))
            .drop("_raw"))
