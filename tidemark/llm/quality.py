"""Quality rules: an isolation forest over the statistics of text rules.

A document's text is reduced to rule statistics (shares of symbols, repeated words, repeated
lines, capitals and so on). Each statistic has a usual range, that of all but a ``tail`` of
the good labelled rows, and the forest is grown over how far rows lie outside of it: a row that
random splits set apart after few steps is unlike the rest. The threshold on the mean path
length comes from other labelled rows: of all thresholds that reject at most ``spare`` of the
good ones, the one that rejects the most.

The forest and threshold are fitted on at most ``sample`` labelled rows, those with the
smallest hash of their id; statistics and verdicts are computed for every document, in one
pass without a shuffle. Null and empty texts have no words and fail the base rules.
Documents without an id can't be labelled but are judged; without labels only the base rules count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.shared import arrow, free_name

SAMPLE = 20_000
TREES = 100
ROWS = 256
SPARE = 0.001
TAIL = 0.0005
SEED = 3
#: The symbols that the rules count.
SYMBOLS = "#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
          "n_letters", "n_distinct", "n_chars", "n_digits", "n_ends"]
FEATURES = ["symbols_per_word", "repeated_share", "dup_line_share", "upper_share", "word_length",
            "digit_share", "end_share", "distinct_deficit"]


def count(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for each text."""
    out = {k: np.zeros(len(texts), np.int64) for k in COUNTS}
    byte = {k: np.zeros(256, np.int32) for k in ("symbol", "upper", "letter", "digit", "end", "head")}
    byte["symbol"][[ord(c) for c in SYMBOLS]] = 1
    byte["upper"][ord("A"):ord("Z") + 1] = 1
    byte["letter"][ord("A"):ord("Z") + 1] = 1
    byte["letter"][ord("a"):ord("z") + 1] = 1
    byte["digit"][ord("0"):ord("9") + 1] = 1
    byte["end"][[ord(c) for c in ".!?"]] = 1
    byte["head"][:128] = 1
    byte["head"][192:] = 1
    i = 0
    for block in words.blocks(texts, words.PLAIN):
        raw = np.frombuffer(block.raw, np.uint8)
        hashes = block.hashes()
        stop = np.append(block.at[1:], len(raw))
        for t, (lo, hi) in enumerate(zip(block.first, block.first[1:])):
            part = np.bincount(raw[block.at[t]:stop[t]], minlength=256)
            n = int(hi - lo)
            out["n_words"][i] = n
            for key, col in (("symbol", "n_symbols"), ("upper", "n_upper"), ("letter", "n_letters"),
                             ("digit", "n_digits"), ("head", "n_chars")):
                out[col][i] = int(part @ byte[key])
            out["word_chars"][i] = out["n_chars"][i] - part[32]
            if n:
                own = hashes[lo:hi]
                out["n_distinct"][i] = len(np.unique(own))
                out["n_repeat_words"][i] = _repeated(own)
                out["n_ends"][i] = int(byte["end"][raw[block.end[lo:hi] - 1]].sum())
            lines = [x for x in (texts[i].as_py() or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
            out["n_lines"][i] = len(lines)
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
            i += 1
    return out


def _repeated(own: np.ndarray) -> int:
    """Words inside three-word windows that occur at least twice."""
    if len(own) < 4:
        return 0
    _, place, times = np.unique(words.shingles(own, 3), return_inverse=True, return_counts=True)
    twice = times[place] > 1
    inside = np.zeros(len(own), bool)
    for k in range(3):
        inside[k:k + len(twice)] |= twice
    return int(inside.sum())


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    n = np.maximum(c["n_words"], 1)
    return np.stack([
        np.log1p(c["n_symbols"] / n), c["n_repeat_words"] / n, c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
        c["n_upper"] / np.maximum(c["n_letters"], 1), np.log1p(c["word_chars"] / n),
        c["n_digits"] / np.maximum(c["word_chars"], 1), c["n_ends"] / n,
        np.log1p(n) - np.log1p(c["n_distinct"])], axis=1)


def _usual(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    m = np.maximum(n, 2).astype(float)
    return np.where(n > 1, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, 0.0)


def excess(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far beyond its usual range each statistic is, in widths of the range."""
    return (np.maximum(low - x, 0) + np.maximum(x - high, 0)) / np.maximum(high - low, 1e-9)


@dataclass
class Trees:
    """Nodes of all trees as arrays; a leaf points to itself and holds its path length."""

    feature: np.ndarray
    split: np.ndarray
    below: np.ndarray
    above: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    depth: int
    low: np.ndarray
    high: np.ndarray
    threshold: float = -1.0

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row: the shorter, the more anomalous."""
        x = excess(x, self.low, self.high)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] < self.split[at], self.below[at], self.above[at])
            total += self.length[at]
        return total / max(len(self.roots), 1)


def grow(x: np.ndarray, good: np.ndarray, trees: int = TREES, rows: int = ROWS, seed: int = SEED) -> Trees:
    """Isolation trees over random subsets of the rows of x, in the given order of rows."""
    usual = x[good] if good.any() else x
    span = np.quantile(usual, [TAIL, 1 - TAIL], axis=0)
    x = excess(x, *span)
    rng = np.random.default_rng(seed)
    limit = max(1, int(np.ceil(np.log2(max(2, min(rows, len(x)))))))
    feature, split, below, above, length, roots = [], [], [], [], [], []

    def node(own: np.ndarray, depth: int) -> int:
        i = len(feature)
        for column, value in ((feature, 0), (split, 0.0), (below, i), (above, i), (length, 0.0)):
            column.append(value)
        low, high = own.min(0), own.max(0)
        free = np.flatnonzero(high > low)
        if depth >= limit or not len(free):
            length[i] = depth + float(_usual(np.array(len(own))))
            return i
        f = int(rng.choice(free))
        s = float(rng.uniform(low[f], high[f]))
        s = s if s > low[f] else float(high[f])
        feature[i], split[i] = f, s
        under = own[:, f] < s
        below[i] = node(own[under], depth + 1)
        above[i] = node(own[~under], depth + 1)
        return i

    for _ in range(trees):
        roots.append(node(x[rng.choice(len(x), min(rows, len(x)), replace=False)], 0))
    return Trees(np.array(feature), np.array(split), np.array(below), np.array(above), np.array(length),
                 np.array(roots), limit, *span)


def calibrate(paths: np.ndarray, good: np.ndarray, spare: float = SPARE) -> float:
    """The largest threshold below which at most ``spare`` of the good rows lie."""
    if not good.any():
        return -1.0
    own = np.sort(paths[good])
    return float(own[int(spare * len(own))])


@arrow("array<bigint>")
def _counts(texts: pa.Array) -> pa.Array:
    found = count(texts)
    return pa.array(np.stack([found[k] for k in COUNTS], axis=1).tolist() if len(texts) else [],
                    pa.list_(pa.int64()))


def _base(n: Column, repeated: Column) -> Column:
    return (n < 50) | (100 * repeated > 50 * n)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Trees | None:
    """A forest and its threshold from at most ``sample`` labelled documents.

    Rows alternate, in the order of a hash of their id, between growing the trees and
    setting the threshold. A document labelled twice counts with its lower label.
    """
    known = (labels.where("doc_id is not null and quality in (0, 1)")
             .groupBy("doc_id").agg(F.min("quality").alias("quality"))
             .withColumn("order", F.xxhash64(F.lit(seed), "doc_id")).orderBy("order", "doc_id").limit(sample))
    rows = (documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``sample`` rows
            .select("order", "doc_id", "quality", _counts("text").alias("c"))
            .groupBy("doc_id", "order").agg(F.min("quality").alias("quality"), F.min("c").alias("c"))
            .orderBy("order", "doc_id").limit(sample).collect())
    if not rows:
        return None
    table = np.array([r["c"] for r in rows], np.int64)
    c = {k: table[:, i] for i, k in enumerate(COUNTS)}
    passed = ~((c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"]))
    x, good = features(c)[passed], np.array([r["quality"] == 1 for r in rows])[passed]
    if len(x) < 4:
        return None
    forest = grow(x[::2], good[::2], seed=seed)
    forest.threshold = calibrate(forest.paths(x[1::2]), good[1::2])
    return forest


def judge(documents: DataFrame, labels: DataFrame, column: str = "__quality", sample: int = SAMPLE) -> DataFrame:
    """Documents with a struct of their counts, mean path length and verdict."""
    forest = fit(documents, labels, sample)
    held = documents.sparkSession.sparkContext.broadcast(forest)  # trees x 2 x rows nodes at most

    def verdict(texts: pa.Array) -> pa.Array:
        c = count(texts)
        failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
        own = held.value
        paths = own.paths(features(c)) if own else np.zeros(len(texts))
        kept = ~failed & (paths >= (own.threshold if own else 0.0))
        return pa.StructArray.from_arrays([*(pa.array(c[k]) for k in COUNTS), pa.array(paths), pa.array(failed),
                                           pa.array(kept)], names=[*COUNTS, "path_length", "base_failed", "kept"])

    kind = ", ".join([*(f"{k}: bigint" for k in COUNTS), "path_length: double, base_failed: boolean, kept: boolean"])
    return documents.withColumn(column, F.arrow_udf(verdict, f"struct<{kind}>")("text"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Only the documents that the rules keep; columns stay as they are."""
    own = free_name(documents, "__quality")
    return judge(documents, labels, own).where(F.col(own)["kept"]).select(*(f"`{c}`" for c in documents.columns))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "path_length"]
    return judge(documents.select("doc_id", "text"), labels).select(
        "doc_id", *(F.col("__quality")[n].alias(n) for n in names))
