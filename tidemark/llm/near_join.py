"""Similarity join of texts on word n-grams by chosen paths.

A text is the set of its five-word shingles (of all its words where there are fewer); two texts
are linked if the sets' Jaccard similarity is 0.8 or more. Texts with equal sets are
one set with copies. Each set is embedded as ``T`` min-hash values, its tokens. In a run, a bucket
(at first all sets) samples some positions, and every set goes on to the buckets of its tokens
there, so similar sets share a path with a probability that does not depend on how many others
there are. A bucket that few sets share is compared set by set; a larger one is split again, or taken
whole where its sets are alike on the whole. Runs are repeated (all at once) until a pair at
the threshold, split as often as was needed, is found with at least the target recall.

What the buckets find are candidates. They form clusters, connected components over edges, and
within a cluster all sets are compared exactly, by matrix products over their shingles. A
cluster is cut into blocks, and a task compares two blocks, so large groups of near copies
spread over tasks; blocks whose sizes rule out the similarity are skipped. Tasks
return counts and spanning edges, never pairs, so a group's output is as long as the group.

Texts move once, those in clusters; before that only min-hashes and ids do. Null and empty
texts have no shingles and no links: each is a class of its own. Repeated rows are copies.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm import words
from tidemark.llm.components import components
from tidemark.llm.shared import arrow, free_name, keep

SIZE = 5
LEAST = 0.8
T = 64
#: A bucket of so many sets (a quarter of a megabyte of tokens) is compared in one task.
SMALL = 1024
BLOCK = 128
RECALL = 0.999
#: Splits that the number of runs allows for; a deeper bucket adds runs.
DEPTH = 4
SEED = 11
#: Estimates from T tokens stray; this far below the threshold a pair is still a candidate.
SLACK = 0.2
#: Sets of a bucket this alike to one of them, on the average, are compared exactly.
ALIKE = 0.6

_rng = np.random.default_rng(SEED)
_A = _rng.integers(1, 2**63, (T, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, (T, 1), dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int = SIZE):
    """The sorted distinct shingle hashes of each text."""
    for block in words.blocks(texts, words.LOWER):
        hashes = block.hashes()
        for lo, hi in zip(block.first, block.first[1:]):
            yield np.unique(words.shingles(hashes[lo:hi], size))


def minhashes(own: np.ndarray) -> np.ndarray:
    """T min-hash values of a set, some thousand members at a time."""
    out = np.full(T, 2**32 - 1, np.uint64)
    for i in range(0, len(own), 4096):
        np.minimum(out, ((own[None, i:i + 4096] * _A + _B) >> np.uint64(32)).min(1), out=out)
    return out.astype(np.uint32)


@arrow("struct<key: string, n: bigint, sketch: binary>")
def _sketches(texts: pa.Array) -> pa.Array:
    keys, sizes, sketches = [], [], []
    for own in shingle_sets(texts):
        keys.append(xxhash.xxh3_128_hexdigest(own.tobytes()) if len(own) else None)
        sizes.append(len(own))
        sketches.append(minhashes(own).tobytes() if len(own) else None)
    return pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int64()),
                                       pa.array(sketches, pa.binary())], names=["key", "n", "sketch"])


def _survives(depth: int, rate: float, least: float) -> float:
    """Chance that a pair at the threshold still shares a bucket after so many splits."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-rate * least * q)
    return q


def runs_for(recall: float, depth: int = DEPTH, rate: float = 1 / LEAST, least: float = LEAST) -> int:
    """Runs that find a pair at the threshold with at least this recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - _survives(depth, rate, least)))


@lru_cache(4096)
def _chosen(bucket: int, seed: int) -> np.ndarray:
    """Positions that a bucket samples: each of T with probability 1 / (LEAST * T)."""
    rng = np.random.default_rng([seed, bucket & (2**63 - 1)])
    return np.flatnonzero(rng.random(T) < 1 / (LEAST * T))


def _next(bucket: int, sketches: np.ndarray, seed: int) -> np.ndarray:
    """The buckets that each row of sketches goes on to from a bucket."""
    at = _chosen(bucket, seed)
    key = np.uint64(bucket & (2**64 - 1))
    return words.as_long(words.mixed(words.mixed(
        sketches[:, at].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(32))) ^ key))


def _matrix(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint32).reshape(-1, T)


def _split(seed: int):
    @arrow("array<bigint>")
    def paths(buckets: pa.Array, sketches: pa.Array) -> pa.Array:
        rows = _matrix(sketches)
        return pa.array([_next(b, rows[i:i + 1], seed)[0].tolist() for i, b in enumerate(buckets.to_pylist())],
                        pa.list_(pa.int64()))
    return paths


def _first(runs: range, seed: int):
    @arrow("array<bigint>")
    def paths(sketches: pa.Array) -> pa.Array:
        rows = _matrix(sketches)
        found = np.concatenate([_next(run, rows, seed) for run in runs], axis=1)
        return pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(
            pa.list_(pa.int64())) if found.shape[1] else pa.array([[]] * len(rows), pa.list_(pa.int64()))
    return paths


def _spanning(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation the smallest row it is connected with."""
    root = np.arange(len(near))
    while True:
        low = np.minimum(root, np.where(near, root[None, :], len(near)).min(1))
        low = low[low]
        if (low == root).all():
            return root
        root = low


@arrow("array<struct<a: bigint, b: bigint>>")
def _compared(sids: pa.Array, sketches: pa.Array) -> pa.Array:
    """Spanning edges of the candidates among the sets of each small bucket."""
    out = []
    for ids, own in zip(sids.to_pylist(), sketches.to_pylist()):
        s = np.frombuffer(b"".join(own), np.uint32).reshape(len(ids), T)
        near = np.stack([np.count_nonzero(s == row, axis=1) >= (LEAST - SLACK) * T for row in s])
        root = _spanning(near)
        out.append([{"a": ids[i], "b": ids[r]} for i, r in enumerate(root.tolist()) if r != i])
    return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))


@arrow("double")
def _alike(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([float((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).mean())
                     for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def candidates(sketches: DataFrame, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """Edges (a, b) between ids of sketches (sid, sketch) whose components hold all candidates."""
    own, found, done, depth = sketches, [], 0, DEPTH
    while done < (runs := runs_for(recall, depth)):  # deeper splits lose more, which more runs make up for
        more, reached = _runs(own, range(done, runs), seed)
        found += more
        done, depth = runs, max(depth, reached)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _runs(own: DataFrame, runs: range, seed: int) -> tuple[list[DataFrame], int]:
    """Candidate edges that these runs find, and how often the largest bucket was split."""
    found, depth = [], 1
    level = own.select("sid", F.explode(_first(runs, seed)("sketch")).alias("bucket"))
    while True:
        level = keep(level)
        sizes = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        met = keep(level.join(sizes, "bucket"))
        # edges are not computed here but all together, by whoever reads them
        found.append(met.where(F.col("size") <= SMALL).join(own, "sid").groupBy("bucket")
                     .agg(F.collect_list(F.struct("sid", "sketch")).alias("s"))
                     .select(F.explode(_compared(F.col("s.sid"), F.col("s.sketch"))).alias("e")).select("e.*"))
        large = met.where(F.col("size") > SMALL)
        if large.isEmpty():
            return found, depth
        heads = (large.groupBy("bucket").agg(F.min_by("sid", F.xxhash64("bucket", "sid")).alias("head"))
                 .join(own.withColumnRenamed("sid", "head").withColumnRenamed("sketch", "pattern"), "head"))
        # a head is one row, so the large side of this join can be split
        like = keep(large.join(own, "sid").join(heads, "bucket").select(
            "bucket", "sid", "sketch", "head", _alike("sketch", "pattern").alias("alike")))
        judged = like.join(like.groupBy("bucket").agg(F.avg("alike").alias("mean")), "bucket")
        found.append(judged.where((F.col("mean") >= ALIKE) & (F.col("sid") != F.col("head")))
                     .select(F.col("sid").alias("a"), F.col("head").alias("b")))
        level = (judged.where(F.col("mean") < ALIKE)
                 .select("sid", F.explode(_split(seed + depth)("bucket", "sketch")).alias("bucket")))
        depth += 1


@arrow("binary")
def _sets(texts: pa.Array) -> pa.Array:
    return pa.array([own.tobytes() for own in shingle_sets(texts)], pa.binary())


def _linked(a: list[np.ndarray], b: list[np.ndarray], least: float) -> np.ndarray:
    """Which sets of a and b have at least the similarity, from exact intersections.

    Rows are cut into pieces of 16,384 shingles, so memory does not grow with the texts.
    """
    every = np.unique(np.concatenate([*a, *b]))
    both = np.zeros((len(a), len(b)))
    for i in range(0, len(every), 16_384):
        part = every[i:i + 16_384]
        sides = []
        for side in (a, b):
            m = np.zeros((len(side), len(part)), np.float32)
            for k, s in enumerate(side):
                own = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], "right")]
                m[k, np.searchsorted(part, own)] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    sizes = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
    return both >= least * (sizes - both) - 1e-9


def _exact(least: float):
    def linked(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        side = np.array(table.column("side"))
        ids = np.array(table.column("sid"))
        weight = np.array(table.column("copies"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("own")]
        alone = key[1].as_py() == key[2].as_py()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if alone else 1))
        hit = _linked([sets[i] for i in left], [sets[i] for i in right], least)
        if alone:
            np.fill_diagonal(hit, False)
        near = np.zeros((len(ids), len(ids)), bool)
        near[np.ix_(left, right)] = hit
        near |= near.T
        root = _spanning(near)
        return pa.table({"sid": ids, "root": ids[root], "n_sets": near.sum(1).astype(np.int64),
                         "n_docs": (near @ weight).astype(np.int64)})
    return linked


def placed(members: DataFrame) -> DataFrame:
    """Members (sid, cluster, n, ..) with a block of their cluster; blocks follow the set's size n.

    Only counts per size are ordered; within a size a hash deals members out to blocks.
    """
    sizes = members.groupBy("cluster", "n").agg(F.count(F.lit(1)).alias("same"))
    order = Window.partitionBy("cluster").orderBy("n")
    before = sizes.select("cluster", "n", "same", (F.sum("same").over(order) - F.col("same")).alias("before"))
    deal = F.pmod(F.xxhash64("sid"), F.ceil(F.col("same") / BLOCK))
    return (members.join(before, ["cluster", "n"])
            .withColumn("block", F.floor(F.col("before") / BLOCK) + deal).drop("same", "before"))


def verified(members: DataFrame, least: float = LEAST) -> DataFrame:
    """(sid, root, n_sets, n_docs) for each pair of blocks of each cluster.

    ``members``: sid, cluster, block, copies, n (size of the set) and own (the set).
    """
    spans = members.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = spans.alias("x"), spans.alias("y")
    pairs = keep(x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.block") <= F.col("y.block"))
                        & (F.col("x.high") >= least * F.col("y.low")))
                 .select(F.col("x.cluster").alias("cluster"), F.col("x.block").alias("i"), F.col("y.block").alias("j")))
    left = pairs.withColumn("side", F.lit(0)).withColumn("block", F.col("i"))
    right = pairs.where("i < j").withColumn("side", F.lit(1)).withColumn("block", F.col("j"))
    dealt = members.join(left.unionByName(right), ["cluster", "block"]).select(
        "cluster", "i", "j", "side", "sid", "copies", "own")
    kind = StructType([StructField(c, LongType()) for c in ("sid", "root", "n_sets", "n_docs")])
    return dealt.groupBy("cluster", "i", "j").applyInArrow(_exact(least), kind)


def _classes(rows: DataFrame, recall: float = RECALL, least: float = LEAST) -> DataFrame:
    """The join over a stored table of row (unique), key and text."""
    docs = keep(rows.select("key", "row", _sketches("text").alias("s")).select(
        "key", "row", F.col("s.key").alias("set"), "s.n", "s.sketch"))
    sets = keep(docs.where("set is not null").groupBy("set").agg(
        F.min("row").alias("sid"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"),
        F.min("sketch").alias("sketch"), F.min("key").alias("least")))
    clusters = components(candidates(keep(sets.select("sid", "sketch")), recall))
    chosen = keep(placed(sets.join(clusters, sets.sid == clusters.id).select(
        "sid", F.col("component").alias("cluster"), "copies", "n")))
    # both sides grow with the input, so this is a merge join at every size
    members = keep(rows.select(F.col("row").alias("sid"), "text").join(chosen.hint("merge"), "sid").select(
        "sid", "cluster", "block", "copies", "n", _sets("text").alias("own")))
    links = keep(verified(members, least))
    classes = components(links.where("sid != root").select(F.col("sid").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("sid").agg(F.sum("n_sets").alias("n_links"), F.sum("n_docs").alias("n_linked_docs"))
    labelled = keep(sets.select("set", "sid", "copies", "least").join(counted, "sid", "left")
                    .join(classes.withColumnRenamed("id", "sid"), "sid", "left")
                    .withColumn("component", F.coalesce("component", "sid")))
    low = labelled.groupBy("component").agg(F.min("least").alias("class_id"))
    of_set = labelled.join(low, "component").select("set", "class_id", "copies", "n_links", "n_linked_docs")
    return docs.select("key", "row", "set").join(of_set, "set", "left").select(
        "key", "row", F.coalesce("class_id", "key").alias("class_id"),
        *(F.coalesce(c, F.lit(d)).cast("long").alias(c) for c, d in (
            ("copies", 1), ("n_links", 0), ("n_linked_docs", 0))))


def join(documents: DataFrame, key: str = "doc_id", recall: float = RECALL, least: float = LEAST) -> DataFrame:
    """(key, class_id, copies, n_links, n_linked_docs) for each document.

    class_id: the smallest key among all documents that are connected by links or copies;
    copies: documents with the same set; n_links: other sets linked with the document's own;
    n_linked_docs: documents with one of these sets.
    """
    rows = keep(documents.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), "text"))
    return _classes(rows, recall, least).withColumnRenamed("key", key).drop("row")


def drop_near_copies(documents: DataFrame) -> DataFrame:
    """One document of each class, the first that is stored; columns stay as they are.

    Texts without shingles are kept.
    """
    own = free_name(documents, "__row")
    rows = keep(documents.withColumn(own, F.monotonically_increasing_id()))
    classes = _classes(rows.select(F.col(own).alias("row"), F.col(own).alias("key"), "text"))
    first = classes.where("key = class_id").select(F.col("key").alias(own))
    return rows.join(first, own, "left_semi").select(*(f"`{c}`" for c in documents.columns))


def report(documents: DataFrame) -> DataFrame:
    return join(documents.select("doc_id", "text"))
