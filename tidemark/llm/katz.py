"""Katz backoff language model over words, with its evaluation in the same partitions.

Counts of words and of pairs (context, word) are discounted by Good-Turing up to count
``K``; a larger count r keeps r - ``TAIL``, so that every context leaves some mass. A pair that was seen has its
discounted share of its context; else the word's own probability counts, times a backoff weight
that makes the context's probabilities sum to one exactly. Below that, words not seen in training share
the mass that the discounts of single words leave; a context never seen has weight 1. A
document starts in the context of its beginning, and its end is a token.

Words are 64-bit hashes. A token of a document is a posting (word, context, document), and
postings are partitioned by word: there the counts of words and pairs are complete,
so each posting is evaluated where its table is. Documents come back as a few sums that
are linear in what is known only later (the discounts of pairs, the weights of contexts).
Postings travel packed in columns, with dictionaries for words and contexts. Words with
more than ``HEAVY`` of all tokens are spread over partitions by their contexts; their counts
are known from the table of words, and there are at most 1 / HEAVY of them.

The tables of words and of contexts are stored in the shared folder by partition. A null or empty
text is just its end. Documents whose id is null are in training (their remainder is null, not 2).
Repeated rows count and are scored each on its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from tidemark.llm import words
from tidemark.llm.shared import keep

K = 5
TAIL = 0.5
HEAVY = 1 / 2000
PART_TOKENS = 6_000_000
SUBS = 8  # of a partition, evaluated one after another
HELD = 2_500_000  # tokens that a task packs at a time
BEGIN, END = np.uint64(1), np.uint64(2)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(7)) == 2, F.lit(False))


def discounts(n: list[int], k: int = K) -> list[float]:
    """Katz's discount of each count 0 to k (0 is unused) from the counts of counts n[0..k + 1].

    Where the counts of counts give no ratio in 0 to 1 the tail's discount stands in.
    """
    out = [1.0] * (k + 1)
    rest = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        d = (ratio - rest) / (1 - rest) if rest < 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - TAIL / r
    return out


def discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    """Discounted counts."""
    k = len(d) - 1
    c = counts.astype(float)
    return np.where(counts > k, c - TAIL, c * np.array(d)[np.minimum(counts, k)])


def _tokens(texts: pa.Array):
    """For each block of texts: (words and ends, contexts, lengths in tokens)."""
    for block in words.blocks(texts, words.LOWER):
        n = np.diff(block.first)
        stops = np.cumsum(n + 1) - 1
        own = np.empty(int(n.sum()) + len(n), np.uint64)
        inner = np.ones(len(own), bool)
        inner[stops] = False
        own[inner] = np.maximum(block.hashes(), np.uint64(3))
        own[stops] = END
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[np.append(0, stops[:-1] + 1)] = BEGIN
        yield own, before, n + 1


def _counted(batches):
    """(word, n) of a task's training tokens, in parts of a few million tokens."""
    held: list[np.ndarray] = []
    size = 0

    def flush():
        w, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.as_long(w)), pa.array(n)], names=["word", "n"])

    for batch in batches:
        for own, _, _ in _tokens(batch.column("text")):
            held.append(own)
            size += len(own)
            if size >= HELD:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def unigrams(training: DataFrame) -> DataFrame:
    """(word, n): the stored table of words, by partition of the word."""
    rows = training.select("text").mapInArrow(_counted, "word bigint, n bigint")
    return keep(rows.groupBy("word").agg(F.sum("n").alias("n")))


def _squeezed(values: np.ndarray) -> bytes:
    """Compressed, all low bytes before all high ones."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _opened(raw: bytes, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _coded(values: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Distinct values, the frequent ones first, and each value's place among them."""
    own, at, n = np.unique(values, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(own), _index(len(own)))
    place[order] = np.arange(len(own))
    return own[order], _squeezed(place[at])


def _index(n: int):
    return np.uint16 if n <= 65536 else np.uint32


_ARRAYS = ("w", "at_w", "h", "at_h", "doc", "n_of_doc", "train")
_PACKED = StructType([*(StructField(c, LongType()) for c in ("part", "n", "n_w", "n_h", "n_d")),
                      *(StructField(c, BinaryType()) for c in _ARRAYS)])


def _packer(parts: int, heavy: np.ndarray):
    """Postings of a task's documents, packed for each partition in the order of the documents."""
    def parted(w, h):
        at = words.mixed(w)
        if len(heavy):
            place = np.minimum(np.searchsorted(heavy, w), len(heavy) - 1)
            at = np.where(heavy[place] == w, words.mixed(w ^ words.mixed(h)), at)
        return (at % np.uint64(parts)).astype(np.int32)

    def pack(held):
        w, h, d, ids, train = map(np.concatenate, zip(*held))
        held.clear()
        part = parted(w, h)
        order = np.argsort(part, kind="stable").astype(np.int32)
        w, h, d, part = w[order], h[order], d[order], part[order]
        del order
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        out = []
        for lo, hi in zip(cuts, cuts[1:]):
            own_w, at_w = _coded(w[lo:hi])
            own_h, at_h = _coded(h[lo:hi])
            own_d, n_of_d = np.unique(d[lo:hi], return_counts=True)
            out.append({"part": int(part[lo]), "n": int(hi - lo), "n_w": len(own_w), "n_h": len(own_h), "n_d": len(own_d),
                        "w": own_w.tobytes(), "at_w": at_w, "h": own_h.tobytes(), "at_h": at_h,
                        "doc": _squeezed(ids[own_d]), "n_of_doc": _squeezed(n_of_d.astype(np.uint32)),
                        "train": np.packbits(train[own_d]).tobytes()})
        return pa.RecordBatch.from_pylist(out, schema=pa.schema(
            [*((c, pa.int64()) for c in ("part", "n", "n_w", "n_h", "n_d")), *((c, pa.binary()) for c in _ARRAYS)]))

    def packed(batches):
        held, size, docs = [], 0, 0
        for batch in batches:
            keys = np.array(batch.column("row"))
            fold = np.array(batch.column("train"))
            i = 0
            for own, before, n in _tokens(batch.column("text")):
                held.append((own, before, np.repeat(np.arange(docs, docs + len(n), dtype=np.int32), n), keys[i:i + len(n)], fold[i:i + len(n)]))
                i, docs, size = i + len(n), docs + len(n), size + len(own)
                if size >= HELD:
                    yield pack(held)
                    size, docs = 0, 0
        if held:
            yield pack(held)
    return packed


class Words:
    """What every partition knows: the unigram discounts, totals, and the heavy words' counts."""

    def __init__(self, total: int, distinct: int, n: list[int], heavy: np.ndarray, counts: np.ndarray, kept: float) -> None:
        self.total, self.distinct, self.heavy, self.counts = total, distinct, heavy, counts
        self.d = discounts(n)
        self.kept = kept  # of all discounted counts
        self.unseen = max(1 - kept / total, 1 / (total + 1)) if total else 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """Of words with these counts; a count of 0 is the class of all unseen words."""
        if not self.total:
            return np.ones(len(counts))
        return np.where(counts > 0, (1 - self.unseen) * discounted(counts, self.d) / self.kept, self.unseen)


#: Rows of three kinds, see _evaluator; key2 is the document of a miss.
_CLASSES = [f"c{r}" for r in range(1, K + 2)]
_INTS = [*_CLASSES, "tokens", "known"]
_FLOATS = ["x", "y", "z"]
_SUMS = StructType([StructField("kind", IntegerType()), StructField("key", LongType()), StructField("key2", LongType()),
                    *(StructField(c, IntegerType()) for c in _INTS), *(StructField(c, DoubleType()) for c in _FLOATS)])
_OUT = 1 << 16  # rows that a task returns at a time


def _evaluator(model):
    """Counts the pairs of one partition and evaluates its postings.

    Kind 0, a document: c1..c5 its seen pairs by their count, x the logs of larger discounted
    counts and of the own probabilities of unseen pairs' words, y the logs of the counts of its words
    other than ends, z the logs of all counts plus one. Kind 1, a context: c1..c6 its pairs by
    count, x the sum of its larger counts, y how many these are, z the sum of its words' own
    probabilities. Kind 2, a miss: an unseen pair of a document, by context.
    """
    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = model.value, []
        for batch in batches:
            for r in batch.to_pylist():
                w = np.frombuffer(r["w"], np.uint64)
                held.append((w, (words.mixed(w) >> np.uint64(40)) % np.uint64(SUBS),
                             _opened(r["at_w"], _index(r["n_w"]), r["n"]),
                             np.frombuffer(r["h"], np.uint64), _opened(r["at_h"], _index(r["n_h"]), r["n"]),
                             np.repeat(np.arange(r["n_d"], dtype=_index(r["n_d"])), _opened(r["n_of_doc"], np.uint32, r["n_d"])),
                             _opened(r["doc"], np.int64, r["n_d"]),
                             np.unpackbits(np.frombuffer(r["train"], np.uint8), count=r["n_d"]).astype(bool)))
        docs, ctxs = _Sums(), _Sums()
        for sub in range(SUBS):
            part = []
            for w, sub_of_w, at_w, h, at_h, at_d, ids, train in held:
                own = np.flatnonzero((sub_of_w == sub)[at_w])
                part.append((w[at_w[own]], h[at_h[own]], ids[at_d[own]], train[at_d[own]]))
            w, h, d, t = map(np.concatenate, zip(*part))
            del part
            if len(w):
                missed = _evaluated(known, w, h, d, t, docs, ctxs)
                yield from _batches(2, *missed)
        del held
        yield from _batches(0, docs.keys, None, docs)
        yield from _batches(1, ctxs.keys, None, ctxs)
    return evaluate


class _Sums:
    """Sums by key, added to in turn."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.int64)
        self.cols: dict[str, np.ndarray] = {c: np.zeros(0, np.int32) for c in _INTS} | {c: np.zeros(0) for c in _FLOATS}

    def add(self, keys: np.ndarray, cols: dict[str, np.ndarray]) -> None:
        """Keys are distinct."""
        every, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        for c, old in self.cols.items():
            new = np.zeros(len(every), old.dtype)
            new[at[:len(old)]] = old
            if c in cols:
                new[at[len(old):]] += cols[c].astype(old.dtype)
            self.cols[c] = new
        self.keys = every


def _batches(kind: int, keys: np.ndarray, keys2: np.ndarray | None, sums: _Sums | None = None) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), _OUT):
        key = keys[i:i + _OUT]
        cols = {"kind": np.full(len(key), kind, np.int32), "key": key,
                "key2": np.zeros(len(key), np.int64) if keys2 is None else keys2[i:i + _OUT]}
        for c in _INTS:
            cols[c] = sums.cols[c][i:i + _OUT] if sums else np.full(len(key), c == "tokens", np.int32)
        for c in _FLOATS:
            cols[c] = sums.cols[c][i:i + _OUT] if sums else np.zeros(len(key))
        yield pa.RecordBatch.from_pydict(cols)


def _evaluated(known, w, h, d, t, docs: _Sums, ctxs: _Sums) -> tuple[np.ndarray, np.ndarray]:
    """Adds to the sums of documents and contexts; returns the misses as contexts and documents."""
    order = np.lexsort((h, w))
    w, h, d, t = w[order], h[order], d[order], t[order]
    new_w = np.diff(w, prepend=w[0] ^ np.uint64(1)) != 0
    new_p = new_w | (np.diff(h, prepend=h[0]) != 0)
    at_w, at_p = np.flatnonzero(new_w), np.flatnonzero(new_p)
    c_w = np.add.reduceat(t, at_w, dtype=np.int64)
    if len(known.heavy):
        place = np.minimum(np.searchsorted(known.heavy, w[at_w]), len(known.heavy) - 1)
        c_w = np.where(known.heavy[place] == w[at_w], known.counts[place], c_w)
    c_p = np.add.reduceat(t, at_p, dtype=np.int64)
    own_w, own_p = np.cumsum(new_w) - 1, np.cumsum(new_p) - 1
    p_w = known.probability(c_w)
    counts, inner = c_p[own_p], w != END
    docs.add(*_per_document(d, counts, inner, own_w, {
        "large": np.log10(np.maximum(c_p - TAIL, 0.5))[own_p], "miss": np.log10(p_w), "length": np.log10(np.maximum(c_w, 1)),
        "base": np.log10(c_w + 1.0), "known": c_w > 0}))
    seen = c_p > 0
    ctxs.add(*_per_context(h[at_p][seen], c_p[seen], p_w[own_w[at_p]][seen]))
    missed = counts == 0
    return words.as_long(h[missed]), d[missed]


def _per_document(d, counts, inner, own_w, of) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    keys, at = np.unique(d, return_inverse=True)
    total = lambda values: np.bincount(at, values, len(keys))
    gain = np.where(counts > K, of["large"], np.where(counts == 0, of["miss"][own_w], 0.0))
    return keys, {"x": total(gain), "y": total(np.where(inner, of["length"][own_w], 0.0)), "z": total(of["base"][own_w]),
                  "tokens": np.bincount(at, minlength=len(keys)), "known": total(of["known"][own_w])} | {
        c: total(counts == r) for r, c in enumerate(_CLASSES, 1)}


def _per_context(h, c, p) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    keys, at = np.unique(words.as_long(h), return_inverse=True)
    total = lambda values: np.bincount(at, values, len(keys))
    return keys, {"x": total(np.where(c > K, c, 0)), "y": total(c > K), "z": total(p)} | {
        name: total(c == r) for r, name in enumerate(_CLASSES, 1)}


def score(documents: DataFrame, train: Column | None = None, key: str = "doc_id") -> DataFrame:
    """One row per document: its token counts, its base score and the model's log10 probability."""
    spark = documents.sparkSession
    train = ~held_out(key) if train is None else train
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), train.alias("train"), "text")
    ids = keep(rows.select("row", "id", "train"))
    table = unigrams(rows.where("train"))
    top = table.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"),
                    *(F.count(F.when(F.col("n") == r, 1)).alias(f"n{r}") for r in range(1, K + 2)),
                    F.sum(F.when(F.col("n") > K, F.col("n") - TAIL)).alias("large")).first()
    total = top["total"] or 0
    heavy = sorted((r["word"] & (2**64 - 1), r["n"]) for r in
                   table.where(F.col("n") >= max(2.0, total * HEAVY)).collect())  # at most 1 / HEAVY rows
    n = [0, *(top[f"n{r}"] for r in range(1, K + 2))]
    d = discounts(n)
    kept = sum(r * n[r] * d[r] for r in range(1, K + 1)) + float(top["large"] or 0)
    model = Words(total, top["distinct"], n, np.array([w for w, _ in heavy], np.uint64),
                  np.array([c for _, c in heavy], np.int64), kept)
    parts = max(4, -(-total // PART_TOKENS))
    packed = rows.select("row", "train", "text").mapInArrow(_packer(parts, model.heavy), _PACKED)
    held = spark.sparkContext.broadcast(model)  # a few numbers and at most 1 / HEAVY words
    sums = keep(packed.groupBy("part").applyInArrow(_evaluator(held), _SUMS))
    pairs = sums.where("kind = 1").agg(*(F.sum(c) for c in _CLASSES)).first()
    return _result(ids, sums, model, discounts([0, *(int(x or 0) for x in pairs)]))


def contexts(sums: DataFrame, d: list[float]) -> DataFrame:
    """(key, log_n, log_weight): the stored table of contexts, their counts and backoff weights."""
    count = sum((F.col(f"c{r}") * r for r in range(1, K + 1)), F.col("x"))
    left = sum((F.col(f"c{r}") * (r * (1 - d[r])) for r in range(1, K + 1)), TAIL * F.col("y"))
    own = sums.where("kind = 1").select("key", count.alias("n"), left.alias("left"), "z").groupBy("key").agg(
        F.sum("n").alias("n"), F.sum("left").alias("left"), F.sum("z").alias("z"))
    weight = F.col("left") / F.col("n") / (1 - F.col("z"))
    return keep(own.select("key", F.log10("n").alias("log_n"), F.log10(weight).alias("log_weight")))


def _result(ids: DataFrame, sums: DataFrame, model: Words, d: list[float]) -> DataFrame:
    table = contexts(sums, d)
    begin = table.where(F.col("key") == int(BEGIN)).select("log_n").first()
    log_begin = begin[0] if begin else 0.0
    missed = (sums.where("kind = 2").groupBy("key", "key2").agg(F.sum("tokens").alias("n")).join(table, "key")
              .select(F.col("key2").alias("row"), (F.col("n") * (F.col("log_n") + F.col("log_weight"))).alias("back"))
              .groupBy("row").agg(F.sum("back").alias("back")))
    gained = sum((F.col(f"c{r}") * math.log10(r * d[r]) for r in range(1, K + 1)), F.col("x") - F.col("y"))
    per = sums.where("kind = 0").select(F.col("key").alias("row"), gained.alias("gained"), "z", "tokens", "known").groupBy(
        "row").agg(*(F.sum(c).alias(c) for c in ("gained", "z", "tokens", "known")))
    n, v = model.total, model.distinct
    return ids.join(per, "row").join(missed, "row", "left").select(
        "row", "id", (~F.col("train")).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("z") - F.col("tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("gained") - F.lit(log_begin) + F.coalesce("back", F.lit(0.0))).alias("score"))


def report(documents: DataFrame) -> DataFrame:
    return score(documents.select("doc_id", "text")).withColumnRenamed("id", "doc_id").drop("row")
