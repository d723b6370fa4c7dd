"""Benchmark decontamination: test n-grams found again in training texts.

The n-grams of all benchmark items form a hash set that every task holds; each document's
token windows are rolled over it, a hit is verified word by word, and the words under
verified windows, or the documents, are removed. The set is cut into blocks of at most
``block`` (n-gram, item) pairs, so what is broadcast stays within that bound however large
the benchmark grows; with more than one block each costs one more pass, and passes are kept
in the shared folder in between. Documents never move: there is no shuffle of texts.

Null and empty texts have no words, so no hits. Items without a word make no n-gram; items
without an id count for hits but not as items. Repeated rows are judged each on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.shared import arrow, free_name, keep

SIZE = 10
BLOCK = 200_000
_FILTER = 1 << 20  # slots of the first, inexact look-up


@arrow("array<struct<hash: bigint, size: int, gram: binary>>")
def _cut(texts: pa.Array, size: pa.Array) -> pa.Array:
    n, out = size[0].as_py() if len(size) else SIZE, []
    for block in words.blocks(texts, words.ALNUM):
        hashes = block.hashes()
        for lo, hi in zip(block.first, block.first[1:]):
            grams = words.as_long(words.shingles(hashes[lo:hi], n)).tolist()
            k = min(n, int(hi - lo))
            out.append([{"hash": h, "size": k, "gram": b" ".join(
                block.word(j) for j in range(lo + i, lo + i + k))} for i, h in enumerate(grams)])
    return pa.array(out, pa.list_(pa.struct([("hash", pa.int64()), ("size", pa.int32()), ("gram", pa.binary())])))


def ngrams(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct (item_id, hash, size, gram) of all items."""
    return (benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                             F.explode(_cut("text", F.lit(size))).alias("g"))
            .select("item_id", "g.*").distinct())


class Grams:
    """One block of n-grams, ready for look-ups."""

    def __init__(self, rows: list) -> None:
        self.items: dict[tuple[int, bytes], list[str]] = {}
        found: dict[int, set[int]] = {}
        for row in rows:
            names = self.items.setdefault((row["size"], bytes(row["gram"])), [])
            if row["item_id"] is not None:
                names.append(row["item_id"])
            found.setdefault(row["size"], set()).add(row["hash"])
        self.sizes = {}
        for size, hashes in found.items():
            known = np.sort(np.array(list(hashes), np.int64).view(np.uint64))
            slots = np.zeros(_FILTER, bool)
            slots[known % np.uint64(_FILTER)] = True
            self.sizes[size] = (known, slots)

    def scan(self, texts: pa.Array) -> pa.Array:
        """For each text: words, a bit per word that is hit (nothing if none is), and items."""
        n_words: list[int] = []
        bits: list[bytes] = []
        items: list[list[str]] = []
        for block in words.blocks(texts, words.ALNUM):
            hashes, first = block.hashes(), block.first
            hit = np.zeros(len(hashes), bool)
            names: dict[int, set[str]] = {}
            for size, (known, slots) in self.sizes.items():
                if len(hashes) < size:
                    continue
                rolled = words.shingles(hashes, size)
                at = np.flatnonzero(slots[rolled % np.uint64(_FILTER)])
                place = np.minimum(np.searchsorted(known, rolled[at]), len(known) - 1)
                at = at[known[place] == rolled[at]]
                text = np.searchsorted(first, at, "right") - 1
                for i, t in zip(at.tolist(), text.tolist()):
                    if i + size <= first[t + 1]:
                        gram = b" ".join(block.word(j) for j in range(i, i + size))
                        if (size, gram) in self.items:
                            hit[i:i + size] = True
                            names.setdefault(t, set()).update(self.items[size, gram])
            for t, (lo, hi) in enumerate(zip(first, first[1:])):
                n_words.append(int(hi - lo))
                bits.append(np.packbits(hit[lo:hi]).tobytes() if hit[lo:hi].any() else b"")
                items.append(sorted(names.get(t, ())))
        return pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))],
            names=["n_words", "bits", "items"])


_SCANNED = "struct<n_words: bigint, bits: binary, items: array<string>>"


def _either(a: bytes, b: bytes) -> bytes:
    if not a or not b:
        return a or b
    return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()


@arrow(_SCANNED)
def _merged(a: pa.Array, b: pa.Array) -> pa.Array:
    rows = [{"n_words": x["n_words"], "bits": _either(x["bits"], y["bits"]),
             "items": sorted({*x["items"], *y["items"]})} for x, y in zip(a.to_pylist(), b.to_pylist())]
    return pa.array(rows, pa.struct([("n_words", pa.int64()), ("bits", pa.binary()), ("items", pa.list_(pa.string()))]))


def scan(documents: DataFrame, benchmark: DataFrame, size: int = SIZE, block: int = BLOCK,
         column: str = "__scan") -> DataFrame:
    """Documents with a struct of their words, hit words (as bits) and items."""
    grams = keep(ngrams(benchmark, size))
    n_blocks = max(1, -(-grams.count() // block))
    spread = F.pmod(F.xxhash64("item_id", "gram"), F.lit(n_blocks))
    out = documents
    for k in range(n_blocks):
        rows = grams.where(spread == k).collect()  # about ``block`` rows, whatever the size
        held = documents.sparkSession.sparkContext.broadcast(Grams(rows))
        found = F.arrow_udf(_scanner(held), _SCANNED)("text")
        if k == 0:
            out = out.withColumn(column, found)
        else:
            out = keep(out.withColumn(column, _merged(column, found)))
    return out


def _scanner(held):
    def of(texts: pa.Array) -> pa.Array:
        return held.value.scan(texts)
    return of


@arrow("bigint")
def _n_hit(bits: pa.Array) -> pa.Array:
    return pa.array([int.from_bytes(x.as_py() or b"").bit_count() for x in bits], pa.int64())


@arrow("string")
def _without(texts: pa.Array, bits: pa.Array) -> pa.Array:
    """Texts without the runs of words that are hit."""
    out = []
    for text, bit in zip(texts, bits):
        text, bit = text.as_py(), bit.as_py()
        if bit:
            raw = text.encode()
            block = words.split(raw.translate(words.ALNUM), np.zeros(1, np.int64))
            hit = np.unpackbits(np.frombuffer(bit, np.uint8), count=len(block.start)).astype(bool)
            edge = np.flatnonzero(np.diff(hit, prepend=False, append=False))
            left = 0
            kept = []
            for lo, hi in zip(edge[::2], edge[1::2]):
                kept.append(raw[left:block.start[lo]])
                left = int(block.end[hi - 1])
            text = b"".join([*kept, raw[left:]]).decode()
        out.append(text)
    return pa.array(out, pa.string())


def n_hit(column: str = "__scan") -> Column:
    return _n_hit(F.col(column)["bits"])


def drop_documents(documents: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Only documents that hold no n-gram of the benchmark; columns stay as they are."""
    own = free_name(documents, "__scan")
    found = scan(documents, benchmark, size, column=own)
    return found.where(F.length(F.col(own)["bits"]) == 0).select(*map(_name, documents.columns))


def remove_spans(documents: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """All documents, with the words under found n-grams cut out of their texts."""
    own = free_name(documents, "__scan")
    found = scan(documents, benchmark, size, column=own)
    return (found.withColumn("text", _without("text", F.col(own)["bits"]))
            .select(*map(_name, documents.columns)))


def _name(column: str) -> str:
    return f"`{column}`"


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: its words, hit words and items."""
    found = scan(documents.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return found.select("doc_id", F.col("__scan")["n_words"].alias("n_words"), n_hit().alias("n_hit"),
                        F.col("__scan")["items"].alias("items")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
