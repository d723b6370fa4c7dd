"""Removal of repeated passages, found by fixed-block anchors.

A passage is repeated if a window of ``window`` words of it stands earlier too: in a document of
smaller id, or in the same one further left. Any such window holds a whole one of the blocks into which the
earlier document is cut, blocks being half as long and not overlapping. So the blocks of all documents are the
index, every rolling run of that many words probes it, and what hits is extended: all windows around a
hit are compared as a whole, and those that stand earlier too are joined to maximal repeats.

Anchors travel as 32-bit hashes with packed positions, to the partition that their hash names; a chance hit
costs a comparison and changes nothing. Windows around hits are compared by 96-bit hashes. In both passes a map task
first brings together what repeats within a batch of documents and sends each different run or
window once. A passage that a third of all documents share thus sends one entry a batch, and the
partitions are of even size. All that is sent back is positions per document. Documents are shuffled
once, by a hash of the row; the search for windows and the removal read the same shuffle.

Null ids count as the largest number. Rows of one id are one document: of two rows that are wholly equal
neither is earlier. Null, empty and shorter texts have no window and stay as they are. An empty
table gives an empty table. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.packed import pack, runs, unpack
from tidemark.llm.shared import keep

WINDOW = 20
BATCH_WORDS = 1_500_000
#: Bytes of text whose entries one partition holds: some 10 million, of 50 bytes each while it works.
PART_BYTES = 64 << 20
_SMALL_PART_BYTES, _SMALL_PARTS = 4 << 20, 64

_LAST = np.iinfo(np.int64).max
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def _parts(texts: DataFrame, part_bytes: int) -> int:
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(total / part_bytes), min(_SMALL_PARTS, math.ceil(total / _SMALL_PART_BYTES)))


@dataclass
class _Batch:
    """Words of some documents end to end: their hashes, each word's document and place in it."""

    key: np.ndarray
    order: np.ndarray
    hits: list
    word: np.ndarray
    doc: np.ndarray
    at: np.ndarray

    def rolling(self, size: int, words_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places where ``size`` words of one document begin, and a hash of these words."""
        word = self.word if words_ is None else words_
        if len(word) < size:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        start = np.flatnonzero(self.doc[:len(word) - size + 1] == self.doc[size - 1:])
        return start, words.shingles(word, size)[start]


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[_Batch]:
    """Documents in batches of ``BATCH_WORDS`` words; a row that occurs again in a batch is left out."""
    held, seen, size = [], set(), 0
    for batch in parts:
        row = batch["row"]
        keys = batch["key"].to_pylist()
        orders = row.field("doc_id").fill_null(_LAST).cast(pa.int64()).to_pylist()
        hits = batch["hits"].to_pylist() if "hits" in batch.schema.names else [None] * len(keys)
        i = 0
        for block in words.blocks(row.field("text"), words.PLAIN):
            own = block.hashes()
            for a, b in zip(block.first[:-1].tolist(), block.first[1:].tolist()):
                if b > a and (keys[i], orders[i]) not in seen:
                    seen.add((keys[i], orders[i]))
                    held.append((keys[i], orders[i], hits[i], own[a:b]))
                    size += b - a
                i += 1
            if size >= BATCH_WORDS:
                yield _joined(held)
                held, seen, size = [], set(), 0
    if held:
        yield _joined(held)


def _joined(held: list) -> _Batch:
    n = np.array([len(h[3]) for h in held])
    doc = np.repeat(np.arange(len(held)), n)
    return _Batch(np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64),
                  [h[2] for h in held], np.concatenate([h[3] for h in held]), doc,
                  np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))


def _rows(batch: _Batch, start: np.ndarray, part: np.ndarray, *hashes: np.ndarray) -> list[dict]:
    """One row for each partition: documents, how many entries each has, their places, their hashes."""
    by_part = np.argsort(part, kind="stable")
    first, count = runs(part[by_part])
    out = []
    for a, n in zip(first.tolist(), count.tolist()):
        own = by_part[a:a + n]
        doc = batch.doc[start[own]]
        begin, many = runs(doc)
        out.append({"part": int(part[own[0]]), "keys": batch.key[doc[begin]].tobytes(),
                    "orders": pack(batch.order[doc[begin]]), "counts": pack(many), "at": pack(batch.at[start[own]]),
                    **{f"h{k}": h[own].tobytes() for k, h in enumerate(hashes)}})
    return out


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_ENTRY = [("part", pa.int32()), ("keys", pa.binary()), ("orders", pa.binary()), ("counts", pa.binary()), ("at", pa.binary())]
_ANCHOR = pa.schema([*_ENTRY, ("h0", pa.binary())])
_WINDOW = pa.schema([*_ENTRY, ("h0", pa.binary()), ("h1", pa.binary())])
_PLACES = pa.schema([("key", pa.int64()), ("order", pa.int64()), ("at", pa.binary())])
_DDL = {"part": "int", "key": "bigint", "order": "bigint"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{n}` {_DDL.get(n, 'binary')}" for n in schema.names)


def _anchors(parts_: int, window: int, seed: int):
    """Map: each different run of a block's length once a batch; what repeats within it are hits at once."""
    block = (window + 1) // 2

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(_batches(batches)):
            start, gram = batch.rolling(block)
            if not len(start):
                continue
            inside = batch.at[start] % block != 0  # blocks of the index come first in their group
            by = np.lexsort((inside, gram))
            first, many = runs(gram[by].view(np.int64))
            sent = np.sort(by[first])
            low, high = gram[sent] & np.uint64(0xFFFFFFFF), (gram[sent] >> np.uint64(32)).astype(np.uint32)
            rows = _rows(batch, start[sent], (low % np.uint64(parts_)).astype(np.int32), high)
            again = np.sort(by[np.repeat(many > 1, many)])
            if len(again):
                rows += [row | {"h0": None} for row in _rows(
                    batch, start[again], np.full(len(again), hash((seed, number, int(batch.key[0]))) % parts_, np.int32))]
            yield _table(rows, _ANCHOR)
    return of


def _entries(batches: Iterator[pa.RecordBatch], hashes: tuple) -> tuple:
    """All entries of a partition: document (as a row of keys), place, hashes; and the rows that have no hash."""
    keys, orders, docs, at, found, plain, n = [], [], [], [], [[] for _ in hashes], [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["h0"] is None:
                plain.append(row)
                continue
            keys.append(np.frombuffer(row["keys"], np.int64))
            orders.append(unpack(row["orders"]))
            docs.append(np.repeat(np.arange(n, n + len(keys[-1]), dtype=np.int64), unpack(row["counts"])))
            at.append(unpack(row["at"]))
            for k, kind in enumerate(hashes):
                found[k].append(np.frombuffer(row[f"h{k}"], kind))
            n += len(keys[-1])
    join = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
    return (join(keys, np.int64), join(orders, np.int64), join(docs, np.int64), join(at, np.int64),
            [join(x, kind) for x, kind in zip(found, hashes)], plain)


def _places(keys, orders, doc, at, chosen) -> Iterator[pa.RecordBatch]:
    """Rows (key, order, places) of the chosen entries, a few thousand documents at a time."""
    chosen = np.flatnonzero(chosen)
    first, many = runs(doc[chosen])
    for i in range(0, len(first), 5000):
        yield _table([{"key": int(keys[doc[chosen[a]]]), "order": int(orders[doc[chosen[a]]]),
                       "at": pack(at[chosen[a:a + n]])}
                      for a, n in zip(first[i:i + 5000].tolist(), many[i:i + 5000].tolist())], _PLACES)


def _told(plain: list[dict]) -> Iterator[pa.RecordBatch]:
    """Rows whose places were found within a batch."""
    for row in plain:
        keys, orders = np.frombuffer(row["keys"], np.int64), unpack(row["orders"])
        doc = np.repeat(np.arange(len(keys)), unpack(row["counts"]))
        yield from _places(keys, orders, doc, unpack(row["at"]), np.ones(len(doc), bool))


def _probe(window: int):
    """Reduce: runs that occur more than once, once of these as a block of the index."""
    block = (window + 1) // 2

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, orders, doc, at, (high,), plain = _entries(batches, (np.uint32,))
        if len(high):
            by = np.argsort(high, kind="stable")
            first, many = runs(high[by].astype(np.int64))
            indexed = np.logical_or.reduceat(at[by] % block == 0, first)
            hit = np.zeros(len(high), bool)
            hit[by] = np.repeat(indexed & (many > 1), many)
            yield from _places(keys, orders, doc, at, hit)
        yield from _told(plain)
    return of


def _around(parts_: int, window: int, seed: int):
    """Map: windows that hold a hit; each different one once a batch, later ones there are repeats at once."""
    block = (window + 1) // 2

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(_batches(batches)):
            n = np.bincount(batch.doc, minlength=len(batch.key))
            base = np.cumsum(n) - n
            edge = np.zeros(len(batch.word) + 1, np.int64)
            for i, hits in enumerate(batch.hits):
                at = np.concatenate([unpack(h) for h in hits])
                at = at[at < n[i]]
                np.add.at(edge, base[i] + np.maximum(at - block + 1, 0), 1)
                np.add.at(edge, base[i] + at + 1, -1)
            start, one = batch.rolling(window)
            if not len(start):
                continue
            near = np.cumsum(edge)[start] > 0
            start, one = start[near], one[near]
            if not len(start):
                continue
            two = (batch.rolling(window, words.mixed(batch.word ^ _SECOND))[1][near] >> np.uint64(32)).astype(np.uint32)
            order = batch.order[batch.doc[start]]
            by = np.lexsort((batch.at[start], order, two, one))
            same = (np.diff(one[by]) == 0) & (np.diff(two[by]) == 0)
            group = np.cumsum(np.append(True, ~same)) - 1
            first = np.flatnonzero(np.append(True, ~same))
            late = np.zeros(len(start), bool)
            late[by] = (order[by] != order[by[first]][group]) | (batch.at[start[by]] != batch.at[start[by[first]]][group])
            sent = ~late
            rows = _rows(batch, start[sent], (one[sent] % np.uint64(parts_)).astype(np.int32), one[sent], two[sent])
            if late.any():
                rows += [row | {"h0": None, "h1": None} for row in _rows(
                    batch, start[late], np.full(int(late.sum()), hash((seed, number, int(batch.key[0]))) % parts_, np.int32))]
            yield _table(rows, _WINDOW)
    return of


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce: windows that stand earlier too."""
    keys, orders, doc, at, (one, two), plain = _entries(batches, (np.uint64, np.uint32))
    if len(one):
        order = orders[doc]
        by = np.lexsort((at, order, two, one))
        new = np.append(True, (np.diff(one[by]) != 0) | (np.diff(two[by]) != 0))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = np.zeros(len(one), bool)
        late[by] = (order[by] != order[by[first]]) | (at[by] != at[by[first]])
        yield from _places(keys, orders, doc, at, late)
    yield from _told(plain)


def _found(documents: DataFrame, window: int, part_bytes: int) -> DataFrame:
    """Each row of the documents as a struct ``row``, with ``late``: places of windows that stand earlier too."""
    if window < 2:
        raise ValueError("a window needs two words")
    docs = documents.select(
        F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"),
        F.xxhash64("doc_id", "text").alias("key"))
    n = _parts(documents, part_bytes)
    anchors = docs.select("key", F.struct("row.doc_id", "row.text").alias("row")).mapInArrow(
        _anchors(n, window, 1), _ddl(_ANCHOR))
    hits = keep(anchors.groupBy("part").applyInArrow(_probe(window), _ddl(_PLACES)))
    near = docs.join(hits.groupBy("key").agg(F.collect_list("at").alias("hits")), "key").select("key", "row", "hits")
    late = (near.mapInArrow(_around(n, window, 2), _ddl(_WINDOW))
            .groupBy("part").applyInArrow(_repeated, _ddl(_PLACES))
            .groupBy("key").agg(F.collect_list(F.struct("order", "at")).alias("late")))
    order = F.coalesce("row.doc_id", F.lit(_LAST)).cast("long")
    return docs.join(late, "key", "left").select("row", F.transform(
        F.filter("late", lambda x: x["order"] == order), lambda x: x["at"]).alias("late"))


def _covered(text: str | None, late: list | None, window: int) -> tuple[list[bytes], np.ndarray]:
    """A text's words, and which of them lie in a repeated window."""
    own = (text or "").encode().translate(words.PLAIN).split()
    edge = np.zeros(len(own) + 1, np.int64)
    if late:
        at = np.concatenate([unpack(x) for x in late])
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
    return own, np.cumsum(edge[:-1]) > 0


def remove(documents: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Documents without repeated words. A text that loses words is the rest, joined by one space.

    A column n_chars, where there is one, follows the text.
    """
    found = _found(documents, window, part_bytes)

    def kept(texts: pa.Array, late: pa.Array) -> pa.Array:
        out = []
        for text, places in zip(texts.to_pylist(), late):
            places = places.as_py()
            if places:
                own, gone = _covered(text, places, window)
                text = b" ".join(w for w, g in zip(own, gone) if not g).decode()
            out.append(text)
        return pa.array(out, pa.string())

    out = found.select("row", F.arrow_udf(kept, "string")("row.text", "late").alias("own"))
    text = F.col("own")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in documents.columns))


def repeats(documents: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Maximal repeats: doc_id, start and length in words, of each stretch that is removed."""
    def stretches(texts: pa.Array, late: pa.Array) -> pa.Array:
        out = []
        for text, places in zip(texts.to_pylist(), late):
            gone = np.flatnonzero(np.diff(_covered(text, places.as_py(), window)[1].astype(np.int8), prepend=0, append=0))
            out.append([{"start": int(a), "length": int(b - a)} for a, b in zip(gone[::2], gone[1::2])])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))

    found = _found(documents.select("doc_id", "text"), window, part_bytes)
    udf = F.arrow_udf(stretches, "array<struct<start: bigint, length: bigint>>")
    return found.select("row.doc_id", F.explode(udf("row.text", "late")).alias("s")).select("doc_id", "s.*")


def report(documents: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: its words, how many are removed, a digest of the rest."""
    kind = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]

    def digest(texts: pa.Array, late: pa.Array) -> pa.Array:
        out = []
        for text, places in zip(texts, late):
            own, gone = _covered(text.as_py(), places.as_py(), window)
            rest = [w for w, g in zip(own, gone.tolist()) if not g]
            out.append({"n_words": len(own), "n_removed": len(own) - len(rest),
                        "kept_sha256": hashlib.sha256(b" ".join(rest)).hexdigest()})
        return pa.array(out, pa.struct(kind))

    found = _found(documents.select("doc_id", "text"), window, part_bytes)
    udf = F.arrow_udf(digest, "n_words bigint, n_removed bigint, kept_sha256 string")
    return found.select("row.doc_id", udf("row.text", "late").alias("own")).select("doc_id", "own.*")
