"""Packing by minimum bin slack.

Every document is its token ids and a closing id. What fills whole windows is cut off first;
the rest of each document is shorter than a window. Of these remaining lengths only the
histogram matters (at most ``window`` numbers): the longest is placed, and a subset-sum table in
the bits of integers, one for each length taken up, tells which sums the others can reach. The
highest sum that fits is traced back to counts of lengths, and that multiset is repeated as often
as the histogram allows. Each repetition uses up a length or nearly so, hence the list of
multisets is short however many documents there are.

Pieces get a number among those of their length (from counts per length and salted bucket, so
no length is ever in one task), and the list of multisets says which sequence and offset
that number has. Pieces, not texts, are shuffled. A null text is an empty one, a single
closing id. Repeated rows are packed each on its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.shared import arrow, keep

WINDOW = 1024
CLOSING = 0
_BUCKET_ROWS = 20_000


def cut(documents: DataFrame, window: int = WINDOW, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Documents' other columns with one row for each piece: start, length, ids_crc32, doc_tokens."""
    @arrow("array<struct<start: bigint, length: bigint, ids_crc32: bigint, doc_tokens: bigint>>")
    def pieces(texts: pa.Array) -> pa.Array:
        out = []
        for ids in tokens.encoded(texts, vocabulary):
            ids = np.append(ids, np.uint32(CLOSING)).astype("<u4")
            raw = ids.tobytes()
            out.append([{"start": a, "length": min(window, len(ids) - a),
                         "ids_crc32": zlib.crc32(raw[4 * a:4 * (a + window)]), "doc_tokens": len(ids)}
                        for a in range(0, len(ids), window)])
        return pa.array(out, pa.list_(pa.struct([(k, pa.int64()) for k in (
            "start", "length", "ids_crc32", "doc_tokens")])))

    return documents.select("doc_id", F.explode(pieces("text")).alias("p")).select("doc_id", "p.*")


def _reach(counts: list[int], room: int) -> list[int]:
    """The multiset of lengths with the largest sum up to ``room``, as counts per length.

    ``steps`` has for each taken block of equal lengths the sums (as bits) before it.
    """
    sums, steps = 1, []
    all_ = (1 << (room + 1)) - 1
    for length in range(room, 0, -1):
        left, block = min(counts[length], room // length), 1
        while left:
            take = min(block, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & all_
            left -= take
            block *= 2
        if sums >> room & 1:
            break
    goal, found = sums.bit_length() - 1, [0] * len(counts)
    for length, take, before in reversed(steps):
        if not before >> goal & 1:
            goal -= length * take
            found[length] += take
    return found


def plan(counts: list[int], window: int = WINDOW) -> list[tuple[list[int], int]]:
    """Multisets of lengths (as counts per length) and how often each fills a window.

    ``counts`` has the number of pieces for each length from 0 to ``window``.
    """
    left, out = list(counts), []
    for longest in range(window, 0, -1):
        while left[longest]:
            left[longest] -= 1
            own = _reach(left, window - longest)
            left[longest] += 1
            own[longest] += 1
            times = min(left[k] // n for k, n in enumerate(own) if n)
            for k, n in enumerate(own):
                left[k] -= n * times
            out.append((own, times))
    return out


def _places(counts: list[int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, each, first sequence, first offset): number r of a length, with
    from <= r < to, is in sequence first + (r - from) div each, at offset + length * ((r - from) mod each)."""
    used, sequence, out = [0] * len(counts), 0, []
    for own, times in plan(counts, window):
        offset = 0
        for length in range(len(own) - 1, 0, -1):
            if n := own[length]:
                out.append((length, used[length], used[length] + n * times, n, sequence, offset))
                used[length] += n * times
                offset += n * length
        sequence += times
    return out


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces (any columns, with ``length``) with sequence_id and offset, which replace columns of these names."""
    spark = pieces.sparkSession
    # inside, the other columns go by number, so that their names can't clash
    own = {c: c if c == "length" else f"own_{i}" for i, c in enumerate(pieces.columns)}
    rows = keep(pieces.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items())).withColumn("__row", F.monotonically_increasing_id()))
    n_buckets = max(1, -(-rows.count() // _BUCKET_ROWS))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__row"), F.lit(n_buckets)))
    counts = keep(rows.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("n")))
    found = [0] * (window + 1)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        found[r["length"]] = r["n"]
    places = spark.createDataFrame(
        _places(found, window) or [(0, 0, 0, 1, 0, 0)],
        "length bigint, __from bigint, __to bigint, __each bigint, __sequence bigint, __offset bigint")
    before = counts.select("length", "__bucket", (F.sum("n").over(
        Window.partitionBy("length").orderBy("__bucket")) - F.col("n")).alias("__before"))
    number = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("__row")) - 1
    ranked = (rows.withColumn("__number", number).join(before, ["length", "__bucket"])
              .withColumn("__number", F.col("__number") + F.col("__before")))
    # the list of multisets depends on the window, not on the number of documents
    step = F.col("__number") - F.col("__from")
    return (ranked.alias("r").join(F.broadcast(places).alias("p"), (F.col("r.length") == F.col("p.length"))
                                   & F.col("__number").between(F.col("__from"), F.col("__to") - 1))
            .select(*(F.col(f"r.{n}").alias(c) for c, n in own.items() if c not in ("sequence_id", "offset")),
                    (F.col("__sequence") + F.floor(step / F.col("__each"))).alias("sequence_id"),
                    (F.col("__offset") + F.col("r.length") * (step % F.col("__each"))).alias("offset")))


def report(documents: DataFrame) -> DataFrame:
    return pack(cut(documents.select("doc_id", "text")))
