"""Alignment of two tokenizers on the same text, each distinct text once.

Documents are shuffled by their full text and equal ones become one row with a multiplicity. Each distinct text is encoded by
both tokenizers, and the byte offsets where a token of either ends are compared: where both end, a
group of tokens closes, and its last tokens are linked. How often a pair of ids is linked counts over all
documents, so a text's links count as often as the text occurs.

Aligned texts are stored in batches: a row holds some texts, the different pairs of the batch once, and for each text which of
these it has how often. Only a batch's different pairs, with their weights, become rows: these are summed, compared with the
highest of their second id, and sent back to the batches, where the measures of each text are complete. Documents then take the
measures of their text by its SHA-256. What one batch or text holds is bounded by its tokens, a text that a third of all
documents share is combined before the shuffle, and nothing is broadcast by hand.

Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros and
an empty digest. Strings of special tokens are plain text. Repeated rows count each. An empty table gives an empty
result. Of other columns nothing is read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.packed import pack, unpack
from tidemark.llm.shared import keep

FIRST, SECOND = "byte_bpe_50k", "piece_bpe_32k"
BATCH_TOKENS = 2_000_000


class ByteLevel:
    """A byte-level vocabulary; ``tiktoken`` encodes it, and special tokens' strings are plain text."""

    def __init__(self, name: str) -> None:
        import public_tokenizers as public
        import tiktoken
        with open(public.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._own = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    def encode(self, text: str) -> list[int]:
        return self._own.encode_ordinary(f" {text}")


class Pieces:
    """A vocabulary of pieces; the encoder itself puts a space before the text."""

    def __init__(self, name: str) -> None:
        import public_tokenizers as public
        import sentencepiece
        self._own = own = sentencepiece.SentencePieceProcessor(model_file=public.path(f"{name}.model"))
        self.tokens = [bytes([int(p[3:5], 16)]) if own.is_byte(i) else p.replace("▁", " ").encode()
                       for i in range(own.get_piece_size()) for p in [own.id_to_piece(i)]]

    def encode(self, text: str) -> list[int]:
        return self._own.encode(text, num_threads=1)


@cache
def tokenizer(name: str):
    kind = Pieces if name.startswith("piece") else ByteLevel
    own = kind(name)
    own.sizes = np.array([len(t) for t in own.tokens], np.int64)
    #: What each id looks like in the digest: in the middle of its side, and at its end.
    own.spelled = np.array([f"{i}{c}" for i in range(len(own.tokens)) for c in ",|;"], object)
    return own


def align(text: str, a: list[int], b: list[int], one, two) -> tuple[np.ndarray, np.ndarray] | None:
    """Indexes of the tokens that close each group, or None if the bytes are not those of the text."""
    raw = f" {text}".encode()
    if not len(a) or not len(b) or b"".join(map(one.tokens.__getitem__, a)) != raw or b"".join(map(two.tokens.__getitem__, b)) != raw:
        return None
    ends_a, ends_b = np.cumsum(one.sizes[a]), np.cumsum(two.sizes[b])
    _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    return at_a, at_b


def digest(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, one, two) -> str:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3``: ids of both sides, group by group."""
    closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    closes_a[at_a], closes_b[at_b] = 1, 2
    group_a = np.cumsum(closes_a) - closes_a
    group_b = (np.cumsum(closes_b) - closes_b) >> 1
    out = np.empty(len(a) + len(b), object)
    before_b = np.append(0, at_b + 1)
    out[np.arange(len(a)) + before_b[group_a]] = one.spelled[3 * a + closes_a]
    out[np.arange(len(b)) + at_a[group_b] + 1] = two.spelled[3 * b + closes_b]
    return hashlib.sha256("".join(out.tolist())[:-1].encode()).hexdigest()


_TEXT = [("sha", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string())]
_BATCH = pa.schema([("batch", pa.int64()), ("texts", pa.list_(pa.struct(_TEXT))), ("a", pa.binary()), ("b", pa.binary()),
                    ("weight", pa.binary()), ("many", pa.binary()), ("pair", pa.binary()), ("times", pa.binary())])
_BATCH_DDL = ("batch bigint, texts array<struct<sha: binary, n_a: bigint, n_b: bigint, n_groups: bigint, "
              "groups_sha256: string>>, a binary, b binary, weight binary, many binary, pair binary, times binary")


def _aligned(first: str, second: str, batch_tokens: int):
    """Map: batches of aligned texts, one row each."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = tokenizer(first), tokenizer(second)
        texts, pairs, times, copies, size = [], [], [], [], 0
        for batch in batches:
            for sha, text, n in zip(batch["sha"], batch["text"], batch["copies"]):
                text = text.as_py()
                a, b = one.encode(text), two.encode(text)
                found = align(text, a, b, one, two)
                if found is None:
                    continue
                a, b = np.array(a), np.array(b)
                links, count = np.unique(a[found[0]] << 32 | b[found[1]], return_counts=True)
                texts.append({"sha": sha.as_py(), "n_a": len(a), "n_b": len(b), "n_groups": len(found[0]),
                              "groups_sha256": digest(a, b, *found, one, two)})
                pairs.append(links)
                times.append(count)
                copies.append(n.as_py())
                size += len(a) + len(b)
                if size >= batch_tokens:
                    yield _row(texts, pairs, times, copies)
                    texts, pairs, times, copies, size = [], [], [], [], 0
        if texts:
            yield _row(texts, pairs, times, copies)
    return of


def _row(texts: list[dict], pairs: list[np.ndarray], times: list[np.ndarray], copies: list[int]) -> pa.RecordBatch:
    many = np.array([len(p) for p in pairs])
    known, pair = np.unique(np.concatenate(pairs), return_inverse=True)
    count = np.concatenate(times)
    weight = np.zeros(len(known), np.int64)
    np.add.at(weight, pair, count * np.repeat(copies, many))
    return pa.RecordBatch.from_pylist([{
        "batch": uuid.uuid4().int >> 65, "texts": texts, "a": pack(known >> 32), "b": pack(known & 0xFFFFFFFF), "weight": pack(weight),
        "many": pack(many), "pair": pack(pair), "times": pack(count)}], _BATCH)


_LINKS = pa.schema([("batch", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("weight", pa.int64())])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map: a row for each pair of a batch."""
    for batch in batches:
        for row in batch.to_pylist():
            a, b, weight = (unpack(row[c]) for c in ("a", "b", "weight"))
            yield pa.RecordBatch.from_arrays([pa.repeat(row["batch"], len(a)), pa.array(a.astype(np.int32)),
                                              pa.array(b.astype(np.int32)), pa.array(weight)], schema=_LINKS)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map: each text of a batch with the sums over its links."""
    for batch in batches:
        for row, got in zip(batch.drop_columns(["counts"]).to_pylist(), batch["counts"]):
            known = (unpack(row["a"]) << 32) | unpack(row["b"])
            a, b, n, top = (got.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            count, best = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
            at = np.searchsorted(known, (a << 32) | b)
            count[at], best[at] = n, top
            pair, times, many = unpack(row["pair"]), unpack(row["times"]), unpack(row["many"])
            first = np.cumsum(many) - many
            n_best = np.add.reduceat(times * best[pair], first)
            count_sum = np.add.reduceat(times * count[pair], first)
            yield pa.RecordBatch.from_pylist(
                [t | {"n_best": int(x), "count_sum": int(y)} for t, x, y in zip(row["texts"], n_best, count_sum)], _MEASURED)


_MEASURED = pa.schema([*_TEXT, ("n_best", pa.int64()), ("count_sum", pa.int64())])
_MEASURED_DDL = "sha binary, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_best bigint, count_sum bigint"


def aligned_texts(documents: DataFrame, first: str = FIRST, second: str = SECOND,
                  batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """The stored batches: each distinct text encoded and aligned once."""
    distinct = (documents.where("text is not null and text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
                .select(F.unhex(F.sha2("text", 256)).alias("sha"), "text", "copies"))
    return keep(distinct.mapInArrow(_aligned(first, second, batch_tokens), _BATCH_DDL))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): how often two ids are linked, and whether no other a is linked to b more often."""
    links = aligned.select("batch", "a", "b", "weight").mapInArrow(_links, "batch bigint, a int, b int, weight bigint")
    counts = links.groupBy("a", "b").agg(F.sum("weight").alias("n"))
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    return counts.join(highest, "b").select("a", "b", "n", (F.col("n") == F.col("highest")).alias("best"))


def measures(documents: DataFrame, first: str = FIRST, second: str = SECOND, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row per distinct text that has tokens: its SHA-256 and its measures."""
    aligned = aligned_texts(documents, first, second, batch_tokens)
    counts = keep(pair_counts(aligned))
    links = aligned.select("batch", "a", "b", "weight").mapInArrow(_links, "batch bigint, a int, b int, weight bigint")
    back = links.join(counts, ["a", "b"]).groupBy("batch").agg(
        F.collect_list(F.struct("a", "b", "n", "best")).alias("counts"))  # as many as a batch has pairs
    return aligned.join(back, "batch").mapInArrow(_measured, _MEASURED_DDL)


def report(documents: DataFrame, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row per document: tokens, groups and links of its text."""
    ids = documents.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"))
    own = measures(documents.select("text"), batch_tokens=batch_tokens)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return ids.join(own, "sha", "left").select(
        "doc_id", zero("n_a").alias("n_a"), zero("n_b").alias("n_b"), zero("n_groups").alias("n_groups"),
        zero("n_groups").alias("n_links"), zero("n_best").alias("n_best"), zero("count_sum").alias("count_sum"),
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
