"""Words of many texts at once, as byte offsets and 64-bit hashes in numpy arrays.

Texts are joined to blocks of about a megabyte, mapped byte by byte (``bytes.translate``
turns what separates words into a space and lower-cases), and cut where spaces are. A word's
hash is a polynomial of its bytes, taken from prefix sums, so no Python object is made per
word. Two of n different words share a hash with a probability of about n * n / 2 ** 65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\r\x0b\x0c"
UPPER = bytes(range(ord("A"), ord("Z") + 1))


def _table(separators: bytes, lower: bool) -> bytes:
    out = bytearray(range(256))
    for b in separators:
        out[b] = 32
    if lower:
        for b in UPPER:
            out[b] = b + 32
    return bytes(out)


#: Words between white space, as they are.
PLAIN = _table(SPACES, False)
#: Words between white space, A-Z lower-cased.
LOWER = _table(SPACES, True)
#: Words of digits, letters and all beyond ASCII, A-Z lower-cased.
ALNUM = _table(bytes(b for b in range(128) if not chr(b).isalnum()), True)

BLOCK = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _grown(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        _powers[:] = [np.multiply.accumulate(np.concatenate(
            [np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_STEP, _BACK)]
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass
class Block:
    """Some texts: ``raw`` is their mapped bytes, words lie at start:end of it.

    Words of text i are first[i]:first[i + 1]; at[i] is where text i begins in ``raw``.
    """

    raw: bytes
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i]:self.end[i]]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, computed about a megabyte at a time."""
        out = np.empty(len(self.start), np.uint64)
        bytes_ = np.frombuffer(self.raw, np.uint8)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + BLOCK, "right")))
            low = int(self.start[i])
            part = bytes_[low:int(self.end[j - 1])]
            power, back = _grown(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTES[part] * power[:len(part)], out=sums[1:])
            s, e = self.start[i:j] - low, self.end[i:j] - low
            out[i:j] = mixed((sums[e] - sums[s]) * back[s])
            i = j
        return out


def split(raw: bytes, at: np.ndarray) -> Block:
    edge = np.diff(np.frombuffer(raw, np.uint8) != 32, prepend=False, append=False)
    cuts = np.flatnonzero(edge)
    start, end = cuts[::2], cuts[1::2]
    first = np.append(np.searchsorted(start, at), len(start))
    return Block(raw, at, start, end, first)


def blocks(texts: pa.Array, table: bytes) -> Iterator[Block]:
    """All texts in order, nulls as empty ones; a text is never cut."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        one = (text.as_py() or "").encode()
        held.append(one)
        size += len(one) + 1
        if size >= BLOCK:
            yield _joined(held, table)
            held, size = [], 0
    if held:
        yield _joined(held, table)


def _joined(held: list[bytes], table: bytes) -> Block:
    at = np.cumsum([0, *(len(x) + 1 for x in held[:-1])])
    return split(b"\n".join(held).translate(table), at)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of ``size`` words; of all words where there are fewer."""
    size = min(size, len(words))
    if not size:
        return words
    out = np.zeros(len(words) - size + 1, np.uint64)
    factor = _grown(size + 1)[0]
    for k in range(size):
        out += words[k:len(words) - size + 1 + k] * factor[k + 1]
    return mixed(out)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
