"""Arrays of integers as bytes, for rows that carry many of them through a shuffle."""

from __future__ import annotations

import numpy as np
import zstandard

_KINDS = (np.uint8, np.uint16, np.uint32, np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Differences of neighbours, signs folded in, in the narrowest type, compressed."""
    if not len(values):
        return b""
    steps = np.diff(values.astype(np.int64, copy=False), prepend=np.int64(0))
    folded = ((steps << 1) ^ (steps >> 63)).view(np.uint64)
    kind = int(np.searchsorted([2**8, 2**16, 2**32], int(folded.max()), "right"))
    return bytes([kind]) + zstandard.ZstdCompressor(level=1).compress(folded.astype(_KINDS[kind]).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, np.int64)
    folded = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), _KINDS[raw[0]]).astype(np.uint64)
    steps = (folded >> np.uint64(1)).view(np.int64) ^ -(folded & np.uint64(1)).view(np.int64)
    return np.cumsum(steps)


def runs(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal neighbours begins, and how long it is."""
    first = np.flatnonzero(np.diff(labels, prepend=labels[:1] - 1) != 0) if len(labels) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(labels)))
