"""Token ids of a public byte-level vocabulary.

Ids are those of ``tokenizers`` with the vocabulary file; ``tiktoken`` encodes the same
vocabulary several times as fast, so it does, save texts that spell out a special token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"


@cache
def _fast(name: str):
    import public_tokenizers as public
    import tiktoken
    with open(public.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _full(name: str):
    import public_tokenizers as public
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public.path(f"{name}.json"))


def encode(text: str, name: str = VOCABULARY) -> np.ndarray:
    if SPECIAL in text:
        return np.array(_full(name).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(_fast(name).encode_ordinary(text), np.uint32)


def encoded(texts: pa.Array, name: str = VOCABULARY) -> Iterator[np.ndarray]:
    """Ids of each text; a null is an empty text."""
    for x in texts:
        yield encode(x.as_py() or "", name)
