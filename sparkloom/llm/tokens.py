"""Byte-level BPE ids from a public vocabulary file."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: Splits text ahead of the merges; fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = "<|endoftext|>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def word_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(4)
def load(path: str):
    """The vocabulary as an encoder, once for each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


def encode(model, text: str, special: bool = True) -> np.ndarray:
    """Ids of a text; with ``special``, the end-of-text string is its own id."""
    if special:
        return model.encode_to_numpy(text, allowed_special="all")
    return model.encode_to_numpy(text, disallowed_special=())
