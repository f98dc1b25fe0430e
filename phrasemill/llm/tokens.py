"""Token ids of a public byte-level BPE vocabulary, as little-endian uint16.

The vocabulary's path is a parameter; nothing of it is kept here.
"""

from __future__ import annotations

import base64

import numpy as np

from .common import kept

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256  # free in the vocabulary; it fills what a sequence has left
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(path: str):
    """The tiktoken encoding; one for each process."""

    def make():
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    return kept(f"encoding {path}", make)


def encoder(path: str = VOCABULARY):
    """A function from a text to its ids as bytes."""
    encode = encoding(path).encode_to_numpy

    def ids(text: str) -> bytes:
        return encode(text, disallowed_special=()).astype("<u2").tobytes() if text else b""

    return ids


def decode(ids: bytes, path: str = VOCABULARY) -> str:
    return encoding(path).decode(np.frombuffer(ids, "<u2").tolist())
