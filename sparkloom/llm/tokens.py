"""Token ids by a public byte-level BPE vocabulary whose file is a parameter."""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that the vocabulary was made with: contractions, letters, digits, other signs, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, tiktoken.Encoding] = {}


def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The encoding in this file, one token a line: base64 and id; loaded once a process."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_lists(column: pa.Array, path: str) -> list[list[int]]:
    """The ids of each text; null and empty texts have none."""
    encode = encoding(path).encode_ordinary
    return [encode(t) if t else [] for t in column.to_pylist()]


def flat_tokens(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and the n + 1 offsets of the texts."""
    lists = token_lists(column, path)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(offsets[-1])), offsets
