"""Byte-level BPE by pre-tokens.

A text is first cut at white space into chunks over which BPE never merges:
an optional space with a run of other characters, or a run of white space.
Pre-tokens never cross a chunk, so a text's pre-tokens are those of its chunks.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import tiktoken

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(rf" ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


@lru_cache(2)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    """vocabulary: the path of a file of ranks, one base64 token and its rank a line."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
