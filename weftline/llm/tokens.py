"""Token counts of texts under a public byte-level BPE tokenizer read from a file."""

from __future__ import annotations

import base64
import importlib
import re
from functools import lru_cache

import tiktoken

#: Rank file of the default tokenizer, and where its splitting pattern is kept; both are parameters of the operators.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN_MODULE = "public_tokenizers"
#: Texts longer than this are encoded in parts that end where the tokenizer's own splitting ends a word anyway.
PART = 50_000
_SEAM = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


@lru_cache(maxsize=4)
def encoding(ranks: str = RANKS, pattern: str | None = None) -> tiktoken.Encoding:
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=pattern or importlib.import_module(PATTERN_MODULE).PATTERN, mergeable_ranks=merges, special_tokens={})


def count(text: str | None, enc: tiktoken.Encoding) -> int:
    if not text:
        return 0
    if len(text) <= PART:
        return len(enc.encode_ordinary(text))
    total, at = 0, 0
    while len(text) - at > PART:
        seam = _SEAM.search(text, at + PART)
        if seam is None:
            break
        total += len(enc.encode_ordinary(text[at : seam.start()]))
        at = seam.start()
    return total + len(enc.encode_ordinary(text[at:]))
