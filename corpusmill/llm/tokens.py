"""Token IDs by the public byte-level BPE vocabulary; the vocabulary's path is a parameter."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

VOCABULARY = "byte_bpe_50k.tiktoken"

#: A run of white space from which on texts go to `tokenizers`: tiktoken's pattern overflows the stack on a million.
LONG_RUN = 100_000
SPACES = re.compile(r"\s+")


@lru_cache(maxsize=4)
def encoder(path: str | None = None):
    """encode(text) -> list of IDs, those of the `tokenizers` file beside the ranks file. tiktoken over the ranks gives them
    at several times its speed. The file's added tokens are one ID each wherever they stand; texts with
    a very long run of white space are encoded by `tokenizers` itself."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path(VOCABULARY)
    whole = path.removesuffix(".tiktoken") + ".json"
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    with open(whole, encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    ranks = {k: v for k, v in ranks.items() if v not in added.values()}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in SPACES.finditer(text)):
            return _slow(whole).encode(text, add_special_tokens=False).ids
        if any(t in text for t in added):
            return fast.encode(text, allowed_special="all")
        return fast.encode_ordinary(text)

    return encode


@lru_cache(maxsize=4)
def _slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
