"""Words of a whole Arrow column of texts as 64-bit hashes, with NumPy over its bytes.

A few passes over the bytes of a block replace a Python object for each word. Blocks bound the memory; they are cut
between words, so neither the number nor the length of the texts matters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

#: ASCII lower case; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between ASCII white space, and of words of letters a-z, digits and all that isn't ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64, up to the n-th at least."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins and the last ends; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _blocks(data: np.ndarray, inside: np.ndarray, firsts: np.ndarray):
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + BLOCK)
        if end < n:
            gaps = np.flatnonzero(~inside[data[at:end]])
            k = np.searchsorted(firsts, end, "right") - 1  # a text that begins here parts words, too
            cut = max(at + int(gaps[-1]) + 1 if len(gaps) else at, int(firsts[k]) if k >= 0 else at)
            while cut <= at:  # a word longer than a block
                more = np.flatnonzero(~inside[data[end : end + BLOCK]])
                after = int(firsts[k + 1]) if k + 1 < len(firsts) else n
                stop = end + int(more[0]) if len(more) else min(n, end + BLOCK)
                end = min(stop, after)
                if len(more) or end in (after, n):
                    cut = end
            end = cut
        yield at, end
        at = end


def hash_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word, and the range of words of each text."""
    firsts = np.unique(offsets[:-1])
    hashes, starts, ends = [], [], []
    for a, b in _blocks(data, inside, firsts):
        block = data[a:b]
        word = inside[block]
        cuts = firsts[np.searchsorted(firsts, a, "left") : np.searchsorted(firsts, b, "left")] - a
        before = np.empty_like(word)
        before[0], before[1:] = False, word[:-1]
        before[cuts] = False
        after = np.empty_like(word)
        after[-1], after[:-1] = False, word[1:]
        after[cuts[cuts > 0] - 1] = False
        s, e = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        up, down = powers(len(block) + 1)
        total = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((LOWER[block].astype(np.uint64) + np.uint64(1)) * up[: len(block)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        starts.append(s + a)
        ends.append(e + a)
    joined = [np.concatenate(x) if x else np.empty(0, k) for x, k in ((hashes, np.uint64), (starts, np.int64), (ends, np.int64))]
    return *joined, np.searchsorted(joined[1], offsets)
