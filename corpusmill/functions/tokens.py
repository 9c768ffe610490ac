"""Tokenizers as columns, and padding, masks and labels.

A tokenizer gives ids(column) -> array<int> and count(column) -> int. WhitespaceTokenizer is native, so gates and
statistics stay inside code generation; any Python tokenizer is wrapped by ArrowTokenizer, in batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


class WhitespaceTokenizer:
    """One token for each run of characters between white space; its ID is a hash into the vocabulary, pad_id apart."""

    def __init__(self, vocabulary: int = 32000, pad_id: int = 0):
        self.vocabulary, self.pad_id = vocabulary, pad_id

    def tokens(self, text: Column) -> Column:
        return F.filter(F.split(text, "\\s+"), lambda t: t != "")

    def ids(self, text: Column) -> Column:
        return F.transform(self.tokens(text), lambda t: (F.pmod(F.crc32(t.cast("binary")), F.lit(self.vocabulary - 1)) + 1).cast("int"))

    def count(self, text: Column) -> Column:
        return F.size(self.tokens(text))


class ArrowTokenizer:
    """A Python tokenizer: encode(list of texts) -> list of ID lists, called once for each Arrow batch. make() builds it on the executor."""

    def __init__(self, make: Callable[[], Callable[[list[str]], list[list[int]]]], pad_id: int = 0):
        self.make, self.pad_id = make, pad_id

    def ids(self, text: Column) -> Column:
        make = self.make
        state: dict = {}

        @F.pandas_udf("array<int>")
        def encode(texts: pd.Series) -> pd.Series:
            if "f" not in state:
                state["f"] = make()
            return pd.Series(state["f"]([t or "" for t in texts]))

        return encode(text)

    def count(self, text: Column) -> Column:
        return F.size(self.ids(text))


def pad(ids: Column, length: int, pad_id: int, side: str = "right") -> Column:
    """ids cut and padded to exactly length."""
    kept = F.slice(ids, 1, length)
    fill = F.array_repeat(F.lit(pad_id), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    return F.concat(kept, fill) if side == "right" else F.concat(fill, kept)


def attention_mask(ids: Column, length: int, side: str = "right") -> Column:
    n = F.least(F.size(ids), F.lit(length))
    ones, zeros = F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n)
    return F.concat(ones, zeros) if side == "right" else F.concat(zeros, ones)


def labels(input_ids: Column, pad_id: int) -> Column:
    """A copy of the IDs in which padding doesn't count towards a loss, token by token."""
    return F.transform(input_ids, lambda t: F.when(t == pad_id, IGNORED).otherwise(t).cast("int"))


def effective_length(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, x: a + x)


def label_length(label_ids: Column) -> Column:
    return F.size(F.filter(label_ids, lambda t: t != IGNORED))


def generated_part(output_ids: Column, padded_width: Column | int, skip: tuple[int, ...] = ()) -> Column:
    """What a model added behind its padded prompt, without special tokens."""
    width = F.lit(padded_width) if isinstance(padded_width, int) else padded_width
    part = F.slice(output_ids, width + 1, F.greatest(F.size(output_ids) - width, F.lit(0)))
    return F.filter(part, lambda t: ~t.isin(list(skip))) if skip else part
