"""Corpus preparation: length gate, prompts, indices shared by models, tokenization. Splits are a column, never a loop.

SYSTEM and INSTRUCTION are defaults of a configuration; a user brings their own.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import text as tx
from corpusmill.functions import tokens as tk

SYSTEM = "You write Java tests. Answer with source code only."
INSTRUCTION = "Write one JUnit 4 test in a public class named GeneratedTest, with the imports it needs, for this code:\n"
MAX_CONTEXT, RESERVED = 4096, 512

#: Registered transforms: name -> function(df, tokenizer, **options) -> df.
PROCESSING: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def put(f):
        PROCESSING[name] = f
        return f

    return put


def lookup(name: str) -> Callable[..., DataFrame]:
    if name not in PROCESSING:
        raise ValueError(f"no function is registered as {name!r}; there are {', '.join(sorted(PROCESSING))}")
    return PROCESSING[name]


def resolve(config: dict, key: str, default: dict[str, str]) -> dict[str, str]:
    """Function name for each split: config[key] by split, over one name for all in config[key without its plural s], over defaults."""
    single = config.get(key.removesuffix("s"))
    named = config.get(key) or {}
    return {split: named.get(split) or single or name for split, name in default.items()}


def instruction_length(df: DataFrame, tokenizer, instruction: str) -> int:
    """Tokens of the instruction, counted once."""
    return df.sparkSession.range(1).select(tokenizer.count(F.lit(instruction)).alias("n")).first().n


def length_gate(df: DataFrame, tokenizer, source_col: str = "src", instruction: str = INSTRUCTION, max_context: int = MAX_CONTEXT, reserved: int = RESERVED, also: int = 0) -> DataFrame:
    """Rows whose instruction and source together fit what the reserved answer leaves of the context; equality fits.

    also: tokens of whatever else a strict gate counts (system text, template). Row indices keep their gaps.
    """
    fixed = instruction_length(df, tokenizer, instruction) + also
    return df.where(tokenizer.count(F.col(source_col)) <= max_context - reserved - fixed)


def gate_counts(df: DataFrame, tokenizer, by: list[str], limit: int, source_col: str = "src") -> DataFrame:
    fits = tokenizer.count(F.col(source_col)) <= limit
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(fits).alias("kept"), F.count_if(~fits).alias("skipped"))


def _prompts(df: DataFrame, tokenizer, with_target: bool, source_col: str = "src", target_col: str = "target", system: str = SYSTEM, instruction: str = INSTRUCTION, dialect: str = "chatml", **gate) -> DataFrame:
    """prompt and idx, and a reference where there is a target; columns idx and split are carried."""
    target = F.col(target_col).cast("string") if target_col in df.columns else F.lit(None).cast("string")
    kept = length_gate(df, tokenizer, source_col, instruction, **gate)
    prompt = tx.chat_prompt(F.col(source_col), target if with_target else None, system, instruction, dialect)
    return kept.select(prompt.alias("prompt"), "idx", *(["split"] if "split" in df.columns else []), target.alias("reference"))


@register("prompts_with_target")
def prompts_with_target(df: DataFrame, tokenizer, **options) -> DataFrame:
    return _prompts(df, tokenizer, True, **options)


@register("prompts_only")
def prompts_only(df: DataFrame, tokenizer, **options) -> DataFrame:
    return _prompts(df, tokenizer, False, **options)


@register("tokenize")
def tokenize(df: DataFrame, tokenizer, max_input_len: int, side: str = "right", prompt_col: str = "prompt") -> DataFrame:
    """input_ids, attention_mask, labels; other columns stay."""
    out = tokenize_for_inference(df, tokenizer, max_input_len, side, prompt_col)
    real = F.zip_with("input_ids", "attention_mask", lambda t, m: F.when(m == 0, tk.IGNORED).otherwise(t).cast("int"))
    return out.withColumn("labels", real)


@register("tokenize_for_inference")
def tokenize_for_inference(df: DataFrame, tokenizer, max_input_len: int, side: str = "right", prompt_col: str = "prompt") -> DataFrame:
    ids = df.withColumn("raw_ids", tokenizer.ids(F.col(prompt_col)))
    padded = ids.withColumns({"input_ids": tk.pad(F.col("raw_ids"), max_input_len, tokenizer.pad_id, side), "attention_mask": tk.attention_mask(F.col("raw_ids"), max_input_len, side)})
    return padded.drop("raw_ids")


# --- fairness --------------------------------------------------------------------------------------------------------


def shared_index(kept: DataFrame, models: int | None = None) -> DataFrame:
    """(split, idx) that every model kept, of (model, split, idx): one aggregation, however many models there are."""
    n = kept.select("model").distinct().count() if models is None else models
    return kept.groupBy("split", "idx").agg(F.count_distinct("model").alias("n")).where(F.col("n") == n).select("split", "idx")


def shared_index_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.intersect, [f.select("split", "idx") for f in frames])


def fairness_filter(df: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows of df with a shared index. A split that shares none keeps all of its rows, with a warning, as an empty set
    stands for a missing registry and not for an empty corpus."""
    some = shared.select("split").distinct()
    empty = [r.split for r in df.select("split").distinct().join(some, "split", "left_anti").collect()]  # names of splits
    if empty:
        warnings.warn(f"no shared indices for {', '.join(map(str, empty))}: all rows are kept", stacklevel=2)
    hit = df.join(shared, ["split", "idx"], "left_semi")
    return hit.unionByName(df.where(F.col("split").isin(empty))) if empty else hit


def kept_percent(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after for each split, and the percentage kept (0 of none)."""
    count = lambda df, name: df.groupBy("split").agg(F.count("*").alias(name))
    both = count(before, "n_before").join(count(after, "n_after"), "split", "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)).cast("long"))
    return both.withColumn("pct", F.when(F.col("n_before") > 0, F.round(F.col("n_after") * F.lit(100.0).cast("double") / F.col("n_before"), 6)).otherwise(F.lit(0.0)))


#: First rows up to so many are picked by heaps, one for each partition; more are cut off at an index that counts find.
HEAP_ROWS = 10_000
CELLS = 1024


def first_rows(df: DataFrame, n: int | None, by: str = "idx") -> DataFrame:
    """The n rows with the least index (all if there are fewer), whatever gaps the index has: the same on every run if no index repeats.

    Nothing is sorted as a whole. Rows without an index come last and are taken only if the others don't suffice.
    """
    if n is None:
        return df
    if n <= HEAP_ROWS:
        return df.orderBy(F.col(by).asc_nulls_last()).limit(n)
    last = nth_index(df, n, by)
    if last is None:  # fewer rows with an index than asked for
        return df.where(F.col(by).isNotNull()).unionByName(df.where(F.col(by).isNull()).limit(n - df.where(F.col(by).isNotNull()).count()))
    below = df.where(F.col(by) < last)
    return below.unionByName(df.where(F.col(by) == last).limit(n - below.count()))


def nth_index(df: DataFrame, n: int, by: str = "idx") -> int | None:
    """The n-th least index, by counts in ever smaller cells: CELLS numbers a round, as many rounds as the range has digits to that base."""
    low, high, there = df.agg(F.min(by), F.max(by), F.count(by)).first()
    if there < n:
        return None
    left = n
    while low < high:
        size = -(-(high - low + 1) // CELLS)
        cell = F.floor((F.col(by).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(size).cast("decimal(20,0)")).cast("int")
        counts = {r.cell: r["count"] for r in df.where(F.col(by).between(low, high)).groupBy(cell.alias("cell")).count().collect()}
        at = 0
        while left > counts.get(at, 0):
            left -= counts.get(at, 0)
            at += 1
        low, high = low + at * size, min(high, low + (at + 1) * size - 1)
    return low


def with_index(df: DataFrame, order: list[Column | str] | None = None) -> DataFrame:
    """df with a dense idx from 0: places in the files as read, or in the given order.

    A row's number is its place in its partition plus the rows of the partitions before it; only one count for each
    partition is gathered. Rows of the source must come the same way twice, as they do from files or a sort by a key.
    """
    inside = (1 << 33) - 1
    src = (df.orderBy(*order) if order else df).withColumn("place_", F.monotonically_increasing_id())
    src = src.withColumns({"part_": F.shiftright("place_", 33), "place_": F.col("place_").bitwiseAND(inside)})
    before = F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    firsts = src.groupBy("part_").agg(F.count("*").alias("n_")).select("part_", F.coalesce(before, F.lit(0)).alias("first_"))
    numbered = src.join(firsts, "part_").withColumn("idx", F.col("first_") + F.col("place_"))
    return numbered.drop("part_", "place_", "first_")
