"""Profiles of token lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import tokens as tk


def length_profile(df: DataFrame, length: Column, by: list[str] = ()) -> DataFrame:
    """n, mean, median, p95, p99 (both cut to whole numbers), max, and a suggested maximum: p95 + 7 cut to a whole number, then down to a multiple of 8."""
    q = F.percentile("len", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    agg = df.select(*by, length.alias("len")).groupBy(*by).agg(F.count("*").alias("n"), F.avg("len").alias("mean"), q.alias("q"), F.max("len").cast("long").alias("max"))
    return agg.select(
        *by, "n", F.round("mean", 6).alias("mean"), F.col("q")[0].alias("median"), F.col("q")[1].cast("long").alias("p95"), F.col("q")[2].cast("long").alias("p99"), "max",
        F.expr("cast(q[1] + 7 as bigint) div 8 * 8").alias("suggested"),
    )


def tokenized_stats(df: DataFrame, by: list[str] = (), has_labels: bool = True) -> DataFrame:
    """n, and least, greatest and mean of effective input lengths and of label lengths."""
    measures = [("input", tk.effective_length(F.col("attention_mask")))] + ([("label", tk.label_length(F.col("labels")))] if has_labels else [])
    cols = df.select(*by, *(c.cast("long").alias(n) for n, c in measures))
    aggs = [f(n).alias(f"{n}_{k}") for n, _ in measures for k, f in (("min", F.min), ("max", F.max), ("avg", lambda c: F.round(F.avg(c), 6)))]
    return cols.groupBy(*by).agg(F.count("*").alias("n"), *aggs)
