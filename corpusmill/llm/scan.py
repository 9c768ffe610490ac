"""Exclusive prefix scans of associative summaries, as rounds of bounded windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import materialise

#: Rows that one window takes at most for each key; a scan of n positions takes log n to this base rounds.
FAN = 64


def exclusive_scan(parts: DataFrame, keys: list[str], pos: str, kinds: dict[str, str], n: int) -> DataFrame:
    """parts with a column c_before for each c of kinds: the combination of c over the rows of the same keys with a smaller pos.

    parts has at most one row for each (keys, pos), pos from 0 to n - 1; no key is null. Kind "sum" adds up (0 where nothing stands before), kind "last" takes the
    last value that isn't null (null where there is none). Blocks of FAN positions are combined, their totals are scanned in the same way, and what
    a block has before it is handed down to its rows, so no window has more than FAN rows, however many positions a key has.
    """
    block = f"{pos}_block"
    blocks = parts.withColumn(block, F.floor(F.col(pos) / FAN).cast("long"))
    before = Window.partitionBy(*keys, block).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    local = {f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) if kind == "sum" else F.last(c, ignorenulls=True).over(before) for c, kind in kinds.items()}
    out = blocks.withColumns(local)
    if n <= FAN:
        return out.drop(block)
    total = [(F.sum(c) if kind == "sum" else F.max_by(c, F.when(F.col(c).isNotNull(), F.col(pos)))).alias(c) for c, kind in kinds.items()]
    totals = materialise(blocks.groupBy(*keys, block).agg(*total), "scan-totals")
    carried = exclusive_scan(totals, keys, block, kinds, -(-n // FAN)).select(*keys, block, *(F.col(f"{c}_before").alias(f"{c}_carried") for c in kinds))
    out = out.join(carried.hint("shuffle_hash"), [*keys, block])
    both = {f"{c}_before": F.col(f"{c}_carried") + F.col(f"{c}_before") if kind == "sum" else F.coalesce(f"{c}_before", f"{c}_carried") for c, kind in kinds.items()}
    return out.withColumns(both).drop(block, *(f"{c}_carried" for c in kinds))
