"""JSON array files of any size, read in splits: elements with their positions, wherever a split begins.

A file is read as text that ends at commas, so splits begin behind a comma, as lines do behind a line break. A comma parts two elements if it stands outside a string and
inside one bracket; what a split has before its first byte decides both. A first pass therefore says of each split what it means for the
ones behind it: whether it has an odd number of quotes, by how much it changes the depth if it begins outside a string and if it
begins inside one, and how many commas it has at each depth (counted from its own beginning). A running sum over the splits of a file gives the state in
which each begins and the number of its first element. The second pass cuts each split into elements; an element that lies in several splits is put together from its pieces.

Valid JSON is assumed: a comma is never escaped, and backslashes stand in strings only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ESCAPED = re.compile(r"\\.", re.DOTALL)


def _outside(fragment: str) -> tuple[bool, tuple[int, int]]:
    """Whether a fragment has an odd number of quotes, and its change of depth if it begins outside and if inside a string."""
    parts = _ESCAPED.sub("", fragment).split('"')
    change = lambda xs: sum(x.count("[") + x.count("{") - x.count("]") - x.count("}") for x in xs)
    return len(parts) % 2 == 0, (change(parts[::2]), change(parts[1::2]))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, at, odd, depth_out, depth_in, commas_out, commas_in) of each split; commas: depth -> how many, as lists of pairs."""
    seen: dict[tuple[str, int], list] = {}
    for batch in batches:
        for text, file, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
            mine = seen.setdefault((file, at), [False, [0, 0], (Counter(), Counter())])
            odd, changes = _outside(text)
            for k in (0, 1):  # begun outside, inside a string
                inside = mine[0] ^ bool(k)
                mine[1][k] += changes[inside]
                if not inside ^ odd:
                    mine[2][k][mine[1][k]] += 1
            mine[0] ^= odd
    columns = list(zip(*((file, at, odd, *depth, *(list(c.items()) for c in commas)) for (file, at), (odd, depth, commas) in seen.items()))) or [[]] * 7
    counts = pa.map_(pa.int32(), pa.int64())
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), counts, counts]
    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "at", "odd", "depth_out", "depth_in", "commas_out", "commas_in"])


_SUMMARY = "file string, at bigint, odd boolean, depth_out int, depth_in int, commas_out map<int,bigint>, commas_in map<int,bigint>"
_PIECE = "file string, at bigint, pos bigint, whole boolean, last boolean, value string"


def _cut(base: int):
    """Pieces of elements, of rows (value, file, at, inside, depth, first) in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, depth, pos, held, begun = None, False, 0, 0, [], False

        def closed(whole: bool) -> tuple:
            return (*now, pos, whole and begun, whole and depth == 0, "".join(held))

        for batch in batches:
            out = []
            for text, file, at, inside0, depth0, first in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (file, at) != now:
                    if held:
                        out.append(closed(False))
                    now, inside, depth, pos, held, begun = (file, at), inside0, depth0, first, [], at == 0
                odd, changes = _outside(text)
                depth += changes[inside]
                inside ^= odd
                held.append(text)
                if not inside and 0 <= depth <= base:
                    out.append(closed(True))
                    pos, held, begun = pos + 1, [], True
                else:
                    held.append(",")
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        if held:
            yield pa.record_batch([pa.array([x], t) for x, t in zip(closed(False), types)], names=names)

    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    names = ["file", "at", "pos", "whole", "last", "value"]
    return run


def pieces(spark: SparkSession, path: str, base: int = 1) -> DataFrame:
    """(file, pos, last, value): what stands between the commas of a file that are inside at most `base` brackets, with outer brackets and blanks left on; last: the file ends there."""
    rows = spark.read.option("lineSep", ",").text(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("place"))
    splits = rows.select("value", "file", "at").mapInArrow(_summaries, _SUMMARY)
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    splits = splits.withColumn("inside", start(F.col("odd").cast("int")) % 2 == 1)
    splits = splits.withColumn("depth", start(F.when(F.col("inside"), F.col("depth_in")).otherwise(F.col("depth_out"))).cast("int"))
    commas = F.when(F.col("inside"), F.col("commas_in")).otherwise(F.col("commas_out"))
    closing = sum((F.coalesce(F.try_element_at(commas, F.lit(d) - F.col("depth")), F.lit(0)) for d in range(base + 1)), F.lit(0))
    splits = splits.withColumn("first", start(closing)).select("file", "at", "inside", "depth", "first")
    known = rows.join(splits, ["file", "at"]).sortWithinPartitions("file", "at", "place").select("value", "file", "at", "inside", "depth", "first")
    cut = known.mapInArrow(_cut(base), _PIECE)
    parts = F.array_sort(F.collect_list(F.struct("at", "value")))
    joined = cut.where("not whole").groupBy("file", "pos").agg(F.max("last").alias("last"), F.array_join(F.transform(parts, lambda x: x["value"]), "").alias("value"))
    return cut.where("whole").select("file", "pos", "last", "value").unionByName(joined)


def _stripped(c) -> Column:
    return F.regexp_replace(c, "\\A\\s+|\\s+\\z", "")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, value): the elements of JSON array files as JSON text, each with its position."""
    found = pieces(spark, path).withColumn("value", _stripped("value"))
    found = found.withColumn("value", F.when(F.col("pos") == 0, F.substr("value", F.lit(2))).otherwise(F.col("value")))
    found = found.withColumn("value", F.when(F.col("last"), F.substr("value", F.lit(1), F.length("value") - 1)).otherwise(F.col("value")))
    return found.select("file", "pos", _stripped("value").alias("value")).where("value <> '' or pos > 0")


def read_columns(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """(file, pos, one column of JSON text for each name) of files that hold one object of arrays; null where an array is missing or too short.

    The keys are gathered on the driver: one for each array of each file.
    """
    found = pieces(spark, path, base=2).withColumn("value", _stripped("value"))
    # escapes blanked out, by as many characters: a group that repeats over what a string holds would take a stack frame for each of its characters
    blank = F.regexp_replace("value", "(?s)\\\\.", "\u0001\u0001")
    head = '\\s*"([^"]*+)"\\s*:\\s*\\[\\s*'
    named = lambda group: F.when(F.col("pos") == 0, F.regexp_extract(blank, f"\\A\\{{{head}", group)).otherwise(F.regexp_extract(blank, f"\\A{head}", group))
    found = found.withColumn("head", F.length(named(0)))
    keys = found.where("head > 0").select("file", "pos", named(1).alias("key"))
    span = keys.withColumn("until", F.lead("pos", 1, 1 << 62).over(Window.partitionBy("file").orderBy("pos"))).where(F.col("key").isin(*names))
    span = span.select(F.col("file").alias("file_"), F.col("pos").alias("begin"), "until", "key")
    on = (F.col("file") == F.col("file_")) & (F.col("pos") >= F.col("begin")) & (F.col("pos") < F.col("until"))
    rows = found.join(F.broadcast(span), on)  # a row for each name and file
    bare = F.when(F.col("pos") == F.col("begin"), F.substr("value", F.col("head") + 1)).otherwise(F.col("value"))
    closed = F.when(F.col("pos") == F.col("until") - 1, True).otherwise(F.col("last"))
    bare = F.when(closed, F.regexp_replace(bare, "\\s*\\]\\s*\\}?\\z", "")).otherwise(bare)
    rows = rows.select("file", (F.col("pos") - F.col("begin")).alias("pos"), "key", bare.alias("value")).where("value <> ''")
    return rows.groupBy("file", "pos").agg(*(F.first(F.when(F.col("key") == n, F.col("value")), ignorenulls=True).alias(n) for n in names))
