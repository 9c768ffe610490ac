"""Best-two-fit packing of tokenised documents into sequences of fixed length.

A bin is filled greedily with the largest piece that still fits; then its smallest piece is replaced by two unpacked
pieces if these fit the expanded gap more tightly. Pieces of equal length are interchangeable, so the packing is decided on the
histogram of lengths: at most `capacity` numbers, whatever the corpus. A bin's filling is a pattern of lengths,
applied as often as the histogram allows before a choice would change, which gives what bin-by-bin packing gives. The patterns (a few thousand
rows at most) are then dealt to the pieces: piece number r of its length gets the sequence and offset that the plan has for (length, r).

Numbers within a length come from the task that cut the piece (its number among the task's pieces of that length) and
the running counts of tasks before it, so nothing is sorted and a length that a third of all pieces share sits in no single task.
The pieces are written to the shared folder first: numbers given once stay, whichever executors are lost later.

Defined cases: a null text counts as empty and an empty text is the end token alone; equal documents are packed each; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusmill.llm.common import materialise

CAPACITY = 1024
END_ID = 2


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all but the first have capacity tokens."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def plan(counts, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a bin) and how often each is used, for counts[length] pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    left[: len(counts)] = counts
    sizes = np.arange(capacity + 1)
    out = []
    while left.any():
        greedy = np.zeros_like(left)
        gap = capacity
        while gap and len(fit := np.flatnonzero(left[: gap + 1] > greedy[: gap + 1])):
            size = int(fit[-1])
            take = min(gap // size, int(left[size] - greedy[size]))
            greedy[size] += take
            gap -= take * size
        final = greedy.copy()
        smallest = int(np.flatnonzero(greedy)[0])
        if gap:
            free = left - greedy
            room = gap + smallest
            below = np.maximum.accumulate(np.where(free > 0, sizes, 0))  # the largest free size up to each
            a = np.flatnonzero(free[: room + 1] > 0)
            b = below[np.minimum(a, room - a)]
            same = (b == a) & (free[a] < 2)
            b = np.where(same, below[np.maximum(a - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            if len(a) and total.max() > smallest:
                k = int(np.flatnonzero(total == total.max())[-1])
                final[smallest] -= 1
                final[a[k]] += 1
                final[b[k]] += 1
        used = np.flatnonzero(final)
        need = np.maximum(greedy, final)
        times = 1 + min(int((left[s] - need[s]) // final[s]) for s in used)
        left -= times * final
        out.append(([int(s) for s in used[::-1] for _ in range(final[s])], times))
    return out


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end, first sequence, pieces of that length in each sequence, offset) for runs of equal lengths."""
    out, given, base = [], {}, 0
    for lengths, times in patterns:
        offset, i = 0, 0
        while i < len(lengths):
            size = lengths[i]
            each = lengths.count(size)
            r = given.get(size, 0)
            out.append((size, r, r + each * times, base, each, offset))
            given[size] = r + each * times
            offset += size * each
            i += each
        base += times
    return out


def _cutter(capacity: int, end_id: int, vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from corpusmill.llm.tokens import encoder

        encode, task = encoder(vocabulary), TaskContext.get().partitionId()
        numbers = np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                owner, rows, ids = [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    own = np.array([*encode(text or ""), end_id], "<u4")
                    for k, (start, length) in enumerate(cut(len(own), capacity)):
                        owner.append(i)
                        rows.append((k, start, length, int(numbers[length])))
                        ids.append(own[start : start + length].tobytes())
                        numbers[length] += 1
                piece, start, length, number = map(list, zip(*rows)) if rows else ([], [], [], [])
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(rows), pa.int64()), pa.array(number, pa.int64())],
                    names=["id", "piece", "start", "length", "ids", "task", "number"],
                )

    return run


def tokenized_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Each document's IDs and the end ID, cut into pieces: id, piece, start, length, ids (little-endian unsigned 32-bit), task, number."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return materialise(src.mapInArrow(_cutter(capacity, end_id, vocabulary), f"id {kind}, piece int, start bigint, length bigint, ids binary, task bigint, number bigint"), "pieces")


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset in place of task and number. pieces: materialised, any further columns."""
    spark = pieces.sparkSession
    each = materialise(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[r.length] = r.n
    fields = ("length", "low", "high", "base", "each", "at")
    dealt = spark.createDataFrame(slots(plan(counts, capacity)), T.StructType([T.StructField(f, T.LongType()) for f in fields]))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = each.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["task", "length"]).withColumn("rank", F.col("first") + F.col("number"))
    found = ranked.join(F.broadcast(dealt), "length").where("rank >= low and rank < high")  # a few thousand rows: bounded by capacity
    return found.select(
        *(c for c in pieces.columns if c not in ("task", "number")),
        F.expr("base + (rank - low) div each").alias("sequence_id"), F.expr("at + length * ((rank - low) % each)").alias("offset"),
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, piece, start, length, ids, sequence_id, offset: the packed corpus, a row for each piece."""
    return assign(tokenized_pieces(docs, id_col, text_col, **options), options.get("capacity", CAPACITY))


def op2_best_fit_packing(docs: DataFrame) -> DataFrame:
    pieces = tokenized_pieces(docs.select("doc_id", "text"))
    # only the digest of the IDs moves on; the IDs stay where they were written
    packed = assign(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
