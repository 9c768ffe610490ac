"""Repeated passages of 100 bytes: a content-defined difference cover, sorted names of its samples, recursion on what they leave open, adjacent comparison.

The question is for each byte string of WINDOW bytes (a window) whether it starts earlier, too. Sorting the suffixes of all bytes answers it, but a
classical difference cover (two of three positions) would sort two names for each three bytes of the corpus. Here the cover is chosen by content:

Sample. A position is sampled if among the 8-byte strings inside the SEED bytes from there the least (by hash) is the first or the last. This depends on those bytes alone, and any
REACH + 1 neighbouring positions have a sample. So two equal windows have their first sample at the same offset, as two suffixes meet in a difference
cover, and one position in twenty is sampled. A sample whose seed occurs once in the corpus settles its windows: they occur once.

Names. The windows whose first sample is p form a block. Its name is that of the triple (bytes before the sample, its seed, bytes behind it), which is all that its windows
cover. Names are dealt by ranges, sorted with their places (doc_id, then place), and compared with their neighbours: a block whose name stands before it is a later copy with all its windows.

Recursion. A block that comes first is settled if its core (what all its windows share) has no other name; else its windows may still be copies of parts of other
blocks. Such blocks are cut into blocks of at most STEP windows, named, sorted and compared anew, and what is still open into single windows, which are settled by their own name.

Cost. Only names and places are shuffled, packed into columns of deltas; texts stay where they were written once (a bucketed table in the shared folder, a bucket for each input
partition), and each round joins its small answers to the buckets in place. A passage that a third of all documents share is sent once for each bucket, so no range is hot.

Names are 64-bit digests. Of 3.5e12 names (100 TB) about 3e5 meet another by chance, one in 1e7.

Defined results: a null text is empty; rows without doc_id come first; rows of the same doc_id are in the table's order; texts of fewer than WINDOW bytes have no
windows. Long texts are cut into overlapping slices. Other columns are ignored whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialise
from corpusmill.llm.words import mix, powers
from corpusmill.sources.scratch import scratch_dir

WINDOW = 100
#: Bytes of a seed, of the strings compared inside it, and how far samples are apart at most.
SEED, GRAM = 54, 8
REACH = SEED - GRAM
#: Windows of a block in the second round.
STEP = 5
#: Rows of a bucket, and bytes that are worked on at once.
BUCKET_ROWS, SLICE = 20_000, 1 << 20
#: A range of names holds those of so many buckets at most, so its size doesn't follow the corpus.
BUCKETS_A_RANGE = 8
SEED_BITS = np.uint64(16)

_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_NO_ID = -(1 << 63)

LATER, CONTESTED, SEEDS = 0, 1, 2
SENT = "kind int, range int, bucket long, a binary, b binary, c binary"
ANSWER = "bucket long, level int, kind int, a binary"


# --- numbers as bytes that compress well ------------------------------------------------------------------------------


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """64-bit numbers by byte planes, of their differences if they rise."""
    x = x.astype(np.uint64)
    if rising and len(x):
        x = np.diff(x, prepend=np.uint64(0))
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes, rising: bool = False) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)
    return np.cumsum(x, dtype=np.uint64) if rising else x


def among(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x


def firsts(x: np.ndarray) -> np.ndarray:
    """True where a value stands for the first time."""
    out = np.zeros(len(x), bool)
    out[np.unique(x, return_index=True)[1]] = True
    return out


# --- a bucket's blocks -------------------------------------------------------------------------------------------------


class Piece:
    """Some texts (or a slice of one) end to end: data, and for each segment its ends, row, place in its text and range of window starts."""

    def __init__(self, data: np.ndarray, segments: list[tuple[int, int, int, int, int, int]]):
        self.data = data
        self.lo, self.hi, self.row, self.base, self.first, self.last = (np.array(x, np.int64) for x in zip(*segments))

    def digests(self, lo: np.ndarray, hi: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
        """Digests of the bytes from lo to hi, each with a number that must be the same, too."""
        up, down = powers(len(self.data) + 1)
        if not hasattr(self, "sums"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[self.data] * up[: len(self.data)], dtype=np.uint64)])
        tag = (hi - lo).astype(np.uint64) * np.uint64(1 << 20) + np.asarray(salt).astype(np.uint64)
        return mix((self.sums[hi] - self.sums[lo]) * down[lo] + mix(tag + np.uint64(1)))

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions and their segments."""
        n = len(self.data) - SEED + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        grams = mix(np.ndarray((len(self.data) - GRAM + 1,), "<u8", self.data, strides=(1,)).astype(np.uint64))
        least, width = grams, 1
        while 2 * width <= REACH + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = REACH + 1 - width
        least = np.minimum(least[:n], least[rest : rest + n])
        at = np.flatnonzero((grams[:n] == least) | (grams[REACH : REACH + n] == least))
        segment = np.searchsorted(self.lo, at, side="right") - 1
        inside = at + SEED <= self.hi[segment]
        return at[inside], segment[inside]

    def blocks(self):
        """For each sample with windows: its place, segment, and its first and last window."""
        at, segment = self.samples()
        before = np.concatenate([[-1], at[:-1]]) if len(at) else at
        same = np.concatenate([[False], segment[1:] == segment[:-1]]) if len(at) else at.astype(bool)
        lo = np.maximum(np.where(same, before + 1, self.lo[segment]), np.maximum(at - REACH, self.first[segment]))
        hi = np.minimum(at, self.last[segment])
        some = lo <= hi
        return at[some], segment[some], lo[some], hi[some]


def pieces(texts: list[memoryview]):
    """Pieces of about SLICE bytes that together hold all windows of texts once."""
    margin = SEED + REACH + WINDOW
    parts, segments, size = [], [], 0
    for row, text in enumerate(texts):
        n = len(text)
        if n < WINDOW:
            continue
        for a in range(0, n, SLICE):
            lo, hi = max(0, a - margin), min(n, a + SLICE + margin)
            last = min(a + SLICE - 1, n - WINDOW)
            if last < a:
                break
            segments.append((size, size + hi - lo, row, lo, size + a - lo, size + last - lo))
            parts.append(text[lo:hi])
            size += hi - lo
            if size >= SLICE:
                yield Piece(np.frombuffer(b"".join(parts), np.uint8), segments)
                parts, segments, size = [], [], 0
    if parts:
        yield Piece(np.frombuffer(b"".join(parts), np.uint8), segments)


class Bucket:
    """The blocks of a bucket's texts, level by level, and what is known of them."""

    def __init__(self, table: pa.Table, answers: pa.Table):
        table = table.sort_by("row")
        self.ids = table["doc_id"]
        ids = self.ids.cast(pa.int64()).combine_chunks()
        self.order = ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        whole = table["text"].combine_chunks()
        self.texts = [memoryview(x.as_buffer()) if x.is_valid else memoryview(b"") for x in whole]
        self.answers = {}
        for level, kind, a in zip(answers["level"].to_pylist(), answers["kind"].to_pylist(), answers["a"].to_pylist()):
            self.answers.setdefault((level, kind), []).append(unpack(a, rising=True))

    def answer(self, level: int, kind: int) -> np.ndarray:
        return np.sort(np.concatenate(self.answers.get((level, kind)) or [np.empty(0, np.uint64)]))

    def level0(self):
        self.found = []
        for piece in pieces(self.texts):
            at, segment, lo, hi = piece.blocks()
            seed = piece.digests(at, at + SEED, 0) >> SEED_BITS
            self.found.append((piece, at, segment, lo, hi, seed, piece.digests(lo, hi + WINDOW, (at - lo) * 64 + hi - lo)))
            del piece.sums
        join = lambda k: np.concatenate([x[k] for x in self.found]) if self.found else np.empty(0, np.uint64)
        return join(5), join(6), np.concatenate([x[0].row[x[2]] for x in self.found]) if self.found else np.empty(0, np.int64)

    def settle(self, level: int, core: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(later copies, open): which blocks of a level are copies and which must be cut."""
        first = firsts(name)
        copy = ~first
        copy[self.answer(level, LATER).astype(np.int64)] = True
        return copy, ~copy & among(core, self.answer(level, CONTESTED))

    def cut(self, chosen: np.ndarray, step: int):
        """The chosen blocks of the level before in blocks of `step` windows: core, name and row of each; self.found is replaced."""
        out, begin = [], 0
        for piece, at, segment, lo, hi, *_ in self.found:
            mine = chosen[begin : begin + len(at)]
            begin += len(at)
            at, segment, lo, hi = at[mine], segment[mine], lo[mine], hi[mine]
            low, high = (at - hi) // step, (at - lo) // step
            times = high - low + 1
            g = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at, segment, lo, hi = (np.repeat(x, times) for x in (at, segment, lo, hi))
            end = at - step * g
            lo, hi = np.maximum(lo, end - step + 1), np.minimum(hi, end)
            core = piece.digests(end, end - step + 1 + WINDOW, 1) if len(at) else np.empty(0, np.uint64)
            name = piece.digests(lo, hi + WINDOW, (at - lo) * 64 + hi - lo) if len(at) else core
            if hasattr(piece, "sums"):
                del piece.sums
            out.append((piece, at, segment, lo, hi, core, name))
        self.found = out
        join = lambda k: np.concatenate([x[k] for x in out]) if out else np.empty(0, np.uint64)
        return join(5), join(6), np.concatenate([x[0].row[x[2]] for x in out]) if out else np.empty(0, np.int64)

    def spans(self, copy: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, start, end) of the windows of later copies among the blocks found last."""
        out, begin = [], 0
        for piece, at, segment, lo, hi, *_ in self.found:
            mine = copy[begin : begin + len(at)]
            begin += len(at)
            s = segment[mine]
            shift = piece.base[s] - piece.lo[s]
            out.append(np.stack([piece.row[s], lo[mine] + shift, hi[mine] + WINDOW + shift], axis=1))
        return np.concatenate(out) if out else np.empty((0, 3), np.int64)

    def rounds(self, upto: int):
        """Settles the levels below `upto`; yields the spans of later copies of each, then (core, name, row) of level `upto`."""
        core, name, row = self.level0()
        for level, step in zip(range(upto), (STEP, 1, 1)):
            copy, open_ = self.settle(level, core, name)
            yield self.spans(copy)
            core, name, row = self.cut(open_, step)
        yield core, name, row


# --- rounds ------------------------------------------------------------------------------------------------------------


def _by_range(x: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    return ((x >> np.uint64(bits - 24)) * np.uint64(ranges)) >> np.uint64(24)


def _rows(kind: int, key: np.ndarray, bits: int, ranges: int, bucket: int, *others: np.ndarray):
    """Rows of SENT: sorted keys and what belongs to them, by ranges."""
    order = np.argsort(key, kind="stable")
    key, others = key[order], [x[order] for x in others]
    cuts = np.searchsorted(_by_range(key, ranges, bits), np.arange(ranges + 1))
    for r in np.flatnonzero(cuts[1:] > cuts[:-1]):
        part = slice(cuts[r], cuts[r + 1])
        yield (kind, int(r), bucket, pack(key[part], rising=True), *(pack(x[part]) for x in others), *[b""] * (2 - len(others)))


def _table(rows, ddl_types) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(ddl_types)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(ddl_types, columns)})


_SENT_TYPES = [("kind", pa.int32()), ("range", pa.int32()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
_ANSWER_TYPES = [("bucket", pa.int64()), ("level", pa.int32()), ("kind", pa.int32()), ("a", pa.binary())]


def _send_seeds(ranges: int, table: pa.Table) -> pa.Table:
    bucket = Bucket(table, pa.table({n: pa.array([], t) for n, t in _ANSWER_TYPES}))
    seeds, times = np.unique(bucket.level0()[0], return_counts=True)
    return _table(_rows(SEEDS, seeds, 64 - int(SEED_BITS), ranges, table["bucket"][0].as_py(), (times > 1).astype(np.uint64)), _SENT_TYPES)


def _send(level: int, ranges: int, table: pa.Table, answers: pa.Table) -> pa.Table:
    """Names with their places and cores with their least and greatest name, once for each bucket."""
    if not len(table):
        return _table([], _SENT_TYPES)
    bucket, number = Bucket(table, answers), table["bucket"][0].as_py()
    *_, (core, name, row) = bucket.rounds(level)
    at = np.arange(len(name), dtype=np.uint64)
    if level == 0:
        some = among(core, bucket.answer(-1, SEEDS))
        core, name, row, at = core[some], name[some], row[some], at[some]
    first = firsts(name)
    rows = [*_rows(LATER, name[first], 64, ranges, number, at[first], bucket.order[row[first]].view(np.uint64))]
    if level < 2:
        order = np.lexsort((name, core))
        c, n = core[order], name[order]
        edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.empty(0, np.int64)
        least, most = n[edge], n[np.concatenate([edge[1:], [len(c)]]) - 1] if len(c) else n
        rows += _rows(CONTESTED, c[edge], 64 - int(SEED_BITS) if level == 0 else 64, ranges, number, least, most - least)
    return _table(rows, _SENT_TYPES)


def _compare(level: int, table: pa.Table) -> pa.Table:
    """Answers of a range: seeds that occur twice, names that stand after their like, cores with two names."""
    kind = table["kind"][0].as_py()
    buckets = table["bucket"].to_numpy()
    keys = [unpack(x, rising=True) for x in table["a"].to_pylist()]
    b, c = ([unpack(x) for x in table[n].to_pylist()] for n in ("b", "c"))
    owner = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
    key, b, c = np.concatenate(keys), np.concatenate(b), np.concatenate(c)
    if kind == LATER:
        order = np.lexsort((b, buckets[owner], c.view(np.int64), key))
        later = np.zeros(len(key), bool)
        later[order[1:]] = key[order[1:]] == key[order[:-1]]
        chosen, value = later, b
    else:
        values, where = np.unique(key, return_inverse=True)
        if kind == SEEDS:
            good = np.bincount(where, weights=1 + b.astype(float)) > 1
        else:
            least, most = np.full(len(values), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(values), np.uint64)
            np.minimum.at(least, where, b)
            np.maximum.at(most, where, b + c)
            good = least != most
        chosen, value = good[where], key
    rows = []
    for i in np.unique(owner[chosen]):
        rows.append((int(buckets[i]), level, kind, pack(np.sort(value[chosen & (owner == i)]), rising=True)))
    return _table(rows, _ANSWER_TYPES)


RESULT = "bucket long, doc_id {id}, n_bytes long, starts array<long>, ends array<long>, kept binary"


def _finish(id_type: pa.DataType, table: pa.Table, answers: pa.Table) -> pa.Table:
    types = [("bucket", pa.int64()), ("doc_id", id_type), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())]
    if not len(table):
        return _table([], types)
    bucket, number = Bucket(table, answers), table["bucket"][0].as_py()
    *spans, (core, name, _) = bucket.rounds(2)
    spans.append(bucket.spans(bucket.settle(2, core, name)[0]))
    spans = np.concatenate(spans)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    by_row = np.searchsorted(spans[:, 0], np.arange(len(bucket.texts) + 1))
    rows = []
    for row, (text, doc_id) in enumerate(zip(bucket.texts, bucket.ids.to_pylist())):
        mine = spans[by_row[row] : by_row[row + 1], 1:]
        starts, ends = [], []
        if len(mine):
            reach = np.maximum.accumulate(mine[:, 1])
            new = np.concatenate([[True], mine[1:, 0] > reach[:-1]])
            starts = mine[new, 0].tolist()
            ends = reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(mine) - 1]])].tolist()
        kept = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)]))
        rows.append((number, doc_id, len(text), starts, ends, kept))
    return _table(rows, types)


def stored(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, row, doc_id, text as bytes), a table in the shared folder that is dealt by bucket as it lies there. Its name is gone from the catalog at once, its files with the application."""
    spark = docs.sparkSession
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    bucket = F.spark_partition_id().cast("long") * (1 << 20) + F.floor(at / BUCKET_ROWS)
    rows = docs.select(bucket.alias("bucket"), at.alias("row"), docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    name = f"corpusmill_texts_{uuid.uuid4().hex}"
    writer = rows.write.option("compression", "zstd").option("path", scratch_dir(spark, "texts"))
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external one: what was read of it stays
    return texts


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row of docs.

    spans: maximal runs of bytes (start, end) that later copies of WINDOW bytes cover; kept: the other bytes.
    """
    spark = docs.sparkSession
    texts = stored(docs, id_col, text_col)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.select("bucket").distinct().count() // BUCKETS_A_RANGE)
    compare = lambda sent, level: materialise(sent.groupBy("kind", "range").applyInArrow(lambda t: _compare(level, t), ANSWER), f"repeats-{level}")
    known = compare(texts.groupBy("bucket").applyInArrow(lambda t: _send_seeds(ranges, t), SENT), -1)
    answers = known.limit(0)
    send = lambda level: lambda t, known: _send(level, ranges, t, known)
    for level in range(3):
        sent = texts.groupBy("bucket").cogroup((answers if level else known).groupBy("bucket")).applyInArrow(send(level), SENT)
        answers = answers.unionByName(compare(sent, level))
    id_type = docs.schema[id_col].dataType
    arrow_id = {"int": pa.int32(), "bigint": pa.int64()}[id_type.simpleString()]
    found = texts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(lambda t, known: _finish(arrow_id, t, known), RESULT.format(id=id_type.simpleString()))
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    return found.select("doc_id", "n_bytes", spans.alias("spans"), "kept")


def op11_repeated_passages(docs: DataFrame) -> DataFrame:
    found = repeated_spans(docs.select("doc_id", "text"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB, from the definition: all windows as strings.
ORACLE = f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, s, substr(x, 2 * s + 1, {2 * WINDOW}) AS w FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - {WINDOW - 1})) AS s FROM t)),
later AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1),
runs AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {WINDOW} THEN 0 ELSE 1 END AS new FROM later)),
spans AS (SELECT doc_id, min(s) AS a, max(s) + {WINDOW} AS b FROM runs GROUP BY doc_id, run),
ends AS (SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_, b FROM (SELECT * FROM spans UNION ALL SELECT doc_id, len(x) // 2, len(x) // 2 FROM t)),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a, b) AS x, sum(b - a) AS n, count(*) FILTER (WHERE b > a) AS spans FROM ends JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(t.x) // 2 AS BIGINT) AS n_bytes, CAST(n AS BIGINT) AS n_removed, spans AS n_spans, sha256(unhex(kept.x)) AS kept_sha256 FROM t JOIN kept USING (doc_id)
"""
