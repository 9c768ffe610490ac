"""Benchmark decontamination with training suffix arrays.

Every task cuts its documents into shards of about SHARD words and builds a suffix array of each: the order of all suffixes of the
shard's word sequence, by prefix doubling over word hashes (only suffixes that are not yet alone in their group are
sorted again), with a stop at each document's end. Every suffix of every test item is then binary-searched in it as far as its window
(`window` words, or the whole item if that is shorter): the interval of suffixes that begin with its first word is narrowed word by
word, all distinct windows at once, which gives all locations of each. Before that, windows with two neighbouring words that are nowhere neighbours in the
shard are ruled out by a table of the shard's pairs, so that the search follows the windows that may be there and not the benchmark. A located window is confirmed on the words' 64-bit hashes and
lengths, marks its words and contaminates its document.

The longest verbatim match of a document begins where one of its windows does, so each such place is looked up among the sorted test
suffixes, where its neighbours have most words in common with it. Stretches are compared by prefix sums of hashes, in one
step whatever their length: neither long items nor long matches need more than a few numbers for each word. The result
depends on the document and the benchmark alone, not on what shares its shard or its block.

Documents never leave their task, so there is no shuffle and no skew, and a lost executor repeats only its own shards.
The test items are sent in blocks of about BLOCK_BYTES of text (or one item, if that is longer), each a broadcast of its own; a shard is
sorted once and searched for one block after another, of which a task holds one at a time; TOGETHER shards meet a block when it has been read.

Defined cases: null, empty and blank texts have no words and are clean; null or blank items match nothing; equal items
each count; of equally long matches the first in the text is named, and of the items that hold it the one with the least ID (as a
string) at its first place; a document row repeated is judged twice alike; an empty benchmark leaves all documents clean; an empty table stays empty. Other columns are
carried through by decontaminate(), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh

WINDOW = 10
SHARD = 1 << 20
BLOCK_BYTES = 8 << 20
#: Shards that meet a block together, and the size of a shard's table of neighbouring words.
TOGETHER, PAIR_BITS = 4, 22

_FIELDS = pa.struct([("n_words", pa.int64()), ("hit", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("test_item", pa.string()), ("test_word", pa.int64()), ("at_word", pa.int64())])
_DDL = "n_words:bigint,hit:array<struct<start:bigint,end:bigint>>,items:array<string>,longest:bigint,test_item:string,test_word:bigint,at_word:bigint"


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of words ordered by the suffixes that begin there, compared to `depth` words; 0 is a stop.

    words: 32-bit numbers as uint64. The order among different words is that of their numbers.
    """
    n = len(words)
    if n < 2:
        return np.arange(n)
    following = np.zeros(n, np.uint64)
    following[:-1] = words[1:]
    following[words == 0] = 0  # nothing behind a stop counts
    key = (words << np.uint64(32)) | following
    order = np.argsort(key, kind="quicksort")
    rank = np.empty(n, np.int64)
    ranked = key[order]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=first[1:])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = start
    k = 2
    stops = words == 0
    before_stop = np.cumsum(stops)
    while k < depth:
        alone = first.copy()
        alone[:-1] &= first[1:]
        at = np.flatnonzero(~alone)  # places in order whose suffix shares its rank
        if not len(at):
            break
        pos = order[at]
        nxt = pos + k
        inside = nxt < n
        reach = np.minimum(nxt, n - 1)
        open_ = inside & (before_stop[np.minimum(nxt, n) - 1] - before_stop[pos] + stops[pos] == 0)
        second = np.where(open_, rank[reach] + 1, 0).astype(np.uint64)
        pair = (start[at].astype(np.uint64) << np.uint64(32)) | second
        by = np.argsort(pair, kind="quicksort")
        pair = pair[by]
        order[at] = pos[by]
        fresh_start = np.empty(len(at), bool)
        fresh_start[0] = True
        np.not_equal(pair[1:], pair[:-1], out=fresh_start[1:])
        first[at] = fresh_start
        start[at] = np.maximum.accumulate(np.where(fresh_start, at, 0))
        rank[order[at]] = start[at]
        k *= 2
    return order


def _bound(column, order, target, low, high, depth, right):
    """Per query, the first place in low..high of order whose word at depth is not below (right: above) target."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) >> 1
        value = column[order[mid] + depth]
        below = value <= target[open_] if right else value < target[open_]
        low[open_[below]] = mid[below] + 1
        high[open_[~below]] = mid[~below]
        open_ = open_[low[open_] < high[open_]]
    return low


def search(words: np.ndarray, order: np.ndarray, codes: np.ndarray, first: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each test window (codes[first : first + need]) the interval of suffixes that begin with it; low = high if none does."""
    low, high = np.zeros(len(first), np.int64), np.full(len(first), len(order), np.int64)
    live = np.arange(len(first))
    depth = int(need.max(initial=0))
    padded = np.concatenate([words, np.zeros(depth + 1, words.dtype)])
    for d in range(depth):
        live = live[need[live] > d]
        if not len(live):
            break
        target = codes[first[live] + d]
        a = _bound(padded, order, target, low[live], high[live], d, False)
        b = _bound(padded, order, target, a, high[live], d, True)
        low[live], high[live] = a, b
        live = live[a < b]
    return np.stack([low, high], axis=1)


class Run:
    """A sequence of 64-bit word hashes in which any two stretches are compared in one step (polynomial prefix sums)."""

    def __init__(self, hashes: np.ndarray, left: np.ndarray):
        from corpusmill.llm.words import powers

        self.hashes, self.left = hashes, left
        up, self.down = powers(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=self.sums[1:])

    def stretch(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.down[at]


def common(one: Run, p: np.ndarray, two: Run, q: np.ndarray) -> np.ndarray:
    """How many words the suffix of one at p and that of two at q have in common, pair by pair."""
    low, high = np.zeros(len(p), np.int64), np.minimum(one.left[p], two.left[q])
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_] + 1) >> 1
        same = one.stretch(p[open_], mid) == two.stretch(q[open_], mid)
        low[open_[same]] = mid[same]
        high[open_[~same]] = mid[~same] - 1
    return low


class TestSet:
    """A block of test items: their words one after another, their distinct windows, and the order of their suffixes."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        from corpusmill.llm.words import ALNUM, hash_words, mix, text_bytes

        items = sorted(items)
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
        hashes, starts, ends, at = hash_words(data, offsets, ALNUM)
        self.ids = [i for i, _ in items]
        self.hashes, self.sizes, self.codes = hashes, ends - starts, narrow(hashes)
        count = np.diff(at)
        self.item = np.repeat(np.arange(len(items)), count)
        self.offset = np.arange(len(hashes)) - at[:-1][self.item]
        self.left = at[1:][self.item] - np.arange(len(hashes))
        need = np.minimum(count, window)[self.item]
        begins = np.flatnonzero(self.left >= need)  # the others are too near their item's end
        need = need[begins]
        run = Run(hashes, self.left)
        _, first, which = np.unique(mix(run.stretch(begins, need)) ^ need.astype(np.uint64), return_index=True, return_inverse=True)
        self.first, self.need = begins[first], need[first]  # of each distinct window
        self.pairs = pair_places(self.codes)
        pairs = np.unique(np.stack([which.reshape(-1), self.item[begins]], axis=1), axis=0)
        self.owner = pairs[:, 1]  # items of window u: owner[of[u] : of[u + 1]]
        self.of = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        # suffixes by their words' hashes; dense numbers, as the order must be that of the whole hash
        dense = np.searchsorted(np.unique(hashes), hashes).astype(np.uint64) + np.uint64(1)
        stopped = np.zeros(len(hashes) + len(items), np.uint64)
        stopped[np.arange(len(hashes)) + self.item] = dense
        order = suffix_array(stopped, int(count.max(initial=1)) + 1)
        place = np.full(len(stopped), -1, np.int64)
        place[np.arange(len(hashes)) + self.item] = np.arange(len(hashes))
        self.order = place[order][place[order] >= 0]

    def longest(self, run: "Run", p: np.ndarray) -> np.ndarray:
        """For each suffix p of run: the most words it has in common with any test suffix."""
        own = Run(self.hashes, self.left)
        at = self._bound(own, run, p, None, False)
        best = np.zeros(len(p), np.int64)
        for near in (at - 1, at):
            some = np.flatnonzero((near >= 0) & (near < len(self.order)))
            best[some] = np.maximum(best[some], common(run, p[some], own, self.order[near[some]]))
        return best

    def _bound(self, own: "Run", run: "Run", p: np.ndarray, length: np.ndarray | None, right: bool) -> np.ndarray:
        """The first place in the order whose suffix is not below (right: above) the suffix p, or its first length words."""
        low, high = np.zeros(len(p), np.int64), np.full(len(p), len(self.order), np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) >> 1
            q, at = self.order[mid], p[open_]
            same = common(run, at, own, q)
            short = run.left[at] if length is None else length[open_]
            whole = same >= short
            ended = same >= own.left[q]
            last = lambda r, x: r.hashes[np.minimum(x, len(r.hashes) - 1)]
            below = np.where(whole, right, ended | (last(own, q + same) < last(run, at + same)))
            low[open_[below]] = mid[below] + 1
            high[open_[~below]] = mid[~below]
        return low

    def first_with(self, run: "Run", p: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The least test place whose suffix begins with the length words of run at p; there must be one."""
        own = Run(self.hashes, self.left)
        a, b = self._bound(own, run, p, length, False), self._bound(own, run, p, length, True)
        return np.array([self.order[x:y].min() for x, y in zip(a.tolist(), b.tolist())], np.int64)


def pair_places(codes: np.ndarray) -> np.ndarray:
    """For each word the place of it and its successor in a table of PAIR_BITS bits; for the last one that of it alone."""
    from corpusmill.llm.words import mix

    nxt = np.concatenate([codes[1:], np.zeros(1, codes.dtype)])
    return (mix(codes * np.uint64(0x9E3779B97F4A7C15) + nxt) >> np.uint64(64 - PAIR_BITS)).astype(np.int32)


def narrow(hashes: np.ndarray) -> np.ndarray:
    """32-bit word numbers, never 0; equal words have equal numbers, and located matches are confirmed on bytes."""
    return np.maximum(hashes >> np.uint64(32), np.uint64(1))


def _shards(at: np.ndarray):
    """Ranges of documents of about SHARD words."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SHARD, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _scan(shared: list, window: int):
    """Batches have the carried columns and the text, which makes room for the matches. shared: the blocks of items, each a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusmill.llm.words import ALNUM, hash_words, text_bytes

        for batch in batches:
            h, s, e, at = hash_words(*text_bytes(batch.column(batch.num_columns - 1)), ALNUM)
            out, ranges = [], [*_shards(at)]
            for first in range(0, len(ranges), TOGETHER):
                shards = [Shard(h[at[i] : at[j]], e[at[i] : at[j]] - s[at[i] : at[j]], at[i : j + 1] - at[i], window) for i, j in ranges[first : first + TOGETHER]]
                found: list[list[dict] | None] = [None] * len(shards)
                for block in shared:  # read once for these shards
                    for k, shard in enumerate(shards):
                        more = shard.matches(block.value)
                        found[k] = more if found[k] is None else [*map(_merge, found[k], more)]
                    if len(shared) > 1:
                        vars(block).pop("_value", None)  # one block in memory at a time
                out += [m for part in found for m in part]
            yield pa.record_batch([*batch.columns[:-1], pa.array(out, _FIELDS)], names=[*batch.schema.names[:-1], "matches"])

    return run


def _union(spans) -> list[dict]:
    merged: list[dict] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1]["end"]:
            merged[-1]["end"] = max(merged[-1]["end"], b)
        else:
            merged.append({"start": a, "end": b})
    return merged


def _merge(x: dict, y: dict) -> dict:
    """Matches with two blocks of items; of equally long ones the first in the text counts, then that of the least item and word."""
    best = min((m for m in (x, y) if m["longest"] is not None), key=lambda m: (-m["longest"], m["at_word"], m["test_item"], m["test_word"]), default=x)
    return best | {"hit": _union((m["start"], m["end"]) for m in [*x["hit"], *y["hit"]]), "items": sorted({*x["items"], *y["items"]})}


class Shard:
    """Documents with their words, and the suffix array over them."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, at: np.ndarray, depth: int):
        self.hashes, self.sizes, self.at = hashes, sizes, at
        self.count = np.diff(at)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        # a stop behind each document
        self.words = np.zeros(len(hashes) + len(self.count), np.uint64)
        self.words[np.arange(len(hashes)) + self.doc] = narrow(hashes)
        self.firsts = at[:-1] + np.arange(len(self.count))
        self.order = suffix_array(self.words, depth)
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        self.pairs[pair_places(self.words)] = True

    def possible(self, tests: TestSet) -> np.ndarray:
        """The windows of which every pair of neighbouring words is a pair of neighbours here, too: most have been ruled out after one or two look-ups."""
        live = np.arange(len(tests.first))
        for k in range(int(tests.need.max(initial=1)) - 1):
            more = tests.need[live] > k + 1
            keep = ~more
            keep[more] = self.pairs[tests.pairs[tests.first[live[more]] + k]]
            live = live[keep]
        return live

    def matches(self, tests: TestSet) -> list[dict]:
        n = len(self.hashes)
        out = [{"n_words": int(c), "hit": [], "items": [], "longest": None, "test_item": None, "test_word": None, "at_word": None} for c in self.count]
        live = self.possible(tests)
        interval = search(self.words, self.order, tests.codes, tests.first[live], tests.need[live])
        size = interval[:, 1] - interval[:, 0]
        row = np.repeat(np.arange(len(size)), size)
        window = live[row]
        if not len(window):
            return out
        # every place of every window, as a word of the shard
        place = self.order[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + interval[row, 0]]
        word = place - (np.searchsorted(self.firsts, place, "right") - 1)
        need, first = tests.need[window], tests.first[window]
        same = np.ones(len(word), bool)
        for k in range(int(need.max())):  # the words themselves, not just their numbers
            some = np.flatnonzero(same & (need > k))
            same[some] = (self.hashes[word[some] + k] == tests.hashes[first[some] + k]) & (self.sizes[word[some] + k] == tests.sizes[first[some] + k])
        word, window, need = word[same], window[same], need[same]
        if not len(word):
            return out
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, word, 1)
        np.add.at(edge, word + need, -1)
        covered = np.cumsum(edge[:-1]) > 0
        begins = np.flatnonzero(covered & ~np.r_[False, covered[:-1] & (self.doc[1:] == self.doc[:-1])])
        ends = np.flatnonzero(covered & ~np.r_[covered[1:] & (self.doc[1:] == self.doc[:-1]), False]) + 1
        for d, a, b in zip(self.doc[begins].tolist(), begins.tolist(), ends.tolist()):
            out[d]["hit"].append({"start": a - int(self.at[d]), "end": b - int(self.at[d])})
        seen = np.unique(np.stack([self.doc[word], window], axis=1), axis=0)
        many = tests.of[seen[:, 1] + 1] - tests.of[seen[:, 1]]
        owner = tests.owner[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(tests.of[seen[:, 1]], many)]
        for d, i in np.unique(np.stack([np.repeat(seen[:, 0], many), owner], axis=1), axis=0).tolist():
            out[d]["items"].append(tests.ids[i])
        # the longest match that begins where a window does
        run = Run(self.hashes, self.at[1:][self.doc] - np.arange(n))
        starts = np.unique(word)
        longest = tests.longest(run, starts)
        by = np.lexsort((starts, -longest, self.doc[starts]))
        docs, top = np.unique(self.doc[starts[by]], return_index=True)
        best = by[top]
        where = tests.first_with(run, starts[best], longest[best])
        for d, p, length, q in zip(docs.tolist(), starts[best].tolist(), longest[best].tolist(), where.tolist()):
            out[d] |= {"items": sorted(set(out[d]["items"])), "longest": length, "test_item": tests.ids[tests.item[q]], "test_word": int(tests.offset[q]), "at_word": p - int(self.at[d])}
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded text, in one pass that fetches a partition at a time."""
    items = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("i"), benchmark[text_col].alias("t")).where("length(t) > 0")
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r.i, r.t))
        size += len(r.t) + len(r.i) + 64
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all but the text by default) and a struct column `matches`.

    matches: n_words; hit (merged word spans inside windows); items (IDs whose windows occur, as strings, sorted);
    longest (words of the longest verbatim match that begins with a window), and where it is: test_item, test_word, at_word.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    out = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(keep)), docs[text_col].alias("text"))
    carried = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    carried += ", " * bool(keep) + f"matches struct<{_DDL}>"
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(TestSet(block, window)) for block in _blocks(benchmark, item_id_col, item_text_col)]
    out = out.mapInArrow(_scan(shared or [context.broadcast(TestSet([], window))], window), carried)
    name = fresh("matches", docs.select(*keep))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), F.col("matches").alias(name))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without a word inside a benchmark window."""
    copy = fresh("text_again", docs)
    name = fresh("matches", docs.withColumn(copy, docs[text_col]).drop(text_col))
    found = find_contamination(docs.withColumn(copy, docs[text_col]), benchmark, text_col, **options)
    return found.where(F.size(f"{name}.hit") == 0).withColumnRenamed(copy, text_col).select(*docs.columns)


def op1_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(docs.select("doc_id", "text"), benchmark, keep=["doc_id"])
    m = F.col("matches")
    n_hit = F.aggregate(m["hit"], F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id", m["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(m["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(m["items"], ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        m["longest"].alias("longest_match"), m["test_item"].alias("longest_item"), m["test_word"].alias("longest_item_word"), m["at_word"].alias("longest_at_word"),
    )


_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: DuckDB, from the definition: windows are joined as strings, and matches are runs of equal words on a diagonal of text and item.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[s:s+n-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT *, least(len(w), {WINDOW}) AS n FROM i WHERE len(w) > 0))),
spots AS (SELECT doc_id, s, n, array_to_string(w[s:s+n-1], ' ') AS g FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT DISTINCT doc_id, s, n, item FROM spots JOIN win USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY doc_id),
dw AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM hit)),
iw AS (SELECT item, unnest(w) AS x, unnest(range(len(w))) AS q FROM i),
same AS (SELECT doc_id, item, p, q, p - row_number() OVER (PARTITION BY doc_id, item, p - q ORDER BY p) AS run FROM dw JOIN iw USING (x)),
ends AS (SELECT doc_id, item, p, q, max(p) OVER (PARTITION BY doc_id, item, p - q, run) - p + 1 AS l FROM same),
best AS (SELECT * FROM ends WHERE (doc_id, p) IN (SELECT (doc_id, s - 1) FROM hit) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, p, item, q) = 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
  l AS longest_match, best.item AS longest_item, q AS longest_item_word, p AS longest_at_word
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN best USING (doc_id)
"""
