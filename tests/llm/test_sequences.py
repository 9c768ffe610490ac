"""Repeated passages, log replay and the Merkle manifest against plain Python, on given and on hard tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import log_replay, merkle, repeats, scan

# --- 11 --------------------------------------------------------------------------------------------------------------


def removed_by_hand(rows):
    """rows: (doc_id, text), rows of the same doc_id in any order if their texts are the same."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        covered, end = bytearray(len(b)), 0
        for s in range(len(b) - 99):
            w = hashlib.md5(b[s : s + 100]).digest()
            if w in seen:
                a = max(s, end)
                covered[a : s + 100] = b"\1" * (s + 100 - a)
                end = s + 100
            seen.add(w)
        spans = sum(1 for p in range(len(b)) if covered[p] and not (p and covered[p - 1]))
        out.append((i, len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest()))
    return sorted(out, key=repr)


def passages(docs):
    return sorted((tuple(r) for r in repeats.op11_repeated_passages(docs).collect()), key=repr)


def test_passages_of_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    assert passages(docs) == removed_by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_passages_of_hard_rows(hard_docs, no_docs):
    assert passages(hard_docs) == removed_by_hand([(r.doc_id, r.text) for r in hard_docs.select("doc_id", "text").collect()])
    assert passages(no_docs) == []


def test_passages_at_every_length_and_overlap(spark):
    """Copies of 90 to 110 bytes at many offsets, inside a text and across, two-sided overlaps, runs of one character, and texts longer than a slice."""
    r = random.Random(3)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    base = noise(2000)
    rows = [(0, base)]
    for i, n in enumerate(range(90, 111)):
        at = r.randint(0, 1800)
        rows.append((i + 1, noise(r.randint(0, 70)) + base[at : at + n] + noise(r.randint(0, 70))))
    rows.append((50, base[300:420] + base[360:500] + base[420:430]))
    rows.append((51, base[:101] * 5))
    rows.append((52, "a" * 450 + "b" + "a" * 120))
    rows.append((53, "ab" * 300))
    long = noise(2_500_000)
    rows.append((60, long))
    rows.append((61, "x" + long[1_000_000:1_300_000] + long[1_048_500:1_048_700] + "y"))
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(6)
    assert passages(docs) == removed_by_hand(rows)


def test_slices_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 300)
    r = random.Random(1)
    texts = ["".join(r.choice("abc") for _ in range(n)).encode() for n in (0, 99, 100, 299, 300, 301, 1234, 50, 700)]
    found = []
    for piece in repeats.pieces([memoryview(t) for t in texts]):
        at, segment, lo, hi = piece.blocks()
        assert all((lo <= hi) & (hi <= at) & (at - lo <= repeats.REACH))
        for s, a, b in zip(segment, lo, hi):
            found += [(int(piece.row[s]), int(piece.base[s] + w - piece.lo[s])) for w in range(a, b + 1)]
    assert sorted(found) == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 99)]


def test_packed_numbers():
    x = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64)) * np.uint64(2)
    assert (repeats.unpack(repeats.pack(x, rising=True), rising=True) == x).all() and (repeats.unpack(repeats.pack(x)) == x).all()
    assert len(repeats.unpack(repeats.pack(x[:0], rising=True), rising=True)) == 0


# --- 12 --------------------------------------------------------------------------------------------------------------


def replay_by_hand(rows, toxic, per_epoch=16):
    """rows: (doc_id, source, text): a store, a list of pending changes and a mark for each source, record by record."""
    store, out, pending, mark, commits = {}, [], {}, {}, 0
    state = lambda: out.append(("state", -(-commits // per_epoch), len(store), sum(store.values())))
    for i, source, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        h = zlib.crc32(str(i).encode())
        m, key, mine = h % 41, h // 100 % 3000, pending.setdefault(source, [])
        if m <= 1:
            for _, k, t in mine:
                store.pop(k, None)
                if t is not None:
                    store[k] = zlib.crc32(f"{k}:{t}".encode())
            commits += 1
            if commits % per_epoch == 0:
                state()
        elif m == 2:
            out.extend(("abort", j, i, k) for j, k, _ in mine)
        elif m <= 4:
            mark[source] = len(mine)
        elif m <= 6:
            out.extend(("rollback", j, i, k) for j, k, _ in mine[mark.get(source, 0) :])
            del mine[mark.get(source, 0) :]
        else:
            mine.append((i, key, None if i in toxic else text))
        if m <= 2:
            pending[source] = []
            mark.pop(source, None)
    out.extend(("abort", j, None, k) for mine in pending.values() for j, k, _ in mine)
    if commits % per_epoch:
        state()
    return sorted(out, key=repr)


def same_log(spark, rows, toxic, **options):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 1) for i in toxic for _ in range(2)] + [(None, 1, 1), (3, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    got = sorted((tuple(r) for r in log_replay.replay(log_replay.records(docs, labels), **options).collect()), key=repr)
    assert got == replay_by_hand(rows, toxic)


@pytest.mark.parametrize("hot", [0.34, 0.9])
def test_log_of_a_skewed_source_in_small_chunks(spark, monkeypatch, hot):
    monkeypatch.setattr(scan, "FAN", 5)
    r = random.Random(hot)
    rows = [(i, "hot" if r.random() < hot else r.choice(["a", "b", "", None]), r.choice([None, "", "é text", "x" * 5000]) if i % 3 else f"text {i}") for i in r.sample(range(-200, 9000), 3000)]
    same_log(spark, rows, set(r.sample(range(9000), 500)), chunk_rows=40)


def test_log_without_an_end(spark):
    changes = [i for i in range(400) if 6 < zlib.crc32(str(i).encode()) % 41]
    same_log(spark, [(i, "s", "t") for i in changes], set())
    same_log(spark, [(None, "s", "t"), (None, None, None)], set())
    same_log(spark, [], set())


def test_log_of_hard_rows(spark, hard_docs):
    labels = spark.createDataFrame([(7, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.source, r.text) for r in hard_docs.collect()]
    got = sorted((tuple(r) for r in log_replay.op12_log_replay(hard_docs, labels).collect()), key=repr)
    want = replay_by_hand([r for r in rows if r[0] is not None], {7})
    assert got == want


def test_chunk_summaries_are_of_constant_size(spark):
    rows = [(i, "s", "t") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    log, n = log_replay.chunks(log_replay.records(docs, spark.createDataFrame([], "doc_id long, toxic int")), 100)
    found = log_replay.summaries(log_replay.numbered(log, n)).collect()
    assert len(found) == n == 21
    by_chunk = {}
    for r in log.orderBy("doc_id").collect():
        pending = by_chunk.setdefault(r.chunk, [0])
        pending[0] = 0 if r.kind in ("commit", "abort") else pending[0] + (r.kind == "change")
    assert {r.chunk: r.pending for r in found} == {c: p[0] for c, p in by_chunk.items()}


# --- 13 --------------------------------------------------------------------------------------------------------------


def manifest_by_hand(rows):
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def tree(leaves):
        """(root, for each leaf its pairs of left and right siblings)."""
        paths, level, place = [[] for _ in leaves], leaves, list(range(len(leaves)))
        while len(level) > 1:
            runs = [level[i : i + 3] for i in range(0, len(level), 3)]
            for path, p in zip(paths, place):
                path.append(("".join(runs[p // 3][: p % 3]), "".join(runs[p // 3][p % 3 + 1 :])))
            level, place = [h("".join(run)) for run in runs], [p // 3 for p in place]
        return level[0], paths

    def leaf(doc, text):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc[0], doc[1], doc[2], doc[3], text)))

    by_source = {}
    for doc in rows:
        by_source.setdefault(doc[1], []).append(doc)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs, out = [], []
    for s in sources:
        docs = sorted(by_source[s], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[4])))
        subs.append((docs, *tree([leaf(d, d[4]) for d in docs])))
    root, tops = tree([s[1] for s in subs])
    for (docs, sub, paths), top in zip(subs, tops):
        for d, path in zip(docs, paths):
            tampered = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 and d[4] is not None
            folded = leaf(d, d[4].replace("\n", "") if tampered else d[4])
            for left, right in path + top:
                folded = h(left + folded + right)
            out.append((d[0], leaf(d, d[4]), sub, root, h("".join(a + b for a, b in path + top)), folded, folded == root))
    return sorted(out, key=repr)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def same_manifest(docs):
    got = sorted((tuple(r) for r in merkle.op13_merkle_manifest(docs).collect()), key=repr)
    want = manifest_by_hand([tuple(r) for r in docs.select(*FIELDS).collect()]) if got else []
    assert got == want
    return got


def test_manifest_of_all_documents(spark, sf_dir):
    got = same_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_a_skewed_source_in_small_blocks(spark, monkeypatch):
    """A source over many ranges and blocks; sources of 1 to 30 documents, null and empty ones, names that differ in bytes above 127."""
    monkeypatch.setattr(merkle, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(merkle, "LEVELS", 2)
    r = random.Random(4)
    names = [None, "", "é", "z", "日本", *(f"s{i}" for i in range(40))]
    rows = [(i, "hot" if r.random() < 0.4 else r.choice(names[: r.randint(1, len(names))]), r.choice(["en", None]), r.choice([None, i]), f"line {i}\nnext" if i % 2 else f"line {i}") for i in range(1500)]
    same_manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_manifest_of_one_source(spark, n):
    rows = [(i, "s", "en", 3, "a\nb") for i in range(n)]
    same_manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))


def test_manifest_of_hard_rows(hard_docs, no_docs):
    same_manifest(hard_docs)
    same_manifest(no_docs)


def test_stack_does_not_depend_on_the_cut():
    """Peaks of any cut, merged, are the nodes of one stack over all leaves."""
    r = random.Random(2)
    for n in (1, 5, 26, 27, 100):
        leaves = [(0, i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(n)]
        whole, top = merkle.climb(leaves, n)
        cuts = sorted({0, n, *(r.randint(0, n) for _ in range(5))})
        made, peaks = [], []
        for a, b in zip(cuts, cuts[1:]):
            m, p = merkle.climb(leaves[a:b], n)
            made += m
            peaks += p
        rest, last = merkle.climb(peaks, n)
        assert sorted(made + rest) == sorted(whole) and last == top and len(top) == 1 and top[0][0] == merkle.height(n)


def test_levels_as_a_column(spark):
    some = [1, 2, 3, 4, 9, 10, 27, 28, 3**20, 3**20 + 1]
    rows = spark.createDataFrame([(x,) for x in some], "n long").select("n", merkle.levels_above(F.col("n")).alias("h")).collect()
    assert all(r.h == merkle.height(r.n) for r in rows)
