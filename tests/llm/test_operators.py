"""Operators against plain Python versions of what they promise."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import decontaminate, line_dedup, near_dedup, packing, pii, quality_classifier, quality_rules, queries, token_counts, url_filter
from corpusmill.llm import words as w
from corpusmill.llm.common import table
from corpusmill.llm.components import connected_components
from tests.compare import same_rows

LOWER = {c: c + 32 for c in range(65, 91)}


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def rows(spark, sf_dir, name, *cols):
    return [tuple(r) for r in table(spark, sf_dir, name).select(*cols).collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    same_rows(queries.queries()[name](spark, sf_dir), duck.sql(queries.oracle_sql()[name]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB 9.\n\té日", max_size=40)), max_size=8), st.integers(1, 20))
def test_word_hashing(texts, block):
    kept, w.BLOCK = w.BLOCK, block
    try:
        data, offsets = w.text_bytes(pa.array(texts, pa.string()))
        for table_, split in ((w.NOT_SPACE, lambda t: (t or "").encode().lower().split()), (w.ALNUM, lambda t: [x.encode() for x in alnum(t)])):
            h, s, e, at = w.hash_words(data, offsets, table_)
            for i, t in enumerate(texts):
                assert [data[a:b].tobytes().lower() for a, b in zip(s[at[i] : at[i + 1]], e[at[i] : at[i + 1]])] == split(t)
    finally:
        w.BLOCK = kept


# --- 1 ---------------------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=40), st.integers(2, 9))
def test_suffix_array_order(values, depth):
    order = decontaminate.suffix_array(np.array(values, np.uint64), depth)
    assert sorted(order) == list(range(len(values)))

    def key(i):  # nothing behind a stop counts
        tail = values[i : i + depth]
        return tail[: tail.index(0)] if 0 in tail else tail

    keys = [key(i) for i in order]
    assert all(a[:depth] <= b[:depth] for a, b in zip(keys, keys[1:]))


def brute_contamination(text, items):
    """The columns of op1: words, hit words, items, digest, contaminated, and the longest match with its item and both places."""
    words, hit, found, starts = alnum(text), set(), set(), set()
    split = [(str(i), alnum(t)) for i, t in items]
    for i, own in split:
        n = min(10, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[k : k + n]:
                    hit |= set(range(p, p + n))
                    starts.add(p)
                    found.add(i)
    best = (0, None, None, None)
    for p in starts:
        for i, own in split:
            for k in range(len(own)):
                m = 0
                while p + m < len(words) and k + m < len(own) and words[p + m] == own[k + m]:
                    m += 1
                if m:
                    best = min(best, (-m, p, i, k))
    length = -best[0] or None
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), length, best[2], best[3], best[1]


OP1 = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_item", "longest_item_word", "longest_at_word")


def test_contamination_is_exact(spark, monkeypatch, words):
    r = random.Random(3)
    items = [(i, " ".join(words(r, r.choice((3, 9, 10, 11, 25, 60))))) for i in range(30)] + [(30, "A a a a a a a a a a a a"), (31, None), (32, "")]
    items += [(100 + i, t) for i, t in items[5:8]] + [(200, " ".join([*words(r, 4), *items[3][1].split(), "tail"]))]
    docs = []
    for i in range(60):
        t = words(r, 80)
        if i % 3 == 0:
            for _ in range(r.randint(1, 2)):
                own = items[r.randrange(31)][1].split()
                k = r.randrange(len(own))
                t[20:20] = own[k : k + r.randint(1, len(own))]
        docs.append((i, ", ".join(t).upper() + " a" * (i % 15)))
    docs.append((60, None))
    items = [(i, t or "") for i, t in items]
    want = {i: brute_contamination(t, items) for i, t in docs}
    assert sum(x[4] for x in want.values()) > 10
    b = spark.createDataFrame(items, "item_id long, text string")
    for block, shard, parts in ((1 << 20, 1 << 20, 1), (1 << 20, 1 << 20, 7), (800, 100, 2), (1, 300, 1)):  # one block and shard, and several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        monkeypatch.setattr(decontaminate, "SHARD", shard)
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        got = {x.doc_id: tuple(x[c] for c in OP1) for x in decontaminate.op1_decontaminate(d, b).collect()}
        assert got == want


def test_longest_match_of_documents_in_one_shard(spark):
    item = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join(["x", *item[4:19], "y", *item[:12]])), (2, " ".join(item[10:50])), (3, "nothing here")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {x.doc_id: x for x in decontaminate.op1_decontaminate(frame, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert (got[1].longest_match, got[1].longest_item, got[1].longest_item_word, got[1].longest_at_word) == (15, "7", 4, 1)
    assert (got[2].longest_match, got[2].longest_item_word, got[2].longest_at_word) == (40, 10, 0) and got[3].longest_match is None


def test_long_items_and_long_matches(spark, words):
    """An item of 60,000 words, all of it in a text, and items and texts of one word over and over."""
    long = words(random.Random(12), 60_000)
    docs = [(1, " ".join(["before", *long, "after"])), (2, " ".join(long[100:140])), (3, "a " * 100_000), (4, "plain")]
    items = [(1, " ".join(long)), (2, "a " * 30_000)]
    got = {x.doc_id: (x.n_hit, x.n_items, x.longest_match, x.longest_at_word) for x in decontaminate.op1_decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: (60_000, 1, 60_000, 1), 2: (40, 1, 40, 0), 3: (100_000, 1, 30_000, 0), 4: (0, 0, None, None)}


# --- 2 ---------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan_uses_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=41) if lengths else np.zeros(41, int)
    used = Counter()
    for bin_, times in packing.plan(counts, 40):
        assert sum(bin_) <= 40 and times > 0
        for x in bin_:
            used[x] += times
    assert used == Counter(lengths)
    bins = sum(t for _, t in packing.plan(counts, 40))
    assert bins <= max(1, math.ceil(sum(lengths) / 40) * 1.4 + 1)


def test_replacement_beats_greedy():
    """Greedy takes 6 and 2 and leaves 2 of 10 free; 6, then 2 for the pair 1 and 3, fills the bin."""
    counts = np.bincount([7, 2, 1, 1, 1], minlength=11)
    assert packing.plan(counts, 10)[0][0] == [7, 2, 1]
    counts = np.bincount([6, 3, 2, 2], minlength=11)
    assert sorted(packing.plan(counts, 10)[0][0]) == [2, 2, 6]


def test_packing_round_trip(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = rows(spark, sf_dir, "documents", "doc_id", "text")
    got = defaultdict(list)
    places = defaultdict(list)
    for x in packing.op2_best_fit_packing(table(spark, sf_dir, "documents")).collect():
        got[x.doc_id].append(x)
        places[x.sequence_id].append((x.offset, x.length))
    for (i, _), e in zip(docs, tok.encode_batch([t or "" for _, t in docs], add_special_tokens=False)):
        ids, at = [*e.ids, 2], 0
        for k, x in enumerate(sorted(got[i], key=lambda x: x.piece)):
            assert (x.piece, x.start) == (k, at) and x.length <= 1024 and (k == 0 or x.length == 1024)
            assert x.ids_crc32 == zlib.crc32(struct.pack(f"<{x.length}I", *ids[at : at + x.length]))
            at += x.length
        assert at == len(ids)
    for spans in places.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(n for s in places.values() for _, n in s)
    assert len(places) <= math.ceil(total / 1024) * 1.03 + 1


def test_packed_ids_are_those_of_the_file(spark):
    """The file's added token is one ID wherever it stands."""
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "a <|endoftext| b", ""]
    want = [[*e.ids, 2] for e in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]
    out = packing.pack(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert {x.id: np.frombuffer(x.ids, "<u4").tolist() for x in out} == dict(enumerate(want)) and 50256 in want[0]


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_quality_keeps_the_good(spark, sf_dir):
    judged = {x.doc_id: x for x in quality_rules.op3_quality_rules(table(spark, sf_dir, "documents")).collect()}
    labels = rows(spark, sf_dir, "labels", "doc_id", "quality")
    assert all(judged[i].kept or judged[i].base_failed for i, q in labels if q == 1)
    assert not any(judged[i].kept for i, q in labels if q == 0 and judged[i].n_symbols > judged[i].n_words)


# --- 4 ---------------------------------------------------------------------------------------------------------------


def brute_components(docs, size, percent):
    sets = {}
    for i, t in docs:
        ws = (t or "").encode().lower().split()
        n = min(size, len(ws))
        sets[i] = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if n else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def mutated(r, base, words, changes):
    out = list(base)
    for k in r.sample(range(len(out)), changes):
        out[k] = words(r, 1)[0] + str(r.randint(0, 9999))
    return out


def test_near_duplicates_are_exact(spark, words):
    """Copies of an original that are similar to it but not to each other, chains, exact copies, a shared passage."""
    r = random.Random(9)
    docs = []
    add = lambda ws: docs.append((len(docs) * 3 + 1, " ".join(ws)))
    base, passage = words(r, 120), words(r, 60)
    for _ in range(60):
        add(mutated(r, base, words, r.randint(2, 12)))
    add(base)
    for _ in range(40):
        add([*passage, *words(r, r.randint(20, 60))])
    chain = words(r, 90)
    for _ in range(12):
        add(chain)
        chain = mutated(r, chain, words, 5)
    for _ in range(10):
        add(base)
    docs += [(1000, None), (1001, ""), (1002, "One"), (1003, "one"), (1004, "one two"), (1005, "one  TWO\n")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup.op4_near_dedup(frame).collect()}
    assert got == brute_components(docs, 2, 80)
    five = {x.id: x.component for x in near_dedup.near_duplicates(frame).collect()}
    assert five == {i: c for i, (_, c, _) in brute_components(docs, 5, 80).items()}


def test_near_duplicates_of_ten_thousand_documents():
    """All links of the documents at sf0.1 by inverted lists of shingles, against the operator."""
    import os

    from pyspark.sql import SparkSession

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no larger tables here")
    session = SparkSession.getActiveSession()
    docs = [(i, t) for i, t in rows(session, folder, "documents", "doc_id", "text")]
    number, postings, owned = {}, [], []
    for k, (_, t) in enumerate(docs):
        ws = (t or "").encode().lower().split()
        own = {tuple(ws[j : j + 2]) for j in range(max(1, len(ws) - 1))} if ws else set()
        owned.append([number.setdefault(x, len(number)) for x in own])
        postings += [[] for _ in range(len(number) - len(postings))]
        for x in owned[-1]:
            postings[x].append(k)
    size = np.array([len(x) for x in owned])
    postings = [np.array(x) for x in postings]
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for k, own in enumerate(owned):
        if own:
            both = np.bincount(np.concatenate([postings[x] for x in own]), minlength=len(docs))
            for j in np.flatnonzero((100 * both >= 80 * (size + size[k] - both)) & (both > 0)).tolist():
                a, b = top(k), top(j)
                up[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        least[top(k)].append(i)
    want = {i: min(group) for group in least.values() for i in group}
    got = {x.doc_id: x.component_id for x in near_dedup.op4_near_dedup(table(session, folder, "documents")).collect()}
    assert got == want


def test_heavy_keys_are_looked_up_in_place(spark, monkeypatch):
    from corpusmill.llm import common

    monkeypatch.setattr(common, "HEAVY", 4)
    keys = [1] * 60 + [2] * 30 + list(range(3, 13)) + [None]
    data = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    counts = Counter(k for k in keys if k is not None)
    right = spark.createDataFrame([(k, f"v{k}", n) for k, n in counts.items()], "k long, v string, n long")
    out = common.look_up(data, right, "k", "n")
    assert sorted((x.k, x.i, x.v) for x in out.collect()) == sorted((k, i, f"v{k}") for i, k in enumerate(keys) if k is not None)
    assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 1


def test_circulant_signature_estimates(words):
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 63, 1000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:800], r.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    same = (near_dedup.signature(a) == near_dedup.signature(b)).mean()
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.1
    assert (near_dedup.signature(a) == near_dedup.signature(a[::-1].copy())).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200)] + [(r.randint(300, 320), r.randint(300, 320)) for _ in range(12)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {x.node: x.label for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges for x in e if e[0] != e[1]}


# --- 6 ---------------------------------------------------------------------------------------------------------------


def brute_lines(docs, least):
    """By the longest previous factor of each suffix: lines that a run with an earlier copy covers are cut."""
    seqs = [[(k, x) for k, x in enumerate(t.split("\n")) if x.split()] for _, t in docs]
    suffixes = [(d, s) for d in range(len(docs)) for s in range(len(seqs[d]))]
    cut = defaultdict(set)
    for n, (d, s) in enumerate(suffixes):
        for e, p in suffixes[:n]:
            m = 0
            while s + m < len(seqs[d]) and p + m < len(seqs[e]) and seqs[d][s + m][1] == seqs[e][p + m][1]:
                m += 1
            if m and sum(len(x.split()) for _, x in seqs[d][s : s + m]) >= least:
                cut[d] |= set(range(seqs[d][s][0], seqs[d][s + m - 1][0] + 1))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut[d]) for d, (i, t) in enumerate(docs)}


def test_line_runs_against_longest_previous_factors(spark):
    r = random.Random(4)
    pool = [" ".join(f"w{k}" for k in range(r.randint(1, 9))) + f" l{i}" for i in range(6)] + ["", " "]
    for least in (1, 6, 15):
        docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 14)))) for i in range(25)]
        docs.append((25, docs[3][1] + "\nend"))
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        want = dict(brute_lines([(i, t) for i, t in docs], least))
        with_word = lambda t: [x for x in t.split("\n") if x.strip()]  # blank lines go with a window, not with a run of windows
        got = {x.doc_id: with_word(x.text) for x in line_dedup.dedup_lines(frame, min_words=least).collect()}
        assert got == {i: with_word(t) for i, t in want.items()}


def test_a_popular_run_is_spread(spark, words):
    """One run of 60 words in a third of all documents: no range of the order holds much of it, and one copy stays."""
    r = random.Random(21)
    run = "\n".join(" ".join(words(r, 20)) for _ in range(3))
    docs = [(i, "\n".join([" ".join(words(r, 25)), *([run] if i % 3 == 0 else [" ".join(words(r, 60))]), " ".join(words(r, 25))])) for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        order = line_dedup.suffix_array(frame)
        sizes = {x.part: x["count"] for x in order.groupBy("part").count().collect()}
        top = order.groupBy("a", "b").count().agg({"count": "max"}).first()[0]
        assert top == 1000 and len(sizes) == 8 * line_dedup.RANGES and max(sizes.values()) < 2.5 * sum(sizes.values()) / len(sizes)
        got = {x.doc_id: x.n_removed_lines for x in line_dedup.op6_line_dedup(frame).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert got == {i: 3 if i % 3 == 0 and i else 0 for i, _ in docs}
    assert got == {x.doc_id: x.n_removed_lines for x in line_dedup.op6_line_dedup(frame.repartition(5)).collect()}


def test_rows_that_repeat_are_one_document(spark, words):
    r = random.Random(22)
    one, two = " ".join(words(r, 60)), " ".join(words(r, 70))
    rows = [(1, one), (1, one), (1, one), (2, one + "\n" + two), (2, one + "\n" + two), (3, two), (None, two), (4, None)]
    got = sorted(((x.doc_id, x.n_removed_lines, x.text) for x in line_dedup.op6_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 0, one)] * 3 + [(2, 2, "")] * 2 + [(3, 1, ""), (None, 0, two), (4, 0, None)], key=str)


# --- 7, 8, 9, 10 -----------------------------------------------------------------------------------------------------


def held_out(part_of):
    """Precision and recall over rows of the labelled table, each judged by a model that was trained without its part."""
    labelled = url_filter.labelled_urls()
    parts = [part_of(k, h) for k, (h, _, _) in enumerate(labelled)]
    right = blocked = bad = 0
    for f in sorted(set(parts)):
        weights, bias = url_filter.train([r for r, p in zip(labelled, parts) if p != f])
        for (h, p, y), part in zip(labelled, parts):
            if part == f:
                said = url_filter.score(h, p, weights, bias) >= 0.5
                right, blocked, bad = right + (said and y == 1), blocked + said, bad + y
    return right / blocked, right / bad


def test_url_model_on_held_out_names():
    """New names of known words; and new words, of which character n-grams can know little."""
    precision, recall = held_out(lambda k, h: k % 5)
    print(f"new names: precision {precision:.3f}, recall {recall:.3f}")
    assert precision > 0.9 and recall > 0.75
    words = [w for kinds in (url_filter.BAD, url_filter.GOOD) for first, _ in kinds.values() for w in first.split()]
    precision, recall = held_out(lambda k, h: next((i for i, w in enumerate(words) if w in h), k) % 5)
    print(f"new words: precision {precision:.3f}, recall {recall:.3f}")


def test_verdicts_of_all_pages(spark, sf_dir):
    """Every page against plain Python: where the host ends, which rule is the longest that fits, what the model says of the rest."""
    weights, bias = url_filter.train()
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    want = {}
    for i, url in rows(spark, sf_dir, "pages", "page_id", "url"):
        rest = (url or "").partition("://")[2]
        host = re.split("[/?#]", rest)[0].translate(LOWER)
        path = re.split("[?#]", rest[len(host) :])[0]
        fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "block" if url_filter.score(host, path, weights, bias) >= 0.5 else "allow"))
        want[i] = (host, path, rule, verdict)
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.op7_url_filter(table(spark, sf_dir, "pages")).collect()}
    assert got == want and {v for *_, v in got.values()} == {"allow", "block"}


def test_hard_urls(spark):
    """An empty table, very long URLs, repeated rows, further columns of the same names."""
    long = "http://" + "a" * 100_000 + ".example.org/" + "b/" * 100_000
    pages = spark.createDataFrame([(1, long, "x", "y"), (1, long, "x", "y"), (2, None, None, None)], "page_id long, url string, host string, c0 string")
    got = [tuple(x) for x in url_filter.op7_url_filter(pages).collect()]
    assert len(got) == 3 and sorted(len(x[2]) for x in got) == [0, 200_001, 200_001]
    assert url_filter.op7_url_filter(pages.where("false")).count() == 0


def test_classifier_on_held_out_labels(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    train, rest = labels.where("doc_id % 3 <> 0"), {x.doc_id: x.quality for x in labels.where("doc_id % 3 = 0").collect()}
    got = {x.doc_id: x.kept for x in quality_classifier.op8_quality_classifier(docs, train).collect()}
    assert np.mean([got[i] == bool(q) for i, q in rest.items()]) > 0.85
    assert np.mean([got[i] for i, q in rest.items() if q == 1]) > 0.95


def test_views_teach_each_other(spark):
    """Labelled texts know one vocabulary. Only the source says what the others are, and the text view learns theirs from it."""
    r = random.Random(31)
    pick = lambda stem, n: " ".join(f"{stem}{r.randint(0, 30)}" for _ in range(n))
    docs, labels = [], []
    for i in range(900):
        good, old = i % 2, i < 200
        docs.append((i, pick(("bad", "fine")[good] if old else ("junk", "prose")[good], 60), "en", ("dump", "library")[good], 300))
        labels += [(i, good)] * old
    docs += [(1000 + i, pick(("junk", "prose")[i % 2], 60), "en", "unseen", 300) for i in range(100)]  # which metadata can't tell
    d, k = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int")

    def right(rounds):
        got = {x.doc_id: x.text_score for x in quality_classifier.op8_quality_classifier(d, k, rounds=rounds).collect()}
        return np.mean([(got[1000 + i] > 0.5) == bool(i % 2) for i in range(100)])

    alone, taught = right(0), right(quality_classifier.ROUNDS)
    assert alone < 0.8 and taught > 0.95


def test_only_labelled_rows_come_to_the_driver(spark, monkeypatch):
    """One ID on most rows, labelled and not: max_labelled rows are gathered, and cells."""
    docs = [(1, f"text {i % 7} words", "en", "s", 10) for i in range(400)] + [(i, f"other {i}", "en", "t", 10) for i in range(2, 60)]
    labels = [(i, i % 2) for i in range(1, 40)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    monkeypatch.setattr(quality_classifier, "co_train", lambda x, y, teach, rounds: seen.append((x.shape, teach(np.zeros(quality_classifier.N_TEXT + 1) + 9, np.zeros(quality_classifier.N_META + 1) + 9))))
    assert quality_classifier.op8_quality_classifier(d, spark.createDataFrame(labels, "doc_id long, quality int"), max_labelled=20).where("kept").count() == len(docs)
    (n, _), teach = seen[0]
    assert n == 20
    for means, said, counts in teach:  # every document that isn't in the sample is counted, repeated rows and all
        assert len(means) <= 2 * quality_classifier.CELLS and set(said) == {1.0} and counts.sum() in (len(docs) - 20, len(docs) - 419)


def test_classifier_without_labels_keeps_all(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where("false")
    assert quality_classifier.op8_quality_classifier(table(spark, sf_dir, "documents"), labels).where("not kept").count() == 0


def test_ledger(spark):
    frame = lambda xs: spark.createDataFrame(xs, "source string, lang string, tokenizer string, tokens long")
    book = token_counts.Ledger(spark)
    one, two = frame([("a", "en", "t", 5), ("a", "en", "t", 7), (None, "en", "t", 1)]), frame([("a", "en", "t", 7)])
    assert book.commit("b1", token_counts.inserts(one)) and not book.commit("b1", token_counts.inserts(one))
    assert book.commit("b2", token_counts.deletes(two)) and book.commit("b3", token_counts.revisions(frame([("a", "en", "t", 5)]), frame([("a", "en", "t", 6)])))
    want = {("a", 1, 6), (None, 1, 1)}
    see = lambda: {(x.source, x.n_docs, x.n_tokens) for x in book.totals().collect()}
    assert see() == want
    book.compact()
    assert see() == want and not book.commit("b2", token_counts.deletes(two)) and see() == want
    assert book.commit("b4", token_counts.deletes(frame([(None, "en", "t", 1)]))) and see() == {("a", 1, 6)}
    with pytest.raises(ValueError):
        book.commit("../x", one)


def test_a_commit_inside_compact_counts_once(spark):
    frame = spark.createDataFrame([("a", "en", "t", 5)], "source string, lang string, tokenizer string, tokens long")
    book = token_counts.Ledger(spark)
    book.commit("b1", token_counts.inserts(frame))
    published, late = book._publish, token_counts.Ledger(spark, book.root)

    def slow(folder, name, write):
        if folder == "snapshots":  # everything is read, nothing is written yet
            assert late.commit("b2", token_counts.inserts(frame))
        return published(folder, name, write)

    book._publish = slow
    book.compact()
    assert [(x.n_docs, x.n_tokens) for x in book.totals().collect()] == [(2, 10)]
    book._publish = published
    book.compact()
    assert [(x.n_docs, x.n_tokens) for x in book.totals().collect()] == [(2, 10)] and book.batches() == ["b1", "b2"]


def test_two_writers_of_one_batch(spark):
    frame = spark.createDataFrame([("a", "en", "t", 5)], "source string, lang string, tokenizer string, tokens long")
    one = token_counts.Ledger(spark)
    two = token_counts.Ledger(spark, one.root)
    published, said = one._publish, []

    def raced(folder, name, write):  # both have seen that the batch isn't there
        said.append(two.commit("b1", token_counts.inserts(frame)))
        return published(folder, name, write)

    one._publish = raced
    said.append(one.commit("b1", token_counts.inserts(frame)))
    assert said == [True, False] and one.batches() == ["b1"]
    for _ in range(2):
        assert [(x.n_docs, x.n_tokens) for x in two.totals().collect()] == [(1, 5)]
        two.compact()


def test_token_totals_against_a_recount(spark, sf_dir):
    from corpusmill.llm.tokens import encoder

    encode, want = encoder(), Counter()
    toxic = {i for i, x in rows(spark, sf_dir, "labels", "doc_id", "toxic") if x == 1}
    poor = {i for i, q, x in rows(spark, sf_dir, "labels", "doc_id", "quality", "toxic") if q == 0 and x == 0}
    for i, s, k, t in rows(spark, sf_dir, "documents", "doc_id", "source", "lang", "text"):
        if i not in toxic:
            revised = re.sub(r"[#*$%&|<>]+", "", t) if i in poor else t
            for name, n in (("byte_bpe_50k-1", len(encode(revised or ""))), ("words-1", len(revised.encode().split()))):
                want[s, k, name, "d"] += 1
                want[s, k, name, "t"] += n
    got = token_counts.op9_token_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).collect()
    assert {(x.source, x.lang, x.tokenizer, c): v for x in got for c, v in (("d", x.n_docs), ("t", x.n_tokens))} == dict(want)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1.@+-() _é2", max_size=40))
def test_base_patterns(text):
    want = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            want += [(m.start(), m.end(), kind)] * bool(ok)
    assert sorted(pii.base_spans(text)) == sorted(want)


def test_long_texts_take_linear_time_and_little_memory():
    import time
    import tracemalloc

    field, r = pii.train(), random.Random(2)
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "a@" * 50_000):
        pii.base_spans(text)
    numbers = " ".join(str(r.randint(1, 99_999)) for _ in range(16_000))
    pii.find(numbers[:5_000], field)
    took = []
    for text in (numbers[: len(numbers) // 4], numbers):
        start = time.process_time()
        pii.find(text, field)
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 1
    tracemalloc.start()
    pii.find(numbers[: len(numbers) // 4], field)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20  # a cache of spans, and some bytes for each atom
    tracemalloc.stop()


def test_dynamic_program_equals_enumeration():
    """The best of all segmentations, each scored from the features that the field is trained with."""
    field, r = pii.train(), random.Random(6)
    m = len(pii.KINDS) + 1
    turn = lambda k, p: field.w.get((k, f"<{p}"), 0.0)
    for _ in range(150):
        text = "".join(r.choice(["ab", "x", "12", "555", "@", ".", " ", " ", "-", "(", ")", "+", "c9f0", "  "]) for _ in range(9))
        atoms = [x.span() for x in pii._ATOM.finditer(text)]
        window = pii.Window(text, atoms)
        paths = [[(0.0, 0, ())]] + [[] for _ in atoms]  # (score, last kind, spans) of every segmentation up to each atom
        for j in range(1, len(atoms) + 1):
            for i, k, features in window.ends[j]:
                own = field.score(k, features)
                paths[j] += [(s + turn(k, p) + own, k, (*spans, (atoms[i][0], atoms[j - 1][1], pii.KINDS[k - 1])) if k else spans) for s, p, spans in paths[i]]
        got = field.best(text, pii.array("q", [x for a in atoms for x in a]))
        best = max(s for s, _, _ in paths[-1])
        assert any(abs(s - best) < 1e-9 and spans == tuple(got) for s, _, spans in paths[-1])


def test_field_on_held_out_sentences(spark):
    field = pii.train()
    sentences = pii.train_sentences(150, seed=77)
    right = found = true = 0
    for text, spans in sentences:
        got = {s for x in pii.windows(text) for s in field.best(text, x)}
        right += len(got & set(spans))
        found += len(got)
        true += len(spans)
    assert right / found > 0.93 and right / true > 0.93
    docs = spark.createDataFrame([(1, 'é call (555) 123-4567 or token = "' + "0af3" * 10 + '" x'), (2, "in 1999 we had 12 cats")], "doc_id long, text string")
    got = {x.doc_id: x.spans for x in pii.op10_pii(docs).collect()}
    assert got == {1: "phone:7:21,secret:34:74", 2: ""}
    assert pii.redact(docs).orderBy("doc_id").first().text == 'é call [PHONE] or token = "[SECRET]" x'


def test_windows_cover_every_hot_atom():
    r = random.Random(8)
    for _ in range(200):
        text = "".join(r.choice(["ab ", "c", "1", "@", ".", " ", "\n", "é ", "x y z w v u t s "]) for _ in range(60))
        seen = {(x[i], x[i + 1]) for x in pii.windows(text) for i in range(0, len(x), 2)}
        assert all(any(a <= m.start() < b for a, b in seen) for m in re.finditer("[0-9@]", text))


def test_pipeline_against_its_stages(spark, sf_dir):
    """Every row of run(): what the quality rules and line dedup leave (each has SQL of its own), then near dedup, decontamination and packing by brute force."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    kept = quality_rules.op3_quality_rules(table(spark, sf_dir, "documents")).where("kept").select("doc_id")
    good = table(spark, sf_dir, "documents").join(kept, "doc_id", "left_semi")
    texts = {x.doc_id: x.text for x in line_dedup.op6_line_dedup(good).collect() if x.n_removed_lines == 0 or x.text.split()}
    groups = brute_components(list(texts.items()), 5, 80)
    texts = {i: t for i, t in texts.items() if groups[i][2]}
    windows = set()
    for _, t in rows(spark, sf_dir, "benchmark", "item_id", "text"):
        own = alnum(t)
        n = min(10, len(own))
        windows |= {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}

    def clean(t):
        own = alnum(t)
        return not any(tuple(own[k : k + n]) in windows for n in sizes for k in range(len(own) - n + 1))

    texts = {i: t for i, t in texts.items() if clean(t)}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, t in texts.items():
        ids, at, piece = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4"), 0, 0
        while at < len(ids):
            n = (len(ids) - 1) % 1024 + 1 if at == 0 else 1024
            want.add((i, piece, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at, piece = at + n, piece + 1
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(x.doc_id, x.piece, x.start, x.length, zlib.crc32(x.ids)) for x in got} == want and len(got) == len(want) > 100
    places = defaultdict(list)
    for x in got:
        places[x.sequence_id].append((x.offset, x.length))
    for spans in places.values():
        ends = [0, *(o + n for o, n in sorted(spans))]
        assert [o for o, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 1024
