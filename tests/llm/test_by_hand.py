"""Whole queries against plain Python: the choice of packing, verdicts, base columns of personal data, co-training."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, near_dedup, packing, pii, quality_classifier, url_filter
from corpusmill.llm.common import table

# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_windows_that_are_ruled_out_are_nowhere(words):
    """The table of pairs keeps every window that the suffix array finds, whatever else it keeps."""
    import pyarrow as pa

    from corpusmill.llm.words import ALNUM, hash_words, text_bytes

    r = random.Random(8)
    docs = [" ".join(words(r, r.choice([0, 1, 5, 300]))) for _ in range(60)]
    h, s, e, at = hash_words(*text_bytes(pa.array(docs)), ALNUM)
    shard = decontaminate.Shard(h, e - s, at, 10)
    items = [(str(i), " ".join(words(r, r.choice([1, 2, 9, 10, 40])))) for i in range(80)] + [(f"d{i}", " ".join(d.split()[3:20])) for i, d in enumerate(docs)] + [("w", docs[3].split()[0] if docs[3] else "x")]
    tests = decontaminate.TestSet(items, 10)
    interval = decontaminate.search(shard.words, shard.order, tests.codes, tests.first, tests.need)
    found = set(np.flatnonzero(interval[:, 1] > interval[:, 0]).tolist())
    live = set(shard.possible(tests).tolist())
    assert found and found <= live and len(live) < len(tests.first)


# --- 2 ---------------------------------------------------------------------------------------------------------------


def best_two_fit(lengths, capacity):
    """Bin by bin: fill greedily from the longest piece, then put two pieces in place of the smallest one if they fit its gap more tightly (the best two, the longer first)."""
    left = Counter(lengths)
    bins = []
    while left:
        own, room = [], capacity
        for size in sorted(left, reverse=True):
            while left[size] and size <= room:
                left[size] -= 1
                own.append(size)
                room -= size
        smallest, gap = own[-1], room + own[-1]
        best = None
        for a in (x for x in left if left[x] and x <= gap):
            for b in (x for x in left if left[x] and x <= min(a, gap - a)):
                if (a != b or left[a] > 1) and a + b > smallest and (best is None or (a + b, a) > best[:2]):
                    best = (a + b, a, b)
        if best:
            left[smallest] += 1
            own[-1:] = best[1:]
            left[best[1]] -= 1
            left[best[2]] -= 1
        bins.append(tuple(sorted(own)))
        left = +left
    return Counter(bins)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_that_of_one_bin_after_another(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 17, 40])
    lengths = [r.randint(1, capacity) if seed % 2 else min(capacity, 1 + int(r.expovariate(4 / capacity))) for _ in range(r.randint(1, 120))]
    counts = np.bincount(lengths, minlength=capacity + 1)
    got = Counter()
    for sizes, times in packing.plan(counts, capacity):
        got[tuple(sorted(sizes))] += times
    assert got == best_two_fit(lengths, capacity)


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_classes_that_meet_many_on_either_side(spark, monkeypatch, words):
    """A text that is the second of most pairs is met in many places, and no pair is lost."""
    monkeypatch.setattr(near_dedup, "HEAVY", 3)
    r = random.Random(2)
    base = words(r, 60)
    texts = {b"%02d" % i: " ".join(base[:30] + ([f"x{i}"] if i else []) + base[30:]) for i in range(30)}
    frame = spark.createDataFrame([(bytearray(k), t) for k, t in texts.items()], "digest binary, text string")
    for pairs in ([(k, b"00") for k in texts if k != b"00"], [(b"00", k) for k in texts if k != b"00"]):
        df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in pairs], "a binary, b binary")
        dealt, heavy = near_dedup._salted(df, "b", "a", df.count())
        assert heavy.count() == (pairs[0][1] == b"00") and (dealt.select("salt_b").distinct().count() > 5) == (pairs[0][1] == b"00")
        assert sorted((bytes(x.a), bytes(x.b)) for x in near_dedup._verify(df, frame, 2, 80).collect()) == sorted(pairs)


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_verdicts_by_hand(spark, sf_dir):
    """Verdicts of all pages from the weights by plain Python: n-grams, their norm, the sum and the threshold."""
    import math

    import xxhash

    weights, bias = url_filter.train()
    got = {r.page_id: r for r in url_filter.op7_url_filter(table(spark, sf_dir, "pages")).collect()}
    seen = Counter()
    for r in table(spark, sf_dir, "pages").select("page_id", "url").collect():
        rest = r.url.partition("://")[2] if r.url and "://" in r.url else ""
        host = re.match(r"[^/?#]*", rest).group().translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
        path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest).group()) :]).group()
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            _, rule, verdict = max(fits)
        else:
            rule, places = None, set()
            for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")) if host or path else ():
                places |= {xxhash.xxh32_intdigest(mark + text[i : i + n]) % url_filter.BUCKETS for n in url_filter.GRAMS for i in range(len(text) - n + 1)}
            z = bias + (sum(weights[p] for p in sorted(places)) / math.sqrt(len(places)) if places else 0)
            verdict = "block" if 1 / (1 + math.exp(-z)) >= 0.5 else "allow"
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule, got[r.page_id].verdict) == (host, path, rule, verdict), r.url
        seen[rule is None, verdict] += 1
    assert len(seen) == 4  # by a rule and by the model, of both verdicts


def test_urls_without_an_id_or_a_url(spark):
    pages = spark.createDataFrame([(None, "http://a.org/fr/x"), (1, None), (1, None), (2, "no scheme"), (3, "http://" + "x" * 300_000 + ".net/")], "page_id long, url string")
    got = sorted(((r.page_id, r.rule, r.verdict) for r in url_filter.op7_url_filter(pages).collect()), key=repr)
    assert got == sorted([(None, "org/fr/", "allow"), (1, None, "allow"), (1, None, "allow"), (2, None, "allow"), (3, "net/", "block")], key=repr)


# --- 10 --------------------------------------------------------------------------------------------------------------


def base_by_hand(text):
    """The patterns of the contract as they stand, leftmost without overlaps, each kind for itself."""

    def luhn(digits):
        return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0

    digits = lambda t: re.sub("[^0-9]", "", t)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= len(digits(t)) <= 19 and luhn(digits(t))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits(t)) <= 15),
    )
    found = [(m.start(), k, m.end(), name) for k, (name, pattern, good) in enumerate(kinds) for m in re.finditer(pattern, text) if good(m.group())]
    return [(name, a, b) for a, _, b, name in sorted(found)]


def pii_by_hand(docs):
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        base = base_by_hand(r.text or "")
        n = Counter(name for name, _, _ in base)
        want[r.doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()] += 1
    return want


def base_columns(docs):
    return Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.op10_pii(docs).collect())


def test_base_columns_of_all_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = base_columns(docs)
    assert got == pii_by_hand(docs)
    assert all(sum(k[i] for k in got) > 0 for i in (1, 2, 3, 4))


def test_base_columns_of_hard_rows(hard_docs, spark):
    some = hard_docs.where("length(text) is null or length(text) <> 300000")  # re takes quadratic time on that one
    assert base_columns(some) == pii_by_hand(some)
    r = random.Random(4)
    texts = ["".join(r.choice(["12", "@", "a.b", ".", "+4", " ", "-", "(", "255", "256", "é", "4111 1111 1111 1111", "1.2.3.4", "x@y.z"]) for _ in range(r.randint(0, 40))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert base_columns(docs) == pii_by_hand(docs)


def test_method_spans_keep_the_base(spark, sf_dir):
    """Every base span stands among the spans, which are in order; only kinds of the field are added."""
    for r in pii.op10_pii(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").collect():
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(base_by_hand(r.text or "")) <= set(spans) and [s[1] for s in spans] == sorted(s[1] for s in spans)
        assert {k for k, _, _ in spans} <= set(pii.KINDS)


# --- 8 ---------------------------------------------------------------------------------------------------------------


def _views(docs, labels):
    """Features of all documents and their labels, without Spark."""
    import pyarrow as pa

    frame, told = docs.toPandas(), {r.doc_id: r.quality for r in labels.collect()}
    x = np.hstack([quality_classifier.text_features(pa.array(frame["text"], pa.string())), quality_classifier.meta_features(frame["source"].tolist(), frame["lang"].tolist(), frame["n_chars"].tolist())])
    return frame["doc_id"].to_numpy(), x.astype(np.float16).astype(np.float32), np.array([told.get(i, -1) for i in frame["doc_id"]])


def _sure(x, models):
    """For each view that is taught: its rows of which the other view is sure, and their labels."""
    views, q = (x[:, : quality_classifier.N_TEXT], x[:, quality_classifier.N_TEXT :]), quality_classifier
    for i, j in ((1, 0), (0, 1)):
        z = q.odds(models[i], views[i])
        yield np.vstack([views[j][z < -q.SURE], views[j][z > q.SURE]]), np.r_[np.zeros((z < -q.SURE).sum()), np.ones((z > q.SURE).sum())]


def test_cells_are_all_the_sure_documents(spark, sf_dir):
    """Sums and counts that one pass over the corpus gives, against all documents one by one."""
    q, docs = quality_classifier, table(spark, sf_dir, "documents")
    _, x, y = _views(docs, table(spark, sf_dir, "labels"))
    r = np.random.default_rng(1)
    models = [r.standard_normal(n + 1) * 3 for n in (q.N_TEXT, q.N_META)]
    got = q.taught(q.features(docs.repartition(5)), *models)
    for (means, labels, counts), (rows, want) in zip(got, _sure(x, models)):
        assert {k: counts[labels == k].sum() for k in (0, 1)} == {k: (want == k).sum() for k in (0, 1)} and len(means) <= 2 * q.CELLS
        for k in (0, 1):
            np.testing.assert_allclose((means[labels == k] * counts[labels == k][:, None]).sum(0), rows[want == k].sum(0), rtol=1e-3, atol=1e-2)


def test_co_training_on_cells_against_all_rows(spark, sf_dir):
    """The whole query against co-training in which every sure document is a row of its own."""
    q, docs, labels = quality_classifier, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ids, x, y = _views(docs, labels)
    order = {r.id: r.place for r in docs.selectExpr("doc_id AS id", "xxhash64(doc_id) AS place").collect()}
    known = np.array(sorted(np.flatnonzero(y >= 0), key=lambda i: (order[ids[i]], ids[i])))
    pool = np.flatnonzero(y < 0)
    plain = q.co_train(x[known], y[known].astype(float), lambda text, meta: tuple((rows, said, np.ones(len(said))) for rows, said in _sure(x[pool], (text, meta))))
    want = dict(zip(ids.tolist(), plain.score(x[:, : q.N_TEXT], x[:, q.N_TEXT :])[:, 2]))
    got = {r.doc_id: (r.score, r.kept) for r in q.op8_quality_classifier(docs, labels).collect()}
    assert np.mean([abs(got[i][0] - w) for i, w in want.items()]) < 0.05
    assert np.mean([got[i][1] == (w >= 0.2) for i, w in want.items()]) > 0.95


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_repeated_runs_with_their_lengths(spark):
    """Maximal runs of lines that later copies cover, by longest previous factors in plain Python."""
    from corpusmill.llm import line_dedup

    r = random.Random(9)
    pool = [" ".join(f"w{k}" for k in range(r.randint(1, 9))) + f" l{i}" for i in range(7)]
    for least in (6, 15):
        docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 16)))) for i in range(30)]
        seqs = [t.split("\n") if t else [] for _, t in docs]
        want = set()
        for d, own in enumerate(seqs):
            covered = set()
            for s in range(len(own)):
                for e in range(d + 1):
                    for p in range(len(seqs[e]) if e < d else s):
                        m = 0
                        while s + m < len(own) and p + m < len(seqs[e]) and own[s + m] == seqs[e][p + m]:
                            m += 1
                        if sum(len(x.split()) for x in own[s : s + m]) >= least:
                            covered |= set(range(s, s + m))
            for a in sorted(covered):
                if a - 1 not in covered:
                    b = next(x for x in range(a, len(own) + 1) if x not in covered)
                    want.add((d, a, b - 1, b - a, sum(len(x.split()) for x in own[a:b])))
        got = line_dedup.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), min_words=least)
        assert {(x.key, x.first, x.last, x.n_lines, x.n_words) for x in got.collect()} == want and want


def test_labelled_urls_from_a_table(spark):
    """A model of other labels knows other words; the sample is bounded and the same each time."""
    rows = [(f"http://zq{'brakkel' if i % 2 else 'wumpo'}{i}.example/{i}", i % 2) for i in range(60)] + [("http://null.example/", None)]
    urls = spark.createDataFrame(rows, "url string, bad int")
    labelled = url_filter.labelled_from(urls)
    assert len(labelled) == 60 and labelled == url_filter.labelled_from(urls.repartition(7)) and len(url_filter.labelled_from(urls, max_rows=7)) == 7
    pages = spark.createDataFrame([(1, "http://brakkel.example/x"), (2, "http://wumpo.example/y")], "page_id long, url string")
    assert {r.id: r.verdict for r in url_filter.filter_urls(pages, labelled=labelled).collect()} == {1: "block", 2: "allow"}


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_of_hard_and_of_no_rows(spark, hard_docs, no_docs, sf_dir):
    """Nulls, blanks, long texts, repeated rows and clashing columns go through all stages; all but the last keep the columns."""
    import corpus_pipeline
    from corpusmill.llm.common import materialise

    from corpusmill.llm import quality_rules

    clean = decontaminate.decontaminate(quality_rules.filter_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")).where("n_chars < 3000").orderBy(F.desc("n_chars")).limit(2).collect()
    good, other = (x.text for x in clean)
    more = spark.createDataFrame([(100, good), (100, good), (101, good), (None, other)], "doc_id long, text string")
    for docs, empty in ((hard_docs.unionByName(more, allowMissingColumns=True), False), (no_docs, True)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), f"hard-{name}")
            assert docs.columns == columns, name
        kept = Counter((x.doc_id, x.text) for x in docs.select("doc_id", "text").collect())
        assert empty or (kept[100, good] == 2 and not any(i == 101 for i, _ in kept) and all(t and len(t.split()) >= 50 for _, t in kept))
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert (packed.count() == 0) == empty and (empty or {x.doc_id for x in packed.collect()} == {i for i, _ in kept})
