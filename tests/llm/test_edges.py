"""Every operator on hard and on empty tables: no crash, the rows it should give, columns untouched."""

from collections import Counter

import pytest

from corpusmill.llm import decontaminate, license_scan, line_dedup, near_dedup, packing, pii, quality_classifier, quality_rules, token_counts, url_filter


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, "single"), (2, None), (3, ""), (None, "changed"), (4, "!!!")], "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (7, 1, 1), (None, 1, 0), (99, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int")


def test_one_row_for_each_document(hard_docs, no_docs, benchmark, labels):
    n = hard_docs.count()
    ops = {
        "op1": lambda d: decontaminate.op1_decontaminate(d, benchmark), "op3": quality_rules.op3_quality_rules, "op4": near_dedup.op4_near_dedup, "op5": license_scan.op5_license_scan,
        "op6": line_dedup.op6_line_dedup, "op8": lambda d: quality_classifier.op8_quality_classifier(d, labels), "op10": pii.op10_pii,
    }
    for name, op in ops.items():
        assert Counter(r.doc_id for r in op(hard_docs).collect()) == Counter(r.doc_id for r in hard_docs.select("doc_id").collect()), name
        assert op(no_docs).count() == 0, name
    assert n == 14 and packing.op2_best_fit_packing(no_docs).count() == 0 and token_counts.op9_token_counts(no_docs, labels).count() == 0


def test_packing_and_counts_of_hard_rows(harder_docs, labels):
    """Every document's IDs come back whole, each at its place, and counts are those of the file's tokenizer."""
    import zlib
    from collections import defaultdict

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text or "") for r in harder_docs.select("doc_id", "text").collect()]
    ids = {t: np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4") for _, t in rows}
    want = Counter()
    for i, t in rows:
        at, piece = 0, 0
        while at < len(ids[t]):
            n = (len(ids[t]) - 1) % 1024 + 1 if at == 0 else 1024
            want[i, piece, at, n, zlib.crc32(ids[t][at : at + n].tobytes())] += 1
            at, piece = at + n, piece + 1
    packed = packing.op2_best_fit_packing(harder_docs).collect()
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in packed) == want
    bins = defaultdict(list)
    for x in packed:
        bins[x.sequence_id].append((x.offset, x.length))
    for spans in bins.values():
        ends = [0, *(o + n for o, n in sorted(spans))]
        assert [o for o, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 1024
    counted = token_counts.op9_token_counts(harder_docs, labels.where("false")).collect()
    assert sum(x.n_tokens for x in counted if x.tokenizer == "byte_bpe_50k-1") == sum(len(ids[t]) - 1 for _, t in rows)
    assert sum(x.n_tokens for x in counted if x.tokenizer == "words-1") == sum(len(t.encode().split()) for _, t in rows)
    assert {x.tokenizer: n for x, n in ((x, sum(y.n_docs for y in counted if y.tokenizer == x.tokenizer)) for x in counted)} == dict.fromkeys(("byte_bpe_50k-1", "words-1"), len(rows))


def test_harder_rows(spark, harder_docs, labels):
    from tests.llm.conftest import LONG_ITEM

    n = Counter(r.doc_id for r in harder_docs.select("doc_id").collect())
    items = spark.createDataFrame([(1, LONG_ITEM), (2, "single")], "item_id long, text string")
    hit = {x.doc_id: x for x in decontaminate.op1_decontaminate(harder_docs, items).collect()}
    assert hit[15].longest_match == 60_000 and hit[15].n_hit == 60_000 and not hit[12].contaminated and hit[13].n_words == 240
    for op in (quality_rules.op3_quality_rules, near_dedup.op4_near_dedup, license_scan.op5_license_scan, line_dedup.op6_line_dedup, lambda d: quality_classifier.op8_quality_classifier(d, labels), pii.op10_pii):
        assert Counter(x.doc_id for x in op(harder_docs).collect()) == n


def test_filters_keep_columns(hard_docs, benchmark):
    for out in (quality_rules.filter_documents(hard_docs), decontaminate.decontaminate(hard_docs, benchmark), near_dedup.drop_near_duplicates(hard_docs), pii.redact(hard_docs), license_scan.drop_licensed(hard_docs, ["MIT"]), line_dedup.dedup_lines(hard_docs).drop("removed_lines_")):
        assert out.columns == hard_docs.columns
        assert {r.c0 for r in out.select("c0").collect()} <= {str(k) for k in range(14)}


def test_empty_benchmark_and_short_items(hard_docs, benchmark):
    clean = decontaminate.op1_decontaminate(hard_docs, benchmark.where("false"))
    assert clean.where("contaminated").count() == 0
    hit = {r.doc_id for r in decontaminate.op1_decontaminate(hard_docs, benchmark).where("contaminated").collect()}
    assert hit == {3, 8, 9}


def test_near_duplicates_of_hard_rows(hard_docs):
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.op4_near_dedup(hard_docs).collect()}
    assert {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (6, 6, True), (8, 8, True), (9, 8, False), (11, 11, True), (None, 1, False), (None, None, True)} <= got


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "HTTP://A.Net", "https://a.net/", "x://sub.example.NET/en/1?q#f", "http://example.com/de/x", "http://notexample.com/de/x", "ftp://b.org/fr/", "http://casino-bets.test/x?y", "http://museum.test", "http://a.b/c\nd#e"]
    rows = {r.page_id: r for r in url_filter.op7_url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(r.host, r.path) for _, r in sorted(rows.items())] == [("", "")] * 4 + [("a.net", ""), ("a.net", "/"), ("sub.example.net", "/en/1"), ("example.com", "/de/x"), ("notexample.com", "/de/x"), ("b.org", "/fr/"), ("casino-bets.test", "/x"), ("museum.test", ""), ("a.b", "/c\nd")]
    assert [r.rule for _, r in sorted(rows.items())] == [None] * 5 + ["net/", "example.net/en/", "example.com/de/", None, "org/fr/"] + [None] * 3
    assert rows[5].verdict == "block" and rows[6].verdict == "allow" and rows[10].verdict == "block" and rows[11].verdict == "allow" and rows[0].verdict == "allow"


def test_pipeline_stages_on_hard_rows(spark, harder_docs, no_docs, sf_dir):
    import corpus_pipeline

    for docs in (harder_docs.unionByName(harder_docs.where("doc_id = 1")), no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            out.count()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).where("piece = 0")
        assert Counter(x.doc_id for x in packed.collect()) == Counter(x.doc_id for x in docs.select("doc_id").collect())


def test_pipeline_keeps_a_good_document_of_many_blanks(spark, harder_docs, tmp_path):
    """All stages, one after the other, on hard rows: a good text survives, long blanks and all."""
    import corpus_pipeline

    harder_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing like it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    judged = {x.doc_id for x in quality_rules.op3_quality_rules(harder_docs).where("kept").collect()}
    assert kept <= judged and (13 in kept) == (13 in judged) and 12 not in kept
