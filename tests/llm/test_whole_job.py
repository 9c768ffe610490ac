"""Inputs on which an operator once did less than its whole job."""

import re
from collections import Counter

from corpusmill.llm import token_counts


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_revision_covers_every_tokenizer(spark):
    from corpusmill.llm.tokens import encoder

    encode = encoder()
    texts = {1: "a ## b $$$ c", 2: "plain words", 3: "### ***", 4: "x % y", 5: None, 6: "", 7: "kept # as it is"}
    poor, toxic = {1, 2, 3, 5, 6}, {4}
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in texts.items()], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 0, int(i in toxic)) for i in poor | toxic] + [(7, 1, 0)], "doc_id long, quality int, toxic int")
    want = Counter()
    for i in texts.keys() - toxic:
        t = texts[i] or ""
        left = re.sub(r"[#*$%&|<>]+", "", t) if i in poor else t
        want["byte_bpe_50k-1"] += len(encode(left))
        want["words-1"] += len(left.split())
    got = {x.tokenizer: (x.n_docs, x.n_tokens) for x in token_counts.op9_token_counts(docs, labels).collect()}
    assert got == {k: (6, n) for k, n in want.items()}


def test_a_batch_that_was_acknowledged_is_never_overtaken(spark):
    """A slow writer that began first, a fast one that commits, and a compaction between: one of them counts, the one that was told so."""
    frame = lambda n: spark.createDataFrame([("a", "en", "t", n)], "source string, lang string, tokenizer string, tokens long")
    slow = token_counts.Ledger(spark)
    fast = token_counts.Ledger(spark, slow.root)
    published = slow._publish

    def late(folder, name, write):
        def first(path):
            write(path)
            assert fast.commit("b", token_counts.inserts(frame(5)))
            fast.compact()

        return published(folder, name, first)

    slow._publish = late
    assert slow.commit("b", token_counts.inserts(frame(7))) is False
    for _ in range(2):
        assert [x.n_tokens for x in slow.totals().collect()] == [5]
        fast.compact()
    assert not fast.commit("b", token_counts.inserts(frame(9))) and slow.batches() == ["b"]


def test_counts_of_columns_with_names_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a ## b", "s", "en", 77, "x", 9)], "doc_id long, text string, source string, lang string, n_words long, revised_text string, n_words_revised long")
    from pyspark.sql import functions as F

    got = {r.tokenizer: (r.tokens, r.revised_tokens, r.n_words) for r in token_counts.count_tokens(docs, keep=("n_words",), revised=F.regexp_replace("text", "#+", "")).collect()}
    assert got["words-1"] == (3, 2, 77) and got["byte_bpe_50k-1"][2] == 77
