import random

import pytest


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    stems = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(400)]
    return lambda rnd, n: [rnd.choice(stems) for _ in range(n)]


@pytest.fixture(scope="session")
def hard_docs(spark, words):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, clashing column names."""
    r = random.Random(7)
    text = lambda n: " ".join(words(r, n))
    one, long = text(120), text(60_000)
    near = one.split()
    near[60] = "changed"
    rows = [(1, one), (1, one), (2, one), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t\n "), (7, long), (8, "single"), (9, "single"), (None, text(80)), (None, one), (10, "é ß 日本 word " * 30), (11, "x" * 300_000)]
    names = ["quality", "matches", "removed_lines", "digest", "text_hash", "base", "spans", "key", "id", "refused_id", "c0"]
    data = [(i, t, None if k % 2 else "en", None if k % 3 else "src", len(t) if t and k % 4 else None, *(str(k) for _ in names)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture(scope="session")
def harder_docs(hard_docs, spark, words):
    """hard_docs with 2 MB of blanks, alone and inside a good document, a dump of numbers, and a benchmark item in full."""
    r = random.Random(17)
    good = " ".join(words(r, 120))
    rows = [(12, " " * 2_000_000), (13, good + " " * 2_000_000 + " ".join(words(r, 120))), (14, " ".join(str(r.randint(0, 9_999)) for _ in range(8_000))), (15, "x " + LONG_ITEM + " y"), (16, "<|endoftext|> " + good)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    return hard_docs.unionByName(more, allowMissingColumns=True)


#: 60,000 different words.
LONG_ITEM = " ".join(f"w{i}" for i in range(60_000))


@pytest.fixture(scope="session")
def no_docs(hard_docs):
    return hard_docs.where("false")
