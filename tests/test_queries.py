import pytest

from corpusmill.plans import derived_queries, io_queries  # noqa: F401  register their queries
from corpusmill.plans.queries import ORACLES, QUERIES
from tests.compare import same_rows

SLOW = {"java_compile", "compile_status_counts"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_equals_sql(spark, duck, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


def test_compile_gate(spark, duck, sf_dir):
    same_rows(QUERIES["java_compile"](spark, sf_dir), duck.sql(ORACLES["java_compile"]))


def test_entry_finds_every_reference(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r.exact_match == 1.0 for r in rows)


def test_summary_cascades(spark, sf_dir):
    rows = {r.metric: r for r in QUERIES["evaluation_summary"](spark, sf_dir).collect()}
    assert rows["compile_rate"].n_in == rows["parse_rate"].passed
    assert rows["exact_match"].score == 1.0 and abs(rows["bleu"].score - 100) < 1e-9
