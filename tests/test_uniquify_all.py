from corpusmill.plans.queries import QUERIES


def test_uniquify_covers_every_variant(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(12)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.idx: (x.named, x.rel_path) for x in QUERIES["uniquify_test"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(12))
    assert got[5] == ("class T5 {\n@Test public void t5() { assertTrue(true); }\n}", "T5.java")
    assert got[8] == ("class T8 {\nundefined\n}", "T8.java")
    assert got[9][0].replace("\n", "") == "class T9 {}" and got[9][1] == "T9.java"
