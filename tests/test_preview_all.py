from corpusmill.plans.queries import QUERIES


def test_preview_takes_all_rows(spark, tmp_path):
    convs = [1, 99, 100, 70_000]
    rows = [(c, t, ("user", "assistant")[t], f"text {c} {t}") for c in convs for t in (0, 1)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["prompt_preview"](spark, str(tmp_path)).collect()
    assert sorted(x.idx for x in got) == [c * 1000 for c in convs]
