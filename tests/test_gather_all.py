from corpusmill.plans.queries import QUERIES


def test_gather_takes_all_predictions(spark, tmp_path):
    convs = [1, 299, 300, 70_000]
    rows = [(c, t, ("user", "assistant")[t], f"text {c} {t}") for c in convs for t in (0, 1)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["gather_focal"](spark, str(tmp_path)).collect()
    assert sorted((x.idx, x.src) for x in got) == [(c * 1000, f"text {c} 1") for c in convs]
