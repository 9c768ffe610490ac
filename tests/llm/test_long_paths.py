import random

from corpusmill.llm.components import connected_components


def test_long_path_of_random_labels(spark):
    """Successive revisions, each linked to its neighbours only, under digests: the rounds before took over 60."""
    names = random.Random(1).sample(range(10**6), 1000)
    edges = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    assert {(x.node, x.label) for x in connected_components(edges).collect()} == {(n, min(names)) for n in names}
