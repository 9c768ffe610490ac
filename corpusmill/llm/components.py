"""Connected components of a graph given as an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import HEAVY, materialise

#: Labels and edges are two short columns; a task takes so many rows.
ROWS_PER_TASK = 500_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b): label is the least node of its component.

    Every round takes the least label among the neighbours, hands the least that any member heard to the node that the member
    pointed at, and then takes the label of the label, so whole trees move at once and a path of n nodes takes about log n
    rounds whatever the order of its labels. Labels only fall, and rounds go on until none does. Labels live in the shared folder; the driver sees only counts and whether a round changed
    any. All steps are aggregations with a combiner or joins against one row for each node, which is broadcast for nodes with a large share of the edges, so a node with very many
    edges is not gathered anywhere.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "cc-edges")
    # nodes with a large share of the edges, HEAVY at most; their edges stay where they are in each round
    edges, total = both.select("a", F.col("b").alias("node")), both.count()
    heavy = materialise(both.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n")).where(F.col("n") * HEAVY >= max(total, HEAVY * HEAVY)).select("node").coalesce(1), "cc-heavy")
    some = not heavy.isEmpty()
    tasks = total // ROWS_PER_TASK + 1

    def met(labels: DataFrame) -> DataFrame:
        """The edges with the labels of their far ends."""
        if not some:
            return edges.join(labels, "node")
        light = edges.join(F.broadcast(heavy), "node", "left_anti").join(labels, "node")
        return light.unionByName(edges.join(F.broadcast(labels.join(F.broadcast(heavy), "node", "left_semi")), "node"))

    keep = lambda df: materialise(df.coalesce(tasks), "cc-labels")
    labels = keep(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")))
    while True:
        heard = met(labels).groupBy("a").agg(F.min("label").alias("heard"))
        near = keep(labels.join(heard, labels["node"] == heard["a"]).select("node", F.least("label", "heard").alias("label"), F.col("label").alias("old")))
        told = near.groupBy(F.col("old").alias("root")).agg(F.min("label").alias("told"))
        hooked = near.join(told, near["node"] == told["root"], "left").select("node", F.least("label", "told").alias("label"), "old")
        up = hooked.select(F.col("node").alias("up"), F.col("label").alias("top"))
        jumped = keep(hooked.join(up, hooked["label"] == up["up"]).select("node", F.least("label", "top").alias("label"), "old"))
        labels = jumped.select("node", "label")
        if jumped.where("label != old").isEmpty():
            return labels


def relabel(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """df with column name: the label of column node, or the node itself if it has none."""
    some = labels.select(F.col("node").alias(node), F.col("label").alias("label_"))
    return df.join(some, node, "left").withColumn(name, F.coalesce("label_", node)).drop("label_")


def join_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after further links: only the components that a link connects take part in the rounds."""
    across = relabel(relabel(links, labels, "a", "x"), labels, "b", "y").where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    across = materialise(across, "cc-across")
    if across.isEmpty():
        return labels
    merged = connected_components(across)
    moved = relabel(labels.withColumnRenamed("label", "part"), merged, "part", "label").select("node", "label")
    fresh_nodes = merged.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return materialise(moved.union(fresh_nodes), "cc-labels")
