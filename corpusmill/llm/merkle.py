"""Merkle manifest of a dataset: a tree of digests for each source, a tree over the sources, and a proof for each document.

Leaves are dealt by ranges of (source, doc_id) and get their index in their source from a prefix scan of the ranges' counts, so a source with a third of all rows lies
in as many ranges as its rows fill. Each range runs a mountain-range stack over its leaves: a leaf is pushed, and as in counting to the base FANOUT a completed run is popped and its
parent pushed (a carry). The carries are the node records; what stays on the stack are the range's peaks, also the nodes at its edges whose run lies partly in another range.

Peaks are merged by the same stack in aligned blocks of FANOUT**LEVELS leaves, then of FANOUT**(2 * LEVELS) leaves and so on, so no task has more than a block's
nodes. The last run of a level may be short, down to one node; it is hashed as it is, without padding, by whichever stack has it whole. Subroots are the leaves of the tree over the sources.

Proofs go the other way: a block of LEVELS levels gets the path of its top (one row) and hands each of its nodes the path below; the lowest blocks fold each leaf with its path.

Defined results: a null field is `-`, a null source is a source of its own (first), rows without doc_id come first in their source, repeated rows are leaves of their own
(ordered by digest). An empty table has no rows. Very long texts only pass through sha256. Other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import materialise
from corpusmill.llm.log_replay import CRC_MACROS, crc_sql
from corpusmill.llm.scan import exclusive_scan

FANOUT = 3
#: Levels of a block: 2,187 leaves and 1,093 nodes above them.
LEVELS = 7
ROWS_PER_TASK = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars")

NODE = "tree long, n long, level int, index long, digest string, peak boolean, made boolean"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def leaf_digest(text: Column) -> Column:
    """Digest of a document's fields, each length-prefixed, with the given text."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(field(F.col(c).cast("string")) for c in FIELDS), field(text)), 256)


def width(n: int, level: int) -> int:
    """Nodes of a level in a tree of n leaves."""
    return -(-n // FANOUT**level)


def height(n: int) -> int:
    level = 0
    while width(n, level) > 1:
        level += 1
    return level


def climb(nodes: list[tuple[int, int, str]], n: int) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(carries, peaks) of disjoint nodes (level, index, digest) in order of their leaves, in a tree of n leaves."""
    stack: list[tuple[int, int, str]] = []
    made = []
    for node in nodes:
        stack.append(node)
        while True:
            level, index, _ = stack[-1]
            wide, size = width(n, level), index % FANOUT + 1
            run = stack[-size:]
            if wide == 1 or (size < FANOUT and index < wide - 1) or [x[:2] for x in run] != [(level, i) for i in range(index - size + 1, index + 1)]:
                break
            del stack[-size:]
            stack.append((level + 1, index // FANOUT, _sha("".join(x[2] for x in run))))
            made.append(stack[-1])
    return made, stack


def levels_above(n: Column) -> Column:
    """height(n) as a column: how many powers of FANOUT are less than n."""
    return F.size(F.filter(F.array(*(F.lit(FANOUT**k) for k in range(39))), lambda power: power < n))


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes that a stack makes of rows (made), and its peaks, made here or before."""
    tree, n = int(rows["tree"].iloc[0]), int(rows["n"].iloc[0])
    nodes = sorted(zip(rows["level"].tolist(), rows["index"].tolist(), rows["digest"].tolist()), key=lambda x: x[1] * FANOUT ** x[0])
    made, peaks = climb(nodes, n)
    open_, new = {x[:2] for x in peaks}, {x[:2] for x in made}
    out = [(*x, x[:2] in open_, True) for x in made] + [(*x, True, False) for x in peaks if x[:2] not in new]
    return pd.DataFrame([(tree, n, *x) for x in out], columns=["tree", "n", "level", "index", "digest", "peak", "made"])


def build(leaves: DataFrame, max_n: int) -> DataFrame:
    """Node records (tree, n, level, index, digest) above leaves (tree, n, part, index, digest); max_n: leaves of the largest tree."""
    rows = leaves.select("tree", "n", "part", F.lit(0).alias("level"), "index", "digest")
    found = [materialise(rows.groupBy("tree", "part").applyInPandas(_merged, NODE), "merkle-ranges")]
    span = LEVELS
    while FANOUT ** (span - LEVELS) < max_n:
        block = F.floor(F.col("index") * F.pow(F.lit(FANOUT), F.col("level")) / FANOUT**span).cast("long")
        found.append(materialise(found[-1].where("peak").withColumn("block", block).groupBy("tree", "block").applyInPandas(_merged, NODE), "merkle-merged"))
        span += LEVELS
    return reduce(DataFrame.unionByName, (x.where("made") for x in found)).drop("peak", "made")


def roots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, n, digest) of each tree's root."""
    single = leaves.where("n = 1").select("tree", "n", "digest")
    return single.unionByName(nodes.where(levels_above(F.col("n")) == F.col("level")).select("tree", "n", "digest"))


def _hand_down(low: int, high: int, fold: bool, key, nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """Paths of a block's lowest nodes (level low) from the path of its top; with fold what a manifest says of each leaf."""
    names = ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"] if fold else ["tree", "n", "index", "path"]
    if nodes.empty:  # no documents: a tree over no sources
        return pd.DataFrame(columns=names)
    n, up = int(nodes["n"].iloc[0]), list(above["path"].iloc[0])
    at = {(lv, i): d for lv, i, d in zip(nodes["level"].tolist(), nodes["index"].tolist(), nodes["digest"].tolist())}
    top = min(high, height(n))
    out = []
    for row in nodes[nodes["level"] == low].itertuples(index=False):
        path, i = [], row.index
        for level in range(low, top):
            start = i - i % FANOUT
            run = range(start, min(start + FANOUT, width(n, level)))
            path += ["".join(at[level, x] for x in run if x < i), "".join(at[level, x] for x in run if x > i)]
            i //= FANOUT
        path += up
        if not fold:
            out.append((row.tree, row.n, row.index, path))
            continue
        folded, subroot = row.given, path.pop()
        for left, right in zip(path[::2], path[1::2]):
            folded = _sha(left + folded + right)
        out.append((row.doc_id, row.digest, subroot, _sha("".join(path)), folded))
    return pd.DataFrame(out, columns=names)


PATH = "tree long, n long, index long, path array<string>"
PROOF = "doc_id string, leaf string, subroot string, proof_sha256 string, folded_root string"


def prove(leaves: DataFrame, nodes: DataFrame, tops: DataFrame, max_n: int, fold: bool) -> DataFrame:
    """What PROOF names for each leaf, or only its path (PATH) without fold. tops: (tree, n, path) of the roots.

    leaves: (tree, n, index, digest, doc_id, given); given is folded in the leaf's place. A path is a list of pairs of what stands left and right of a node in its run; with
    fold the paths of the roots end with the subroot.
    """
    every = leaves.select("tree", "n", F.lit(0).alias("level"), "index", "digest", "doc_id", "given").unionByName(nodes, allowMissingColumns=True)
    every, tops = (x.withColumn("height", levels_above(F.col("n"))) for x in (every, tops))
    found = None
    for low in range(max(height(max_n) - 1, 0) // LEVELS * LEVELS, -1, -LEVELS):
        high = low + LEVELS
        start = tops.where((F.col("height") <= high) & ((F.col("height") > low) | F.lit(low == 0))).select("tree", F.lit(0).cast("long").alias("block"), "path")
        above = start if found is None else start.unionByName(found.select("tree", F.col("index").alias("block"), "path"))
        block = F.floor(F.col("index") / F.pow(F.lit(FANOUT), high - F.col("level"))).cast("long")
        part = every.where((F.col("level") >= low) & (F.col("level") < high) & ((F.col("height") > low) | F.lit(low == 0))).withColumn("block", block)
        found = part.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(partial(_hand_down, low, high, fold and low == 0), PROOF if fold and low == 0 else PATH)
        if low:
            found = materialise(found, "merkle-paths")
    return found


def indexed_leaves(docs: DataFrame, given: Column) -> DataFrame:
    """(tree, n, part, index, digest, doc_id, given): leaves with their place in their source; tree is the source's place among the sources.

    given: the text that is folded in place of the document's own.
    """
    spark = docs.sparkSession
    src = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # the null source is not the empty one, and comes first
    rows = materialise(docs.select(src.alias("src"), "doc_id", leaf_digest(F.col("text")).alias("digest"), leaf_digest(given).alias("given")), "merkle-leaves")
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS_PER_TASK + 1)
    cut = materialise(rows.repartitionByRange(wanted, "src", "doc_id", "digest").withColumn("part", F.spark_partition_id().cast("long")), "merkle-ranges")
    counts = materialise(cut.groupBy("part", "src").agg(F.count("*").alias("rows")), "merkle-counts")
    parts = (counts.agg(F.max("part")).first()[0] or 0) + 1
    sources = counts.groupBy("src").agg(F.sum("rows").alias("n"), F.min("part").alias("part"))
    begun = materialise(sources.groupBy("part").agg(F.count("*").alias("begun")), "merkle-sources")
    ranked = sources.join(exclusive_scan(begun, [], "part", {"begun": "sum"}, parts).hint("shuffle_hash"), "part")
    tree = F.col("begun_before") + F.row_number().over(Window.partitionBy("part").orderBy("src")) - 1
    trees = ranked.select("src", "n", tree.cast("long").alias("tree"))
    starts = exclusive_scan(counts, ["src"], "part", {"rows": "sum"}, parts).join(trees.hint("shuffle_hash"), "src").drop("rows")
    place = F.row_number().over(Window.partitionBy("part", "src").orderBy("doc_id", "digest")) - 1
    out = cut.join(starts.hint("shuffle_hash"), ["part", "src"]).withColumn("index", (F.col("rows_before") + place).cast("long"))
    return materialise(out.select("tree", "n", "part", "index", "digest", F.col("doc_id").cast("string").alias("doc_id"), "given"), "merkle-indexed")


def manifest(docs: DataFrame, given: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each document: given is the text that is proved to be the document's."""
    leaves = indexed_leaves(docs, given)
    max_n, n_trees = leaves.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("tree") + 1, F.lit(0))).first()
    nodes = materialise(build(leaves, max_n), "merkle-records")
    subroots = materialise(roots(leaves, nodes), "merkle-subroots")
    block = F.floor(F.col("tree") / FANOUT**LEVELS).cast("long")
    none = F.lit(None).cast("string")
    over = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), block.alias("part"), F.col("tree").alias("index"), "digest", none.alias("doc_id"), none.alias("given"))
    above = materialise(build(over, n_trees), "merkle-top")
    root = roots(over, above).select("digest").first()
    start = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.array().cast("array<string>").alias("path"))
    found = materialise(prove(over, above, start, n_trees, fold=False), "merkle-subpaths").select(F.col("index").alias("tree"), "path")
    tops = found.join(subroots.hint("shuffle_hash"), "tree").select("tree", "n", F.array_append("path", F.col("digest")).alias("path"))
    root = F.lit(root and root[0]).cast("string")
    out = prove(leaves, nodes, tops, max_n, fold=True)
    return out.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op13_merkle_manifest(docs: DataFrame) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest(docs, F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


def _oracle() -> str:
    """DuckDB, level by level; enough levels for 531,441 documents a source and as many sources."""
    levels = 12
    digest = lambda text: "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', {c}) END" for c in (*FIELDS, text)) + "))"
    steps = [
        f"base AS MATERIALIZED (SELECT doc_id, source, {digest('text')} AS leaf, {digest('given')} AS given, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM texts)",
        "n0 AS MATERIALIZED (SELECT source AS g, i, leaf AS h, count(*) OVER (PARTITION BY source) AS c FROM base)",
    ]

    def tree(n: str, p: str) -> None:
        for k in range(levels):
            run = "OVER (PARTITION BY g, i // 3 ORDER BY i ROWS BETWEEN"
            steps.append(f"{p}{k} AS MATERIALIZED (SELECT g, i, c, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {n}{k})")
            steps.append(f"{n}{k + 1} AS MATERIALIZED (SELECT g, i // 3 AS i, CASE WHEN any_value(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(c) + 2) // 3 AS c FROM {n}{k} GROUP BY g, i // 3)")

    def fold(f: str, p: str) -> None:
        for k in range(levels):
            steps.append(f"{f}{k + 1} AS MATERIALIZED (SELECT f.* EXCLUDE (i, d, proof), f.i // 3 AS i, CASE WHEN p.c = 1 THEN d ELSE sha256(l || d || r) END AS d, proof || l || r AS proof FROM {f}{k} f JOIN {p}{k} p ON f.i = p.i AND f.g IS NOT DISTINCT FROM p.g)")

    tree("n", "p")
    steps.append(f"m0 AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, count(*) OVER () AS c, g AS source FROM n{levels})")
    tree("m", "q")
    steps.append("f0 AS MATERIALIZED (SELECT doc_id, leaf, source AS g, i, given AS d, '' AS proof FROM base)")
    fold("f", "p")
    steps.append(f"t0 AS MATERIALIZED (SELECT f.doc_id, f.leaf, m.h AS subroot, 0 AS g, m.i, f.d, f.proof FROM f{levels} f JOIN m0 m ON f.g IS NOT DISTINCT FROM m.source)")
    fold("t", "q")
    texts = f"texts AS (SELECT *, CASE WHEN {crc_sql('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS given FROM documents, crc_table)"
    return f"{CRC_MACROS}, {texts}, {', '.join(steps)} SELECT doc_id, leaf, subroot, m.h AS root, sha256(proof) AS proof_sha256, d AS folded_root, d = m.h AS verified FROM t{levels}, m{levels} m"


ORACLE = _oracle()
