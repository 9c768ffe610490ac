"""MinHash near-dedup with circulant permutations, exact Jaccard verification and connected components.

Signature. A shingle hash is dealt to a place in a universe of 2**20 by a first permutation (a bijective mix of the 64-bit
hash, of which the top bits are taken). A second permutation, one table of 2**20 numbers, is circularly shifted by k to give
coordinate k: min over the shingles of table[place + k]. The K shifted values of a place are K neighbouring table
entries, so a signature is a minimum over table rows and no K hash functions are evaluated.

Candidates. 48 bands of 6 rows: two texts with similarity 0.8 share no band with probability (1 - 0.8**6)**48 = 5e-7.
All texts with the same shingle set are one class (a copy costs one row, not a pair). Bands hold classes.

Links. Not all pairs of a bucket are made. A bucket's hub is its class with the most company over all buckets. A class is
compared with the hub that it shares most buckets with, then with its other hubs that are not yet in its component. For
what could still be missed (two classes of a bucket, neither or only one linked to its hub) the residual step uses an exact prefix filter with
positions: with the shingles of each class in one global order, rarest first, two sets of similarity t share one
of the first n - ceil(t * n) + 1, and of the smaller set one of still fewer, with enough behind it. Only classes of
buckets with several components take part, and only pairs across components.
Every candidate is verified on the full sets, so no link is taken on trust and none within the buckets is lost.

Keys. Rows meet the one row of their bucket, class or component by look_up(): a key that holds a large share of the rows is
broadcast (there are at most a thousand such keys at any size), any other one is shuffled.

Bounds: the order of shingles comes from a table of 2**20 counters, the only thing that is broadcast (8 MB at most, whatever the
corpus). Sets are never shuffled; candidate texts are.

Defined cases: null and blank texts have no shingles, are linked with nothing and kept; one word is a set of its own; equal doc_ids with the
same shingles are one document and share their fate; null doc_ids are the least only of a group that has no other; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import HEAVY, fresh, look_up, materialise
from corpusmill.llm.components import connected_components, join_components, relabel

UNIVERSE_BITS = 20
BANDS, ROWS = 48, 6
CHUNK = 2048
SALTS = 32


@lru_cache(maxsize=1)
def _circulant(k: int) -> np.ndarray:
    """Row i: the values at place i of the k shifts of one permutation."""
    table = np.random.default_rng(20240607).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[: k - 1]]), k)


def signature(shingles: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """The k circulant MinHash coordinates of a set of 64-bit shingle hashes."""
    from corpusmill.llm.words import mix

    rows = _circulant(k)
    places = (mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    least = None
    for i in range(0, len(places), CHUNK):
        part = rows[places[i : i + CHUNK]].min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def band_keys(coordinates: np.ndarray, bands: int = BANDS) -> np.ndarray:
    from corpusmill.llm.words import mix

    rows = coordinates.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for c in range(rows.shape[1]):
        key = mix(key ^ rows[:, c])
    return key.view(np.int64)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the size-word shingles of each text."""
    from corpusmill.llm.words import NOT_SPACE, hash_words, mix, text_bytes

    words, _, _, at = hash_words(*text_bytes(column), NOT_SPACE)
    for a, b in zip(at[:-1], at[1:]):
        own = words[a:b]
        n = min(size, len(own))
        if not n:
            yield own
            continue
        h = np.full(len(own) - n + 1, n, np.uint64)
        for j in range(n):
            h = mix(h ^ own[j : len(own) - n + 1 + j])
        yield np.unique(h)


def _digest(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sketcher(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            ns, digests, keys = [], [], []
            for s in shingle_sets(text, size):
                ns.append(len(s))
                digests.append(_digest(s) if len(s) else None)
                keys.append(band_keys(signature(s, bands * rows), bands) if len(s) else None)
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=[*batch.schema.names[:-1], "n", "digest", "bands"],
            )

    return run


def _verifier(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray | None] = (None, None)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i in range(0, len(a), 64):
                firsts = {}
                for j in range(i, min(i + 64, len(a))):  # pairs come sorted by a
                    firsts.setdefault(a[j], j)
                new = [j for x, j in firsts.items() if x != last[0]]
                known = {a[j]: s for j, s in zip(new, shingle_sets(batch.column(2).take(pa.array(new, pa.int64())), size))}
                known |= {last[0]: last[1]} if last[0] is not None else {}
                for j, t in enumerate(shingle_sets(batch.column(3).slice(i, 64), size), i):
                    s = known[a[j]]
                    # both are sorted sets
                    both = np.searchsorted(s, t)
                    common = int((s[np.minimum(both, len(s) - 1)] == t).sum())
                    if 100 * common >= percent * (len(s) + len(t) - common):
                        keep.append(j)
                last = (a[j], known[a[j]])
            yield pa.record_batch([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["a", "b"])

    return run


def _counter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << UNIVERSE_BITS, np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column(0), size):
                np.add.at(counts, (s >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.record_batch([pa.array(part), pa.array(counts[part])], names=["place", "n"])

    return run


def _prefixer(size: int, percent: int, counts):
    """For each set the first n - ceil(percent / 100 * n) + 1 of its shingles, rarest first, with their place in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        for batch in batches:
            owners, ns, places, shingles = [], [], [], []
            for i, s in enumerate(shingle_sets(batch.column(batch.num_columns - 1), size)):
                take = len(s) + (-percent * len(s)) // 100 + 1
                rare = table[(s >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
                first = s[np.lexsort((s, rare))[:take]].view(np.int64)
                owners.append(np.full(len(first), i, np.int64))
                ns.append(np.full(len(first), len(s), np.int64))
                places.append(np.arange(len(first)))
                shingles.append(first)
            owner = pa.array(join(owners))
            yield pa.record_batch([*(c.take(owner) for c in batch.columns[:-1]), *(pa.array(join(x)) for x in (ns, places, shingles))], names=[*batch.schema.names[:-1], "n", "pos", "shingle"])

    return run


def _salted(pairs: DataFrame, one: str, other: str, total: int) -> tuple[DataFrame, DataFrame]:
    """pairs with a column salt_<one>, in which classes with a large share of the pairs are dealt over SALTS places, and those classes (one, salts)."""
    heavy = pairs.groupBy(one).agg(F.count("*").alias("n")).where(F.col("n") * HEAVY >= max(total, HEAVY * HEAVY)).select(one, F.lit(SALTS).alias("salts"))
    heavy = F.broadcast(materialise(heavy.coalesce(1), "heavy-classes"))  # HEAVY rows at most
    dealt = pairs.join(heavy, one, "left").withColumn(f"salt_{one}", F.pmod(F.xxhash64(other), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return dealt, heavy


def _verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are as similar as percent. A class with a large share of the pairs, on either side, is met in
    SALTS places: its text is copied to each, its pairs are dealt over them."""
    total = pairs.count()
    dealt, heavy_a = _salted(pairs, "a", "b", total)
    dealt, heavy_b = _salted(dealt, "b", "a", total)

    def side(one: str, heavy: DataFrame) -> DataFrame:
        mine = texts.select(F.col("digest").alias(one), F.col("text").alias(f"text_{one}")).join(heavy, one, "left")
        return mine.withColumn(f"salt_{one}", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")

    met = dealt.join(side("b", heavy_b), ["b", "salt_b"]).join(side("a", heavy_a), ["a", "salt_a"])
    joined = met.select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
    return joined.mapInArrow(_verifier(size, percent), "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, text_hash, n_shingles, component, class): one row for each row of docs.

    component is the least id reachable by links of similarity percent / 100 or more; class is the digest of the
    shingle set (null if empty). Rows of docs and of the result correspond by id and text_hash.
    """
    spark = docs.sparkSession
    src = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    sketches = materialise(
        src.mapInArrow(_sketcher(size, bands, rows), f"id {id_type}, text_hash bigint, n bigint, digest binary, bands array<bigint>"), "sketches"
    )
    known = sketches.where("digest is not null")
    # copies have the same bands, so a class is one combined row and its copies are never gathered
    owners = known.groupBy("digest").agg(F.min("id").alias("least_id"), F.min(F.struct("id", "text_hash")).alias("owner"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = materialise(owners.select("digest", "least_id", F.col("owner.id").alias("id"), F.col("owner.text_hash").alias("text_hash"), "copies", "bands"), "classes")
    owners = classes.drop("bands")

    banded = classes.select("digest", F.explode("bands").alias("key"))
    sizes = materialise(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").withColumn("weight", F.col("size")), "bucket-sizes")
    members = materialise(look_up(banded, sizes, "key", "weight"), "buckets")  # only buckets of two classes or more

    wanted = owners.join(members.select("digest").distinct(), "digest", "left_semi")
    src_rows = src.withColumnRenamed("id", "src_id").withColumnRenamed("text_hash", "src_hash")
    texts = src_rows.join(wanted.hint("shuffle_hash"), F.col("src_id").eqNullSafe(F.col("id")) & (F.col("src_hash") == F.col("text_hash")))
    texts = materialise(texts.dropDuplicates(["digest"]).select("digest", "text"), "candidate-texts")

    # the hub of a bucket is its class with the most company over all buckets: in a group of copies, what they were copied from
    company = members.groupBy("digest").agg(F.sum("size").alias("company"))
    hubs = members.select("key", "digest", "size").join(company, "digest").groupBy("key").agg(F.max(F.struct("company", "digest")).alias("hub"), F.max("size").alias("weight"))
    hubs = materialise(hubs.select("key", F.col("hub.digest").alias("hub"), "weight"), "hubs")
    star = look_up(members.select("key", "digest"), hubs, "key", "weight").where("digest != hub")
    star = materialise(star.groupBy("digest", "hub").agg(F.count("*").alias("shared")), "star-pairs")
    nearest = star.groupBy("digest").agg(F.max(F.struct("shared", "hub")).alias("most")).select("digest", F.col("most.hub").alias("hub"))
    nearest = materialise(nearest, "nearest-hubs")
    links = materialise(_verify(nearest.select(F.col("hub").alias("a"), F.col("digest").alias("b")), texts, size, percent), "links")
    labels = connected_components(links)

    rest = relabel(relabel(star.join(nearest, ["digest", "hub"], "left_anti"), labels, "digest", "x"), labels, "hub", "y").where("x != y")
    rest = materialise(rest.select(F.col("hub").alias("a"), F.col("digest").alias("b")), "further-hubs")
    more = materialise(_verify(rest, texts, size, percent), "links")
    labels = join_components(labels, more)

    mixed = relabel(members, labels, "digest", "part")
    several = mixed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("c")).where("p != q and c > 2").select("key")
    left = materialise(mixed.join(several, "key", "left_semi").select("digest", "part").distinct(), "mixed-classes")
    residual = left.join(texts, "digest")
    counted = residual.select("text").mapInArrow(_counter(size), "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    table = np.zeros(1 << UNIVERSE_BITS, np.int64)  # bounded: one number for each place, however large the corpus
    for batch in counted.toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    counts = spark.sparkContext.broadcast(table)
    rare = materialise(residual.select("digest", "part", "text").mapInArrow(_prefixer(size, percent, counts), "digest binary, part binary, n bigint, pos bigint, shingle bigint"), "prefixes")
    split = rare.groupBy("shingle").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q").select("shingle")
    rare = rare.join(split, "shingle", "left_semi")
    # the smaller set of a pair need only be met in a shorter prefix; what is left behind the shingle must suffice for the overlap
    one = rare.select("shingle", *(F.col(c).alias(f"{c}_a") for c in ("digest", "part", "n", "pos")))
    two = rare.where(F.col("pos") < F.col("n") - F.expr(f"({2 * percent} * n + {99 + percent}) div {100 + percent}") + 1)
    two = two.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("digest", "part", "n", "pos")))
    larger = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("digest_a") > F.col("digest_b")))
    enough = F.least(F.expr("n_a - pos_a"), F.expr("n_b - pos_b")) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    fits = larger & enough & (F.col("part_a") != F.col("part_b")) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    pairs = one.join(two, "shingle").where(fits).select(F.col("digest_a").alias("a"), F.col("digest_b").alias("b")).distinct()
    last = materialise(_verify(materialise(pairs, "residual-pairs"), texts, size, percent), "links")
    labels = join_components(labels, last)

    parts = relabel(owners.select("digest", "least_id", "copies"), labels, "digest", "part")
    least = materialise(parts.groupBy("part").agg(F.min("least_id").alias("component"), F.count("*").alias("weight")), "components")
    final = materialise(look_up(parts, least, "part", "weight").select("digest", "component", F.col("copies").alias("weight")), "class-components")
    own = sketches.select("id", "text_hash", "n", "digest")
    out = look_up(own.where("digest is not null"), final, "digest", "weight")
    out = out.unionByName(own.where("digest is null").withColumn("component", F.col("id")))
    return out.select("id", "text_hash", F.col("n").alias("n_shingles"), "component", F.col("digest").alias("class"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs less the rows that a document with a smaller id stands for."""
    found = near_duplicates(docs, id_col, text_col, size, percent).where(~F.col("id").eqNullSafe(F.col("component")))
    gone = found.select("id", "text_hash").distinct()
    digest = fresh("text_hash", docs)
    hashed = docs.withColumn(digest, F.xxhash64(docs[text_col]))
    on = hashed[id_col].eqNullSafe(gone["id"]) & (hashed[digest] == gone["text_hash"])
    return hashed.join(gone.hint("shuffle_hash"), on, "left_anti").select(*docs.columns)


def op4_near_dedup(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs.select("doc_id", "text"), size=2, percent=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

#: DuckDB: all pairs that share a shingle, and what can be reached by links. For small tables only.
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least AS component_id, least = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS least FROM reach GROUP BY x) USING (doc_id)
"""
