"""Line dedup: a suffix array over line-ID sequences by prefix doubling; common prefixes reveal repeated runs, later copies are deleted.

Ranks. A document is the sequence of its lines that have a word. Each suffix of a sequence (one for each line) is ranked by
prefix doubling: the rank at depth 1 is the line's ID, the rank at depth 2k of the suffix at i is made from its rank at
depth k and that of the suffix at i + k, and the rank at a depth between two powers from two ranks that overlap. A rank is a pair of
64-bit hashes of what it stands for, so two suffixes anywhere in the corpus have the same rank at depth k exactly if their
first k lines are the same, and no round has to sort the corpus to name its pairs.

Order. What matters of a suffix is its prefix of `min_words` words: its first m lines, the fewest that have so many (and,
mirrored, the suffixes of the sequences read backwards). Suffixes are sorted by their rank at that depth, then by document and
place, once, over the whole corpus. In this order suffixes with a common prefix of min_words words are neighbours, the first of an interval is
the earliest copy, and each other one is known from the longest common prefix with its predecessor alone (m lines or none of interest). The
repeated runs of maximal length are the unions of overlapping members: a run of min_words words or more is covered by such prefixes, forwards from each of
its lines and backwards from each, as far as they fit. Those of the later copies are deleted.

Skew. The sort is one exchange by ranges of the rank. A rank with a thousandth of all suffixes or more (one pass finds them, without a shuffle) is dealt over all ranges, so a run that
a third of all documents share is spread; the first of its suffixes in each range are held against the first of all, a row for each such rank and range.
Cuts come back to the documents by one join on the document.

Defined cases: null text stays null; empty texts and texts without repeated runs come back as they are; of equal texts
the one with the smallest key keeps its lines (null key first); rows equal in key and text count as one document and share its
fate; an empty table stays empty. Blank lines inside a deleted window go with it, other blank lines stay. Other columns are
carried through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import WORD, fresh, let, materialise

MIN_WORDS = 50


def _line_ids(text: Column) -> Column:
    """The lines that have a word: place among all lines, words, two independent IDs."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda line, i: F.struct(i.alias("i"), F.regexp_count(line, F.lit(WORD)).alias("w"), F.xxhash64(line).alias("a"), F.xxhash64(F.lit("b"), line).alias("b")),
    )
    return F.filter(lines, lambda x: x["w"] > 0)


def _ranks(ids: Column, max_lines: int, body) -> Column:
    """body(list of rank arrays), the j-th at depth 2**j, as deep as max_lines needs."""

    def deeper(ranks: list[Column], depth: int) -> Column:
        if 2 * depth > max_lines:
            return body(ranks)
        last = ranks[-1]
        return let(F.transform(last, lambda r, i: F.xxhash64(r, F.get(last, i + depth))), lambda x: deeper([*ranks, x], 2 * depth))

    return let(ids, lambda x: deeper([x], 1))


def _windows(lines: Column, min_words: int) -> Column:
    """For each place the shortest run from it, and the shortest run to it, that has min_words words: (s, m)."""

    def length(some: Column) -> Column:
        """Lines of `some` (in order of reading) that it takes; null if they don't suffice."""
        start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("m"))
        step = lambda a, x: F.when(a["w"] >= min_words, a).otherwise(F.struct((a["w"] + x["w"]).alias("w"), (a["m"] + 1).alias("m")))
        return F.aggregate(some, start, step, lambda a: F.when(a["w"] >= min_words, a["m"]))

    forth = F.transform(lines, lambda _, i: F.struct(i.alias("s"), length(F.slice(lines, i + 1, F.lit(min_words))).alias("m")))
    first = lambda i: F.greatest(i + 1 - min_words, F.lit(0))
    back = F.transform(
        lines,
        lambda _, i: let(length(F.reverse(F.slice(lines, first(i) + 1, i - first(i) + 1))), lambda m: F.struct((i + 1 - m).alias("s"), m.alias("m"))),
    )
    return F.array_distinct(F.filter(F.concat(forth, back), lambda x: x["m"].isNotNull()))


def _ranked_windows(text: Column, min_words: int) -> Column:
    """Prefixes of min_words words of all suffixes: rank (two hashes), lines that have words, first and last place among all lines."""

    def of_lines(lines: Column) -> Column:
        def ranked(levels: list[Column]) -> Column:
            def row(x: Column) -> Column:
                level = F.floor(F.log2(x["m"].cast("double"))).cast("int")
                pick = F.coalesce(*(F.when(level == j, F.xxhash64(F.get(r, x["s"]), F.get(r, x["s"] + x["m"] - 2**j), x["m"])) for j, r in enumerate(levels)))
                other = F.xxhash64(F.transform(F.slice(lines, x["s"] + 1, x["m"]), lambda y: y["b"]))
                return F.struct(pick.alias("a"), other.alias("b"), x["m"].alias("m"), F.get(lines, x["s"])["i"].alias("lo"), F.get(lines, x["s"] + x["m"] - 1)["i"].alias("hi"))

            return F.transform(_windows(lines, min_words), row)

        return _ranks(F.transform(lines, lambda x: x["a"]), min_words, ranked)

    return let(_line_ids(text), of_lines)


ORDER = ("a", "b", "key", "digest", "lo")


#: Ranges of the order for each shuffle partition, and the share of all rows from which on a rank is heavy.
RANGES, HEAVY_SHARE = 8, 0.001


def suffix_array(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(a, b, key, digest, lo, hi, m, heavy, part): suffixes with their rank (a, b), in ranges `part` of a.

    A row stands for the m lines from place lo to place hi of a document. Ranks are uniform, so ranges are equal parts of their numbers; the rows of a heavy rank, of which there are
    1 / HEAVY_SHARE at most (and as many that only seem so), are dealt over all ranges.
    """
    keyed = docs.select(docs[key_col].alias("key"), F.xxhash64(docs[text_col]).alias("digest"), docs[text_col].alias("text")).where(F.col("text").isNotNull())
    ranked = materialise(keyed.select("key", "digest", F.inline(_ranked_windows(F.col("text"), min_words))), "line-suffixes")
    parts = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = ranked.stat.freqItems(["a"], HEAVY_SHARE).first()[0]  # bounded by the share, in one pass without a shuffle
    heavy = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in often or []], "a bigint").withColumn("heavy", F.lit(True)))
    rows = ranked.join(heavy, "a", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    own = F.shiftright((F.shiftright("a", 40) + F.lit(1 << 23)) * parts, 24)
    return rows.withColumn("part", F.when(F.col("heavy"), F.pmod(F.xxhash64("key", "digest", "lo"), F.lit(parts))).otherwise(own))


def later_copies(suffixes: DataFrame) -> DataFrame:
    """(key, digest, lo, hi) of the suffixes whose longest common prefix with their predecessor is all of their m lines."""
    me = F.struct(*(F.col(c) for c in ORDER))
    same = lambda before: (before["a"] == F.col("a")) & (before["b"] == F.col("b"))
    # lcp: lines in common with the predecessor, as far as they matter; a repeated row is no predecessor of its like
    common = lambda before: F.when(same(before) & ~before.eqNullSafe(me), F.col("m")).otherwise(0)
    before = F.col("before")
    ordered = suffixes.withColumn("before", F.lag(me).over(Window.partitionBy("part").orderBy(*ORDER)))
    ordered = ordered.withColumns({"lcp": common(before), "edge": F.col("heavy") & ~F.coalesce(same(before), F.lit(False))})
    found = materialise(ordered.where("lcp = m or edge").drop("part", "before"), "line-copies")
    # the first rows of heavy ranks in each range: one for each rank and range; all but the first of a rank are later copies
    edges = found.where("edge")
    firsts = F.broadcast(edges.groupBy("a", "b").agg(F.min(me).alias("first")))  # a row for each heavy rank: 1 / HEAVY_SHARE at most
    across = edges.join(firsts, ["a", "b"]).where(~me.eqNullSafe(F.col("first")))
    return found.where("lcp = m").select("key", "digest", "lo", "hi").union(across.select("key", "digest", "lo", "hi"))


def repeated_lines(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, digest, cut): for each document with later copies of runs, the places of its lines to delete."""
    cut = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("lo", "hi")), lambda x: F.sequence(x["lo"], x["hi"]))))
    return later_copies(suffix_array(docs, key_col, text_col, min_words)).groupBy("key", "digest").agg(cut.alias("cut"))


def repeated_runs(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, digest, first, last, n_lines, n_words): the maximal runs of lines that later copies cover, one row each; the unions of overlapping or adjoining members.

    first and last are places among all lines of the text; n_lines and n_words count lines that have words, and their words.
    """
    cuts = repeated_lines(docs, key_col, text_col, min_words).select("key", "digest", F.explode("cut").alias("at"))
    place = F.row_number().over(Window.partitionBy("key", "digest").orderBy("at"))
    runs = cuts.withColumn("run", F.col("at") - place).groupBy("key", "digest", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    own = docs.select(docs[key_col].alias("key"), F.xxhash64(docs[text_col]).alias("digest"), docs[text_col].alias("text")).where("text is not null").dropDuplicates(["key", "digest"])
    on = own["key"].eqNullSafe(runs["key"]) & (own["digest"] == runs["digest"])
    lines = F.filter(F.transform(F.slice(F.split("text", "\n"), F.col("first") + 1, F.col("last") - F.col("first") + 1), lambda x: F.regexp_count(x, F.lit(WORD))), lambda w: w > 0)
    found = runs.join(own, on).select(runs["key"], runs["digest"], "first", "last", lines.alias("w"))
    return found.select("key", "digest", "first", "last", F.size("w").alias("n_lines"), F.aggregate("w", F.lit(0), lambda a, x: a + x).alias("n_words"))


def dedup_lines(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated runs cut from the text, and a new column `removed_lines`: how many lines went."""
    removed, digest = fresh("removed_lines", docs), fresh("digest", docs)
    cuts = repeated_lines(docs, key_col, text_col, min_words).select(F.col("key").alias("cut_key"), F.col("digest").alias("cut_digest"), F.col("cut").alias("cut_places"))
    left = docs.withColumn(digest, F.xxhash64(docs[text_col]))
    on = left[key_col].eqNullSafe(cuts["cut_key"]) & (left[digest] == cuts["cut_digest"])
    joined = left.join(cuts.hint("shuffle_hash"), on, "left")
    text, cut = left[text_col], cuts["cut_places"]
    kept = let(
        F.split(text, "\n"),
        lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut), lambda i: F.get(lines, i)), "\n"),
    )
    new = {text_col: F.when(cut.isNull(), text).otherwise(kept)}
    return joined.select(*(new[c].alias(c) if c in new else left[c] for c in docs.columns), F.coalesce(F.size(cut), F.lit(0)).alias(removed))


def op6_line_dedup(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("removed_lines").cast("long").alias("n_removed_lines"), "text")


#: DuckDB, from the definition: a line goes if a run of 50 words or more covers it whose text occurs earlier too.
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, i, l, len(regexp_extract_all(l, '{WORD}')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
), s AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM lines WHERE w > 0
), spans AS (
  SELECT a.doc_id, a.p AS s, min(b.p) AS e FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 49 AND b.c - a.c + a.w >= {MIN_WORDS} GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.p) AS s, b.p AS e FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.p BETWEEN b.p - 49 AND b.p AND b.c - a.c + a.w >= {MIN_WORDS} GROUP BY ALL
), named AS (
  SELECT x.doc_id, x.s, x.e, string_agg(y.l, chr(10) ORDER BY y.p) AS name, min(y.i) AS lo, max(y.i) AS hi
  FROM spans x JOIN s y ON x.doc_id = y.doc_id AND y.p BETWEEN x.s AND x.e GROUP BY ALL
), later AS (
  SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS i FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, s) AS k FROM named) WHERE k > 1
), kept AS (
  SELECT l.doc_id, count(x.i) AS n, string_agg(l.l, chr(10) ORDER BY l.i) FILTER (WHERE x.i IS NULL) AS t
  FROM lines l LEFT JOIN later x USING (doc_id, i) GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_removed_lines, CASE WHEN d.text IS NOT NULL THEN coalesce(t, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id)
"""
