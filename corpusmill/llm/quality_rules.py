"""Quality rules: a threshold table compiled into one Spark projection.

Everything here is a built-in Spark function; a document never leaves its task, so there is no shuffle and no group
to be skewed.

Defined cases: null, empty and blank texts have no words, all counts 0, and fail `min_words`; repeated rows and ties are
judged row by row; an empty table gives an empty table. Columns of the input other than the text are carried through
`filter_documents` untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import SPACE_CLASS, WORD, fresh, let

SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he are this have from or had an they which she you we "
    "le la les un une des du de et en est que qui dans pour par sur au aux pas avec "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch "
    "el los las y se del al lo su como más o con sin una no si sobre"
).split()


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: the document fails if 100 * top lies outside low..high per cent of bottom.

    Whole numbers on both sides keep the comparison exact. Without bottom, the bounds are plain values of top.
    """

    name: str
    top: str
    bottom: str | None = None
    low: int | None = None
    high: int | None = None
    base: bool = False

    def fails(self, metrics: Column) -> Column:
        value = metrics[self.top] if self.bottom is None else metrics[self.top] * 100
        unit = F.lit(1) if self.bottom is None else metrics[self.bottom]
        tests = [value < unit * self.low] if self.low is not None else []
        tests += [value > unit * self.high] if self.high is not None else []
        return reduce(Column.__or__, tests, F.lit(False))


THRESHOLDS = (
    Rule("min_words", "n_words", low=50, base=True),
    Rule("repeated_words", "n_repeat_words", "n_words", high=50, base=True),
    Rule("word_length", "word_chars", "n_words", low=200, high=1200),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("exclamations", "n_exclamations", "n_words", high=25),
    Rule("stop_words", "n_stop_words", "n_words", low=6),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=40),
)


def metrics(text: Column, stop_words=STOP_WORDS) -> Column:
    """A struct of whole-number measures of the whole text."""

    def repeats(words: Column) -> Column:
        """Words inside 3-word windows that occur twice or more. Windows are sorted by hash, so equal ones are neighbours."""
        windows = F.when(
            F.size(words) >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 3),
                lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
            ),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        twice = lambda s: F.sort_array(
            F.transform(F.filter(s, lambda x, j: (F.get(s, j + 1)["h"] == x["h"]) | ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"]))), lambda x: x["i"])
        )
        covered = lambda at: F.aggregate(
            F.transform(at, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x
        )
        return let(F.sort_array(windows), lambda s: let(twice(s), covered))

    def lines_of(lines: Column) -> tuple[Column, Column]:
        return F.size(lines), F.size(lines) - F.size(F.array_distinct(lines))

    def all_of(words: Column) -> Column:
        n_stop = F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(PUNCTUATION))).isin(list(stop_words))))
        with_word = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
        counts = {
            "n_words": F.size(words), "word_chars": F.length(F.array_join(words, "")), "n_repeat_words": repeats(words), "n_stop_words": n_stop,
            "n_symbols": F.regexp_count(body, F.lit(f"[{SYMBOLS}]")), "n_exclamations": F.regexp_count(body, F.lit("!")),
        }
        line_counts = let(with_word, lambda x: F.struct(*(c.alias(n) for n, c in zip(("n_lines", "n_dup_lines"), lines_of(x)))))
        return let(line_counts, lambda x: F.struct(*(c.cast("long").alias(n) for n, c in (counts | {n: x[n] for n in ("n_lines", "n_dup_lines")}).items())))

    body = F.coalesce(text, F.lit(""))
    return let(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), all_of)


def compile_rules(measures: Column, rules=THRESHOLDS) -> Column:
    """The threshold table as one array: the names of the rules that the document fails."""
    return F.array_compact(F.array(*(F.when(r.fails(measures), F.lit(r.name)) for r in rules)))


def judge(docs: DataFrame, text_col: str = "text", rules=THRESHOLDS) -> DataFrame:
    """docs with a struct column `quality`: measures, failed (rule names), base_failed, kept."""
    name = fresh("quality", docs)
    base = [r.name for r in rules if r.base]

    def verdict(m: Column) -> Column:
        return let(
            compile_rules(m, rules),
            lambda failed: F.struct(m.alias("measures"), failed.alias("failed"), F.arrays_overlap(failed, F.array(*map(F.lit, base)).cast("array<string>")).alias("base_failed"), (F.size(failed) == 0).alias("kept")),
        )

    return docs.withColumn(name, let(metrics(docs[text_col]), verdict))


def filter_documents(docs: DataFrame, text_col: str = "text", rules=THRESHOLDS) -> DataFrame:
    """The rows of docs that pass every rule, columns as they were."""
    name = fresh("quality", docs)
    return judge(docs, text_col, rules).where(F.col(f"{name}.kept")).select(*docs.columns)


def op3_quality_rules(docs: DataFrame) -> DataFrame:
    judged = judge(docs.select("doc_id", "text"))
    return judged.select(
        "doc_id",
        *(F.col(f"quality.measures.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        "quality.base_failed", "quality.kept",
        *(F.col(f"quality.measures.{c}").alias(c) for c in ("n_stop_words", "n_exclamations", "n_lines")),
    )


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: DuckDB. RE2 takes [^...] by code point, as Java does.
ORACLE = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{SPACE_CLASS}]+') AS w FROM documents
), grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)
), hit AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams), (VALUES (0), (1), (2)) AS o(k)
  WHERE c > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM base) WHERE regexp_matches(l, '[^{SPACE_CLASS}]') GROUP BY doc_id
), m AS (
  SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda x: lower(rtrim(x, '{PUNCTUATION}')) IN ({_STOP_SQL}))) AS BIGINT) AS n_stop_words,
    CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclamations, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
  FROM base b LEFT JOIN hit USING (doc_id) LEFT JOIN lines USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * word_chars < 200 * n_words OR 100 * word_chars > 1200 * n_words
    OR 100 * n_symbols > 10 * n_words OR 100 * n_exclamations > 25 * n_words OR 100 * n_stop_words < 6 * n_words OR 100 * n_dup_lines > 40 * n_lines) AS kept,
  n_stop_words, n_exclamations, n_lines
FROM m
"""
