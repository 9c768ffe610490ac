"""Metrics as relational aggregations over an evaluation frame (idx, prediction, reference), and their registry.

A metric is a function of the frame that returns one row (score DOUBLE, passed BIGINT); passed is null unless the metric is a gate.
A gate also has a Column that says which rows survive it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill import schemas
from corpusmill.functions.text import let, strip

_ratio = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))  # noqa: E731  0 of no rows


def align(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Predictions (idx, prediction) with references (idx, reference); what only one side has is left out."""
    return predictions.join(references, "idx")


def gather(tests: DataFrame, focal: DataFrame, idx: str = "original_idx") -> DataFrame:
    """Every test with its focal row; a ValueError if one has none."""
    there = focal.select("*", F.lit(True).alias("there_"))
    found = tests.join(there, tests[idx] == there["idx"], "left").drop(there["idx"])
    lost = found.where("there_ is null").count()
    if lost:
        raise ValueError(f"{lost} tests have no focal method")
    return found.drop("there_")


def exact_match(ev: DataFrame) -> DataFrame:
    return ev.agg(_ratio(strip(F.col("prediction")) == strip(F.col("reference"))).alias("score"), F.lit(None).cast("long").alias("passed"))


def _common(a: Column, b: Column, part) -> Column:
    """The greatest n for which part(a, n) = part(b, n), by halving steps; part: the first or the last n characters."""
    room = F.least(F.length(a), F.length(b))
    grown = lambda n, step: F.when((n + step <= room) & (part(a, n + step) == part(b, n + step)), n + step).otherwise(n)
    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(22, -1, -1))), F.lit(0), grown)


#: Length of one text, times the other's, up to which the JVM's quadratic function is used.
QUADRATIC = 1_000_000


def distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in characters, exact for texts of any length.

    What two texts begin and end with alike is cut. Short texts go through the JVM's quadratic program, others in Arrow batches through `long_distance`; a
    Python column can't stand inside an aggregation, so select the distance before summing it.
    """

    def cut(n: Column) -> Column:
        x, y = F.substr(a, n + 1), F.substr(b, n + 1)
        last = lambda c, m: F.substr(c, F.length(c) - m + 1)
        left = lambda c, m: F.substr(c, F.lit(1), F.length(c) - m)
        return let(F.struct(x.alias("x"), y.alias("y")), lambda p: let(_common(p["x"], p["y"], last), lambda m: F.levenshtein(left(p["x"], m), left(p["y"], m))))

    short = let(_common(a, b, lambda c, m: F.substr(c, F.lit(1), m)), cut)
    long = F.length(a).cast("long") * F.length(b) > QUADRATIC
    slow = F.pandas_udf(_long_distances, "int")(F.when(long & (a != b), a), F.when(long & (a != b), b))
    return F.when(a == b, 0).when(long, slow).otherwise(short)


def _long_distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else long_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


#: Edits up to which the diagonals are followed; their cost is the square of the edits.
FEW_EDITS = 256


def long_distance(a: str, b: str) -> int:
    """Levenshtein distance: by furthest reaching diagonals if there are few edits, else bit-parallel, a bit for each character of the shorter text."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    begin = _slide(x, y, 0, 0)
    end = _slide(x[begin:][::-1], y[begin:][::-1], 0, 0)
    a, b, x, y = (t[begin : len(t) - end] for t in (a, b, x, y))
    found = _few_edits(x, y) if len(b) - len(a) <= FEW_EDITS else None
    return _bit_parallel(a, b) if found is None else found


def _slide(x: np.ndarray, y: np.ndarray, i: int, j: int) -> int:
    """How many equal numbers follow from x[i] and y[j]."""
    n, step, done = min(len(x) - i, len(y) - j), 64, 0
    while done < n:
        m = min(step, n - done)
        other = x[i + done : i + done + m] != y[j + done : j + done + m]
        at = int(other.argmax())
        if other[at]:
            return done + at
        done, step = done + m, step * 4
    return n


def _few_edits(x: np.ndarray, y: np.ndarray) -> int | None:
    """The distance if it is at most FEW_EDITS: reach[d] is how far into x the diagonal d (place in y less place in x) comes with so many edits."""
    goal, reach = len(y) - len(x), {}
    for edits in range(FEW_EDITS + 1):
        now = {}
        for d in range(-min(edits, len(x)), min(edits, len(y)) + 1):
            if edits == 0:
                i = 0
            else:
                i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            i = min(i, len(x), len(y) - d)
            if i < 0 or i + d < 0:
                continue
            now[d] = i + _slide(x, y, i, i + d)
        if now.get(goal) == len(x):
            return edits
        reach = now
    return None


def _bit_parallel(a: str, b: str) -> int:
    """The columns of the quadratic program as differences, a bit for each character of a, which isn't longer."""
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for c in set(a):
        where[c] = int("".join("1" if x == c else "0" for x in reversed(a)), 2) if len(a) < 64 else int.from_bytes(np.packbits(np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32) == ord(c), bitorder="little").tobytes(), "little")
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for c in b:
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up, right_down = down | (full & ~(diagonal | up)), up & diagonal
        score += 1 if right_up & top else -1 if right_down & top else 0
        right_up, right_down = (right_up << 1 | 1) & full, right_down << 1 & full
        up, down = right_down | (full & ~(diagonal | right_up)), right_up & diagonal
    return score


def edit_distance(ev: DataFrame) -> DataFrame:
    """Mean Levenshtein distance in characters."""
    return ev.select(distance(F.col("prediction"), F.col("reference")).alias("edits")).agg(_ratio(F.col("edits")).alias("score"), F.lit(None).cast("long").alias("passed"))


# --- BLEU ------------------------------------------------------------------------------------------------------------

# The mteval-13a rules: markup, then punctuation apart from digits.
_UNESCAPE = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
_SPLIT = (("([{-~\\[-` -&(-+:-@/])", " $1 "), ("([^0-9])([.,])", "$1 $2 "), ("([.,])([^0-9])", " $1 $2"), ("([0-9])(-)", "$1 $2 "))


def tokens_13a(text: Column) -> Column:
    out = text
    for a, b in _UNESCAPE:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, by in _SPLIT:
        out = F.regexp_replace(out, pattern, by)
    return whitespace_tokens(out)


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda t: t != "")


def _clipped(p: pa.Array, r: pa.Array, order: int, full: frozenset[str] | None, other: float) -> list[np.ndarray]:
    """Of lists of tokens, row by row: correct_1, total_1, correct_2 and so on. Grams are numbered, so that equal numbers are equal grams.

    full: tokens that weigh 1, if not all do; other single tokens then weigh `other`, longer grams 1.
    """
    rows = len(p)
    words = pa.concat_arrays([p.flatten(), r.flatten()]).dictionary_encode()
    code, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    lengths = np.concatenate([x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in (p, r)]).astype(np.int64)
    row = np.repeat(np.arange(2 * rows), lengths)  # those of p, then those of r
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(code))  # tokens from here on in this row
    weight = np.ones(len(names)) if full is None else np.array([1.0 if w in full else other for w in names.to_pylist()])
    gram, out = code, []
    if not len(code):
        return [np.zeros(rows)] * (2 * order)
    for n in range(1, order + 1):
        if n > 1:
            keep = np.flatnonzero(left >= n)
            pair = np.full(len(code), -1)
            pair[keep] = gram[keep] * (len(names) + 1) + code[keep + n - 1]
            gram = np.full(len(code), -1)
            gram[keep] = np.unique(pair[keep], return_inverse=True)[1]
        some = left >= n
        size = int(gram.max(initial=0)) + 1
        key, count = np.unique(row[some] * size + gram[some], return_counts=True)
        mine = key < rows * size  # keys of p; those of r are `rows` rows further
        at, which = key[mine] // size, key[mine] % size
        w = weight[which] if n == 1 else np.ones(len(which))
        _, of_p, of_r = np.intersect1d(key[mine], key[~mine] - rows * size, assume_unique=True, return_indices=True)
        hits = np.zeros(len(which))
        hits[of_p] = np.minimum(count[mine][of_p], count[~mine][of_r])
        out += [np.bincount(at, hits * w, rows), np.bincount(at, count[mine] * w, rows)]
    return out


#: Tokens that are numbered at once, some 200 bytes for each; a row isn't divided.
TOKENS_AT_ONCE = 1 << 17


def _parts(batch: pa.RecordBatch, first: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most TOKENS_AT_ONCE tokens in the columns `first` and the next one, a row at least."""
    ends = np.cumsum(sum(batch.column(first + k).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + TOKENS_AT_ONCE, "right")))
        yield batch.slice(at, to - at)
        at = to


def _bleu_sums(ev: DataFrame, tokenize: Callable[[Column], Column], by: list[str], order: int, full: frozenset[str] | None, other: float) -> DataFrame:
    """Lengths and n-gram counts of whole groups. Pairs are counted where they are, a batch at once; only sums are shuffled."""
    counts = [f"{c}_{n}" for n in range(1, order + 1) for c in ("correct", "total")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, len(by)):
                p, r = part.column(len(by)), part.column(len(by) + 1)
                sizes = [x.value_lengths().fill_null(0).cast(pa.int64()) for x in (p, r)]
                columns = [*part.columns[: len(by)], *sizes, *(pa.array(x, pa.float64()) for x in _clipped(p, r, order, full, other))]
                yield pa.record_batch(columns, names=[*part.schema.names[: len(by)], "sys_len", "ref_len", *counts])

    tokens = ev.select(*(ev[c].alias(f"b{i}") for i, c in enumerate(by)), *(tokenize(F.coalesce(c, F.lit(""))).alias(c) for c in ("prediction", "reference")))
    kinds = [f"b{i} {ev.schema[c].dataType.simpleString()}" for i, c in enumerate(by)]
    each = tokens.mapInArrow(run, ", ".join([*kinds, "sys_len bigint, ref_len bigint", *(f"{c} double" for c in counts)]))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return each.groupBy(*(F.col(f"b{i}").alias(c) for i, c in enumerate(by))).agg(*(total(c).alias(c) for c in ("sys_len", "ref_len", *counts)))


def bleu_ngram_stats(ev: DataFrame, tokenize: Callable[[Column], Column] = whitespace_tokens, by: list[str] = (), order: int = 4, full: frozenset[str] | None = None, other: float = 1.0) -> DataFrame:
    """(n, correct, total) for each order, counts clipped by pair. With full, tokens that are not in it weigh `other`."""
    kind = "long" if full is None else "double"
    rows = F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"correct_{n}").cast(kind).alias("correct"), F.col(f"total_{n}").cast(kind).alias("total")) for n in range(1, order + 1)))
    return _bleu_sums(ev, tokenize, by, order, full, other).select(*by, F.inline(rows))


def corpus_bleu(ev: DataFrame, tokenize: Callable[[Column], Column] = tokens_13a, by: list[str] = (), order: int = 4, full: frozenset[str] | None = None, other: float = 1.0) -> DataFrame:
    """0 to 100: geometric mean of the precisions (those without a match halved again and again) times the brevity penalty."""
    log_sum, zeros = F.lit(0.0), F.lit(0)
    for n in range(1, order + 1):
        correct, total = F.col(f"correct_{n}"), F.col(f"total_{n}")
        zeros = zeros + F.when(correct == 0, 1).otherwise(0)
        log_sum = log_sum + F.log(F.when(total == 0, F.lit(None)).when(correct == 0, 1 / (F.pow(F.lit(2.0), zeros) * total)).otherwise(correct / total))
    longer = F.col("sys_len") >= F.col("ref_len")
    brevity = F.when(longer, F.lit(1.0)).otherwise(F.exp(1 - F.col("ref_len") / F.nullif("sys_len", F.lit(0)).cast("double")))
    score = F.when((F.col("correct_1") == 0) | log_sum.isNull(), F.lit(0.0)).otherwise(100 * brevity * F.exp(log_sum / order))
    return _bleu_sums(ev, tokenize, by, order, full, other).select(*by, score.alias("score"), F.lit(None).cast("long").alias("passed"))


# Java's reserved words.
KEYWORDS = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()


def keyword_bleu(ev: DataFrame, tokenize=whitespace_tokens) -> DataFrame:
    """BLEU in which a single token counts fully if it is a keyword and a fifth otherwise; longer grams count as they are."""
    return corpus_bleu(ev, tokenize, full=frozenset(KEYWORDS), other=0.2)


def codebleu(ev: DataFrame, tokenize=whitespace_tokens, store: str | None = None) -> DataFrame:
    """The four parts and their mean. Syntax and data flow come from the JDK's own parser (operators.workers), so the
    composite is comparable within this engine and not to the last digit with tools that use another grammar."""
    from corpusmill.operators.workers import code_matches

    parts = code_matches(ev, store=store).agg(F.sum("tree_hit").alias("th"), F.sum("tree_all").alias("ta"), F.sum("flow_hit").alias("fh"), F.sum("flow_all").alias("fa"))
    share = lambda a, b: F.when(F.coalesce(F.col(b), F.lit(0)) > 0, F.col(a) / F.col(b).cast("double")).otherwise(F.lit(0.0))
    one = corpus_bleu(ev, tokenize).select((F.col("score") / 100).alias("ngram"))
    two = keyword_bleu(ev, tokenize).select((F.col("score") / 100).alias("weighted_ngram"))
    rows = one.join(F.broadcast(two), F.lit(True)).join(F.broadcast(parts), F.lit(True))  # one row each
    named = rows.select("ngram", "weighted_ngram", share("th", "ta").alias("syntax"), share("fh", "fa").alias("dataflow"))
    return named.withColumn("score", (F.col("ngram") + F.col("weighted_ngram") + F.col("syntax") + F.col("dataflow")) / 4).withColumn("passed", F.lit(None).cast("long"))


# --- gates and coverage ----------------------------------------------------------------------------------------------


def parse_rate(ev: DataFrame) -> DataFrame:
    """Of a frame with parse_ok (operators.workers.parse_java)."""
    return ev.agg(_ratio(F.col("parse_ok")).alias("score"), F.count_if("parse_ok").alias("passed"))


def compile_rate(ev: DataFrame) -> DataFrame:
    """Of a frame with status (operators.workers.compile_java)."""
    ok = F.col("status").isin("HARD_PASS", "SOFT_PASS")
    return ev.agg(_ratio(ok).alias("score"), F.count_if(ok).alias("passed"))


def status_counts(results: DataFrame, by: list[str] = ()) -> DataFrame:
    return results.groupBy(*by, "status").agg(F.count("*").alias("n"))


def focal_coverage(counters: DataFrame, focal: DataFrame, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """(test_idx, coverage) of counters (test_idx, pos, method_name, covered, missed; lines only) and focal
    (test_idx, focal_name, class_name): the best method of the focal name; if none has a line counter, the first method in
    the report that is no constructor, accessor or utility and has lines; else 0. order: the columns that say which is first; a method
    for which one of them is null is none of those. A null test_idx is an index like any other."""
    lines = F.col("covered") + F.col("missed")
    ratio = F.when(lines > 0, 100.0 * F.col("covered").cast("double") / lines)
    named = F.col("method_name") == F.col("focal_name")
    other = reduce(lambda a, c: a & F.col(c).isNotNull(), order, eligible(F.col("method_name"), F.col("class_name")) & (lines > 0))
    found = counters.withColumnRenamed("test_idx", "test_idx_")
    agg = focal.join(found, F.col("test_idx").eqNullSafe(F.col("test_idx_")), "left").groupBy("test_idx").agg(
        F.count_if(named).alias("named"), F.coalesce(F.max(F.when(named, ratio)), F.lit(0.0)).alias("best"), F.min_by(F.when(other, ratio), F.when(other, F.struct(*order))).alias("fallback")
    )
    return agg.select("test_idx", F.when(F.col("named") > 0, F.col("best")).otherwise(F.coalesce("fallback", F.lit(0.0))).alias("coverage"))


def eligible(method: Column, class_name: Column) -> Column:
    return (method != F.coalesce(class_name, F.lit(""))) & ~method.isin("<init>", "<clinit>", "toString", "equals", "hashCode") & ~method.startswith("get") & ~method.startswith("set")


def aggregate_coverage(counters: DataFrame, by: list[str]) -> DataFrame:
    total = F.sum("covered") + F.sum("missed")
    return counters.groupBy(*by).agg(F.sum("covered").alias("covered"), F.sum("missed").alias("missed"), F.when(total > 0, F.round(100.0 * F.sum("covered").cast("double") / total, 6)).otherwise(F.lit(0.0)).alias("pct"))


def coverage(ev: DataFrame) -> DataFrame:
    """Mean of a frame with coverage (rows without a report count 0)."""
    return ev.agg(_ratio(F.coalesce("coverage", F.lit(0.0))).alias("score"), F.lit(None).cast("long").alias("passed"))


# --- registry and runners --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Metric:
    """compute: of a frame. survives: which rows pass, for a gate. mean: what a row contributes, for a metric that is a mean over rows; such
    metrics are all computed in one pass."""

    compute: Callable[[DataFrame], DataFrame]
    survives: Callable[[], Column] | None = None
    mean: Callable[[], Column] | None = None


def _compiled() -> Column:
    return F.col("status").isin("HARD_PASS", "SOFT_PASS")


REGISTRY: dict[str, Metric] = {
    "parse_rate": Metric(parse_rate, lambda: F.col("parse_ok"), lambda: F.col("parse_ok")),
    "compile_rate": Metric(compile_rate, _compiled, _compiled),
    "coverage": Metric(coverage, mean=lambda: F.coalesce("coverage", F.lit(0.0))),
    "bleu": Metric(corpus_bleu),
    "edit_distance": Metric(edit_distance, mean=lambda: distance(F.col("prediction"), F.col("reference"))),
    "exact_match": Metric(exact_match, mean=lambda: strip(F.col("prediction")) == strip(F.col("reference"))),
    "codebleu": Metric(codebleu),
}


def register_metric(name: str, compute: Callable[[DataFrame], DataFrame], survives: Callable[[], Column] | None = None, mean: Callable[[], Column] | None = None) -> None:
    REGISTRY[name] = Metric(compute, survives, mean)


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"


def run_metrics(ev: DataFrame, names: list[str] | None = None, cascade: bool = True, registry: dict[str, Metric] | None = None) -> DataFrame:
    """A row for each metric: metric, score, passed, n_in, pct_total (of all rows, for gates), error.

    With cascade, a gate narrows the rows of the metrics behind it: its flag joins their condition. Counts, gates and all metrics that are means come from
    one aggregation; any other metric is a job of its own over the rows of its condition. A metric that fails has its error in place of a score and the others go on.
    registry: metrics in place of the registered ones.
    """
    known = REGISTRY if registry is None else registry
    spark, names = ev.sparkSession, list(names or known)
    for name in names:
        if name not in known:
            raise ValueError(f"unknown metric: {name}")
    errors: dict[str, str] = {}
    rows_in: dict[str, Column] = {}
    alive = F.lit(True)
    for name in names:
        rows_in[name], metric = alive, known[name]
        try:
            if metric.mean is not None or metric.survives is not None:
                metric.compute(ev)  # a column that isn't there is found without a job
            if cascade and metric.survives is not None:
                alive = alive & F.coalesce(metric.survives(), F.lit(False))
        except Exception as e:  # noqa: BLE001  isolates metrics from each other
            errors[name] = _said(e)

    def sums(wanted: list[str]) -> list[Column]:
        out = [F.count("*").alias("total")]
        for i, name in enumerate(names):
            out.append(F.count_if(rows_in[name]).alias(f"n{i}"))
            if name in wanted:
                metric = known[name]
                out.append(_ratio(F.col(f"mean{i}_")).alias(f"s{i}"))
                out.append((F.lit(None).cast("long") if metric.survives is None else F.count_if(rows_in[name] & F.coalesce(metric.survives(), F.lit(False)))).alias(f"p{i}"))
        return out

    single = [n for n in names if n not in errors and known[n].mean is None]
    means = [n for n in names if n not in errors and known[n].mean is not None]
    ev = ev.persist() if single else ev
    rows = []
    try:
        try:
            each = ev.withColumns({f"mean{i}_": F.when(rows_in[n], known[n].mean().cast("double")) for i, n in enumerate(names) if n in means})
            found = each.agg(*sums(means)).first().asDict()
        except Exception:  # noqa: BLE001  one of the means fails on the rows: each for itself
            found, single, means = ev.agg(*sums([])).first().asDict(), single + means, []
        for i, name in enumerate(names):
            n_in, score, passed = found[f"n{i}"], found.get(f"s{i}"), found.get(f"p{i}")
            if name in single:
                try:
                    r = known[name].compute(ev.where(rows_in[name])).first()
                    score, passed = float(r["score"]), r["passed"]
                except Exception as e:  # noqa: BLE001
                    errors[name] = _said(e)
            total = found["total"]
            pct = None if passed is None else (100.0 * passed / total if total else 0.0)
            rows.append((name, None, None, n_in, None, errors[name]) if name in errors else (name, score, passed, n_in, pct, None))
    finally:
        ev.unpersist()
    return spark.createDataFrame(rows, T.StructType(schemas.METRIC.fields))
