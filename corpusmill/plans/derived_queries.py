"""Queries of functions on sources, messages and signatures that are made of every row of a table, each with what SQL makes of the same row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import gates, java, java_scan
from corpusmill.operators import metrics, workers
from corpusmill.plans import build
from corpusmill.plans.fixtures import view
from corpusmill.plans.io_queries import _13A
from corpusmill.plans.queries import _FOLD, _GRAMS, _TYPES, _dealt, query
from corpusmill.sources import readers, writers
from corpusmill.sources.scratch import scratch_dir


def _pick(row: str, texts) -> str:
    """SQL for both engines: the text at the place that the integer expression gives; {id} in a text is the row's doc_id."""
    quoted = lambda t: "concat(" + ", CAST(doc_id AS STRING), ".join("'" + p.replace("'", "''").replace("\n", "', chr(10), '") + "'" for p in t.split("{id}")) + ", '')"
    return f"CASE {row} % {len(texts)} " + " ".join(f"WHEN {i} THEN {quoted(t)}" for i, t in enumerate(texts)) + " END"


def _rows(spark, d, **columns: str) -> DataFrame:
    """doc_id of documents and columns by SQL that DuckDB runs, too."""
    return spark.sql("SELECT doc_id, " + ", ".join(f"{sql} AS {n}" for n, sql in columns.items()).replace("{", "{{").replace("}", "}}") + " FROM {docs}", docs=view(spark, d, "documents"))


_N = "coalesce(n_chars, 0)"

# --- compiler messages -----------------------------------------------------------------------------------------------

_LINES = ("", "Gen{id}.java:1: error: package p{id}.b does not exist\n", "Gen{id}.java:2: error: cannot find symbol\n", "Gen{id}.java:3: error: class file for X{id} not found\n", "Gen{id}.java:4: error: ';' expected\n", "  Foo{id} x;\n", "error: reached end of file while parsing\n", "Note: {id}\n", "1 error\n")
_ERR = f"concat({_pick('doc_id', _LINES)}, {_pick(f'({_N} + doc_id)', _LINES[:4])}, {_pick(_N, _LINES[:5])})"
_HAS = "len(list_filter(ls, lambda x: {1} regexp_matches(x, '{0}')))"
_FATAL = _HAS.format("|".join(gates.FATAL).replace("'", "''"), "")
_HARD = _HAS.format("|".join(gates.SOFT).replace("'", "''"), "NOT")


@query(f"""SELECT doc_id, {_FATAL} > 0 AS fatal, err <> '' AND {_HARD} = 0 AS soft, CASE WHEN code = 0 THEN 'HARD_PASS' WHEN {_FATAL} = 0 AND err <> '' AND {_HARD} = 0 THEN 'SOFT_PASS' ELSE 'HARD_FAIL' END AS status,
  CASE WHEN code = 0 THEN '' WHEN err = '' THEN 'unknown error' ELSE ls[1] END AS msg
  FROM (SELECT *, string_split(rtrim(err, chr(10)), chr(10)) AS ls FROM (SELECT doc_id, {_ERR} AS err, doc_id % 11 AS code FROM documents))""")
def compiler_messages(spark, d):
    """Messages of up to three kinds of lines, with names of the row."""
    rows = _rows(spark, d, err=_ERR)
    code = F.col("doc_id") % 11
    return rows.select("doc_id", gates.is_fatal(F.col("err")).alias("fatal"), gates.only_soft(F.col("err")).alias("soft"), gates.compile_status(code, F.col("err")).alias("status"), gates.compile_message(code, F.col("err")).alias("msg"))


# --- Java sources ----------------------------------------------------------------------------------------------------

_MEMBERS = ("", "C{id}() { } ", "int getX{id}() { return 1; } ", "void setY{id}(int y) { } ", "int run{id}(int a) { return a; } ", "public static <T> T pick{id}(T t) { return t; } ", "void bare{id}(); ")
_NAMES = ("", "", "getX{id}", "setY{id}", "run{id}", "pick{id}", "")
_PLACES = ("doc_id", f"({_N} + doc_id)", f"({_N} / 7)")
_PLACES = tuple(f"CAST(floor({p}) AS BIGINT)" for p in _PLACES)
_NAMED = ", ".join(_pick(p, _NAMES) for p in _PLACES)


@query(f"""SELECT doc_id, coalesce(list_filter(ns, lambda x: NOT starts_with(x, 'get') AND NOT starts_with(x, 'set'))[1], ns[1], 'unknownMethod') AS name
  FROM (SELECT doc_id, list_filter([{_NAMED}], lambda x: x <> '') AS ns FROM documents)""")
def focal_method_names(spark, d):
    """Classes of three members out of seven kinds in any order."""
    src = f"concat('class C', CAST(doc_id AS STRING), ' {{ ', {', '.join(_pick(p, _MEMBERS) for p in _PLACES)}, '}}')".replace("{{", "{").replace("}}", "}")
    return _rows(spark, d, src=src).select("doc_id", java.focal_method_name(F.col("src")).alias("name"))


_RETURNS = [*_TYPES, ("Row{id}", "return null;"), ("Set<Row{id}>", java.default_statement("Set<Row>")), ("Row{id}[]", "return null;"), ("long", java.default_statement("long"))]
_PLACE = f"({_N} + doc_id)"


@query(f"SELECT doc_id, stmt, concat('public ', ret, ' f', CAST(doc_id AS VARCHAR), '(int a) throws E ', CASE WHEN stmt = '' THEN '{{}}' ELSE '{{ ' || stmt || ' }}' END) AS method FROM (SELECT doc_id, {_pick(_PLACE, [t for t, _ in _RETURNS])} AS ret, {_pick(_PLACE, [s for _, s in _RETURNS])} AS stmt FROM documents)")
def trivial_methods(spark, d):
    rows = _rows(spark, d, ret=_pick(_PLACE, [t for t, _ in _RETURNS]))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    return rows.select("doc_id", java.default_return(F.col("ret")).alias("stmt"), java.implement_signature(F.lit("public  "), F.col("ret"), name, F.lit("int a"), F.lit("E ")).alias("method"))


_SIGS = [f"concat({head}, CAST({n} AS STRING), {tail})" for head, n, tail in (("'int f'", "doc_id % 3", "'(int a, int b)'"), ("'public  int f'", f"{_N} % 3", "' (int a,int  b) {'"), ("'void f'", "doc_id % 2", "'()'"), ("'int f'", f"{_N} % 2", "'(int a, long b)'"), ("'static void f'", f"{_N} % 2", "'( )'"))]
_CORE = "regexp_extract(s, '(\\w+)\\s*\\(', 1) || '(' || regexp_replace(regexp_extract(s, '\\(([^)]*)\\)', 1), '\\s+', '', 'g') || ')'"


@query(f"""SELECT doc_id, list_filter(sigs, lambda s, i: list_position(cores, {_CORE}) = i) AS sigs, cores[1] = cores[2] AS same FROM (
  SELECT doc_id, sigs, list_transform(sigs, lambda s: {_CORE}) AS cores FROM (SELECT doc_id, [{', '.join(_SIGS)}] AS sigs FROM documents))""")
def signatures_of_rows(spark, d):
    """Five signatures of one to three names, two parameter lists and other spacing."""
    rows = _rows(spark, d, sigs=f"array({', '.join(_SIGS)})")
    return rows.select("doc_id", java.distinct_signatures(F.col("sigs")).alias("sigs"), java.signatures_match(F.get("sigs", F.lit(0)), F.get("sigs", F.lit(1))).alias("same"))


_PARTS = ("", "void go{id}() { if (x) { run(\"}\"); } } ", "int f{id}(int a); ", "List<String> all{id}(); ", "/* { */ private int n = {id}; ", "boolean is{id}() { return '}' == c; } ")
_DONE = ("", _PARTS[1], "int f{id}(int a) { return 0; } ", "List<String> all{id}() { return new java.util.ArrayList<>(); } ", _PARTS[4], _PARTS[5])
_HEAD = _pick("doc_id", ("C{id} { ", "class D{id} { ", "public class E{id} implements Runnable { ", "F{id} extends Base { "))
_HEADED = _pick("doc_id", ("public class C{id} {", "class D{id} {", "public class E{id} implements Runnable {", "public class F{id} extends Base {"))


@query(f"""SELECT doc_id, CASE WHEN contains(body, 'java.util.') THEN 'import java.util.*;' || chr(10) ELSE '' END || head || chr(10) || '    ' || trim(body) || chr(10) || '}}' AS src
  FROM (SELECT doc_id, {_HEADED} AS head, concat({', '.join(_pick(p, _DONE) for p in _PLACES)}) AS body FROM documents)""")
def focal_sources(spark, d):
    """Classes of three members out of six kinds, under four heads."""
    return _rows(spark, d, src=f"concat({_HEAD}, {', '.join(_pick(p, _PARTS) for p in _PLACES)}, '}}')".replace("}}", "}")).select("doc_id", java_scan.normalize_focal(F.col("src")).alias("src"))


@query("SELECT doc_id, array_to_string(list_filter(['a', source, '', lang, NULL, source], lambda x: x IS NOT NULL AND x <> ''), ':') AS path FROM documents")
def classpath_of_rows(spark, d):
    parts = F.array(F.lit("a"), "source", F.lit(""), "lang", F.lit(None), "source")
    return view(spark, d, "documents").select("doc_id", java.classpath(parts).alias("path"))


_FILES = ("a/b/T{id}.class", "Z{id}.class", "a/T{id}$Inner.class", "a/b/notes{id}.txt", "c/d$e/U{id}.class")


@query(f"""SELECT doc_id, list_sort(list_transform(list_filter(ps, lambda p: ends_with(p, '.class') AND NOT contains(split_part(p, '/', -1), '$')), lambda p: replace(left(p, length(p) - 6), '/', '.'))) AS names
  FROM (SELECT doc_id, [{', '.join(_pick(p, _FILES) for p in _PLACES)}] AS ps FROM documents)""")
def class_discovery(spark, d):
    """Top classes among three files of five kinds."""
    rows = _rows(spark, d, ps=f"array({', '.join(_pick(p, _FILES) for p in _PLACES)})")
    return rows.select("doc_id", java.class_names(F.col("ps")).alias("names"))


@query("""SELECT idx || '/src/C' || idx || '.java' AS path, 'class C' || idx || ' {' || chr(10) || '    int f() { return ' || idx || '; }' || chr(10) || '}' AS src FROM java_tests
UNION ALL SELECT idx || '/tests/' || CASE WHEN starts_with(prediction, 'package a.b;') THEN 'a/b/' ELSE '' END || 'GenTest' || idx || '.java', NULL FROM java_tests WHERE prediction <> ''""", "java_tests")
def workspace_sink(spark, d):
    """Each test and its focal class as files of a workspace of their own, written and read again; the reader leaves out files without a byte."""
    tests = view(spark, d, "java_tests").select(F.col("idx").alias("original_idx"), "prediction")
    n = F.col("original_idx").cast("string")
    focal = tests.select(F.col("original_idx").alias("idx"), F.concat(F.lit("class C"), n, F.lit(" { int f() { return "), n, F.lit("; } }")).alias("src"))
    path = scratch_dir(spark, "workspaces")
    writers.write_java_files(workers.workspace_files(build.coverage_tests(tests, focal)), path, folders=writers.FOLDERS)
    own = F.col("rel_path")
    return readers.read_java_files(spark, path).select(own.alias("path"), F.when(own.contains("/src/"), F.decode("content", "UTF-8")).alias("src"))


# --- scores ----------------------------------------------------------------------------------------------------------

_GRAMS_13A = _GRAMS.replace("regexp_split_to_array(x, ", f"regexp_split_to_array({_13A.replace('prediction', 'coalesce(x, chr(32))')}, ")


@query(f"""{_GRAMS_13A}, s AS (SELECT split, n, sum(least(np, nr))::DOUBLE AS correct, sum(np)::DOUBLE AS total FROM c GROUP BY split, n),
l AS (SELECT split, sum(len(w)) FILTER (side = 'p')::DOUBLE AS sys, sum(len(w)) FILTER (side = 'r')::DOUBLE AS ref FROM t GROUP BY split)
SELECT l.split, round(100 * CASE WHEN sys < ref THEN exp(1 - ref / sys) ELSE 1 END * exp(avg(ln(correct / total))), 6) AS score FROM s JOIN l USING (split) GROUP BY l.split, sys, ref""", "predictions")
def corpus_bleu_13a(spark, d):
    """The score by its default tokenizer."""
    return metrics.corpus_bleu(_dealt(view(spark, d, "predictions")), by=["split"]).select("split", F.round("score", 6).alias("score"))


_FIELDS = {"p": "doc_id % 5 + 1", "r": f"{_N} % 7 + 1"}


def _class(n: str) -> str:
    """SQL: a class of n fields, each but the first initialised with the one before."""
    return f"concat('class A {{ int x0 = 1;'{''.join(f", CASE WHEN {n} > {k} THEN ' int x{k} = x{k - 1};' ELSE '' END" for k in range(1, 7))}, ' }}')".replace("{{", "{").replace("}}", "}")


_CLASSES = f"SELECT doc_id AS idx, {_FIELDS['p']} AS p, {_FIELDS['r']} AS r FROM documents"
_KEYWORDS = ", ".join(f"'{k}'" for k in metrics.KEYWORDS)


@query(f"""WITH f AS ({_CLASSES}), v AS (SELECT idx, p, r, {_class('p')} AS prediction, {_class('r')} AS reference FROM f),
t AS (SELECT idx, side, list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '') AS w FROM (SELECT idx, 'p' AS side, prediction AS x FROM v UNION ALL SELECT idx, 'r', reference FROM v)),
g AS (SELECT idx, side, n, array_to_string(w[i:i+n-1], chr(1)) AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM t, (VALUES (1), (2), (3), (4)) AS o(n))),
c AS (SELECT idx, n, gram, count(*) FILTER (side = 'p') AS np, count(*) FILTER (side = 'r') AS nr, CASE WHEN n > 1 OR gram IN ({_KEYWORDS}) THEN 1 ELSE 0.2::DOUBLE END AS k FROM g GROUP BY ALL),
s AS (SELECT n, sum(least(np, nr))::DOUBLE AS a, sum(np)::DOUBLE AS b, sum(least(np, nr) * k) AS ka, sum(np * k) AS kb FROM c GROUP BY n),
l AS (SELECT sum(len(w)) FILTER (side = 'p')::DOUBLE AS sys, sum(len(w)) FILTER (side = 'r')::DOUBLE AS ref FROM t),
m AS (SELECT exp(avg(ln(a / b))) AS one, exp(avg(ln(ka / kb))) AS two FROM s),
x AS (SELECT sum(least(p, r) + CASE WHEN p = r THEN 2 ELSE 0 END)::DOUBLE / sum(r + 2) AS syntax, sum(least(p, r) - 1)::DOUBLE / sum(r - 1) AS dataflow FROM f),
y AS (SELECT one * brevity AS ngram, two * brevity AS weighted_ngram, syntax, dataflow FROM m, x, (SELECT CASE WHEN sys < ref THEN exp(1 - ref / sys) ELSE 1 END AS brevity FROM l))
SELECT round(ngram, 6) AS ngram, round(weighted_ngram, 6) AS weighted_ngram, round(syntax, 6) AS syntax, round(dataflow, 6) AS dataflow, round((ngram + weighted_ngram + syntax + dataflow) / 4, 6) AS score FROM y""")
def codebleu_of_classes(spark, d):
    """The four parts over classes of as many fields as each row says: subtrees are those of the fields, and of class and unit where all agree; each field but the first has a flow."""
    fields = spark.sql(_CLASSES.replace("FROM documents", "FROM {docs}"), docs=view(spark, d, "documents"))
    pairs = fields.select("idx", F.expr(_class("p")).alias("prediction"), F.expr(_class("r")).alias("reference"))
    return metrics.codebleu(_dealt(pairs)).select(*(F.round(c, 6).alias(c) for c in ("ngram", "weighted_ngram", "syntax", "dataflow", "score")))


@query(f"SELECT idx, levenshtein({_FOLD.format('prediction')}, {_FOLD.format('reference')})::INTEGER AS edits FROM predictions", "predictions")
def edit_distances(spark, d):
    """Of each pair, by the program for long texts alone (folded to ASCII, as DuckDB counts bytes)."""
    fold = lambda c: F.regexp_replace(c, "[^\\x00-\\x7F]", "?")
    rows = _dealt(view(spark, d, "predictions"))
    return rows.select("idx", F.pandas_udf(metrics._long_distances, "int")(fold("prediction"), fold("reference")).alias("edits"))
