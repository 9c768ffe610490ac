"""Queries of readers, writers and whole plans: what is written and read again must be what SQL says of the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from corpusmill.functions import java, java_scan
from corpusmill.functions import text as tx
from corpusmill.functions import tokens as tk
from corpusmill.operators import metrics, prep, workers
from corpusmill.plans import build
from corpusmill.plans.fixtures import view
from corpusmill.plans.queries import _CHATML, _COUNT, _FIXED, _IDS, _LLAMA, _PAD, _PROFILE, COMPILES, NL, PARSES, STRIP, WORDS, _dealt, _gate_sql, _Lengths, _rendered, _sql_prompt, query
from corpusmill.sources import readers, writers
from corpusmill.sources.scratch import scratch_dir

SPLITS = ("train", "eval", "test")


def _written(df, label: str, suffix: str) -> str:
    """The path of df as a table of that suffix."""
    path = f"{scratch_dir(df.sparkSession, label)}.{suffix}"
    (df.write.parquet if suffix == "parquet" else df.write.json)(path)
    return path


# --- readers ---------------------------------------------------------------------------------------------------------


@query("SELECT idx, split, src, target FROM chat_pairs", "chat_pairs")
def json_table_scan(spark, d):
    df = view(spark, d, "chat_pairs").select("idx", "split", "src", "target")
    return readers.read_table(spark, _written(df, "pairs", "json"), df.schema)


@query("SELECT split, idx, src, target FROM chat_pairs", "chat_pairs")
def raw_splits_scan(spark, d):
    df = view(spark, d, "chat_pairs").select("idx", "src", "target", "split")
    paths = {s: _written(df.where(F.col("split") == s).drop("split"), s, "jsonl") for s in SPLITS}
    return readers.read_splits(spark, paths, df.drop("split").schema).select("split", "idx", "src", "target")


@query("SELECT DISTINCT idx FROM chat_pairs", "chat_pairs")
def index_scan(spark, d):
    df = view(spark, d, "chat_pairs")
    return readers.read_index(spark, _written(df.union(df), "index", "parquet"))


@query("SELECT model, split, idx FROM registry", "registry")
def registry_scan(spark, d):
    """A YAML file that names a table for each model and split."""
    reg, text = view(spark, d, "registry"), "models:\n"
    for model in ("m_words", "m_chars"):
        text += f"  {model}:\n"
        for split in SPLITS:
            rows = reg.where((F.col("model") == model) & (F.col("split") == split)).select("idx")
            text += f"    processed_{split}: {_written(rows, f'{model}-{split}', 'parquet')}\n"
    path = scratch_dir(spark, "registry")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return readers.read_registered_index(spark, readers.read_registry(spark, path))


@query("SELECT idx AS original_idx, prediction FROM predictions WHERE prediction IS NOT NULL", "predictions")
def predictions_lines_scan(spark, d):
    """JSON lines with blank ones between them."""
    rows = view(spark, d, "predictions").select(F.to_json(F.struct("prediction", F.col("idx").alias("original_idx"))).alias("value"))
    path = f"{scratch_dir(spark, 'lines')}.jsonl"
    rows.select(F.explode(F.array("value", F.lit(" "), F.lit(""))).alias("value")).write.text(path)
    return readers.read_predictions(spark, path)


@query("SELECT DISTINCT pos::INTEGER AS pos FROM (SELECT unnest(range(n)) AS pos FROM (SELECT count(*) AS n FROM predictions))", "predictions")
def json_lines_positions(spark, d):
    """Positions in one file, which is read in many splits. One task writes it, line by line; what makes the lines is spread."""
    path = f"{scratch_dir(spark, 'lines')}.jsonl"
    view(spark, d, "predictions").select(F.to_json(F.struct("prediction")).alias("value")).repartition(1).write.text(path)
    return _read_in_splits(spark, lambda small: readers.read_json_lines(small, path).select("pos"))


def _read_in_splits(spark, read, size: int = 64 << 10):
    """What read(session) gives in a session of its own, in which splits are small."""
    small, path = spark.newSession(), scratch_dir(spark, "read")
    small.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    small.conf.set("spark.sql.files.openCostInBytes", str(size))
    read(small).write.parquet(path)
    return spark.read.parquet(path)


def _array_file(df, label: str, before: str = "[", after: str = "]") -> str:
    """The JSON texts `value` of df (idx, value) in one file, by idx, with commas and line breaks between them."""
    path = f"{scratch_dir(df.sparkSession, label)}.json"
    ends = df.agg(F.min("idx"), F.max("idx")).first()
    text = F.concat(F.when(F.col("idx") == ends[0], before).otherwise(""), "value", F.when(F.col("idx") == ends[1], after).otherwise(" ,"))
    df.select("idx", text.alias("text")).repartition(1).sortWithinPartitions("idx").select("text").write.text(path)
    return path


_SHAPES = "(VALUES ('columns'), ('objects'), ('strings'))"


@query(f"SELECT shape, CASE WHEN shape = 'strings' THEN row_number() OVER (PARTITION BY shape ORDER BY idx) - 1 ELSE idx END AS original_idx, prediction FROM predictions, {_SHAPES} AS v(shape)", "predictions")
def prediction_arrays_scan(spark, d):
    """All predictions as one array of strings, of objects, and as an object of arrays, read in many splits."""
    rows = view(spark, d, "predictions").select("idx", "prediction")
    string = F.expr("substring(to_json(array(prediction)), 2, length(to_json(array(prediction))) - 2)")
    strings = rows.select("idx", string.alias("value"))
    ends = rows.agg(F.min("idx").alias("first"), F.max("idx").alias("last")).crossJoin(rows)
    number = F.concat(F.when(F.col("idx") == F.col("first"), '], "original_idx": [').otherwise(""), F.col("idx").cast("string"))
    behind = ends.select((F.col("last") + 1 + F.col("idx") - F.col("first")).alias("idx"), number.alias("value"))
    files = {
        "strings": _array_file(strings, "strings", "[\n "),
        "objects": _array_file(rows.select("idx", F.to_json(F.struct("prediction", F.col("idx").alias("original_idx"), F.array(F.lit("],{"), F.lit('"')).alias("more"))).alias("value")), "objects"),
        "columns": _array_file(strings.unionByName(behind), "columns", '{"prediction": [', "]}"),
    }
    read = lambda small: reduce(lambda a, b: a.unionByName(b), [readers.read_predictions(small, p).select(F.lit(k).alias("shape"), "original_idx", "prediction") for k, p in files.items()])
    return _read_in_splits(spark, read, 256 << 10)


@query("SELECT prediction, idx AS original_idx FROM predictions", "predictions")
def tests_scan(spark, d):
    df = view(spark, d, "predictions").select(F.col("idx").alias("original_idx"), "prediction", F.lit("x").alias("more"))
    return readers.read_tests(spark, _written(df, "tests", "json"))


@query("SELECT f AS format, count(*) AS n, sum(idx)::BIGINT AS total FROM chat_pairs, (VALUES ('json'), ('jsonl'), ('parquet')) AS v(f) GROUP BY f UNION ALL SELECT 'csv', NULL, NULL", "chat_pairs")
def suffix_dispatch(spark, d):
    df = view(spark, d, "chat_pairs").select("idx")
    frames = [readers.read_table(spark, _written(df, "pairs", f)).agg(F.lit(f).alias("format"), F.count("*").alias("n"), F.sum("idx").alias("total")) for f in ("json", "jsonl", "parquet")]
    try:
        readers.read_table(spark, "table.csv")
    except ValueError:
        frames.append(spark.createDataFrame([("csv", None, None)], "format string, n long, total long"))
    return reduce(lambda a, b: a.unionByName(b), frames)


@query("SELECT 'there' AS name, true AS there, count(*) AS n FROM chat_pairs UNION ALL SELECT 'missing', false, NULL UNION ALL SELECT 'unreadable', true, NULL", "chat_pairs")
def safe_counts(spark, d):
    there = _written(view(spark, d, "chat_pairs"), "pairs", "parquet")
    bad = f"{scratch_dir(spark, 'bad')}.parquet"
    spark.createDataFrame([("no parquet",)], "value string").write.option("compression", "none").text(bad + "/x.parquet")
    paths = {"there": there, "missing": there + ".not.parquet", "unreadable": bad}
    return spark.createDataFrame([(k, readers.exists(spark, p), readers.safe_count(spark, p)) for k, p in paths.items()], "name string, there boolean, n long")


def _reports(spark, d):
    """(idx, report): coverage XML of every order, a method for each of its lines; null for orders of one line."""
    name = F.replace(F.replace("method_name", F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    method = F.concat(F.lit('<method name="'), name, F.lit('" desc="()V"><counter type="BRANCH" missed="9" covered="9"/><counter type="LINE" missed="'), F.col("missed"), F.lit('" covered="'), F.col("covered"), F.lit('"/></method>'))
    rows = view(spark, d, "method_counters").withColumn("m", method).groupBy("test_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "method_name", "covered", "missed", "m"))).alias("ms"))
    xml = F.concat(F.lit('<?xml version="1.0"?><!DOCTYPE report PUBLIC "x" "report.dtd"><report><class name="a/C">'), F.array_join(F.transform("ms", lambda x: x["m"]), "\n"), F.lit("</class></report>"))
    return rows.select(F.col("test_idx").cast("long").alias("idx"), F.when(F.size("ms") > 1, xml).alias("report"))


_REPORTED = "(SELECT *, count(*) OVER (PARTITION BY test_idx) AS n, row_number() OVER (PARTITION BY test_idx ORDER BY pos, method_name, covered, missed) - 1 AS place FROM method_counters)"


@query(f"SELECT test_idx::BIGINT AS idx, place::BIGINT AS pos, method_name, covered::BIGINT AS covered, missed::BIGINT AS missed FROM {_REPORTED} WHERE n > 1", "method_counters")
def coverage_xml_scan(spark, d):
    return readers.coverage_methods(_reports(spark, d).where("report is not null"))


_PCT = "100.0::DOUBLE * covered / (covered + missed)"


@query(f"""SELECT test_idx::BIGINT AS idx, CASE WHEN n = 1 THEN 0 WHEN count(*) FILTER (method_name = 'apply') > 0 THEN coalesce(max({_PCT}) FILTER (method_name = 'apply' AND covered + missed > 0), 0)
  ELSE coalesce(arg_min({_PCT}, place) FILTER (method_name NOT IN ('<init>', 'getName') AND covered + missed > 0), 0) END AS coverage FROM {_REPORTED} GROUP BY test_idx, n""", "method_counters")
def coverage_of_reports(spark, d):
    """Reports are written, read again, and joined to the focal methods of all tests; one without a report has 0."""
    reports = _reports(spark, d)
    path = scratch_dir(spark, "reports")
    writers.write_reports(reports, path)
    pairs = reports.select("idx", F.lit("apply").alias("focal_name"), F.lit("C").alias("class_name"))
    return build.coverage_of(pairs, spark.read.parquet(path))


# --- writers ---------------------------------------------------------------------------------------------------------


@query(f"SELECT idx, split, {_sql_prompt(True)} AS prompt FROM chat_pairs", "chat_pairs")
def processed_splits_sink(spark, d):
    path = scratch_dir(spark, "processed")
    writers.write_splits(prep.prompts_with_target(view(spark, d, "chat_pairs"), WORDS), path)
    return readers.read_processed(spark, path).select("idx", "split", "prompt")


@query(f"SELECT split, {_PAD.format(0)} AS input_ids, {_PAD.format(-100)} AS labels FROM (SELECT split, {_IDS} AS ids FROM chat_pairs)", "chat_pairs")
def tokenized_splits_sink(spark, d):
    path = scratch_dir(spark, "tokenized")
    writers.write_tokenized(prep.tokenize(view(spark, d, "chat_pairs"), _Lengths(), 32, prompt_col="src").select("split", "input_ids", "attention_mask", "labels"), path)
    return readers.read_tokenized(spark, path).select("split", "input_ids", "labels")


@query("SELECT idx, prediction FROM predictions", "predictions")
def predictions_sink(spark, d):
    path = writers.write_predictions(view(spark, d, "predictions"), scratch_dir(spark, "predictions"), "m", "1")
    return spark.read.schema("idx long, prediction string").json(path)


def _results(spark, d):
    tests = view(spark, d, "java_tests")
    status = F.when(F.length("prediction") > 60, "HARD_FAIL").otherwise("HARD_PASS")
    return tests.select("idx", status.alias("status"), F.concat(F.lit("log "), F.col("idx").cast("string")).alias("msg"), F.col("prediction").alias("fixed_src"))


@query("SELECT idx, CASE WHEN length(prediction) > 60 THEN 'HARD_FAIL' ELSE 'HARD_PASS' END AS status, prediction AS fixed_src, 'log ' || idx AS log, true AS in_order FROM java_tests", "java_tests")
def corrected_tests_sink(spark, d):
    """In the order of idx inside each file."""
    path = scratch_dir(spark, "corrected")
    writers.write_corrected_tests(_results(spark, d), path)
    rows = spark.read.schema("idx long, status string, fixed_src string, log string").json(path).withColumns({"place": F.monotonically_increasing_id(), "file": F.input_file_name()})
    from pyspark.sql.window import Window

    before = F.lag("idx").over(Window.partitionBy("file").orderBy("place"))
    return rows.select("idx", "status", "fixed_src", "log", (F.coalesce(before, F.lit(-1)) < F.col("idx")).alias("in_order"))


@query("SELECT 'GenTest' || idx || '.java' AS file, prediction || chr(10) AS src FROM java_tests", "java_tests")
def java_files_sink(spark, d):
    path = scratch_dir(spark, "java")
    named = _results(spark, d).select(F.concat(F.lit("GenTest"), F.col("idx").cast("string"), F.lit(".java")).alias("rel_path"), F.concat("fixed_src", F.lit("\n")).alias("src"))
    writers.write_java_files(_dealt(named), path, folders=writers.FOLDERS)
    return readers.read_java_files(spark, path).select(F.col("rel_path").alias("file"), F.decode("content", "UTF-8").alias("src"))


@query("SELECT idx, 'log ' || idx AS error FROM java_tests WHERE length(prediction) > 60", "java_tests")
def failures_sink(spark, d):
    path = scratch_dir(spark, "failures")
    for _ in range(2):  # what a run before left is replaced
        writers.write_failures(_results(spark, d), path)
    return spark.read.schema("idx long, error string").json(path)


# --- columns ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents")
def dense_index(spark, d):
    return prep.with_index(view(spark, d, "documents").select("doc_id"), ["doc_id"])


_REFERENCE = STRIP.format("target")


@query(f"SELECT m AS model, idx, {_REFERENCE} AS reference FROM chat_pairs, (VALUES ('Qwen2_5-Coder-3B'), ('llama_3_2_1B')) AS v(m) UNION ALL SELECT 'other', NULL, NULL", "chat_pairs")
def dialect_references(spark, d):
    frames = []
    for model in ("Qwen2_5-Coder-3B", "llama_3_2_1B"):
        dialect = tx.dialect_of(model)
        frames.append(_rendered(spark, d, dialect).select(F.lit(model).alias("model"), "idx", tx.extract_reference(F.col("prompt"), dialect).alias("reference")))
    try:
        tx.dialect_of("other")
    except ValueError:
        frames.append(spark.createDataFrame([("other", None, None)], "model string, idx long, reference string"))
    return reduce(lambda a, b: a.unionByName(b), frames)


@query(f"SELECT idx, rtrim({_LLAMA}, {NL}) AS inference_prompt FROM chat_pairs", "chat_pairs")
def inference_prompt_cut_llama(spark, d):
    """The prompt with a closed answer behind its last header is cut there, too."""
    prompt = F.concat("prompt", F.lit("answer<|eot_id|> "))
    return _rendered(spark, d, "llama3").select("idx", tx.prompt_for_inference(prompt).alias("inference_prompt"))


_OUT = "list_transform(list_filter(regexp_split_to_array(target, '\\s+'), lambda t: t <> ''), lambda t: least(length(t), 99)::INTEGER)"


@query(f"SELECT idx, list_filter({_OUT}, lambda t: t NOT IN (1, 2)) AS ids FROM chat_pairs", "chat_pairs")
def generated_part(spark, d):
    ids = _Lengths().ids
    rows = view(spark, d, "chat_pairs").select("idx", ids(F.col("src")).alias("a"), ids(F.col("target")).alias("b"))
    return rows.select("idx", tk.generated_part(F.concat("a", "b"), F.size("a"), (1, 2)).alias("ids"))


@query(f"SELECT idx, {_IDS} AS ids, len({_IDS}) AS n FROM chat_pairs", "chat_pairs")
def arrow_tokenizer(spark, d):
    """A Python tokenizer in Arrow batches."""
    tok = tk.ArrowTokenizer(lambda: lambda texts: [[min(len(w), 99) for w in t.split()] for t in texts])
    return view(spark, d, "chat_pairs").select("idx", tok.ids(F.col("src")).alias("ids"), tok.count(F.col("src")).cast("long").alias("n"))


_USER = f"'<|im_start|>user' || {NL} || '" + prep.INSTRUCTION.replace("\n", f"' || {NL} || '") + f"' || src || '<|im_end|>' || {NL}"
_ANSWER = f"'<|im_start|>assistant' || {NL} || target || '<|im_end|>' || {NL}"


@query(f"SELECT part, {_PROFILE} FROM (SELECT part, {_COUNT.format('x')} AS l FROM (SELECT 'input' AS part, {_USER} AS x FROM chat_pairs UNION ALL SELECT 'input_and_target', {_USER} || {_ANSWER} FROM chat_pairs UNION ALL SELECT 'target', target FROM chat_pairs)) GROUP BY part", "chat_pairs")
def profile_template(spark, d):
    return build.profile_lengths(view(spark, d, "chat_pairs"), WORDS, "src", "target")


_13A = "' ' || " + reduce(lambda c, p: f"replace({c}, {p[0]}, {p[1]})", (("'<skipped>'", "''"), (f"'-' || {NL}", "''"), (NL, "' '"), ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")), "prediction") + " || ' '"
_13A = reduce(lambda c, p: f"regexp_replace({c}, '{p[0]}', '{p[1]}', 'g')", (("([{-~[-` -&(-+:-@/])", " \\1 "), ("([^0-9])([.,])", "\\1 \\2 "), ("([.,])([^0-9])", " \\1 \\2"), ("([0-9])(-)", "\\1 \\2 ")), _13A)


@query(f"SELECT idx, list_filter(regexp_split_to_array({_13A}, '\\s+'), lambda t: t <> '') AS tokens FROM predictions", "predictions")
def bleu_tokens_13a(spark, d):
    return view(spark, d, "predictions").select("idx", metrics.tokens_13a(F.col("prediction")).alias("tokens"))


@query("SELECT doc_id, ['int f' || doc_id || '(int a, int b)', 'void g()'] AS sigs, true AS same, false AS other FROM documents")
def distinct_signatures(spark, d):
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    one, two = F.concat(F.lit("int "), name, F.lit("(int a, int b)")), F.concat(F.lit("public int "), name, F.lit(" (int a,int  b) {"))
    sigs = F.array(one, two, F.lit("void g()"))
    return view(spark, d, "documents").select("doc_id", java.distinct_signatures(sigs).alias("sigs"), java.signatures_match(one, two).alias("same"), java.signatures_match(one, F.lit("void g()")).alias("other"))


@query("SELECT * FROM (VALUES (0, 'a:b'), (1, 'a'), (2, '')) AS v(k, path)")
def classpath(spark, d):
    parts = (("a", None, ["b", ""]), ("", "a"), (None,))
    return spark.createDataFrame([(k, java.build_classpath(*p)) for k, p in enumerate(parts)], "k int, path string")


@query("""SELECT idx, replace(prediction, 'class GeneratedTest', 'class T' || idx) AS named, CASE WHEN starts_with(prediction, 'package a.b;') THEN 'a/b/' ELSE '' END || 'T' || idx || '.java' AS rel_path FROM java_tests""", "java_tests")
def uniquify_generated_only(spark, d):
    out = view(spark, d, "java_tests").select("idx", java.uniquify_test(F.col("idx"), F.col("prediction"), "T", generated_only=True).alias("x"), "prediction")
    added = F.array_join(F.filter(tx.lines(F.col("x.src")), lambda s: s != "import org.junit.Test;"), "\n")
    return out.select("idx", F.when(F.col("prediction").contains("import org.junit.Test;"), F.col("x.src")).otherwise(added).alias("named"), "x.rel_path")


_BARE = "replace(prediction, 'class GeneratedTest', 'GeneratedTest')"


@query(f"SELECT idx, CASE WHEN split_part(src, '{{', 1) LIKE '%class%' THEN src WHEN regexp_matches(src, '^\\s*[A-Z]\\w*\\s*\\{{') THEN 'public class GeneratedTest {{' || substr(src, strpos(src, '{{') + 1) END AS src FROM (SELECT idx, {_BARE} AS src FROM java_tests)", "java_tests")
def class_keyword_strict(spark, d):
    src = F.replace("prediction", F.lit("class GeneratedTest"), F.lit("GeneratedTest"))
    return view(spark, d, "java_tests").select("idx", java.ensure_class_keyword(src, strict=True).alias("src"))


_BODY = "void go() {{ if (x) {{ run(\"}}\"); }} }} int f{0}(int a); List<String> all(); // done"
_FILLED = "void go() {{ if (x) {{ run(\"}}\"); }} }} int f{0}(int a) {{ return 0; }} List<String> all() {{ return new java.util.ArrayList<>(); }} // done"


@query("SELECT doc_id, 'import java.util.*;' || chr(10) || 'public class C' || doc_id || ' {' || chr(10) || '    " + _FILLED.format("' || doc_id || '") + "' || chr(10) || '}' AS src FROM documents")
def focal_normalized(spark, d):
    """A head without the keyword, an implemented method with a brace in a string, bare signatures, a comment."""
    before, after = _BODY.format("\u0001").split("\u0001")
    n = F.col("doc_id").cast("string")
    return view(spark, d, "documents").select("doc_id", java_scan.normalize_focal(F.concat(F.lit("C"), n, F.lit(" { "), F.lit(before), n, F.lit(after), F.lit("\n}"))).alias("src"))


# --- plans -----------------------------------------------------------------------------------------------------------

@query(f"SELECT avg({PARSES}::INT)::DOUBLE AS score, count(*) FILTER ({PARSES}) AS passed FROM java_tests", "java_tests")
def parse_rate(spark, d):
    return metrics.parse_rate(workers.parse_java(_dealt(view(spark, d, "java_tests"))))


@query(f"SELECT CASE WHEN {COMPILES} THEN 'HARD_PASS' ELSE 'HARD_FAIL' END AS status, count(*) AS n FROM java_tests GROUP BY 1", "java_tests")
def compile_report_counts(spark, d):
    """Of a file of predictions; corrected tests and failures are written, too."""
    tests = _dealt(view(spark, d, "java_tests")).select("prediction", F.col("idx").alias("original_idx"))
    path = scratch_dir(spark, "report")
    return build.compile_report(spark, _written(tests, "predictions", "jsonl"), f"{path}/fixed", f"{path}/errors")[0]


def _flat(name: str, col: str) -> str:
    return f"SELECT '{name}' AS metric, avg({col}::INT)::DOUBLE AS score, count(*) FILTER ({col}) AS passed, count(*) AS n_in, 100.0::DOUBLE * count(*) FILTER ({col}) / count(*) AS pct_total, NULL::VARCHAR AS error FROM s"


@query(f"""s AS (SELECT *, {PARSES} AS p, {COMPILES} AS c FROM java_tests) {_flat('parse_rate', 'p')} UNION ALL {_flat('compile_rate', 'c')}
UNION ALL SELECT 'exact_match', 1, NULL, count(*), NULL, NULL FROM s UNION ALL SELECT 'edit_distance', 0, NULL, count(*), NULL, NULL FROM s""", "java_tests")
def evaluation_flat(spark, d):
    """Every metric over all rows; the predictions are their own references."""
    tests = view(spark, d, "java_tests").select("idx", "prediction")
    prompts = tests.select("idx", F.lit("p").alias("prompt"), F.col("prediction").alias("reference"))
    return build.evaluate(prompts, tests, "qwen", ["parse_rate", "compile_rate", "exact_match", "edit_distance"], cascade=False, partitions=spark.sparkContext.defaultParallelism)


def _config(spark) -> dict:
    return {"output_dir": scratch_dir(spark, "build"), "max_input_len": 64, "need_special_processing": False, "processing_options": {"max_context": 200, "reserved": 40}}


_FITS = _gate_sql("src", 200 - 40 - _FIXED)


@query(f"SELECT idx, split, CASE WHEN split = 'test' THEN {_sql_prompt(False)} ELSE {_sql_prompt(True)} END AS prompt FROM chat_pairs WHERE {_FITS}", "chat_pairs")
def process_by_registered_names(spark, d):
    """Each split by the function that the configuration names."""
    config = {"processing_functions": {"train": "prompts_with_target", "test": "prompts_only"}, "processing_function": "prompts_with_target", "processing_options": {"max_context": 200, "reserved": 40}}
    return build.process(view(spark, d, "chat_pairs"), WORDS, config).select("idx", "split", "prompt")


_BUILT = f"SELECT split, list_transform(list_filter(regexp_split_to_array(p, '\\s+'), lambda t: t <> ''), lambda t: least(length(t), 99)) [1:64] AS ids FROM (SELECT split, CASE WHEN split = 'test' THEN {_sql_prompt(False)} ELSE {_sql_prompt(True)} END AS p FROM chat_pairs WHERE {_FITS})"


class _Counted(_Lengths):
    def count(self, text):
        return WORDS.count(text)


@query(f"SELECT split, count(*) AS n, sum(len(ids))::BIGINT AS n_tokens, sum(list_sum(ids))::BIGINT AS total, count(*) FILTER (split <> 'test') AS n_labels FROM ({_BUILT}) GROUP BY split", "chat_pairs")
def build_tokens(spark, d):
    """Built twice: the second time prompts and tokens are used again."""
    config, raw = _config(spark), view(spark, d, "chat_pairs")
    for _ in range(2):
        out = build.build_datasets(spark, config, _Counted(), raw)
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    return out.groupBy("split").agg(F.count("*").alias("n"), F.sum(total("attention_mask")).alias("n_tokens"), F.sum(total("input_ids")).alias("total"), F.count("labels").alias("n_labels"))


_CHANGED = "(SELECT idx, split, src, CASE WHEN idx % 100 = 0 THEN target || ' changed' ELSE target END AS target FROM chat_pairs)"


@query(f"SELECT split, count(*) AS n, sum(list_sum(ids))::BIGINT AS total, true AS same_as_full, true AS others_kept FROM ({_BUILT.replace('FROM chat_pairs', f'FROM {_CHANGED}')}) GROUP BY split", "chat_pairs")
def incremental_build(spark, d):
    """Built, then built again with one answer in a hundred changed: only the buckets of changed rows are made anew, and the tokens are those of a build from nothing."""
    config, raw = _config(spark) | {"buckets": 64}, view(spark, d, "chat_pairs").select("idx", "split", "src", "target")
    build.build_datasets(spark, config, _Counted(), raw)
    store = build.Store(spark, config["output_dir"])
    before = store.known("processed")
    touched = F.col("idx") % 100 == 0
    changed = raw.withColumn("target", F.when(touched, F.concat("target", F.lit(" changed"))).otherwise(F.col("target")))
    out = build.build_datasets(spark, config, _Counted(), changed)
    units = raw.where(touched).select("split", build.bucket_of(64)).distinct().count()
    kept = len(store.known("processed") - before) == units
    full = build.build_datasets(spark, config | {"output_dir": scratch_dir(spark, "full")}, _Counted(), changed)
    same = out.exceptAll(full).isEmpty() and full.exceptAll(out).isEmpty()
    total = F.sum(F.aggregate("input_ids", F.lit(0), lambda a, x: a + x))
    return out.groupBy("split").agg(F.count("*").alias("n"), total.alias("total"), F.lit(same).alias("same_as_full"), F.lit(kept).alias("others_kept"))


@query("SELECT n, idx FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY idx) AS k FROM (SELECT 3 * doc_id + 7 AS idx, unnest([1, 37, 400]) AS n FROM documents)) WHERE k <= n")
def first_rows(spark, d):
    """Of an index with gaps: by heaps, and by counts (the largest)."""
    docs = view(spark, d, "documents").select((3 * F.col("doc_id") + 7).alias("idx"))
    frames = [prep.first_rows(docs, n).select(F.lit(n).alias("n"), "idx") for n in (1, 37)]
    last = prep.nth_index(docs, min(400, docs.count()))
    return reduce(lambda a, b: a.unionByName(b), [*frames, docs.where(F.col("idx") <= last).select(F.lit(400).alias("n"), "idx")])


@query(f"SELECT split, count(*) AS n FROM chat_pairs WHERE {_FITS} GROUP BY split", "chat_pairs")
def dry_run_counts(spark, d):
    return build.dry_run(spark, _config(spark), WORDS, view(spark, d, "chat_pairs"))["counts"].withColumnRenamed("count", "n")


@query("SELECT idx, 'class GeneratedTest { @Test void t' || length(rtrim(prompt, chr(10))) || '() { } }' AS prediction FROM (SELECT idx, " + _CHATML + " AS prompt FROM chat_pairs)", "chat_pairs")
def infer_written(spark, d):
    path, _ = build.infer(_rendered(spark, d, "chatml"), workers.echo_model, scratch_dir(spark, "infer"), "m", "1")
    return spark.read.schema("idx long, prediction string").json(path)
