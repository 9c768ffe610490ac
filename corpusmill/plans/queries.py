"""A query for each operator on the driver's tables, and the same in DuckDB's SQL, written from the definition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import gates, java
from corpusmill.functions import text as tx
from corpusmill.functions import tokens as tk
from corpusmill.operators import metrics, prep, profile, workers
from corpusmill.plans.fixtures import in_order, view, with_views
from corpusmill.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORDS = tk.WhitespaceTokenizer()
NL = "chr(10)"
STRIP = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"


def query(sql: str | None = None, *views: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return put


def _dealt(df: DataFrame) -> DataFrame:
    """df on all cores: its few files would leave most of them idle while each row costs milliseconds."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _sql_prompt(target: bool, system: str = prep.SYSTEM, instruction: str = prep.INSTRUCTION) -> str:
    tag = lambda role, x: f"'<|im_start|>{role}' || {NL} || {x} || '<|im_end|>' || {NL}"
    ins = instruction.replace("\n", f"' || {NL} || '")
    answer = f" || CASE WHEN target IS NULL THEN '' ELSE {tag('assistant', 'target')} END" if target else ""
    return f"{tag('system', chr(39) + system + chr(39))} || {tag('user', chr(39) + ins + chr(39) + ' || src')}{answer} || '<|im_start|>assistant' || {NL}"


_COUNT = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda t: t <> ''))"


def _gate_sql(col: str, limit: int) -> str:
    return f"{_COUNT.format(col)} <= {limit}"


_FIXED = len(prep.INSTRUCTION.split())


@query(f"SELECT idx, split, {_sql_prompt(True)} AS prompt, target AS reference FROM chat_pairs WHERE {_gate_sql('src', 200 - 40 - _FIXED)}", "chat_pairs")
def prompt_build_with_target(spark, d):
    return prep.prompts_with_target(view(spark, d, "chat_pairs"), WORDS, max_context=200, reserved=40)


@query(f"SELECT idx, split, {_sql_prompt(False)} AS prompt, target AS reference FROM chat_pairs", "chat_pairs")
def prompt_build_prompt_only(spark, d):
    return prep.prompts_only(view(spark, d, "chat_pairs"), WORDS)


@query(f"SELECT idx, split FROM chat_pairs WHERE {_gate_sql('src', 80 - 20 - _FIXED)}", "chat_pairs")
def length_gate(spark, d):
    return prep.length_gate(view(spark, d, "chat_pairs"), WORDS, max_context=80, reserved=20).select("idx", "split")


@query(f"SELECT lang, count(*) AS n, count(*) FILTER ({_gate_sql('text', 300)}) AS kept, count(*) FILTER (NOT {_gate_sql('text', 300)}) AS skipped FROM documents GROUP BY lang")
def length_gate_counts(spark, d):
    return prep.gate_counts(view(spark, d, "documents"), WORDS, ["lang"], 300, "text")


def _rendered(spark, d, dialect):
    return view(spark, d, "chat_pairs").select("idx", "split", "target", tx.chat_prompt(F.col("src"), F.col("target"), "S", "I ", dialect).alias("prompt"))


_CHATML = _sql_prompt(True, "S", "I ")
_LLAMA = "'<|begin_of_text|>' || list_reduce([{0}], lambda a, b: a || b) || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)".format(
    ", ".join(f"'<|start_header_id|>{r}<|end_header_id|>' || chr(10) || chr(10) || {x} || '<|eot_id|>'" for r, x in (("system", "'S'"), ("user", "'I ' || src"), ("assistant", "target")))
)


@query(f"SELECT idx, {STRIP.format('target')} AS reference FROM (SELECT idx, target, {_CHATML} AS prompt FROM chat_pairs)", "chat_pairs")
def reference_extract_chatml(spark, d):
    return _rendered(spark, d, "chatml").select("idx", tx.extract_reference(F.col("prompt"), "chatml").alias("reference"))


@query(f"SELECT idx, {STRIP.format('list_last(regexp_extract_all(prompt, ' + chr(39) + '<.start_header_id.>assistant<.end_header_id.>(.*?)<.eot_id.>' + chr(39) + ', 1, ' + chr(39) + 's' + chr(39) + '))')} AS reference FROM (SELECT idx, {_LLAMA} AS prompt FROM chat_pairs)", "chat_pairs")
def reference_extract_llama(spark, d):
    return _rendered(spark, d, "llama3").select("idx", tx.extract_reference(F.col("prompt"), "llama3").alias("reference"))


@query(f"SELECT idx, prompt, prompt = inference_prompt || {NL} AS is_whole, inference_prompt FROM (SELECT idx, {_CHATML} AS prompt, rtrim({_CHATML}, {NL}) AS inference_prompt FROM chat_pairs)", "chat_pairs")
def inference_prompt_cut(spark, d):
    out = _rendered(spark, d, "chatml").withColumn("inference_prompt", tx.prompt_for_inference(F.col("prompt")))
    return out.select("idx", "prompt", (F.col("prompt") == F.concat("inference_prompt", F.lit("\n"))).alias("is_whole"), "inference_prompt")


@query("SELECT idx, CASE WHEN prediction LIKE '```java%' AND strpos(prediction, chr(10)) > 0 THEN rtrim(split_part(substr(prediction, strpos(prediction, chr(10)) + 1), '```', 1), chr(10) || ' ') ELSE prediction END AS code FROM java_tests", "java_tests")
def fence_extract(spark, d):
    return view(spark, d, "java_tests").select("idx", tx.extract_java_code(F.col("prediction")).alias("code"))


_SHARED = "SELECT split, idx FROM registry WHERE model = 'm_words' INTERSECT SELECT split, idx FROM registry WHERE model = 'm_chars'"


@query(_SHARED, "registry")
def shared_index(spark, d):
    return prep.shared_index(view(spark, d, "registry"))


@query(_SHARED, "registry")
def shared_index_intersect(spark, d):
    reg = view(spark, d, "registry")
    return prep.shared_index_of([reg.where(F.col("model") == m) for m in ("m_words", "m_chars")])


@query(f"SELECT idx, split, src FROM chat_pairs c WHERE EXISTS (SELECT 1 FROM ({_SHARED}) s WHERE s.split = c.split AND s.idx = c.idx)", "registry")
def fairness_filter(spark, d):
    return prep.fairness_filter(view(spark, d, "chat_pairs"), prep.shared_index(view(spark, d, "registry"))).select("idx", "split", "src")


@query(f"SELECT idx, split FROM chat_pairs c WHERE split = 'eval' OR EXISTS (SELECT 1 FROM ({_SHARED}) s WHERE s.split = c.split AND s.idx = c.idx)", "registry")
def fairness_empty_bypass(spark, d):
    shared = prep.shared_index(view(spark, d, "registry")).where("split <> 'eval'")
    return prep.fairness_filter(view(spark, d, "chat_pairs"), shared).select("idx", "split")


@query(f"SELECT c.split, count(*) AS n_before, count(s.idx) AS n_after, round(100.0::DOUBLE * count(s.idx) / count(*), 6) AS pct FROM chat_pairs c LEFT JOIN ({_SHARED}) s ON s.split = c.split AND s.idx = c.idx GROUP BY c.split", "registry")
def split_kept_percent(spark, d):
    pairs = view(spark, d, "chat_pairs")
    return prep.kept_percent(pairs, pairs.join(prep.shared_index(view(spark, d, "registry")), ["split", "idx"], "left_semi"))


class _Lengths:
    """IDs that SQL can make, too: the length of each word, 1 to 99."""

    pad_id = 0

    def ids(self, text):
        return F.transform(WORDS.tokens(text), lambda t: F.least(F.length(t), F.lit(99)))


_IDS = "list_transform(list_filter(regexp_split_to_array(src, '\\s+'), lambda t: t <> ''), lambda t: least(length(t), 99)::INTEGER)"
_PAD = "list_concat(ids[1:32], list_transform(range(greatest(32 - len(ids), 0)), lambda i: {0}::INTEGER))"
_MASK = "list_transform(range(32), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END::INTEGER)"


@query(f"SELECT idx, {_PAD.format(0)} AS input_ids, {_MASK} AS attention_mask, {_PAD.format(-100)} AS labels FROM (SELECT idx, {_IDS} AS ids FROM chat_pairs)", "chat_pairs")
def tokenize_pad_labels(spark, d):
    return prep.tokenize(view(spark, d, "chat_pairs"), _Lengths(), 32, prompt_col="src").select("idx", "input_ids", "attention_mask", "labels")


@query(f"SELECT idx, list_concat(list_transform(range(greatest(32 - len(ids), 0)), lambda i: 0::INTEGER), ids[1:32]) AS input_ids, list_reverse({_MASK}) AS attention_mask FROM (SELECT idx, {_IDS} AS ids FROM chat_pairs)", "chat_pairs")
def tokenize_infer(spark, d):
    return prep.tokenize_for_inference(view(spark, d, "chat_pairs"), _Lengths(), 32, "left", "src").select("idx", "input_ids", "attention_mask")


_LEN = f"least(32, {_COUNT.format('src')})"


@query("SELECT split, count(*) AS n, " + ", ".join(f"{f}({_LEN})::BIGINT AS {k}_{f}" for k in ("input", "label") for f in ("min", "max")) + f", round(avg({_LEN}), 6) AS input_avg, round(avg({_LEN}), 6) AS label_avg FROM chat_pairs GROUP BY split", "chat_pairs")
def effective_length_stats(spark, d):
    return profile.tokenized_stats(prep.tokenize(view(spark, d, "chat_pairs"), _Lengths(), 32, prompt_col="src"), ["split"])


_PROFILE = "count(*) AS n, round(avg(l), 6) AS mean, quantile_cont(l, 0.5)::DOUBLE AS median, trunc(quantile_cont(l, 0.95))::BIGINT AS p95, trunc(quantile_cont(l, 0.99))::BIGINT AS p99, max(l)::BIGINT AS max, trunc(quantile_cont(l, 0.95) + 7)::BIGINT // 8 * 8 AS suggested"


@query(f"SELECT lang, {_PROFILE} FROM (SELECT lang, {_COUNT.format('text')} AS l FROM documents) GROUP BY lang")
def token_length_profile(spark, d):
    return profile.length_profile(view(spark, d, "documents"), WORDS.count(F.col("text")), ["lang"])


@query(f"SELECT trunc(quantile_cont(l, 0.95) + 7)::BIGINT // 8 * 8 AS suggested FROM (SELECT {_COUNT.format('text')} AS l FROM documents)")
def suggested_max_len(spark, d):
    return profile.length_profile(view(spark, d, "documents"), WORDS.count(F.col("text"))).select("suggested")


@query(f"SELECT idx, replace(substr(prompt, 1, 400), {NL}, '\\n') || CASE WHEN length(prompt) > 400 THEN '...' ELSE '' END AS preview FROM (SELECT idx, {_CHATML} AS prompt FROM chat_pairs)", "chat_pairs")
def prompt_preview(spark, d):
    return _rendered(spark, d, "chatml").select("idx", tx.preview(F.col("prompt")).alias("preview"))


_SHAPES = ('["a", "b\\n"]', '[{"prediction": "p", "original_idx": 7}, {"other": 1}, {"prediction": "q"}]', '{"prediction": ["x", "y"], "original_idx": [3, 4]}', '{"prediction": ["z"]}', '"one"')


@query("SELECT * FROM (VALUES (0, 0::BIGINT, 'a'), (0, 1, 'b' || chr(10)), (1, 7, 'p'), (1, 2, 'q'), (2, 3, 'x'), (2, 4, 'y'), (3, 0, 'z'), (4, 0, 'one')) AS v(shape, original_idx, prediction)")
def predictions_explode(spark, d):
    out = None
    for k, text in enumerate(_SHAPES):
        part = readers.explode_predictions(spark.createDataFrame([(text,)], "value string")).select(F.lit(k).alias("shape"), "original_idx", "prediction")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT r.idx, r.pos, r.prediction, d.lang FROM (SELECT conv_id AS idx, u.pos, u.prediction FROM (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id), LATERAL (SELECT unnest(t) AS prediction, unnest(range(len(t)))::INTEGER AS pos) AS u) r JOIN documents d ON d.doc_id = r.idx")
def predictions_array_positions(spark, d):
    arrays = view(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])).alias("value"))
    rows = arrays.select(F.col("conv_id").alias("idx"), F.posexplode(F.from_json("value", "array<string>")).alias("pos", "prediction"))
    return rows.join(view(spark, d, "documents").select(F.col("doc_id").alias("idx"), "lang"), "idx").select("idx", "pos", "prediction", "lang")


@query(f"SELECT avg(CASE WHEN {STRIP.format('prediction')} = {STRIP.format('reference')} THEN 1.0 ELSE 0.0 END)::DOUBLE AS score, NULL::BIGINT AS passed FROM predictions", "predictions")
def exact_match(spark, d):
    return metrics.exact_match(view(spark, d, "predictions"))


_FOLD = "regexp_replace({0}, '[^\\x00-\\x7F]', '?', 'g')"


@query(f"SELECT avg(levenshtein({_FOLD.format('prediction')}, {_FOLD.format('reference')}))::DOUBLE AS score, NULL::BIGINT AS passed FROM predictions", "predictions")
def mean_edit_distance(spark, d):
    """ASCII for once, as DuckDB counts bytes."""
    fold = {c: F.regexp_replace(c, "[^\\x00-\\x7F]", "?") for c in ("prediction", "reference")}
    return metrics.edit_distance(_dealt(view(spark, d, "predictions").withColumns(fold)))


_GRAMS = f"""t AS (SELECT idx, split, side, list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '') AS w FROM (SELECT idx, split, 'p' AS side, prediction AS x FROM predictions UNION ALL SELECT idx, split, 'r', reference FROM predictions)),
g AS (SELECT idx, split, side, n, array_to_string(w[i:i+n-1], chr(1)) AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM t, (VALUES (1), (2), (3), (4)) AS o(n))),
c AS (SELECT idx, split, n, gram, count(*) FILTER (side = 'p') AS np, count(*) FILTER (side = 'r') AS nr FROM g GROUP BY ALL)"""


@query(f"{_GRAMS} SELECT split, n::INTEGER AS n, sum(least(np, nr))::BIGINT AS correct, sum(np)::BIGINT AS total FROM c GROUP BY split, n", "predictions")
def bleu_ngram_stats(spark, d):
    return metrics.bleu_ngram_stats(_dealt(view(spark, d, "predictions")), by=["split"])


@query(f"""{_GRAMS}, s AS (SELECT split, n, sum(least(np, nr))::DOUBLE AS correct, sum(np)::DOUBLE AS total FROM c GROUP BY split, n),
l AS (SELECT split, sum(len(w)) FILTER (side = 'p')::DOUBLE AS sys, sum(len(w)) FILTER (side = 'r')::DOUBLE AS ref FROM t GROUP BY split)
SELECT l.split, round(100 * CASE WHEN sys < ref THEN exp(1 - ref / sys) ELSE 1 END * exp(avg(ln(correct / total))), 6) AS score FROM s JOIN l USING (split) GROUP BY l.split, sys, ref""", "predictions")
def corpus_bleu(spark, d):
    return metrics.corpus_bleu(_dealt(view(spark, d, "predictions")), metrics.whitespace_tokens, ["split"]).select("split", F.round("score", 6).alias("score"))


_N = "(length(prediction) - length(replace(prediction, '{0}', '')))"


@query(f"SELECT idx, length({STRIP.format('prediction')}) < 10 OR lower({STRIP.format('prediction')}) IN ('type', 'null', 'undefined') OR {_N.format(chr(34))} % 2 <> 0 OR {_N.format('{')} <> {_N.format('}')} OR {_N.format('(')} <> {_N.format(')')} AS invalid FROM java_tests", "java_tests")
def parse_prefilter(spark, d):
    return view(spark, d, "java_tests").select("idx", gates.trivially_invalid(F.col("prediction")).alias("invalid"))


@query(f"SELECT idx, {STRIP.format('prediction')} = '' OR {_N.format('{')} <> {_N.format('}')} OR prediction NOT LIKE '%@Test%' AS rejected FROM java_tests", "java_tests")
def compile_trivial_reject(spark, d):
    return view(spark, d, "java_tests").select("idx", gates.trivially_bad(F.col("prediction")).alias("rejected"))


_IMPORTS = "regexp_extract_all(prediction, '(?m)^\\s*import\\s+(static\\s+)?([\\w.]+?)(\\.\\*)?\\s*;', {0})"


@query(f"SELECT idx, coalesce(s, '') <> '' AS is_static, f AS fqcn, coalesce(w, '') <> '' AS is_wildcard FROM (SELECT idx, unnest({_IMPORTS.format(1)}) AS s, unnest({_IMPORTS.format(2)}) AS f, unnest({_IMPORTS.format(3)}) AS w FROM java_tests)", "java_tests")
def imports_collect(spark, d):
    return view(spark, d, "java_tests").select("idx", F.inline(java.collect_imports(F.col("prediction"))))


@query(f"SELECT idx, list_sort(list_distinct(list_filter({_IMPORTS.format(2)}, lambda f: NOT regexp_matches(f, '^(java|javax|org\\.junit|org\\.hamcrest)\\.')))) AS outside FROM java_tests", "java_tests")
def import_fence(spark, d):
    return view(spark, d, "java_tests").select("idx", java.disallowed_imports(F.col("prediction")).alias("outside"))


@query("SELECT idx, regexp_replace(prediction, '(?m)^\\s*public\\s+(class|interface|enum)\\s+', '\\1 ') AS src FROM java_tests", "java_tests")
def sanitize_public(spark, d):
    return view(spark, d, "java_tests").select("idx", java.sanitize_test(F.col("prediction")).alias("src"))


_ADD = """(CASE WHEN strpos(prediction, 'LocalDate') > 0 THEN 'import java.time.*;' || chr(10) || 'import java.util.*;' || chr(10) ELSE '' END
  || CASE WHEN regexp_matches(prediction, '\\bassert[A-Z]\\w*\\s*\\(') THEN 'import static org.junit.Assert.*;' || chr(10) ELSE '' END
  || CASE WHEN strpos(prediction, '@Test') > 0 AND strpos(prediction, 'import org.junit.Test') = 0 THEN 'import org.junit.Test;' || chr(10) ELSE '' END)"""


@query(f"""SELECT idx, CASE variant WHEN 0 THEN replace(prediction, 'import org.junit.Test;' || chr(10), 'import org.junit.Test;' || chr(10) || {_ADD})
  WHEN 3 THEN replace(prediction, 'class Gen', {_ADD} || 'class Gen') WHEN 4 THEN replace(prediction, 'class Gen', {_ADD} || 'class Gen') WHEN 10 THEN replace(prediction, 'public class', {_ADD} || 'public class')
  ELSE {_ADD} || prediction END AS src FROM java_tests""", "java_tests")
def std_imports(spark, d):
    return view(spark, d, "java_tests").select("idx", java.ensure_std_imports(F.col("prediction")).alias("src"))


@query("SELECT idx, CASE WHEN regexp_matches(prediction, '\\bclass\\b') THEN prediction ELSE 'class GenTest {' || chr(10) || prediction || chr(10) || '}' END AS src FROM java_tests", "java_tests")
def outer_class(spark, d):
    return view(spark, d, "java_tests").select("idx", java.ensure_outer_class(F.col("prediction")).alias("src"))


@query("""SELECT idx, CASE WHEN split_part(replace(prediction, 'class GeneratedTest', 'GeneratedTest'), '{', 1) LIKE '%class%' THEN replace(prediction, 'class GeneratedTest', 'GeneratedTest')
  WHEN variant IN (2, 6, 7, 11) THEN 'public class GeneratedTest {' || substr(prediction, strpos(prediction, '{') + 1)
  ELSE 'public class ' || coalesce(nullif(regexp_extract(replace(prediction, 'class GeneratedTest', 'GeneratedTest'), '[A-Z]\\w+'), ''), 'FocalClass') || ' {' || chr(10) || replace(prediction, 'class GeneratedTest', 'GeneratedTest') || chr(10) || '}' END AS src FROM java_tests""", "java_tests")
def class_keyword(spark, d):
    src = F.replace("prediction", F.lit("class GeneratedTest"), F.lit("GeneratedTest"))
    return view(spark, d, "java_tests").select("idx", java.ensure_class_keyword(src).alias("src"))


_MISSING = "list_sort(list_filter(list_distinct(regexp_extract_all(prediction, '\\b([A-Z][A-Za-z0-9_]*)\\b', 1)), lambda c: c NOT IN ({0}) AND NOT list_contains(regexp_extract_all(prediction, '\\bclass\\s+([A-Z][A-Za-z0-9_]*)\\b', 1), c)))"
_KNOWN = ", ".join(f"'{c}'" for c in java.KNOWN_CLASSES)
_KNOWN_MORE = ", ".join(f"'{c}'" for c in (*java.KNOWN_CLASSES, *java.LANG_CLASSES))


@query(f"SELECT idx, {_MISSING.format(_KNOWN)} AS missing FROM java_tests", "java_tests")
def missing_classes(spark, d):
    return view(spark, d, "java_tests").select("idx", java.missing_classes(F.col("prediction")).alias("missing"))


_CALLS = "SELECT DISTINCT idx, unnest(regexp_extract_all(prediction, '([A-Z][A-Za-z0-9_]*)\\s*\\.\\s*([a-zA-Z_]\\w*)\\s*\\(', 1)) AS cls, unnest(regexp_extract_all(prediction, '([A-Z][A-Za-z0-9_]*)\\s*\\.\\s*([a-zA-Z_]\\w*)\\s*\\(', 2)) AS method FROM java_tests"


@query(f"SELECT idx, cls, string_agg(method, ',' ORDER BY method) AS methods FROM ({_CALLS}) GROUP BY idx, cls", "java_tests")
def methods_per_class(spark, d):
    rows = view(spark, d, "java_tests").select("idx", F.explode(java.methods_per_class(F.col("prediction"))).alias("cls", "m"))
    return rows.select("idx", "cls", F.array_join("m", ",").alias("methods"))


@query(f"""SELECT m.idx, m.cls || '.java' AS path, 'class ' || m.cls || ' {{' || chr(10) || '    public ' || m.cls || '(Object... a) {{}}' || chr(10) || '    public static Object ANY = null;' || chr(10)
  || coalesce(string_agg('    public static <T> T ' || method || '(Object... a) {{ return null; }}' || chr(10), '' ORDER BY method), '    public static <T> T any(Object... a) {{ return null; }}' || chr(10)) || '}}' AS stub_src
FROM (SELECT idx, unnest({_MISSING.format(_KNOWN_MORE)}) AS cls FROM java_tests) m LEFT JOIN ({_CALLS}) c USING (idx, cls) GROUP BY m.idx, m.cls
UNION ALL SELECT idx, 'org/mockito/Mockito.java', 'package org.mockito;' || chr(10) || 'public class Mockito {{' || chr(10) || '    public static Object ANY = null;' || chr(10) || '    public static <T> T any() {{ return null; }}' || chr(10) || '    public static <T> T when(Object o) {{ return null; }}' || chr(10) || '    public static <T> T verify(Object o) {{ return null; }}' || chr(10) || '    public static <T> T mock(Class<T> c) {{ return null; }}' || chr(10) || '}}' FROM java_tests WHERE variant = 3""", "java_tests")
def stub_table(spark, d):
    return view(spark, d, "java_tests").select("idx", F.inline(java.stubs(F.col("prediction"))))


_WRAPPED = "'class T' || idx || ' {{' || chr(10) || {0} || chr(10) || '}}'"


@query(f"""SELECT idx, CASE WHEN strpos(prediction, 'class GeneratedTest') > 0 THEN replace(prediction, 'class GeneratedTest', 'class T' || idx)
  ELSE {_WRAPPED.format("prediction")} END AS named, CASE WHEN starts_with(prediction, 'package a.b;') THEN 'a/b/' ELSE '' END || 'T' || idx || '.java' AS rel_path FROM java_tests""", "java_tests")
def uniquify_test(spark, d):
    out = view(spark, d, "java_tests").select("idx", java.uniquify_test(F.col("idx"), F.col("prediction"), "T").alias("x"), "prediction")
    added = F.array_join(F.filter(tx.lines(F.col("x.src")), lambda s: s != "import org.junit.Test;"), "\n")
    return out.select("idx", F.when(F.col("prediction").contains("import org.junit.Test;"), F.col("x.src")).otherwise(added).alias("named"), "x.rel_path")


_STDERR = ("", "GenTest.java:1: error: package a.b does not exist", "GenTest.java:2: error: cannot find symbol\nGenTest.java:3: error: class file for X not found", "GenTest.java:2: error: ';' expected\n1 error", "GenTest.java:9: error: cannot find symbol\n  Foo x;\n  ^\n1 error", "error: reached end of file while parsing", "Note: fine")
_VALUES = ", ".join(f"({i}, '" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "')" for i, s in enumerate(_STDERR))


@query(f"""SELECT k, len(list_filter(ls, lambda x: regexp_matches(x, '{"|".join(gates.FATAL).replace("'", "''")}'))) > 0 AS fatal, err <> '' AND len(list_filter(ls, lambda x: NOT regexp_matches(x, '{"|".join(gates.SOFT)}'))) = 0 AS soft,
 CASE WHEN k = 6 THEN 'HARD_PASS' WHEN len(list_filter(ls, lambda x: regexp_matches(x, '{"|".join(gates.FATAL).replace("'", "''")}'))) = 0 AND err <> '' AND len(list_filter(ls, lambda x: NOT regexp_matches(x, '{"|".join(gates.SOFT)}'))) = 0 THEN 'SOFT_PASS' ELSE 'HARD_FAIL' END AS status,
 CASE WHEN k = 6 THEN '' WHEN err = '' THEN 'unknown error' ELSE ls[1] END AS msg FROM (SELECT k, err, string_split(err, chr(10)) AS ls FROM (VALUES {_VALUES}) AS v(k, err))""")
def stderr_classify(spark, d):
    df = spark.createDataFrame(list(enumerate(_STDERR)), "k int, err string")
    code, err = F.when(F.col("k") == 6, 0).otherwise(1), F.col("err")
    return df.select("k", gates.is_fatal(err).alias("fatal"), gates.only_soft(err).alias("soft"), gates.compile_status(code, err).alias("status"), gates.compile_message(code, err).alias("msg"))


_FOCAL = (("class A { A() { } int getX() { return 1; } public static <T> T pick(T t) { return t; } }", "pick"), ("class B { B() { } }", "unknownMethod"), ("class C { public int getY() { return 2; } }", "getY"), ("int run(int a) { return a; }", "run"), ("interface D { void f(); }", "unknownMethod"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, (_, n) in enumerate(_FOCAL)) + ") AS v(k, name)")
def focal_method_name(spark, d):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(_FOCAL)], "k int, src string")
    return df.select("k", java.focal_method_name(F.col("src")).alias("name"))


_TYPES = (("void", ""), ("int", "return 0;"), ("double", "return 0.0;"), ("boolean", "return false;"), ("char", "return '\\0';"), ("int[]", "return null;"), ("List<String>", "return new java.util.ArrayList<>();"), ("Map<A,B>", "return new java.util.HashMap<>();"), ("Optional<A>", "return java.util.Optional.empty();"), ("Foo", "return null;"))


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}', '{}')".format(t, r.replace("'", "''"), f"public {t} f(int a) throws E " + (f"{{ {r} }}" if r else "{}").replace("'", "''")) for t, r in _TYPES) + ") AS v(ret, stmt, method)")
def trivial_bodies(spark, d):
    df = spark.createDataFrame([(t,) for t, _ in _TYPES], "ret string")
    return df.select("ret", java.default_return(F.col("ret")).alias("stmt"), java.implement_signature(F.lit("public  "), F.col("ret"), F.lit("f"), F.lit("int a"), F.lit("E ")).alias("method"))


_PCT = "100.0::DOUBLE * covered / (covered + missed)"


@query(f"SELECT test_idx, CASE WHEN count(*) FILTER (method_name = 'apply') > 0 THEN coalesce(max({_PCT}) FILTER (method_name = 'apply' AND covered + missed > 0), 0) ELSE coalesce(arg_min({_PCT}, pos) FILTER (method_name NOT IN ('<init>', 'getName') AND covered + missed > 0), 0) END AS coverage FROM method_counters GROUP BY test_idx", "method_counters")
def focal_coverage_best(spark, d):
    counters = view(spark, d, "method_counters")
    focal = counters.select("test_idx").distinct().select("test_idx", F.lit("apply").alias("focal_name"), F.lit("C").alias("class_name"))
    return metrics.focal_coverage(counters, focal)


@query(f"SELECT test_idx, coalesce(arg_min({_PCT}, pos) FILTER (method_name = 'apply' AND covered + missed > 0), 0) AS coverage FROM method_counters GROUP BY test_idx", "method_counters")
def focal_coverage_fallback(spark, d):
    """Of methods in one place the first in the table counts, as for SQL."""
    counters = in_order(spark, d, "method_counters")
    focal = counters.select("test_idx").distinct().select("test_idx", F.lit("absent").alias("focal_name"), F.lit("C").alias("class_name"))
    return metrics.focal_coverage(counters, focal, ("pos", "place"))


@query("SELECT method_name, sum(covered)::BIGINT AS covered, sum(missed)::BIGINT AS missed, round(100.0::DOUBLE * sum(covered) / (sum(covered) + sum(missed)), 6) AS pct FROM method_counters GROUP BY method_name", "method_counters")
def focal_coverage_aggregate(spark, d):
    return metrics.aggregate_coverage(view(spark, d, "method_counters"), ["method_name"])


@query("SELECT p.idx, p.prediction, p.reference AS src FROM predictions p", "predictions")
def gather_focal(spark, d):
    p = view(spark, d, "predictions")
    return metrics.gather(p.select(F.col("idx").alias("original_idx"), "prediction"), p.select("idx", F.col("reference").alias("src"))).select(F.col("original_idx").alias("idx"), "prediction", "src")


@query("SELECT count(*) AS n FROM predictions p JOIN predictions q ON q.idx = p.idx", "predictions")
def positional_zip(spark, d):
    p = view(spark, d, "predictions")
    return metrics.align(p.select("idx", "prediction"), p.select("idx", "reference")).agg(F.count("*").alias("n"))


@query(f"""s AS (SELECT idx, prediction, reference, length(prediction) % 3 <> 0 AS a, length(prediction) % 2 = 0 AS b, {STRIP.format('prediction')} = {STRIP.format('reference')} AS e FROM predictions)
SELECT 'gate_a' AS metric, avg(a::INT)::DOUBLE AS score, count(*) FILTER (a) AS passed, count(*) AS n_in, 100.0::DOUBLE * count(*) FILTER (a) / count(*) AS pct_total, NULL::VARCHAR AS error FROM s
UNION ALL SELECT 'gate_b', avg(b::INT)::DOUBLE, count(*) FILTER (b), count(*), 100.0::DOUBLE * count(*) FILTER (b) / (SELECT count(*) FROM s), NULL FROM s WHERE a
UNION ALL SELECT 'exact_match', avg(e::INT)::DOUBLE, NULL, count(*), NULL, NULL FROM s WHERE a AND b""", "predictions")
def cascade_summary(spark, d):
    ev = view(spark, d, "predictions").withColumns({"a": F.length("prediction") % 3 != 0, "b": F.length("prediction") % 2 == 0})
    rate = lambda c: lambda df: df.agg(F.avg(F.col(c).cast("double")).alias("score"), F.count_if(c).alias("passed"))
    gates_ = {f"gate_{c}": metrics.Metric(rate(c), lambda c=c: F.col(c), lambda c=c: F.col(c)) for c in ("a", "b")}
    return metrics.run_metrics(ev, ["gate_a", "gate_b", "exact_match"], registry=metrics.REGISTRY | gates_)


@query("SELECT idx, '```java' || chr(10) || 'class GeneratedTest { @Test void t' || length(p) || '() { } }' || chr(10) || '```' || chr(10) AS output, 'class GeneratedTest { @Test void t' || length(p) || '() { } }' AS prediction FROM (SELECT idx, rtrim(prompt, chr(10)) AS p FROM (SELECT idx, " + _CHATML + " AS prompt FROM chat_pairs))", "chat_pairs")
def generate_stub(spark, d):
    return workers.generate(_rendered(spark, d, "chatml"), workers.echo_model)


_INVALID = f"(length({STRIP.format('prediction')}) < 10 OR lower({STRIP.format('prediction')}) IN ('type', 'null', 'undefined') OR {_N.format(chr(34))} % 2 <> 0 OR {_N.format('{')} <> {_N.format('}')} OR {_N.format('(')} <> {_N.format(')')})"
#: What these tests look like if the parser takes them, and if the compiler does: an assertion class needs its import, a fence is no Java.
PARSES = f"(NOT {_INVALID} AND NOT starts_with(prediction, '```'))"
COMPILES = f"({PARSES} AND prediction LIKE '%@Test%' AND NOT regexp_matches(prediction, 'import org\\.mockito') AND (prediction NOT LIKE '%Assert.%' OR prediction LIKE '%import org.junit.Assert%'))"


@query(f"SELECT idx, {PARSES} AS parse_ok FROM java_tests", "java_tests")
def java_parse(spark, d):
    return workers.parse_java(_dealt(view(spark, d, "java_tests"))).select("idx", "parse_ok")


@query(f"SELECT idx, CASE WHEN {COMPILES} THEN 'HARD_PASS' ELSE 'HARD_FAIL' END AS status FROM java_tests", "java_tests")
def java_compile(spark, d):
    return workers.compile_java(_dealt(view(spark, d, "java_tests"))).select("idx", "status")


@query(f"SELECT CASE WHEN {COMPILES} THEN 'HARD_PASS' ELSE 'HARD_FAIL' END AS status, count(*) AS n FROM java_tests GROUP BY 1", "java_tests")
def compile_status_counts(spark, d):
    return metrics.status_counts(workers.compile_java(_dealt(view(spark, d, "java_tests"))))


@query()
def codebleu_parts(spark, d):
    tests = view(spark, d, "java_tests")
    pairs = tests.select("idx", "prediction", F.replace("prediction", F.lit("GeneratedTest"), F.lit("Other")).alias("reference"))
    return metrics.codebleu(_dealt(pairs))


@query()
def evaluation_summary(spark, d):
    from corpusmill.plans import build

    tests = view(spark, d, "java_tests").select("idx", "prediction")
    prompts = tests.select("idx", tx.chat_prompt(F.lit("int f() { return 1; }"), F.col("prediction"), "S", "I ").alias("prompt"))
    return build.evaluate(prompts, tests, "qwen", ["parse_rate", "compile_rate", "bleu", "edit_distance", "exact_match"], partitions=spark.sparkContext.defaultParallelism)
