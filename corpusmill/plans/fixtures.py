"""Views of the driver's tables in the shapes that the operators take. The SQL runs unchanged in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHAT_PAIRS = """SELECT CAST(u.conv_id*1000+u.turn AS BIGINT) AS idx, u.conv_id, u.turn, u.text AS src, a.text AS target,
  CASE WHEN u.conv_id % 10 < 8 THEN 'train' WHEN u.conv_id % 10 = 8 THEN 'eval' ELSE 'test' END AS split
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"""

PREDICTIONS = """SELECT idx, split, target AS reference,
  CASE (conv_id+turn) % 4 WHEN 0 THEN target WHEN 1 THEN concat('  ',target,chr(10))
    WHEN 2 THEN substring(target,1,greatest(length(target)-7,0)) ELSE src END AS prediction FROM chat_pairs"""

REGISTRY = """SELECT 'm_words' AS model, split, idx FROM chat_pairs WHERE length(src)-length(replace(src,' ','')) < 40
UNION ALL SELECT 'm_chars' AS model, split, idx FROM chat_pairs WHERE length(src) <= 240"""

JAVA_TESTS = """SELECT doc_id AS idx, doc_id % 12 AS variant, CASE doc_id % 12
  WHEN 0 THEN concat('import org.junit.Test;',chr(10),'public class GeneratedTest {',chr(10),'  @Test public void t',CAST(doc_id AS STRING),'() { Assert.assertEquals(1, Foo.bar(1)); }',chr(10),'}')
  WHEN 1 THEN concat('public class GeneratedTest { @Test public void t',CAST(doc_id AS STRING),'() { }')
  WHEN 2 THEN concat('class GeneratedTest { public void t',CAST(doc_id AS STRING),'() { } }')
  WHEN 3 THEN concat('import org.mockito.Mockito;',chr(10),'class GeneratedTest { @Test public void t() { Mockito.mock(Foo.class); } }')
  WHEN 4 THEN concat('```java',chr(10),'class GeneratedTest { @Test void t() { } }',chr(10),'```',chr(10),'tail ',CAST(doc_id AS STRING))
  WHEN 5 THEN concat('@Test public void t',CAST(doc_id AS STRING),'() { assertTrue(true); }')
  WHEN 6 THEN 'class GeneratedTest { @Test void t() { f((1); } }'
  WHEN 7 THEN 'class GeneratedTest { @Test void t() { String x = "a; } }'
  WHEN 8 THEN 'undefined' WHEN 9 THEN ''
  WHEN 10 THEN concat('package a.b;',chr(10),'import static org.hamcrest.CoreMatchers.*;',chr(10),'public class GeneratedTest { @Test void t() { } }')
  ELSE 'class GeneratedTest { @Test void t() { LocalDate d = null; assertEquals(d, Util.make()); Util.close(); } }' END AS prediction
FROM documents"""

METHOD_COUNTERS = """SELECT l_orderkey AS test_idx, l_linenumber AS pos,
  CASE l_returnflag WHEN 'A' THEN 'apply' WHEN 'N' THEN 'getName' ELSE '<init>' END AS method_name,
  CAST(l_quantity AS INT) AS covered, CAST(l_partkey % 7 AS INT) AS missed FROM lineitem"""

#: name -> (SQL, what it reads)
VIEWS = {"chat_pairs": (CHAT_PAIRS, "conversations"), "predictions": (PREDICTIONS, "chat_pairs"), "registry": (REGISTRY, "chat_pairs"), "java_tests": (JAVA_TESTS, "documents"), "method_counters": (METHOD_COUNTERS, "lineitem")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, source = VIEWS[name]
    sql = sql.replace("{", "{{").replace("}", "}}")  # spark.sql fills in {src}
    return spark.sql(sql.replace(f"FROM {source}", "FROM {src}").replace(f"JOIN {source}", "JOIN {src}"), src=view(spark, sf_dir, source))


def in_order(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of one table with `place`, which ascends in the order of the table's files and of their rows."""
    sql, source = VIEWS[name]
    base = spark.read.parquet(f"{sf_dir}/{source}.parquet").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    return spark.sql(sql.replace("SELECT ", "SELECT place, ", 1).replace(f"FROM {source}", "FROM {src}"), src=base)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL below the definitions of the views that it names."""
    wanted: list[str] = []
    for name in names:
        source = VIEWS[name][1]
        for n in (*([source] if source in VIEWS else []), name):
            wanted += [n] * (n not in wanted)
    more = ", " if sql[:2] in ("t ", "s ") else " "  # further definitions follow
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][0]})" for n in wanted) + more + sql
