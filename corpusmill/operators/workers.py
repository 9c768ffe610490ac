"""Operators that need a process of their own: Java parsing and compiling, coverage runs, text generation.

One JVM serves a Python worker and is told what to do over its standard input. Sources are only parsed and compiled, with a
time limit for each. Whatever can be decided by column expressions is decided before, so that only candidates reach it.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import gates, java
from corpusmill.functions.text import extract_java_code
from corpusmill.sources.readers import exists
from corpusmill.sources.scratch import materialise

TIMEOUT_MS = 20_000
#: The compiler's packages with the pool of tasks, which keeps symbols from one source to the next, and the form of its messages.
EXPORTS = [x for p in ("api", "util") for x in ("--add-exports", f"jdk.compiler/com.sun.tools.javac.{p}=ALL-UNNAMED")]

#: Sources that stand in for JUnit and Hamcrest where no class path is given: what tests name, without behaviour.
JUNIT_STUBS = {
    "org/junit/Test.java": "package org.junit; import java.lang.annotation.*; @Retention(RetentionPolicy.RUNTIME) public @interface Test { Class<? extends Throwable> expected() default None.class; long timeout() default 0L; class None extends Throwable {} }",
    **{f"org/junit/{n}.java": f"package org.junit; public @interface {n} {{}}" for n in ("Before", "After", "BeforeClass", "AfterClass", "Rule")},
    "org/junit/Ignore.java": 'package org.junit; public @interface Ignore { String value() default ""; }',
    "org/junit/Assert.java": "package org.junit; public class Assert { "
    + " ".join(f"public static void {n}(Object... a) {{}}" for n in ("assertEquals", "assertNotEquals", "assertArrayEquals", "assertSame", "assertNotSame", "assertNull", "assertNotNull", "assertThat", "assertTrue", "assertFalse", "fail"))
    + " public interface ThrowingRunnable { void run() throws Throwable; } public static <T extends Throwable> T assertThrows(Class<T> c, ThrowingRunnable r) { return null; } }",
    "org/hamcrest/CoreMatchers.java": "package org.hamcrest; public class CoreMatchers { " + " ".join(f"public static <T> T {n}(Object... a) {{ return null; }}" for n in ("is", "equalTo", "not", "nullValue", "notNullValue", "containsString", "instanceOf")) + " }",
}


def _helper_classes(java: str) -> str:
    """The folder of the helper's classes, with those of JUNIT_STUBS in `stubs`, compiled once for a user and machine; renamed into place whole, whoever is first."""
    source = Path(__file__).with_name("JavaTool.java")
    version = hashlib.sha256(source.read_bytes() + java.encode() + repr(sorted(JUNIT_STUBS.items())).encode()).hexdigest()[:16]
    home = Path(tempfile.gettempdir()) / f"corpusmill-java-{os.getuid()}-{version}"
    if home.is_dir() and home.stat().st_uid == os.getuid():
        return str(home)
    own = tempfile.mkdtemp(prefix="corpusmill-java-")
    javac = [str(Path(java).with_name("javac")) if os.path.dirname(java) else "javac", "-proc:none", "-d"]
    subprocess.run([*javac, own, *EXPORTS, str(source)], check=True, capture_output=True)
    with tempfile.TemporaryDirectory() as top:
        for path, text in JUNIT_STUBS.items():
            at = Path(top, path)
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text)
        subprocess.run([*javac, f"{own}/stubs", *(f"{top}/{p}" for p in JUNIT_STUBS)], check=True, capture_output=True)
    try:
        os.rename(own, home)
    except OSError:
        if not home.is_dir() or home.stat().st_uid != os.getuid():
            return own
        shutil.rmtree(own)  # another task was first
    return str(home)


class JavaTool:
    """A running helper JVM."""

    def __init__(self, java_bin: str | None = None):
        found = java_bin or (os.path.join(os.environ["JAVA_HOME"], "bin", "java") if os.environ.get("JAVA_HOME") else shutil.which("java"))
        self.known: dict[tuple[str, ...], list[str]] = {}
        home = _helper_classes(found)
        options = ["-Xmx512m", "-XX:+UseSerialGC", "-XX:TieredStopAtLevel=1", *EXPORTS, f"-Dcorpusmill.stubs={home}/stubs", "-cp", home, "JavaTool"]
        self.process = subprocess.Popen([found, *options], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)

    def ask(self, mode: str, *args: str, timeout_ms: int = TIMEOUT_MS) -> list[str]:
        key = (mode, *args)
        if key in self.known:  # generated tests repeat
            return self.known[key]
        parts = [x.encode("utf-8", "replace") for x in (mode, str(timeout_ms), *args)]
        self.process.stdin.write(struct.pack(">i", len(parts)) + b"".join(struct.pack(">i", len(p)) + p for p in parts))
        self.process.stdin.flush()
        answer = [self._read(self._int()).decode("utf-8", "replace") for _ in range(self._int())]
        if len(self.known) < 1000 and sum(map(len, args)) < 20_000:
            self.known[key] = answer
        return answer

    def _read(self, n: int) -> bytes:
        out = self.process.stdout.read(n)
        if len(out) < n:
            raise RuntimeError("the Java helper ended")
        return out

    def _int(self) -> int:
        return struct.unpack(">i", self._read(4))[0]

    def close(self) -> None:
        self.process.stdin.close()
        self.process.wait(10)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


_TOOLS: dict[int, JavaTool] = {}


def _tool() -> JavaTool:
    """The JVM of this Python worker, which serves task after task and ends with the worker, as its input does."""
    mine = os.getpid()
    if mine not in _TOOLS or _TOOLS[mine].process.poll() is not None:
        _TOOLS.clear()
        _TOOLS[mine] = JavaTool()
    return _TOOLS[mine]


def _asked(rows: DataFrame, names: list[str], fields: dict[str, str], work: Callable[[Callable[..., list[str]], dict], tuple]) -> DataFrame:
    """(key, fields): the helper's answers for rows (key, names). A JVM starts with the first question of a Python worker."""
    types = _arrow_types(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ask(mode: str, *args: str) -> list[str]:
            try:
                return _tool().ask(mode, *args)
            except BaseException:  # an answer may be left in the pipe
                tool = _TOOLS.pop(os.getpid(), None)
                if tool:
                    tool.process.kill()
                raise

        for batch in batches:
            values = zip(*(batch.column(1 + k).to_pylist() for k in range(len(names))))
            answers = [work(ask, dict(zip(names, v))) for v in values]
            columns = [*zip(*answers)] if answers else [()] * len(fields)
            yield pa.record_batch([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=["key", *fields])

    return rows.select("key", *names).mapInArrow(run, ", ".join(["key string", *(f"{n} {t}" for n, t in fields.items())]))


def helper_version() -> str:
    """What answers depend on beside the questions: the helper's source."""
    return hashlib.sha256(Path(__file__).with_name("JavaTool.java").read_bytes()).hexdigest()[:16]


def _answered(df: DataFrame, inputs: dict[str, Column], fields: dict[str, str], work: Callable[[Callable[..., list[str]], dict], tuple], task: str, store: str | None = None) -> DataFrame:
    """df with the columns `fields`, the helper's answers for each row. inputs: what work(ask, row of inputs) sees.

    Answers are addressed by content: each distinct question (a digest of its inputs, of the task and of the helper) is put once, and its answer joined to all rows that ask it. With
    store, a folder, answers are kept there and only new questions are put. Rows whose inputs are all null ask nothing and get nulls, without a
    join by a common key.
    """
    spark, own = df.sparkSession, [*inputs]
    names = [f"in_{n}_" for n in own]
    some = F.coalesce(*(F.when(F.col(n).isNotNull(), True) for n in names), F.lit(False))
    content = F.sha2(F.concat_ws("\u0001", F.lit(f"{task} {helper_version()}"), F.to_json(F.struct(*names))), 256)
    nothing = F.concat(F.lit("none-"), (F.monotonically_increasing_id() % 4096).cast("string"))
    # written once: questions and rows come from the same inputs, whose expressions are long
    keyed = materialise(df.select("*", *(c.alias(n) for n, c in zip(names, inputs.values()))).withColumn("key_", F.when(some, content).otherwise(nothing)), "java-inputs")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    questions = keyed.where(some).groupBy(F.col("key_").alias("key")).agg(*(F.first(n).alias(n) for n in names)).repartition(tasks)  # short, but each costs milliseconds; by key it would be merged with the grouping, and coalesced
    put = lambda ask, x: work(ask, {n: x[f"in_{n}_"] for n in own})
    if store is None:
        answers = _asked(questions, names, fields, put)
    else:
        schema = ", ".join(["key string", *(f"{n} {t}" for n, t in fields.items())])
        path = f"{store.rstrip('/')}/{task.partition(' ')[0]}"
        known = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
        _asked(questions.join(known.select("key"), "key", "left_anti"), names, fields, put).write.mode("append").parquet(path)
        answers = spark.read.schema(schema).parquet(path).dropDuplicates(["key"])  # two runs at once may have put the same question
    return keyed.join(answers.withColumnRenamed("key", "key_"), "key_", "left").select(*df.columns, *fields)


def _arrow_types(fields: dict[str, str]) -> list[pa.DataType]:
    return [{"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[t] for t in fields.values()]


def parse_java(ev: DataFrame, code_col: str = "prediction", store: str | None = None) -> DataFrame:
    """ev with parse_ok: whether the code, in a class of its own if it names none, is Java by syntax. Only what passes the cheap tests reaches the parser, each text once."""
    code = F.when(~gates.trivially_invalid(F.col(code_col)), gates.to_parse(F.col(code_col)))
    done = _answered(ev, {"code": code}, {"parse_ok": "boolean"}, lambda ask, x: (ask("parse", x["code"])[0] == "1",), "parse", store)
    return done.withColumn("parse_ok", F.coalesce("parse_ok", F.lit(False)))


def with_status(ev: DataFrame, code_col: str = "prediction", classpath: str = "", messages_only: bool = False, store: str | None = None) -> DataFrame:
    """ev with status, msg and fixed_src: cheap rejects, repair, import fence, stubs and then the compiler, once for each distinct repaired source."""
    src = F.coalesce(F.col(code_col), F.lit(""))
    bad = gates.trivially_bad(src)
    fixed = F.when(~bad, gates.repaired(src))
    outside = F.when(fixed.isNotNull(), java.disallowed_imports(fixed))
    def work(ask, x: dict) -> tuple:
        own = [y for s in x["stubs"] if not s["path"].startswith(("org/junit/", "org/hamcrest/")) for y in (s["path"], s["stub_src"])]
        code, said = ask("compile", classpath, "GenTest.java", x["fixed"], *own)
        return int(code), said

    held = {n: f"{n}_{k}" for k, n in enumerate(("fixed", "outside"))}  # names that ev doesn't have
    while set(held.values()) & set(ev.columns):
        held = {n: h + "_" for n, h in held.items()}
    rows = ev.select("*", fixed.alias(held["fixed"]), outside.alias(held["outside"]))
    compiled = F.col(held["fixed"]).isNotNull() & (F.size(held["outside"]) == 0)
    questions = {"fixed": F.when(compiled, F.col(held["fixed"])), "stubs": F.when(compiled, java.stubs(F.col(held["fixed"])))}
    done = _answered(rows, questions, {"java_code_": "int", "java_said_": "string"}, work, f"compile {classpath}", store)
    code, said, fixed, outside = F.col("java_code_"), F.col("java_said_"), F.col(held["fixed"]), F.col(held["outside"])
    fenced = F.concat(F.lit("disallowed import(s): "), F.array_join(outside, ", "))
    return done.select(
        *ev.columns,
        F.when(code.isNull(), "HARD_FAIL").otherwise(gates.compile_status(code, said, messages_only)).alias("status"),
        F.when(code.isNotNull(), gates.compile_message(code, said)).when(fixed.isNull(), "trivial reject").otherwise(fenced).alias("msg"),
        F.coalesce(fixed, F.col(code_col), F.lit("")).alias("fixed_src"),
    )


def compile_java(ev: DataFrame, code_col: str = "prediction", idx: str = "idx", classpath: str = "", messages_only: bool = False, store: str | None = None) -> DataFrame:
    """idx, status, msg, fixed_src for each row."""
    return with_status(ev.select(F.col(idx).alias("idx"), F.col(code_col).alias("prediction")), classpath=classpath, messages_only=messages_only, store=store).drop("prediction")


def code_shapes(codes: DataFrame, store: str | None = None) -> DataFrame:
    """(key, kind, digest, n) of sources (key, code): how often each subtree (`tree`, by digest) and each flow of values (`flow`) is in it. Each source is parsed once."""
    told = _answered(codes, {"code": F.col("code")}, {"told_": "string"}, lambda ask, x: (ask("shapes", x["code"])[0],), "shapes", store)
    line = F.split(F.col("line"), "\t")
    lines = told.select("key", F.explode(F.split("told_", "\n")).alias("line")).where("line <> ''")
    return lines.select("key", line[0].alias("kind"), line[1].alias("digest"), line[2].cast("bigint").alias("n"))


def code_matches(ev: DataFrame, idx: str = "idx", store: str | None = None) -> DataFrame:
    """idx, tree_hit, tree_all, flow_hit, flow_all: subtrees and value flows of the reference that the prediction has, clipped by how often.

    Shapes are a table of distinct sources; pairs meet theirs in joins, and equal pairs are counted once.
    """
    codes = {c: gates.to_parse(F.coalesce(F.col(c), F.lit(""))) for c in ("prediction", "reference")}
    keys = ev.select(F.col(idx).alias("idx_"), *(F.sha2(c, 256).alias(n) for n, c in codes.items()))
    sources = ev.select(codes["prediction"].alias("code")).union(ev.select(codes["reference"].alias("code"))).select(F.sha2("code", 256).alias("key"), "code").dropDuplicates(["key"])
    shapes = materialise(code_shapes(sources, store), "shapes")
    pairs = keys.select("prediction", "reference").distinct()
    wanted = pairs.join(shapes.withColumnRenamed("key", "reference"), "reference")
    has = shapes.select(F.col("key").alias("prediction"), "kind", "digest", F.col("n").alias("m"))
    met = wanted.join(has, ["prediction", "kind", "digest"], "left")
    part = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, c)), F.lit(0))
    hit = F.least("n", F.coalesce("m", F.lit(0)))
    sums = met.groupBy("prediction", "reference").agg(*(part(kind, c).alias(f"{kind}_{name}") for kind in ("tree", "flow") for name, c in (("hit", hit), ("all", F.col("n")))))
    out = keys.join(sums, ["prediction", "reference"], "left")
    names = ("tree_hit", "tree_all", "flow_hit", "flow_all")
    return out.select(F.col("idx_").alias(idx), *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


# --- generation ------------------------------------------------------------------------------------------------------


def generate(df: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], prompt_col: str = "prompt", batch_size: int = 128, idx: str = "idx") -> DataFrame:
    """idx, output, prediction: a model's answers to prompts, cut at their last assistant header, and the code in them.

    make() is called once in each worker and returns batch -> answers; a GPU model and a stub plug in alike.
    """
    from corpusmill.functions.text import prompt_for_inference

    kind = df.schema[idx].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in frames:
            model = model or make()
            for i in range(0, len(pdf), batch_size):
                part = pdf.iloc[i : i + batch_size]
                yield pd.DataFrame({idx: part[idx], "output": model(part["p"].tolist())})

    out = df.select(idx, prompt_for_inference(F.col(prompt_col)).alias("p")).mapInPandas(run, f"{idx} {kind}, output string")
    return out.withColumn("prediction", extract_java_code(F.col("output")))


def echo_model() -> Callable[[list[str]], list[str]]:
    """A deterministic stand-in for a model: answers with a fenced test named after the prompt's length."""
    return lambda prompts: [f"```java\nclass GeneratedTest {{ @Test void t{len(p)}() {{ }} }}\n```\n" for p in prompts]


# --- coverage --------------------------------------------------------------------------------------------------------


def run_coverage(tests: DataFrame, junit_classpath: str, agent_jar: str, cli_jar: str, allow_execution: bool = False, timeout_s: int = 30) -> DataFrame:
    """idx, report: coverage XML of tests (idx, test_src, test_path, focal_src, focal_path), null where any step failed.

    This runs generated code. It is off unless allow_execution says otherwise, and each step has a time limit.
    """
    if not allow_execution:
        raise PermissionError("coverage runs generated code; pass allow_execution=True inside a sandbox")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"idx": pdf["idx"], "report": [_covered(r, junit_classpath, agent_jar, cli_jar, timeout_s) for r in pdf.itertuples()]})

    return tests.select(F.col("idx").cast("bigint").alias("idx"), "test_src", "test_path", "focal_src", "focal_path").mapInPandas(run, "idx bigint, report string")


def workspace_files(pairs: DataFrame) -> DataFrame:
    """(rel_path, src): the files of each row's workspace, `<idx>/src/` for the focal class and `<idx>/tests/` for the test, for `write_java_files`."""
    at = lambda folder, path: F.concat(F.col("idx").cast("string"), F.lit(f"/{folder}/"), F.col(path))
    files = F.array(*(F.struct(at(folder, f"{kind}_path").alias("rel_path"), F.col(f"{kind}_src").alias("src")) for folder, kind in (("src", "focal"), ("tests", "test"))))
    return pairs.select(F.inline(files))


def _covered(row, junit: str, agent: str, cli: str, limit: int) -> str | None:
    with tempfile.TemporaryDirectory() as top:
        root = Path(top)
        files = []
        for folder, path, text in (("src", row.focal_path, row.focal_src), ("tests", row.test_path, row.test_src)):
            at = (root / folder / path).resolve()
            if root.resolve() not in at.parents:
                return None
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text)
            files.append(at)
        call = lambda *a: subprocess.run([str(x) for x in a], cwd=root, capture_output=True, timeout=limit, check=True)
        try:
            call("javac", "-proc:none", "-d", root / "classes", files[0])
            call("javac", "-proc:none", "-cp", java.build_classpath(root / "classes", junit), "-d", root / "tcls", files[1])
            for name in test_classes(root / "tcls"):
                call("java", f"-javaagent:{agent}=destfile={root / 'run.exec'}", "-cp", java.build_classpath(root / "tcls", root / "classes", junit), "org.junit.runner.JUnitCore", name)
            call("java", "-jar", cli, "report", root / "run.exec", "--classfiles", root / "classes", "--xml", root / "report.xml")
            return (root / "report.xml").read_text()
        except (subprocess.SubprocessError, OSError):
            return None


def test_classes(folder: Path) -> list[str]:
    """Names of the compiled top classes below a folder, sorted."""
    return sorted(".".join(p.relative_to(folder).with_suffix("").parts) for p in folder.rglob("*.class") if "$" not in p.name)


@lru_cache(maxsize=1)
def java_available() -> bool:
    return bool(shutil.which("javac"))
