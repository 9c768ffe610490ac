"""Readers: JSON arrays and lines, splits, predictions in every shape, coverage reports, the model registry."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusmill import schemas
from corpusmill.functions.text import is_blank, lstrip
from corpusmill.sources import json_arrays, publish, writers

SPLITS = ("train", "eval", "test")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None) -> DataFrame:
    """A table by the suffix of its path: .json (an array, or lines), .jsonl, .parquet. ValueError for another."""
    fmt = fmt or path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "jsonl":
        return reader.json(path)
    if fmt == "json":
        return reader.option("multiLine", is_array(spark, path)).json(path)
    raise ValueError(f"cannot read {path}: neither .json, .jsonl nor .parquet")


def is_array(spark: SparkSession, path: str) -> bool:
    """Whether the first line that isn't blank opens an array."""
    first = spark.read.text(path).where(~is_blank(F.col("value"))).select(F.substring(lstrip(F.col("value")), 1, 1).alias("value")).limit(1).collect()
    return bool(first) and first[0].value == "["


def read_splits(spark: SparkSession, paths: dict[str, str], schema: T.StructType | None = None) -> DataFrame:
    """One table of all splits, with a column split."""
    frames = [read_table(spark, p, schema).withColumn("split", F.lit(s)) for s, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_processed(spark: SparkSession, root: str) -> DataFrame:
    """Splits as write_splits leaves them: partitions, of which a filter on split reads only its own."""
    return spark.read.parquet(root)


read_tokenized = read_processed


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Only the column idx, each once."""
    return read_table(spark, path).select("idx").distinct()


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Values of a JSON array or of JSON lines, as strings, with their position in their file; blank lines don't count.

    Both are read in splits; see `json_arrays` for arrays. A line's position is its place in its split plus the lines of the splits before it, of which there is one count each.
    """
    if is_array(spark, path):
        return json_arrays.read_elements(spark, path).select(F.col("pos").cast("int").alias("pos"), _one("value", "string").alias("value"))
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")]
    rows = spark.read.text(path).select("value", *split).where(~is_blank(F.col("value"))).withColumn("place", F.monotonically_increasing_id())
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    firsts = firsts.select("file", "at", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(firsts, ["file", "at"]).select((F.col("place") + F.col("shift")).cast("int").alias("pos"), "value")


def explode_predictions(text: DataFrame, col: str = "value") -> DataFrame:
    """(original_idx, prediction) of whole JSON texts: an array of strings, an array of objects, an object of arrays, or one string.

    An object without original_idx has its position in the raw array; objects without a prediction are left out.
    """
    v = F.trim(F.col(col))
    kind = F.when(v.startswith("{"), "columns").when(v.startswith('"'), "one").when(v.rlike("\\A\\[\\s*\\{"), "objects").otherwise("strings")
    entry = "struct<prediction:string,original_idx:bigint>"
    typed = lambda c: c.cast(f"array<{entry}>")
    columns = F.from_json(v, "struct<prediction:array<string>,original_idx:array<bigint>>")
    numbered = lambda a: F.transform(a, lambda x, i: F.struct(x.alias("prediction"), i.cast("bigint").alias("original_idx")))
    from_columns = F.transform(columns["prediction"], lambda x, i: F.struct(x.alias("prediction"), F.coalesce(F.get(columns["original_idx"], i), i.cast("bigint")).alias("original_idx")))
    objects = F.transform(F.from_json(v, f"array<{entry}>"), lambda x, i: F.struct(x["prediction"].alias("prediction"), F.coalesce(x["original_idx"], i.cast("bigint")).alias("original_idx")))
    one = F.array(F.struct(F.get(F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>"), F.lit(0)).alias("prediction"), F.lit(0).cast("bigint").alias("original_idx")))
    rows = F.when(kind == "columns", typed(from_columns)).when(kind == "objects", typed(objects)).when(kind == "one", typed(one)).otherwise(typed(numbered(F.from_json(v, "array<string>"))))
    return text.select(F.inline(F.filter(rows, lambda x: x["prediction"].isNotNull()))).select("original_idx", "prediction")


def _one(value: str, kind: str):
    """A column of JSON texts, each as a value of that type."""
    return F.get(F.from_json(F.concat(F.lit("["), F.col(value), F.lit("]")), f"array<{kind}>"), F.lit(0))


def read_prediction_array(spark: SparkSession, path: str) -> DataFrame:
    """(original_idx, prediction) of a file as `explode_predictions` has them, read in splits."""
    first = spark.read.text(path).where(~is_blank(F.col("value"))).select(F.substring(lstrip(F.col("value")), 1, 1).alias("value")).limit(1).collect()
    opens = first[0].value if first else ""
    if opens == "[":
        rows = json_arrays.read_elements(spark, path)
        is_object = F.col("value").startswith("{")
        parsed = F.from_json(F.when(is_object, F.col("value")), "struct<prediction:string,original_idx:bigint>")
        pair = [F.when(is_object, F.coalesce(parsed["original_idx"], F.col("pos"))).otherwise(F.col("pos")), F.when(is_object, parsed["prediction"]).otherwise(_one("value", "string"))]
    elif opens == "{":
        rows = json_arrays.read_columns(spark, path, ("prediction", "original_idx"))
        pair = [F.coalesce(_one("original_idx", "bigint"), F.col("pos")), _one("prediction", "string")]
    else:
        return explode_predictions(spark.read.text(path, wholetext=True))  # one string
    return rows.select(pair[0].alias("original_idx"), pair[1].alias("prediction")).where("prediction is not null")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of a .json file of any shape, or of .jsonl objects, read in splits. ValueError if there are none."""
    if path.endswith(".jsonl"):
        rows = read_json_lines(spark, path)
        parsed = F.from_json("value", "struct<prediction:string,original_idx:bigint>")
        out = rows.select(F.coalesce(parsed["original_idx"], F.col("pos").cast("bigint")).alias("original_idx"), parsed["prediction"].alias("prediction")).where("prediction is not null")
    else:
        out = read_prediction_array(spark, path)
    if out.isEmpty():
        raise ValueError(f"{path} holds no predictions")
    return out


def read_tests(spark: SparkSession, path: str) -> DataFrame:
    return schemas.require(read_table(spark, path), schemas.PREDICTIONS, path).select("prediction", "original_idx")


#: Groups inside groups that a report may have; deeper ones are an error.
GROUPS = 8


class _Report:
    """Line counters of the methods of one report after another, by Expat."""

    def methods(self, text: str) -> list[tuple[int, str | None, int, int]]:
        """(pos, name, covered, missed) in document order, pos among all methods; none if the text isn't well formed."""
        self.found, self.kinds, self.method, self.deep = [], [], None, 0
        parser = expat.ParserCreate(encoding="utf-8")
        parser.StartElementHandler, parser.EndElementHandler = self._start, self._end
        try:
            parser.Parse(text.encode("utf-8", "surrogatepass"), True)
        except expat.ExpatError:
            return []
        if self.deep > GROUPS:
            raise ValueError(f"a report has groups inside {GROUPS} groups")
        return [(i, name, covered, missed) for i, (name, _, covered, missed) in enumerate(self.found) if covered is not None and missed is not None]

    def _start(self, kind: str, attributes: dict[str, str]) -> None:
        """An element counts if those around it are known ones in their order: report, groups, package, class, method."""
        kinds = self.kinds
        above = kinds[-1] if kinds else None
        if above is None:
            known = not kinds
            kind = "report"
        elif kind == "counter":
            known = above == "method"
            if known and not self.method[1] and attributes.get("type") == "LINE":
                self.method[1:] = True, _whole(attributes.get("covered")), _whole(attributes.get("missed"))
        elif kind == "method":
            known = above in ("report", "group", "package", "class")
            if known:
                self.method = [attributes.get("name"), False, None, None]
                self.found.append(self.method)
        else:
            known = above in _AROUND.get(kind, ())
            if known and kind == "group":
                self.deep = max(self.deep, 1 + kinds.count("group"))
        kinds.append(kind if known else "")

    def _end(self, kind: str) -> None:
        self.kinds.pop()


#: What each kind of element may stand in.
_AROUND = {"class": ("report", "group", "package"), "package": ("report", "group"), "group": ("report", "group")}


def _whole(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"\s*[+-]?[0-9]{1,18}\s*", text, re.ASCII) else None


def coverage_methods(reports: DataFrame, xml_col: str = "report") -> DataFrame:
    """The other columns of reports, and (pos, method_name, covered, missed) of each method in document order; line counters only.

    Reports are parsed as XML; one that isn't well formed has no methods.
    """
    keep = [c for c in reports.columns if c != xml_col]
    kind = "array<struct<pos:bigint,method_name:string,covered:bigint,missed:bigint>>"

    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        report = _Report()
        for texts in batches:
            yield pd.Series([None if t is None else report.methods(t) for t in texts])

    return reports.select(*keep, F.pandas_udf(parsed, kind)(F.col(xml_col)).alias("m_")).select(*keep, F.inline("m_"))


def read_coverage_xml(spark: SparkSession, path: str) -> DataFrame:
    """(report, pos, method_name, covered, missed): methods of the coverage reports in a folder; report is the file's path."""
    return coverage_methods(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("report"), "value"), "value")


#: Bytes of files that a task hands on at once, and how many files at most.
FILES_AT_ONCE = 1 << 23, 2000


def read_java_files(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, content) of the files that `write_java_files(folders=…)` wrote, without those that have no byte.

    The driver lists the folders of root, of which there are as many at any size; what is in one is listed and read by the task that it is dealt to.
    """
    uri, (most, many) = writers.store_uri(root), FILES_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        handed = lambda rows: pa.record_batch([pa.array([p for p, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.binary())], names=["rel_path", "content"])
        for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
            top, rows, held = f"{base.rstrip('/')}/{folder}", [], 0
            for info in store.get_file_info(fs.FileSelector(top, recursive=True)):
                if info.type != fs.FileType.File or not info.size:
                    continue
                with store.open_input_stream(info.path) as data:
                    rows.append((info.path[len(top) + 1 :], data.read()))
                held += info.size
                if held >= most or len(rows) >= many:
                    yield handed(rows)
                    rows, held = [], 0
            yield handed(rows)

    found = publish.names(spark, root)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    folders = spark.createDataFrame([(n,) for n in found], "folder string").repartition(min(tasks, max(1, len(found))))
    return folders.mapInArrow(run, "rel_path string, content binary")


def read_registry(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """model -> split -> path, of the small YAML file `models: {name: {processed_train: path, ...}}`, wherever Spark can read it.

    With PyYAML installed any YAML of that form is read; without it, mappings by indentation.
    """
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file
    try:
        import yaml
    except ImportError:
        models = _mappings(text).get("models") or {}
    else:
        models = (yaml.safe_load(text) or {}).get("models") or {}
    return {m: {k.removeprefix("processed_"): v for k, v in (paths or {}).items() if k.startswith("processed_")} for m, paths in models.items()}


def _mappings(text: str) -> dict:
    """Nested mappings of plain strings, by indentation."""
    root: dict = {}
    open_: list[tuple[int, dict]] = [(-1, root)]
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth, (key, _, value) = len(line) - len(line.lstrip()), line.strip().partition(":")
        while open_[-1][0] >= depth:
            open_.pop()
        value = value.strip().strip("'\"")
        open_[-1][1][key.strip("'\"")] = value or {}
        if not value:
            open_.append((depth, open_[-1][1][key.strip("'\"")]))
    return root


def read_registered_index(spark: SparkSession, registry: dict[str, dict[str, str]]) -> DataFrame:
    """(model, split, idx) of all registered models; a split that a model lacks has no rows."""
    frames = [read_table(spark, p).select(F.lit(m).alias("model"), F.lit(s).alias("split"), F.col("idx").cast("bigint").alias("idx")) for m, splits in registry.items() for s, p in splits.items()]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], "model string, split string, idx bigint")


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file_system(spark, path)
    return fs.exists(p)


def versions(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, size and time of all files at or below a path: what tells whether an input has changed without reading it."""
    p, fs = _file_system(spark, path)
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def safe_count(spark: SparkSession, path: str) -> int | None:
    """Rows, or None for a table that isn't there or can't be read."""
    try:
        return read_table(spark, path).count() if exists(spark, path) else None
    except Exception:  # noqa: BLE001  whatever is wrong with it
        return None
