"""Writers: splits, tokens, predictions, corrected tests, failures, stubs, reports, and manifests that say what a cache holds."""

from __future__ import annotations

import json
import os
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(df: DataFrame, root: str, fmt: str = "parquet") -> None:
    """A folder for each split, so that a reader of one split opens no other."""
    df.write.mode("overwrite").partitionBy("split").format(fmt).save(root)


write_tokenized = write_splits


def write_predictions(df: DataFrame, root: str, label: str, run: str) -> str:
    """(idx, prediction) as JSON lines below label=…/run=…; returns the folder, named once."""
    path = f"{root.rstrip('/')}/label={label}/run={run}"
    df.select("idx", "prediction").write.mode("overwrite").json(path)
    return path


def predictions_array(df: DataFrame) -> DataFrame:
    """One row with the JSON array of all predictions by idx, for tools that read one file. It is one value: for small results only."""
    return df.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("idx", "prediction"))), lambda x: x["prediction"])).alias("value"))


def write_corrected_tests(results: DataFrame, path: str, files: int | None = None, java_dir: str | None = None) -> None:
    """idx, status, fixed_src, log as JSON lines in the order of idx: ranges of idx over files, sorted in each (one file with files=1).
    With java_dir also a file GenTest<idx>.java for each row."""
    rows = results.select("idx", "status", "fixed_src", F.col("msg").alias("log"))
    rows = rows.coalesce(1).sortWithinPartitions("idx") if files == 1 else rows.orderBy("idx")
    rows.write.mode("overwrite").json(path)
    if java_dir:
        write_java_files(results.select(F.concat(F.lit("GenTest"), F.col("idx").cast("string"), F.lit(".java")).alias("rel_path"), F.col("fixed_src").alias("src")), java_dir)


#: Folders of files by their path, at any size.
FOLDERS = 1024


def store_uri(root: str) -> str:
    """A path or URI as the URI by which Arrow opens its store."""
    return root if "://" in root else f"file://{os.path.abspath(root.removeprefix('file:'))}"


def write_java_files(df: DataFrame, root: str, path_col: str = "rel_path", src_col: str = "src", folders: int = 0) -> int:
    """A file root/<path> for each row, with its source as it is, written by the tasks; returns how many.

    root: a folder that all executors share, as a path or URI of a store that Arrow opens. A path that leads out of it is a ValueError.
    folders: over how many folders of root, 0000 and so on, files are dealt by the first part of their path. No folder then grows with all rows, and
    `readers.read_java_files` has each listed and read by a task. By default files are in root itself.
    """
    uri = store_uri(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for folder, path, src in zip(*(c.to_pylist() for c in batch.columns)):
                top = posixpath.join(base, folder)
                at = posixpath.normpath(posixpath.join(top, path))
                if not at.startswith(top.rstrip("/") + "/"):
                    raise ValueError(f"{path} leads out of {root}")
                store.create_dir(posixpath.dirname(at), recursive=True)
                with store.open_output_stream(at) as out:
                    out.write((src or "").encode())
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    folder = F.format_string("%04d", F.pmod(F.xxhash64(F.substring_index(path_col, "/", 1)), F.lit(folders))) if folders else F.lit("")
    rows = df.select(folder.alias("folder"), F.col(path_col).alias("path"), F.col(src_col).alias("src")).where("path is not null")
    return rows.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_failures(results: DataFrame, path: str) -> None:
    """What failed to compile, (idx, error), in place of what a run before left."""
    results.where("status = 'HARD_FAIL'").select("idx", F.col("msg").alias("error")).write.mode("overwrite").json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Coverage XML by idx."""
    reports.where("report is not null").write.mode("overwrite").parquet(path)


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    from corpusmill.sources.readers import exists

    if not exists(spark, path):
        return None
    rows = spark.read.text(path).collect()  # one line
    return json.loads(rows[0].value) if rows else None
