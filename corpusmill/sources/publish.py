"""Small files that are put in place once and never change: what decides which of several writers counts.

A file is written under a name of its own and then given its real name in one step that fails if that name is taken: a hard link on a
local or mounted file system, a rename elsewhere (HDFS and its like refuse to rename onto a file). Stores without such a
rename, as plain object stores, can't decide between writers; there only one may write at a time.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write(fs, path, text: str) -> None:
    out = fs.create(path, False)
    out.write(bytearray(text.encode()))
    out.close()


def publish_once(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a small file there unless one is; says whether it is this one. A reader sees the whole file or none."""
    at, fs = file_system(spark, path)
    if fs.exists(at):
        return False
    staged, _ = file_system(spark, f"{at.getParent().toString()}/.staged-{uuid.uuid4().hex}")
    _write(fs, staged, text)
    try:
        uri = urlparse(fs.makeQualified(at).toUri().toString())
        if uri.scheme != "file":
            return fs.rename(staged, at)
        try:
            os.link(unquote(urlparse(fs.makeQualified(staged).toUri().toString()).path), unquote(uri.path))
        except FileExistsError:
            return False
        return True
    finally:
        fs.delete(staged, False)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or None if there is none."""
    at, fs = file_system(spark, path)
    if not fs.exists(at):
        return None
    data = fs.open(at)
    try:
        return bytes(data.readAllBytes()).decode()
    finally:
        data.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there. Hidden ones are left out."""
    at, fs = file_system(spark, folder)
    if not fs.exists(at):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(at)) if not n.startswith((".", "_")))
