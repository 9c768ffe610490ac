"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.scratch import scratch_dir

#: ASCII white space that parts words, as a character class for Java and RE2.
SPACE_CLASS = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE_CLASS}]+"

def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have yet; names compare without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there and lost executors cost no recomputation."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



#: A key is heavy if it has one row in HEAVY or more, so there are at most HEAVY heavy keys, whatever the table.
HEAVY = 1000


def look_up(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """rows joined to table, which has one row for each value of key and says in column `weight` how many of the rows have it.

    Heavy keys, HEAVY at most by their weight, are broadcast, so their rows stay where they are; of the others none has more than a
    HEAVY-th of the rows, and they are shuffled.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    heavy = F.col(weight) * HEAVY >= max(total, HEAVY * HEAVY)
    light = rows
    out = None
    some = table.where(heavy)
    if not some.isEmpty():
        out = rows.join(F.broadcast(some), key)
        light = rows.join(F.broadcast(some.select(key)), key, "left_anti")
    rest = light.join(table.where(~heavy), key)
    return (rest if out is None else out.unionByName(rest)).drop(weight)
