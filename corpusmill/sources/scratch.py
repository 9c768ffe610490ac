"""Folders for intermediate tables, which the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where spark.checkpoint.dir is unset and the master is local, that is in tests.
LOCAL_SCRATCH = "/tmp/corpusmill-scratch"


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names, deleted when the application's JVM ends. ValueError on a cluster without it."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_SCRATCH
    own = f"{root.rstrip('/')}/corpusmill-{context.applicationId}"
    at = context._jvm.org.apache.hadoop.fs.Path(own)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there and lost executors cost no recomputation."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
