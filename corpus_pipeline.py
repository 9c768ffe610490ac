"""From raw documents to packed training sequences: five stages, each of them one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. A document whose every word is a later copy of lines
elsewhere is gone after line dedup; n_chars follows the text.

Defined cases, stage by stage as its operator defines them: a null, empty or blank text has fewer than 50 words and goes with the quality rules; rows without doc_id stay and are ordered before
all others; rows that repeat go as far as the near dedup together, where one document of each group stays (all its equal rows); ties go to the least doc_id; a
very long text is one document up to the packing, which cuts it; an empty table gives empty tables; further columns are carried to the packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate as decontamination
from corpusmill.llm import line_dedup as lines
from corpusmill.llm import near_dedup as near
from corpusmill.llm import packing, quality_rules
from corpusmill.llm.common import WORD, fresh, materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    removed = fresh("removed_lines", docs)
    out = lines.dedup_lines(docs).where((F.col(removed) == 0) | F.col("text").rlike(WORD))
    new = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words at 0.8, the default of stages."""
    return near.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("best_fit_packing", pack)]

#: Tokenising and packing have no SQL; test_pipeline_against_its_stages holds all rows against brute force, on top of op3's and op6's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
