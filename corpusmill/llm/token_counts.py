"""Token counts as delta-maintained rollups.

A ledger is a folder of batches. A batch holds signed totals by source, language and tokenizer version: inserts count +1, deletes -1,
a revised count -1 for the old and +1 for the new row. Totals are additive, so the rollup is the sum of the batches
and no document is ever counted again.

Commits. A batch is written whole to a folder that no other writer can have. Then its ID is claimed: one small file that names the folder and can be made
only once (`publish_once`). Who claims the ID counts, for ever; a commit that is repeated, raced by another writer, overtaken, or cut off half-way and repeated, counts
once, and what a returned commit said stays true. A snapshot is published in the same way, under the next number. It names the batches that it sums, from the one
listing that it was made of, so a batch that lands meanwhile is not in it and is read beside it. Batches are never changed or deleted.
The driver holds the names of batches, a few bytes for each commit.

Counting is a map over the documents; totals combine in the map stage before their shuffle, which moves a row for each
group and task whatever share of the rows a source has.

Defined cases: a null or empty text has 0 tokens and counts as a document; null source or language is a group of its own; rows that
repeat count each; an empty change set commits an empty batch; groups that come to nothing (no documents, no tokens) are left out of totals.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD, fresh, materialise, scratch_dir
from corpusmill.sources.publish import names, publish_once, read_text

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def bpe_counts(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str | None = None, revised_col: str | None = None) -> DataFrame:
    """The columns keep and n_bpe, the number of byte-level BPE tokens of the text; with revised_col also n_bpe_revised,
    that of the revised text, which is null where it equals the text."""
    texts = {"n_bpe": text_col, **({"n_bpe_revised": revised_col} if revised_col else {})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusmill.llm.tokens import encoder

        encode = encoder(vocabulary)
        for batch in batches:
            counts = [[len(encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]]
            if revised_col:
                counts.append([n if t is None else len(encode(t)) if t else 0 for n, t in zip(counts[0], batch.column(len(keep) + 1).to_pylist())])
            yield pa.record_batch([*batch.columns[: len(keep)], *(pa.array(c, pa.int64()) for c in counts)], names=[*batch.schema.names[: len(keep)], *texts])

    src = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(keep)), *(docs[c].alias(f"text{i}") for i, c in enumerate(texts.values())))
    out = src.mapInArrow(run, ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), *(f"{n} bigint" for n in texts)]))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), *texts)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, keep: tuple[str, ...] = (), revised: Column | None = None) -> DataFrame:
    """A row for each document and tokenizer version: id, source, lang, the columns keep, tokenizer, tokens; with revised,
    a text, also revised_tokens, what it counts by the same version."""
    n_words, n_new, text_new = (fresh(n, docs) for n in ("n_words", "n_words_revised", "revised_text"))
    words = docs.withColumn(n_words, word_count(F.col(text_col)))
    own = [id_col, "source", "lang", *keep, n_words]
    parts = {"byte_bpe_50k-1": ("n_bpe", "n_bpe_revised"), "words-1": (n_words, n_new)}
    if revised is not None:
        words = words.withColumn(n_new, word_count(revised)).withColumn(text_new, F.when(~revised.eqNullSafe(F.col(text_col)), revised))
        own.append(n_new)
    counted = bpe_counts(words, own, text_col, vocabulary, None if revised is None else text_new)
    more = lambda n: [] if revised is None else [F.col(n).alias("revised_tokens")]
    each = F.array(*(F.struct(F.lit(k).alias("tokenizer"), F.col(n).alias("tokens"), *more(new)) for k, (n, new) in parts.items()))
    return counted.select(F.col(id_col).alias("id"), "source", "lang", *keep, F.inline(each))


def signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.col("tokens") * sign).alias("n_tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    return signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    return signed(counts, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return signed(old, -1).unionByName(signed(new, 1))


class Ledger:
    """Signed batches below a folder that driver and executors share. Without root it is a scratch folder, gone with the session."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or scratch_dir(spark, "token-ledger")).rstrip("/")

    def _publish(self, folder: str, name: str, write) -> bool:
        """write(path) to a folder of its own, then claims the name for it; says whether it is now this folder's."""
        own = f"{self.root}/data/{name}--{uuid.uuid4().hex}"
        write(own)
        return publish_once(self.spark, f"{self.root}/{folder}/{name}", own)

    def _published(self, but: set[str] = frozenset()) -> dict[str, str]:
        """Batch ID -> the folder that counts, of all batches but some."""
        return {n: read_text(self.spark, f"{self.root}/batches/{n}") for n in names(self.spark, f"{self.root}/batches") if n not in but}

    def batches(self) -> list[str]:
        return names(self.spark, f"{self.root}/batches")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds the batch unless one of that ID is there or in a snapshot; says whether it is this one that counts."""
        if not batch_id.replace("-", "").replace("_", "").isalnum() or "--" in batch_id:
            raise ValueError(f"not a batch ID: {batch_id}")
        if batch_id in self.batches():
            return False
        totals = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return self._publish("batches", batch_id, totals.write.parquet)

    def _snapshot(self) -> tuple[int, str | None, set[str]]:
        """Number and folder of the last snapshot, and the batches in it."""
        there = names(self.spark, f"{self.root}/snapshots")
        if not there:
            return 0, None, set()
        folder = read_text(self.spark, f"{self.root}/snapshots/{there[-1]}")
        return int(there[-1]), folder, {r.value for r in self.spark.read.text(f"{folder}/covers").collect()}  # a name for each batch

    def _sum(self, snapshot: str | None, folders: list[str]) -> DataFrame:
        paths = folders + ([f"{snapshot}/totals"] if snapshot else [])
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        _, snapshot, covered = self._snapshot()
        return self._sum(snapshot, list(self._published(covered).values()))

    def compact(self) -> None:
        """Folds all batches into a snapshot that names them; the batches stay and are read no more."""
        number, last, covered = self._snapshot()
        published = self._published(covered)
        totals = self._sum(last, list(published.values()))
        listed = sorted(covered | set(published))

        def write(path: str) -> None:
            totals.write.parquet(f"{path}/totals")
            self.spark.createDataFrame([(n,) for n in listed], "value string").coalesce(1).write.text(f"{path}/covers")

        self._publish("snapshots", f"{number + 1:012d}", write)


def op9_token_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Loads all documents (twice, which must count once), then deletes the toxic ones and revises those of poor quality to
    what is left without symbols, by every tokenizer version; returns the rollup. Texts are read once, in place: the later
    batches join the counts, which are a few numbers for each document."""
    counts = materialise(count_tokens(docs, revised=F.regexp_replace("text", "[#*$%&|<>]+", "")), "token-counts")
    ledger = Ledger(docs.sparkSession)
    ledger.commit("load", inserts(counts))
    ledger.commit("load", inserts(counts))
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    poor = labels.where("quality = 0 and toxic = 0").select(F.col("doc_id").alias("id")).distinct()
    ledger.commit("drop-toxic", deletes(counts.join(toxic, "id", "left_semi")))
    old = counts.join(poor, "id", "left_semi")
    ledger.commit("revise-poor", revisions(old, old.withColumn("tokens", F.col("revised_tokens"))))
    ledger.compact()
    return ledger.totals()
