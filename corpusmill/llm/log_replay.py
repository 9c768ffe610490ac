"""Transaction log reassembly: summaries of chunks of the log, combined by a parallel prefix scan, then resolved chunk by chunk.

A log record has a place (doc_id), a source and a kind: change, savepoint, rollback, commit or abort. A rollback keeps its savepoint, so what becomes of a
change depends on two later records of its source alone. The first savepoint, rollback or end after it: a rollback
undoes it, a savepoint shields it from all later ones. And the first end after it: a commit applies it, an abort (or the end of the log)
undoes it.

Chunks are ranges of doc_id with a bounded number of rows. A chunk's summary has one row for each of its sources, of constant size however many changes are
pending: the first mark (an unmatched rollback, a savepoint or an end), the first end, and how many changes it leaves pending. Summaries are combined by "the first of the
later ones", which is associative, so `exclusive_scan` tells each chunk what follows it; commits are numbered by a scan of the chunks' counts. Changes are
then resolved inside their chunk. A source with a third of the log is cut into chunks like any other.

The store after each epoch comes from differences: of the changes that an epoch applies to a key the last one counts, its difference from the key's value before (again a
scan, in blocks of epochs) is summed for each epoch, and a scan of the sums gives the states.

Defined results: rows without doc_id are no records; rows of the same doc_id are of the same kind, ordered by source (null first), then by entry. An empty log
has no rows. Very long texts only pass through crc32. Other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import materialise
from corpusmill.llm.scan import exclusive_scan

#: Rows of a chunk, about; a chunk is one task's work.
CHUNK_ROWS = 100_000
PER_EPOCH = 16
KEYS = 3000
ORDER = ("doc_id", "src", "entry")
CHANGE, SAVEPOINT, ROLLBACK, COMMIT, ABORT = "change", "savepoint", "rollback", "commit", "abort"


def records(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, src, kind, key, entry) of documents: entry is the crc32 of what a change stores, null if it deletes its key. src is never null."""
    h = F.crc32(F.col("doc_id").cast("string"))
    m, key = h % 41, F.floor(h / 100) % KEYS
    kind = F.when(m <= 1, COMMIT).when(m == 2, ABORT).when(m <= 4, SAVEPOINT).when(m <= 6, ROLLBACK).otherwise(CHANGE)
    stored = F.crc32(F.concat(key.cast("string"), F.lit(":"), F.col("text")))
    src = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    toxic = labels.where("toxic = 1 AND doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("toxic_")).distinct()
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", src.alias("src"), kind.alias("kind"), key.alias("key"), stored.alias("entry"))
    return rows.join(toxic.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "src", "kind", "key", F.when(F.col("toxic_").isNull(), F.col("entry")).alias("entry"))


def chunks(log: DataFrame, rows: int | None = None) -> tuple[DataFrame, int]:
    """The log with a column chunk, ranges of ORDER, and how many chunks there are."""
    spark = log.sparkSession
    log = materialise(log, "log-records")
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), log.count() // (rows or CHUNK_ROWS) + 1)
    cut = materialise(log.repartitionByRange(wanted, *ORDER).withColumn("chunk", F.spark_partition_id().cast("long")), "log-chunks")
    return cut, (cut.agg(F.max("chunk")).first()[0] or 0) + 1


def numbered(log: DataFrame, n: int) -> DataFrame:
    """The log with seq: how many commits there are up to and including the row."""
    inside = Window.partitionBy("chunk").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    is_commit = (F.col("kind") == COMMIT).cast("long")
    counts = materialise(log.groupBy("chunk").agg(F.sum(is_commit).alias("commits")), "log-commits")
    start = exclusive_scan(counts, [], "chunk", {"commits": "sum"}, n).select("chunk", "commits_before")
    return log.withColumn("seq", F.sum(is_commit).over(inside)).join(start.hint("shuffle_hash"), "chunk").withColumn("seq", F.col("seq") + F.col("commits_before")).drop("commits_before")


def _events() -> dict[str, Column]:
    kind = F.col("kind")
    return {
        "mark": F.when(kind != CHANGE, F.struct("kind", "doc_id")),
        "end": F.when(kind.isin(COMMIT, ABORT), F.struct("kind", "doc_id", "seq")),
    }


def summaries(log: DataFrame) -> DataFrame:
    """(chunk, src, mark, end, pending): what a chunk means for the changes of its source that stand before it, and how many it leaves open."""
    at = F.struct(*ORDER)
    first = [F.min_by(e, F.when(e.isNotNull(), at)).alias(c) for c, e in _events().items()]
    last_end = F.max(F.when(F.col("kind").isin(COMMIT, ABORT), at)).over(Window.partitionBy("chunk", "src"))
    open_ = F.col("kind").eqNullSafe(CHANGE) & (F.col("last_end").isNull() | (at > F.col("last_end")))
    return log.withColumn("last_end", last_end).groupBy("chunk", "src").agg(*first, F.count_if(open_).alias("pending"))


def resolve(log: DataFrame, n: int) -> DataFrame:
    """The changes of a numbered log in n chunks with their fate: `commit` (and seq, the commit's number), `abort` or `rollback`, and by, the record that decided (null: the end of the log)."""
    later = materialise(summaries(log).withColumn("rev", F.lit(n - 1) - F.col("chunk")), "log-summaries")
    carried = exclusive_scan(later, ["src"], "rev", {"mark": "last", "end": "last"}, n).select("chunk", "src", "mark_before", "end_before")
    after = Window.partitionBy("chunk", "src").orderBy(*ORDER).rowsBetween(1, Window.unboundedFollowing)
    local = log.withColumns({f"next_{c}": F.first(e, ignorenulls=True).over(after) for c, e in _events().items()}).where(F.col("kind") == CHANGE)
    both = local.join(carried.hint("shuffle_hash"), ["chunk", "src"])
    mark, end = F.coalesce("next_mark", "mark_before"), F.coalesce("next_end", "end_before")
    rolled, done = mark["kind"].eqNullSafe(ROLLBACK), end["kind"].eqNullSafe(COMMIT)
    fate = F.when(rolled, ROLLBACK).when(done, COMMIT).otherwise(ABORT)
    return both.select("doc_id", "src", "key", "entry", fate.alias("fate"), F.when(rolled, mark["doc_id"]).otherwise(end["doc_id"]).alias("by"), F.when(~rolled & done, end["seq"]).alias("seq"))


def states(applied: DataFrame, epochs: DataFrame, n_epochs: int) -> DataFrame:
    """(epoch, n, value) after each epoch: keys stored and the sum of their entries. applied: (epoch, seq, doc_id, src, key, entry)."""
    last = applied.groupBy("key", "epoch").agg(F.max_by(F.struct("entry"), F.struct("seq", *ORDER)).alias("now"))
    chain = exclusive_scan(materialise(last, "log-last"), ["key"], "epoch", {"now": "last"}, n_epochs)
    stored, was = F.col("now")["entry"], F.col("now_before")["entry"]
    dn = F.sum(stored.isNotNull().cast("long") - was.isNotNull().cast("long"))
    dv = F.sum(F.coalesce(stored, F.lit(0)) - F.coalesce(was, F.lit(0)))
    moved = chain.groupBy("epoch").agg(dn.alias("dn"), dv.alias("dv"))
    moved = epochs.join(moved.hint("shuffle_hash"), "epoch", "left").na.fill(0, ["dn", "dv"])
    sums = exclusive_scan(materialise(moved, "log-epochs"), [], "epoch", {"dn": "sum", "dv": "sum"}, n_epochs)
    return sums.select("epoch", (F.col("dn_before") + F.col("dn")).alias("n"), (F.col("dv_before") + F.col("dv")).alias("value"))


def replay(log: DataFrame, per_epoch: int = PER_EPOCH, chunk_rows: int | None = None) -> DataFrame:
    """(kind, id, n, value): a row `state` for each epoch, and a row `abort` or `rollback` for each change that was undone."""
    cut, n = chunks(log, chunk_rows)
    log = materialise(numbered(cut, n), "log-numbered")
    changes = materialise(resolve(log, n), "log-changes")
    epoch = F.floor((F.col("seq") - 1) / per_epoch).cast("long").alias("epoch")
    epochs = log.where(F.col("kind") == COMMIT).select(epoch).distinct()
    n_epochs = -(-(log.agg(F.max("seq")).first()[0] or 0) // per_epoch)
    after = states(changes.where(F.col("fate") == COMMIT).select("*", epoch), epochs, n_epochs)
    state = after.select(F.lit("state").alias("kind"), (F.col("epoch") + 1).alias("id"), "n", "value")
    undone = changes.where(F.col("fate") != COMMIT).select(F.col("fate").alias("kind"), F.col("doc_id").cast("long").alias("id"), F.col("by").cast("long").alias("n"), F.col("key").alias("value"))
    return state.unionByName(undone)


def op12_log_replay(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return replay(records(docs, labels))


#: DuckDB has no crc32. Bytes as numbers, then the table of the polynomial, one step a byte.
CRC_MACROS = """
WITH RECURSIVE step(n, k, c) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM step WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY n) AS t FROM step WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """DuckDB expression: unsigned crc32 of the UTF-8 bytes of text, beside a row of crc_table."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"


ORACLE = f"""{CRC_MACROS}, hashed AS (
  SELECT doc_id, source, text, {crc_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc_table
), log AS (
  SELECT doc_id, source, h % 41 AS m, (h // 100) % {KEYS} AS key,
    CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) THEN {crc_sql(f"CAST((h // 100) % {KEYS} AS VARCHAR) || ':' || text")} END AS entry
  FROM hashed, crc_table
), numbered AS (
  SELECT *, sum(CASE WHEN m <= 1 THEN 1 ELSE 0 END) OVER (ORDER BY doc_id) AS seq FROM log
), found AS (
  SELECT *,
    first_value(CASE WHEN m <= 6 THEN [m, doc_id] END IGNORE NULLS) OVER later AS mark,
    first_value(CASE WHEN m <= 2 THEN [m, doc_id, seq] END IGNORE NULLS) OVER later AS stop
  FROM numbered WINDOW later AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), changes AS (
  SELECT *, CASE WHEN mark[1] IN (5, 6) THEN 'rollback' WHEN stop[1] <= 1 THEN 'commit' ELSE 'abort' END AS fate FROM found WHERE m > 6
), applied AS (
  SELECT (stop[3] - 1) // {PER_EPOCH} + 1 AS epoch, stop[3] AS seq, doc_id, key, entry FROM changes WHERE fate = 'commit'
), epochs AS (
  SELECT DISTINCT (seq - 1) // {PER_EPOCH} + 1 AS epoch FROM numbered WHERE m <= 1
), latest AS (
  SELECT e.epoch, a.entry, row_number() OVER (PARTITION BY e.epoch, a.key ORDER BY a.seq DESC, a.doc_id DESC) AS r FROM epochs e JOIN applied a ON a.epoch <= e.epoch
)
SELECT 'state' AS kind, CAST(e.epoch AS BIGINT) AS id, CAST(count(l.entry) AS BIGINT) AS n, CAST(coalesce(sum(l.entry), 0) AS BIGINT) AS value
FROM epochs e LEFT JOIN (SELECT * FROM latest WHERE r = 1) l USING (epoch) GROUP BY e.epoch
UNION ALL
SELECT fate, doc_id, CASE WHEN fate = 'rollback' THEN mark[2] ELSE stop[2] END, CAST(key AS BIGINT) FROM changes WHERE fate <> 'commit'
"""
