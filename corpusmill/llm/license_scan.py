"""Licence scans by canonical digest lookup.

A text is canonical once case, punctuation, copyright lines, titles and equivalent spellings are gone; its SHA-256 is looked up by a
hash join among the digests of the known licences. The unit is the entire text of a document; as corpora also carry
notices as lines of their own in a longer text, each entire line is looked up the same way. No part of a text is
matched loosely, so prose about licences is no licence.

Only built-in functions touch the texts. The table of known digests is counted: up to BROADCAST_ROWS of them (some 10 MB) are broadcast, so
digests stay in their task and only finds are shuffled, however often a line occurs; beyond that lines are dealt by digest and a salt, so a
line that a third of all documents share is spread over SALTS keys.

Defined cases: null and blank texts (and lines) have no digest and match nothing; repeated rows are looked up alike; several notices in
a document are reported each once, sorted; documents that share an id are told apart by their texts; an empty table of documents or licences gives no finds. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh, let
from corpusmill.llm.licenses import DIGESTS, NOTICES, TAGS, TEXTS

BROADCAST_ROWS, SALTS = 100_000, 32

#: Spellings that licence matching guidelines hold to be the same.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("noncommercial", "non commercial"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("per cent", "percent"), ("copyright owner", "copyright holder"))
COPYRIGHT_LINE = "(?im)^[^a-z\\n]*(copyright|\\(c\\)|©)[^a-z\\n]*[0-9(©][^\\n]*$|^[^a-z\\n]*all rights reserved[^a-z\\n]*$"

#: Titles of the licences whose whole texts are known, as a line of their own.
TITLE_LINE = "(?i:[^a-z0-9\\n]*(?:the )?(?:(?:mit|expat|isc|zlib|zlib/libpng|simplified bsd|freebsd|new bsd|modified bsd|(?:bsd[ -])?[023][ -]clause(?: bsd)?(?: \"(?:simplified|new|revised)\")?|bsd[ -]zero[ -]clause|zero[ -]clause bsd)(?: licen[cs]e)?|0bsd)(?: \\([a-z0-9 -]+\\))?[^a-z0-9\\n]*)"
#: A holder without a year; lines of a licence text that begin with the copyright holder are none.
YEARLESS_LINE = "[^A-Za-z\\n]*(?:(?i:copyright)(?i: by)? (?!(?i:holders?|owners?|notices?|laws?|licen[cs]es?|and|or|is)\\b)(?:[A-Z]|the )[^\\n]*|©[^\\n]*)"
#: Such lines at the head of a text, with more behind them.
HEAD = f"\\A(?:\\s*+(?:{TITLE_LINE}|{YEARLESS_LINE})\\n){{1,64}}(?=\\s*\\S)"


def canonical(text: Column) -> Column:
    """Lower case without copyright lines and titles, punctuation as one space, equivalent spellings as one."""
    plain = F.regexp_replace(F.regexp_replace(text, COPYRIGHT_LINE, ""), HEAD, "")
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(plain), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")), F.lit(" "))
    return F.trim(reduce(lambda c, s: F.replace(c, F.lit(f" {s[0]} "), F.lit(f" {s[1]} ")), SPELLINGS, plain))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical text in hex; null for one without words."""
    return let(canonical(text), lambda c: F.when(c != "", F.sha2(c, 256)))


def _pairs() -> list[tuple[str, str]]:
    """(name, text) of everything that comes with the library."""
    tags = [(t, f"SPDX-License-Identifier: {t}") for t in TAGS]
    return [(k, t) for k, ts in NOTICES.items() for t in ts] + tags + list(TEXTS.items())


def known_licenses(spark: SparkSession, texts=None) -> DataFrame:
    """(license, digest) of (name, text) pairs; by default of the texts, notices and digests that come with the library."""
    rows = spark.createDataFrame(_pairs() if texts is None else list(texts), "license string, text string")
    found = rows.select("license", digest(F.col("text")).alias("digest")).where("digest is not null")
    if texts is None:
        found = found.union(spark.createDataFrame([(k, d) for k, ds in DIGESTS.items() for d in ds], "license string, digest string"))
    return found.groupBy("digest").agg(F.min("license").alias("license"))


def digests_of(spark: SparkSession, folder: str) -> DataFrame:
    """(name, digest) of the licence files in a folder."""
    files = spark.read.text(folder, wholetext=True)
    return files.select(F.substring_index(F.input_file_name(), "/", -1).alias("name"), digest(F.col("value")).alias("digest"))


def _look_up(rows: DataFrame, known: DataFrame, how: str, few: bool) -> DataFrame:
    """rows (id, text_hash, digest) with the license of their digest."""
    if few:
        return rows.join(F.broadcast(known), "digest", how)
    dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id", "text_hash"), F.lit(SALTS)).cast("int")).join(dealt, ["digest", "salt"], how).drop("salt")


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, text_digest, text_license (of the entire text), line_licenses (of entire lines, sorted), for each row of docs."""
    known = known_licenses(docs.sparkSession) if known is None else known
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_hash"))
    # a line of a licence text says so only as a whole text, a notice as a line, too
    lines = src.select("id", "text_hash", F.explode(F.split("text", "\n")).alias("line")).select("id", "text_hash", digest(F.col("line")).alias("digest")).where("digest is not null")
    noted = _look_up(lines, known, "inner", few).groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("license")).alias("line_licenses"))
    noted = noted.select(F.col("id").alias("noted_id"), F.col("text_hash").alias("noted_hash"), "line_licenses")
    whole = _look_up(src.select("id", "text_hash", digest(F.col("text")).alias("digest")), known, "left", few).withColumnsRenamed({"digest": "text_digest", "license": "text_license"})
    out = whole.join(noted, F.col("id").eqNullSafe(F.col("noted_id")) & (F.col("text_hash") == F.col("noted_hash")), "left")
    return out.select("id", "text_hash", "text_digest", "text_license", F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"))


def drop_licensed(docs: DataFrame, refused: list[str], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those under one of the refused licences."""
    found = scan_licenses(docs, id_col=id_col, text_col=text_col, **options).where(F.col("text_license").isin(refused) | F.arrays_overlap("line_licenses", F.array(*map(F.lit, refused))))
    name, digest_of = fresh("refused_id", docs), fresh("refused_hash", docs)
    gone = found.select(F.col("id").alias(name), F.col("text_hash").alias(digest_of)).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone[name]) & (F.xxhash64(docs[text_col]) == gone[digest_of]), "left_anti")


def op5_license_scan(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs).select(F.col("id").alias("doc_id"), "text_digest", "text_license", F.array_join("line_licenses", ",").alias("line_licenses"))


def _sql_digest(text: str) -> str:
    plain = f"lower(regexp_replace({text}, '{COPYRIGHT_LINE}', '', 'g'))"
    plain = f"' ' || trim(regexp_replace({plain}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')) || ' '"
    plain = reduce(lambda c, s: f"replace({c}, ' {s[0]} ', ' {s[1]} ')", SPELLINGS, plain)
    return f"CASE WHEN trim({plain}) <> '' THEN sha256(trim({plain})) END"


_quoted = lambda pairs: ", ".join("({}, {})".format(*("'" + x.replace("'", "''") + "'" for x in p)) for p in pairs)
_PAIRS, _KNOWN = _quoted(_pairs()), _quoted([(k, d) for k, ds in DIGESTS.items() for d in ds])

ORACLE = f"""
WITH known AS (SELECT digest, min(license) AS license FROM (SELECT license, {_sql_digest('t')} AS digest FROM (VALUES {_PAIRS}) AS v(license, t) UNION ALL FROM (VALUES {_KNOWN}) AS v(license, digest)) GROUP BY digest),
lines AS (SELECT doc_id, {_sql_digest('l')} AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)),
noted AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses FROM lines JOIN known USING (digest) GROUP BY doc_id),
whole AS (SELECT doc_id, {_sql_digest('text')} AS text_digest FROM documents)
SELECT w.doc_id, text_digest, k.license AS text_license, coalesce(line_licenses, '') AS line_licenses
FROM whole w LEFT JOIN known k ON k.digest = w.text_digest LEFT JOIN noted n USING (doc_id)
"""
