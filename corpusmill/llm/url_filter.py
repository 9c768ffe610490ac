"""URL filters: rules for hosts and paths, and logistic regression on hashed character n-grams for the rest.

The model is trained on the driver from a small labelled URL table (a parameter; by default a table of names made of
two words, of kinds that block lists hold and of ordinary ones), its 2**16 weights are broadcast, and each URL is judged in its own task: no shuffle, no skew. Host and path are cut
out by built-in functions and only they go to Python.

Defined cases: a null URL, or one without ://, has an empty host and path, fits no rule, and as it has no n-grams gets the model's
intercept, which allows, as most labelled URLs are good; repeated rows are judged alike; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: What names of sites are made of, by kind: a word that tells the kind, and one that goes with it. The kinds are those of public block lists.
BAD = {
    "gambling": ("casino poker slots roulette bingo jackpot betting lottery", "online bonus club royal spins win"),
    "drugs": ("viagra cialis pills steroids meds pharmacy", "cheap online discount buy generic"),
    "adult": ("porn xxx sex adult escort webcam", "tube videos live cams chat girls"),
    "money": ("loans payday credit crypto bitcoin cash", "fast instant easy free giveaway doubler"),
    "counterfeits": ("replica fake outlet", "watches handbags sneakers rolex"),
    "malware": ("crack keygen warez torrent codec cleaner", "download free serials update pro"),
    "phishing": ("verify login account password", "secure confirm update alert"),
    "advertising": ("ads popunder banner tracking click traffic", "server network exchange media pixel"),
    "link farms": ("spam backlinks seo link", "farm cheap bulk blog"),
}
GOOD = {
    "news": ("news weather daily journal magazine radio", "report today weekly archive online"),
    "science": ("science astronomy climate medical history research", "society lectures notes institute review"),
    "public": ("city village national public health tax", "library museum council office register transport"),
    "schools": ("school university language math music", "course club department forum"),
    "shops": ("book bike tea flower furniture shoe", "store shop market workshop online"),
    "hobbies": ("garden travel recipe chess sailing hiking bird photo", "club guide forum blog gallery"),
    "software": ("python linux kernel database compiler font", "docs wiki mailing review download update"),
    "places": ("harbour island castle lake mountain", "tours hotel ferry map"),
}
#: Frequent letter pairs of European languages, for made-up names that say nothing.
PAIRS = "th er on an re he in ed nd ha at en es of or nt ea ti to it st le is ou ar as de ve la al se co me ri ro ic ne ch ng il".split()


@lru_cache(maxsize=1)
def labelled_urls() -> tuple[tuple[str, str, int], ...]:
    """(host, path, 1 for bad): every pair of words of a kind, with and without a hyphen and in either order, and made-up names that say nothing, all
    under the same suffixes and with the same paths, so that only names can be learned. About 1,000 rows."""
    n = len(PAIRS)
    made = [PAIRS[i] + PAIRS[(i * 3 + k * 7) % n] + PAIRS[(i + k * k) % n] * (k % 2) + ("", "ing", "tion", "ble", "ment")[k % 5] for i in range(n) for k in range(12)]
    out = []
    for label, kinds in ((1, BAD), (0, GOOD)):
        pairs = [(a, b) for first, second in kinds.values() for a in first.split() for b in second.split()]
        out += [(("{0}-{1}", "{1}{0}", "{0}{1}", "{1}-{0}")[k % 4].format(*pair), label) for k, pair in enumerate(pairs)]
    rows = []
    for k, (name, label) in enumerate([*out, *((m, 0) for m in made)]):
        top = ("example.com", "example.net", "example.org")[k % 3]
        path = f"/{('en', 'fr', 'de', 'es')[k // 3 % 4]}/{k * 7919 % 100000}{('', '.html', '/')[k // 5 % 3]}"
        rows.append((f"{('', 'www.', 'blog.', 'm.')[k // 2 % 4]}{name}.{top}", path, label))
    return tuple(rows)


def labelled_from(urls: DataFrame, url_col: str = "url", label_col: str = "bad", max_rows: int = 20_000) -> list[tuple[str, str, int]]:
    """Rows for `labelled` of filter_urls() from a table of labelled URLs: at most max_rows of them, the least by a hash of the URL; null labels are left out.

    This is what the model is for: the built-in table knows only the words it is made of.
    """
    host, path = host_and_path(urls[url_col])
    rows = urls.where(urls[label_col].isNotNull()).select(host.alias("h"), path.alias("p"), urls[label_col].cast("int").alias("y"), F.xxhash64(urls[url_col]).alias("at"))
    return [(r.h, r.p, r.y) for r in rows.orderBy("at", "h", "p", "y").limit(max_rows).collect()]


def _grams(host: str, path: str) -> np.ndarray:
    """Buckets of the character n-grams of host and path, each with marks for its ends."""
    import xxhash

    found = set()
    for field, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            for i in range(len(text) - n + 1):
                found.add(xxhash.xxh32_intdigest(f"{field}{text[i : i + n]}") % BUCKETS)
    return np.fromiter(found, np.int64, len(found))


def train(rows=None, rounds: int = 400, rate: float = 2.0, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights by gradient descent on the mean log loss, with n-grams of equal norm for each URL. The intercept is the log odds of
    the labels, so a URL of which the model knows nothing is as likely bad as a labelled one."""
    rows = list(labelled_urls() if rows is None else rows)
    grams = [_grams(h, p) for h, p, _ in rows]
    row = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
    col = np.concatenate(grams)
    scale = 1 / np.sqrt(np.bincount(row, minlength=len(rows)).clip(1))
    y = np.array([r[2] for r in rows], float)
    weights, intercept = np.zeros(BUCKETS), float(np.log(max(y.sum(), 0.5) / max(len(y) - y.sum(), 0.5)))
    for _ in range(rounds):
        z = scale * np.bincount(row, weights[col], len(rows)) + intercept
        error = 1 / (1 + np.exp(-z)) - y
        weights -= rate * (np.bincount(col, (error * scale)[row], BUCKETS) / len(rows) * 10 + decay * weights)
    return weights, intercept


def score(host: str, path: str, weights: np.ndarray, intercept: float) -> float:
    """The probability that the URL is bad."""
    g = _grams(host, path) if host or path else np.empty(0, np.int64)
    z = (weights[g].sum() / np.sqrt(len(g)) if len(g) else 0.0) + intercept
    return float(1 / (1 + np.exp(-z)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct (rule, verdict), or null. rules: a short list that is part of the plan."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    cases = [F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ordered]
    return reduce(lambda a, b: F.coalesce(a, b), cases) if cases else F.lit(None).cast("struct<rule:string,verdict:string>")


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled=None, threshold: float = 0.5) -> DataFrame:
    """id, host, path, rule, verdict (allow or block), bad_score for each row of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(train(labelled))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = shared.value
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.record_batch([*batch.columns, pa.array([score(h, p, weights, intercept) for h, p in pairs], pa.float64())], names=[*batch.schema.names, "bad_score"])

    host, path = host_and_path(pages[url_col])
    parts = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    kind = parts.schema["id"].dataType.simpleString()
    scored = parts.mapInArrow(scores, f"id {kind}, host string, path string, bad_score double")
    ruled = scored.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bad_score") >= threshold, "block").otherwise("allow")
    return ruled.select("id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "bad_score")


def op7_url_filter(pages: DataFrame) -> DataFrame:
    return filter_urls(pages).withColumnRenamed("id", "page_id")
