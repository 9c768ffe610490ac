"""Quality classifier by co-training: a text view and a metadata view teach each other, then score together.

Both views are logistic regressions. In each round either view labels all documents that it is sure of, however many there
are, and hands them to the other view's training set. Each view is calibrated on labelled rows by models that had not seen them (Platt scaling), and a
last regression on the two calibrated log odds of other such rows combines them.

Passes. Features of all documents are made once and written to the shared folder (some hundred sparse numbers for each). A round is one pass over
them: a task scores its documents by both views and adds the sure ones up in CELLS cells for each view and label, by
the signs of fixed random projections, so that a cell holds documents that are alike. Sums and counts of cells are additive and are
all that leaves a task; the model is fitted to the labelled rows and to the means of cells, weighted by how many documents they
stand for. So pseudo-labels grow with the corpus and what comes to the driver (CELLS x 4 rows of some hundred numbers) does not.

Only the labelled rows are a bounded sample: `max_labelled` of them, the least by a hash of their ID, one document for each
ID; the others count as unlabelled. Scoring covers every row: no shuffle of texts, a broadcast of a few thousand weights.

Defined cases: null and empty texts have all-zero text features and get a score like any other; null metadata is a value of its own; labels that contradict each
other for a document count as 0; labels without a document, and null ones, are left out; rows that repeat are scored alike, and as a labelled
document they count once; with fewer than 6 labelled documents of either kind every score is 0.5 and everything is kept; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialise

MAX_LABELLED = 3000
BUCKETS = 512
META_BUCKETS = 64
STATS = 10
N_TEXT, N_META = STATS + BUCKETS, 8 + META_BUCKETS
N_ALL = N_TEXT + N_META
ROUNDS = 3
#: Calibrated log odds from which on a view is sure, cells for each view and label, and what pseudo-labels weigh beside the labels of their kind.
SURE, CELLS, PSEUDO_WEIGHT = 2.0, 32, 0.5


def text_features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each whole text: ratios, and how often words fall into hashed buckets."""
    from corpusmill.llm.words import NOT_SPACE, hash_words, mix, text_bytes

    data, offsets = text_bytes(column)
    words, starts, ends, at = hash_words(data, offsets, NOT_SPACE)
    n = np.diff(at)
    size = np.diff(offsets).astype(float)
    out = np.zeros((len(n), N_TEXT), np.float32)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=total[1:])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)

    def kinds(chars: str) -> np.ndarray:
        table = np.zeros(256, np.int32)
        table[list(chars.encode())] = 1
        return table

    out[:, 0] = np.log1p(n) / 10
    out[:, 1] = share(kinds("#*$%&|<>")) * 10
    out[:, 2] = share(kinds("!?")) * 10
    out[:, 3] = share(kinds("ABCDEFGHIJKLMNOPQRSTUVWXYZ")) * 5
    out[:, 4] = share(kinds("0123456789")) * 5
    out[:, 5] = share(kinds(".,")) * 10
    out[:, 6] = share(kinds("\n")) * 10
    lengths = ends - starts
    for i in range(len(n)):
        own = words[at[i] : at[i + 1]]
        if len(own):
            out[i, 7] = lengths[at[i] : at[i + 1]].mean() / 10
            out[i, 8] = (len(own) - len(np.unique(own))) / (len(own) + 10)
            if len(own) > 2:
                windows = np.unique(mix(mix(own[:-2]) + own[1:-1]) ^ own[2:])
                out[i, 9] = (len(own) - 2 - len(windows)) / (len(own) + 8)
            out[i, STATS:] = np.bincount((own >> np.uint64(55)).astype(np.int64), minlength=BUCKETS) / (len(own) + 30) * 4  # few words say little
    return out


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Hashed source and language, and the length, which the page says and not the words."""
    import xxhash

    out = np.zeros((len(source), N_META), np.float32)
    for i, (s, k, c) in enumerate(zip(source, lang, n_chars)):
        out[i, 8 + xxhash.xxh32_intdigest(f"s{s}") % META_BUCKETS] += 1
        out[i, 8 + xxhash.xxh32_intdigest(f"l{k}") % META_BUCKETS] += 1
        out[i, 0] = c is None
        out[i, min(1 + int(np.log10((c or 0) + 1)), 7)] = 1
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, decay: float = 1e-4, steps: int = 300, rate: float = 1.0) -> np.ndarray:
    """Logistic regression by gradient descent with momentum; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    weight = np.ones(len(y)) if weight is None else weight
    weight = (weight / weight.sum()).astype(np.float32)
    y = y.astype(np.float32)
    w, v = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    scale = 1 / np.maximum(np.sqrt(weight @ (x * x)), 1e-2)  # unit size for each feature
    z = x * scale
    for _ in range(steps):
        slope = z.T @ (weight * (1 / (1 + np.exp(-np.clip(z @ w, -30, 30))) - y)) + decay * w
        v = 0.9 * v - rate * 0.1 * slope
        w += v
    return (w * scale).astype(np.float64)


def odds(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


@dataclass
class CoTrained:
    """Weights of both views, their calibration (slope, intercept) and the combination (text, meta, intercept)."""

    text: np.ndarray
    meta: np.ndarray
    scale: np.ndarray
    join: np.ndarray

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Three columns: probability of good quality by text, by metadata, by both."""
        a = np.clip(self.scale[0, 0] * odds(self.text, text) + self.scale[0, 1], -30, 30)
        b = np.clip(self.scale[1, 0] * odds(self.meta, meta) + self.scale[1, 1], -30, 30)
        c = np.clip(self.join[0] * a + self.join[1] * b + self.join[2], -30, 30)
        return 1 / (1 + np.exp(-np.stack([a, b, c], axis=1)))


#: For each view the means of the cells that the other view filled, their labels and how many documents each stands for.
Taught = tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


FOLDS = 3


def co_train(x: np.ndarray, y: np.ndarray, teach: Callable[[np.ndarray, np.ndarray], Taught], rounds: int = ROUNDS) -> CoTrained | None:
    """x: features of the labelled rows, y: 1 good, 0 poor; teach(text weights, metadata weights) asks the unlabelled documents.

    A view is calibrated on odds that models gave which had not seen the row: those of FOLDS parts of the labelled rows. Every other row of each
    label calibrates, the rest combine. None without two rows of each label for every part.
    """
    of_label = np.zeros(len(y), int)  # a row's number among those of its label
    for kind in (0, 1):
        if (y == kind).sum() < 2 * FOLDS:
            return None
        of_label[y == kind] = np.arange((y == kind).sum())
    fold, calibrates = of_label // 2 % FOLDS, of_label % 2 == 0
    views = (x[:, :N_TEXT], x[:, N_TEXT:])
    nothing = [(np.empty((0, v.shape[1]), np.float32), np.empty(0), np.empty(0)) for v in views]

    def fitted(view: np.ndarray, rows: np.ndarray, said) -> np.ndarray:
        means, labels, counts = said
        weight = np.zeros(len(labels))
        for kind in (0, 1):
            if (labels == kind).any():
                weight[labels == kind] = PSEUDO_WEIGHT * (y[rows] == kind).sum() * counts[labels == kind] / counts[labels == kind].sum()
        return fit(np.vstack([view[rows], means]), np.concatenate([y[rows], labels]), np.concatenate([np.ones(rows.sum()), weight]))

    said: Taught | list = nothing
    for k in range(rounds + 1):
        models = [fitted(v, np.ones(len(y), bool), t) for v, t in zip(views, said)]
        unseen = np.zeros((2, len(y)))
        for i, (v, t) in enumerate(zip(views, said)):
            for f in range(FOLDS):
                unseen[i, fold == f] = odds(fitted(v, fold != f, t), v[fold == f])
        scale = np.array([fit(z[calibrates][:, None], y[calibrates], decay=1e-3) for z in unseen])
        if k < rounds:
            said = teach(*(np.append(a * m[:-1], a * m[-1] + b) for m, (a, b) in zip(models, scale)))  # a view is sure by calibrated odds
    calibrated = np.clip(scale[:, :1] * unseen + scale[:, 1:], -30, 30).T
    return CoTrained(*models, scale, fit(calibrated[~calibrates], y[~calibrates], decay=1e-3))


def _inputs(docs: DataFrame, text_col: str):
    return [F.col(c).cast(t).alias(n) if c in docs.columns else F.lit(None).cast(t).alias(n) for c, t, n in (("source", "string", "source"), ("lang", "string", "lang"), ("n_chars", "bigint", "n_chars"), (text_col, "string", "text"))]


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as places and values of what isn't 0."""
    return [at.astype("<u2").tobytes() + row[at].astype("<f2").tobytes() for row in x for at in (np.flatnonzero(row),)]


def unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), N_ALL), np.float32)
    for i, r in enumerate(rows):
        half = len(r) // 2
        out[i, np.frombuffer(r, "<u2", half // 2)] = np.frombuffer(r, "<f2", half // 2, half)
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 1000):
            batch = whole.slice(a, 1000)
            source, lang, n_chars = (batch.column(k).to_pylist() for k in (1, 2, 3))
            x = np.hstack([text_features(batch.column(4)), meta_features(source, lang, n_chars)])
            yield pa.record_batch([batch.column(0), pa.array(packed(x), pa.binary())], names=["id", "x"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) for each row of docs, in the shared folder."""
    src = docs.select(docs[id_col].alias("id"), *_inputs(docs, text_col))
    return materialise(src.mapInArrow(_extract, f"id {src.schema['id'].dataType.simpleString()}, x binary"), "quality-features")


@lru_cache(maxsize=1)
def _projections() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(8)
    bits = CELLS.bit_length() - 1
    return r.standard_normal((N_TEXT, bits)).astype(np.float32), r.standard_normal((N_META, bits)).astype(np.float32)


def _teacher(shared):
    """Sums and counts of cells: (view to be taught, label, cell, sums and at the end the count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        sums = [np.zeros((2, CELLS, n + 1)) for n in (N_TEXT, N_META)]
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                x = unpacked(whole.column(0).slice(a, 1000).to_pylist())
                views = (x[:, :N_TEXT], x[:, N_TEXT:])
                for i, j in ((0, 1), (1, 0)):
                    z = odds(models[i], views[i])
                    for label, rows in ((0, np.flatnonzero(z < -SURE)), (1, np.flatnonzero(z > SURE))):
                        told = views[j][rows]
                        cell = ((told @ _projections()[j] > 0) @ (1 << np.arange(CELLS.bit_length() - 1))).astype(np.int64)
                        np.add.at(sums[j][label], cell, np.hstack([told, np.ones((len(rows), 1))]))
        for j in (0, 1):
            label, cell = np.nonzero(sums[j][:, :, -1])
            yield pa.record_batch(
                [pa.array([j] * len(label), pa.int32()), pa.array(label, pa.int32()), pa.array(cell, pa.int32()), pa.array(list(sums[j][label, cell]), pa.list_(pa.float64()))],
                names=["view", "label", "cell", "sums"],
            )

    return run


def taught(pool: DataFrame, text: np.ndarray, meta: np.ndarray) -> Taught:
    """One pass over all unlabelled documents."""
    shared = pool.sparkSession.sparkContext.broadcast((text, meta))
    parts = pool.select("x").mapInArrow(_teacher(shared), "view int, label int, cell int, sums array<double>")
    added = parts.select("view", "label", "cell", F.posexplode("sums").alias("at", "v")).groupBy("view", "label", "cell", "at").agg(F.sum("v").alias("v"))
    found = added.where("v <> 0").toPandas()  # at most 4 x CELLS cells, whatever the corpus
    out = []
    for j, n in enumerate((N_TEXT, N_META)):
        table = np.zeros((2, CELLS, n + 1))
        own = found[found["view"] == j]
        table[own["label"], own["cell"], own["at"]] = own["v"]
        label, cell = np.nonzero(table[:, :, -1])
        rows = table[label, cell]
        out.append(((rows[:, :-1] / rows[:, -1:]).astype(np.float32), label.astype(float), rows[:, -1]))
    return out[0], out[1]


def train(known: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> CoTrained | None:
    """known: features()."""
    place = F.xxhash64(F.col("id"))
    told = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
    told = materialise(told.join(known.select("id").distinct(), "id", "left_semi").orderBy(place, "id").limit(max_labelled), "quality-labels")
    sample = F.broadcast(told)  # max_labelled rows
    rows = known.join(sample, "id").groupBy("id", "y").agg(F.min("x").alias("x")).select(place.alias("place"), "id", "y", "x").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("place", "ascending"), ("id", "ascending")])
    pool = known.join(sample.select("id"), "id", "left_anti")
    return co_train(unpacked(rows.column("x").to_pylist()), rows.column("y").to_numpy().astype(float), lambda text, meta: taught(pool, text, meta), rounds)


def score_documents(known: DataFrame, model: CoTrained | None) -> DataFrame:
    """id, text_score, meta_score, score for each row of features()."""
    shared = known.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                if found is None:
                    s = np.full((batch.num_rows, 3), 0.5)
                else:
                    x = unpacked(batch.column(1).to_pylist())
                    s = found.score(x[:, :N_TEXT], x[:, N_TEXT:])
                yield pa.record_batch([batch.column(0), *(pa.array(s[:, k], pa.float64()) for k in range(3))], names=["id", "text_score", "meta_score", "score"])

    return known.select("id", "x").mapInArrow(run, f"id {known.schema['id'].dataType.simpleString()}, text_score double, meta_score double, score double")


def op8_quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.2, **options) -> DataFrame:
    known = features(docs)
    scored = score_documents(known, train(known, labels, **options))
    return scored.select(F.col("id").alias("doc_id"), "text_score", "meta_score", "score", (F.col("score") >= threshold).alias("kept"))
