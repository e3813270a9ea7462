"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of a whole text are transformed (log, arcsine of roots) so that each class is
near Gaussian; class covariances shrink towards the pooled diagonal; a score is the
logistic function of the difference of log densities, by Mahalanobis distances from
Cholesky factors computed once.

Defined cases: a null or empty text has all statistics at zero and is scored like any
other; with labels of one class only, or none, every score is that class's share (0.5
without labels). Equal texts get equal scores. Extra columns pass through; ``score`` and
``predicted`` replace columns of these names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

MAX_TRAIN_ROWS = 20_000  # bound of the labelled sample
SHRINKAGE = 0.2
# a usual text's figures: each text counts with so many words and bytes of it, so that the
# shares of a very short text say little
PSEUDO_WORDS, PSEUDO_BYTES, MIN_COUNT = 20, 100, 30
USUAL_SHARES = (0.8, 0.02, 0.0, 0.02, 0.0)  # lower case, upper case, digits, sentence marks, symbols
USUAL_LENGTH, USUAL_SPREAD, USUAL_SHORT = 5.5, 3.3, 0.4
_kind = np.zeros(256, np.uint8)  # 0 other, 1 space, 2 lower case, 3 upper case, 4 digit, 5 sentence marks, 6 symbols
_kind[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1
_kind[ord("a"):ord("z") + 1] = 2
_kind[0x80:] = 2  # parts of letters outside ASCII
_kind[ord("A"):ord("Z") + 1] = 3
_kind[ord("0"):ord("9") + 1] = 4
_kind[[ord(c) for c in ".,;:'\"-()?"]] = 5
_kind[[ord(c) for c in "#$%&*!|<>{}[]=+/\\^_~@`"]] = 6


def _runs(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums over the runs given by offsets; empty runs are 0."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[at[1:]] - sums[at[:-1]]


def features(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    rows, hashes, starts, ends, data, offsets = X.words(column)
    n = len(column)
    kind = _kind[data]
    size = np.diff(offsets).astype(float)
    share = [(_runs(kind == k, offsets) + PSEUDO_BYTES * usual) / (size + PSEUDO_BYTES)
             for k, usual in zip(range(2, 7), USUAL_SHARES)]
    lines = _runs(data == 10, offsets)
    at = X.row_starts(rows, n)
    count = np.diff(at).astype(float)
    length = (ends - starts).astype(float)
    per_word = lambda values, usual: (_runs(values, at) + PSEUDO_WORDS * usual) / (count + PSEUDO_WORDS)
    mean = per_word(length, USUAL_LENGTH)
    spread = np.sqrt(np.maximum(per_word(length ** 2, USUAL_LENGTH ** 2 + USUAL_SPREAD ** 2) - mean ** 2, 0))
    last = kind[ends - 1] if len(ends) else np.empty(0, np.uint8)
    capital = (kind[starts] == 3) & (kind[np.minimum(starts + 1, ends - 1)] == 3) if len(starts) else starts
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    again = np.zeros(len(r), bool)
    again[1:] = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
    long = np.log1p(np.maximum(count, MIN_COUNT))
    root = lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    return np.column_stack([
        *map(root, share), root(per_word(last == 6, 0)), root(per_word(capital, 0)),
        root(per_word(length <= 3, USUAL_SHORT)), np.log1p(mean), np.log1p(spread), long,
        root(per_word(again, 0)) - 0.1 * long, np.log1p(lines) - 0.3 * long])


@dataclass
class Gaussian:
    mean: np.ndarray
    inverse: np.ndarray  # of the Cholesky factor
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.inverse.T
        return -0.5 * (z * z).sum(axis=1) - self.log_det


@dataclass
class Model:
    prior: float  # share of label 1
    classes: tuple[Gaussian, Gaussian] | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.prior)
        low, high = (g.log_density(x) for g in self.classes)
        z = np.clip(high - low + np.log(self.prior / (1 - self.prior)), -500, 500)
        return 1.0 / (1.0 + np.exp(-z))


def fit_rows(x: np.ndarray, y: np.ndarray, shrinkage: float = SHRINKAGE) -> Model:
    if len(y) == 0:
        return Model(0.5, None)
    if y.min() == y.max() or min((y == 0).sum(), (y == 1).sum()) < 2:
        return Model(float(y.mean()), None)
    parts = [x[y == k] for k in (0, 1)]
    pooled = sum(((p - p.mean(axis=0)) ** 2).sum(axis=0) for p in parts) / len(y) + 1e-4
    classes = []
    for p in parts:
        own = np.cov(p, rowvar=False, bias=True)
        factor = np.linalg.cholesky((1 - shrinkage) * own + shrinkage * np.diag(pooled))
        classes.append(Gaussian(p.mean(axis=0), np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))
    return Model(float(y.mean()), (classes[0], classes[1]))


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Texts and labels of about `max_rows` labelled documents, all where there are no more.

    The sample is chosen by a hash of doc_id on the labels alone, so that texts of other
    documents are not joined; a document with several labels counts once for each."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    total = marks.count()
    if total > max_rows:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    # at most about max_rows ids, whatever the size of the tables: small enough to broadcast
    return docs.join(F.broadcast(marks), "doc_id").select("text", F.col("quality").cast("int").alias("quality"))


def fit(rows: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """Learns from columns text and quality, a bounded sample (`labelled_rows`)."""

    def measure(batches):
        for part in X.slices(batches):
            x = features(part.column(0))
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    found = rows.mapInArrow(measure, "y int, x array<double>").toPandas()
    x = np.array(found["x"].tolist(), float).reshape(len(found), -1 if len(found) else 0)
    return fit_rows(x, found["y"].to_numpy(int), shrinkage)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score and predicted to all rows, from `text` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for part in X.slices(batches):
            score = shared.value.score(features(part.column(part.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=[*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)
