"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled one and towards a multiple of the identity; a score is the
logistic of the difference of two Gaussian log-densities, whose Mahalanobis terms come from Cholesky factors computed once; the
logistic curve is fitted to the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.llm import arrowtext as at
from armwise.llm.calibration import calibrate
from armwise.llm.common import remainder, written

#: Statistics of a text, after their transforms; none depends on labels, language, source or id.
FEATURES = ("log_words", "word_length", "capitals", "symbols", "exclamations", "bars", "digits", "stops", "lines", "repeats", "types", "pairs")
_BYTES = {"capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "symbols": b"#$%&*<>", "exclamations": b"!", "bars": b"|", "digits": b"0123456789", "stops": b".,;:?"}


def statistics(column: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text; a null or empty text is a text without words."""
    out = np.zeros((len(column), len(FEATURES)))
    tables = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _BYTES.items()}
    for s in at.slices(column):
        w = at.find_words(s)
        h = at.hash_spans(s.data, w.starts, w.ends)
        n = np.diff(w.first)
        size = at.counts_between(~at._IS_BLANK[s.data], s.starts, s.ends)
        x = out[s.lo : s.hi]
        many = np.maximum(n, 1)
        x[:, 0] = np.log1p(n)
        x[:, 1] = np.log1p(size / many)
        for k, flag in tables.items():
            x[:, FEATURES.index(k)] = np.sqrt(at.counts_between(flag[s.data], s.starts, s.ends) / np.maximum(size, 1))
        ends = at.counts_between(s.data == 10, s.starts, s.ends) + 1
        x[:, 8] = np.log(many / ends + 1)
        same = np.append(False, h[1:] == h[:-1])
        for r, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
            if b - a < 2:
                continue
            x[r, 9] = np.sqrt(np.count_nonzero(same[a + 1 : b]) / (b - a - 1))
            one = np.sort(h[a:b])
            x[r, 10] = np.log1p(np.count_nonzero(one[1:] != one[:-1])) / np.log1p(b - a)
            two = np.sort(h[a : b - 1] * at.U(3) + h[a + 1 : b])
            x[r, 11] = np.sqrt(np.count_nonzero(two[1:] == two[:-1]) / (b - a))
    return out


@dataclass(frozen=True)
class Model:
    """Per class 0 and 1: mean, inverse of the Cholesky factor, and log prior less half the log determinant."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.difference(x) + self.shift)))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, priors included, in tenths and between -50 and 50."""
        density = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.factors[c].T
            density.append(self.offsets[c] - 0.5 * np.einsum("ij,ij->i", z, z))
        return np.round(np.clip(density[1] - density[0], -50, 50), 1)


def fit(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrink: float = 0.1, ridge: float = 0.02) -> Model | None:
    """From each class's count, sums and sums of products; None unless both classes have two rows.

    Covariance: (1 - shrink) own + shrink pooled, then (1 - ridge) of that + ridge times its mean variance times the identity.
    """
    if n.min() < 2:
        return None
    means = sums / n[:, None]
    own = squares / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (own * n[:, None, None]).sum(0) / n.sum()
    factors, offsets = [], []
    for c in (0, 1):
        v = (1 - shrink) * own[c] + shrink * pooled
        v = (1 - ridge) * v + (ridge * np.trace(v) / len(v) + 1e-9) * np.eye(len(v))
        low = np.linalg.cholesky(v)
        factors.append(np.linalg.inv(low))
        offsets.append(np.log(n[c] / n.sum()) - np.log(np.diag(low)).sum())
    return Model(means, np.array(factors), np.array(offsets))


def _rows(docs: DataFrame, key: str, text: str, by: int, out: int) -> tuple[DataFrame, list[str]]:
    """Every row's key, statistics and held_out, as a written table."""
    d = len(FEATURES)
    names = [f"x{i}" for i in range(d)]
    kind = docs.schema[key].dataType.simpleString()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in at.released(batches):
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[:, i]) for i in range(d)]], ["_key", *names])

    schema = f"_key {kind}, " + ", ".join(f"{x} double" for x in names)
    rows = written(docs.select(F.col(key).alias("_key"), F.col(text)).mapInArrow(measured, schema), "statistics")
    return rows.withColumn("held_out", remainder("_key", by) == out), names


def _train(rows: DataFrame, names: list[str], labels: DataFrame, label: str, key: str) -> Model | None:
    """Class moments are summed by Spark over every labelled row that is not held out; the driver gets 182 numbers."""
    d = len(names)
    votes = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.sum(F.col(label)).alias("n1"), F.sum(1 - F.col(label)).alias("n0"))
    train = rows.where(~F.col("held_out")).join(votes, "_key")
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = []
    for c in (0, 1):
        n = F.col(f"n{c}")
        sums += [F.sum(n).cast("double"), *[F.sum(n * F.col(x)) for x in names], *[F.sum(n * F.col(names[i]) * F.col(names[j])) for i, j in pairs]]
    got = np.array([v or 0.0 for v in train.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]).reshape(2, -1)
    squares = np.zeros((2, d, d))
    for k, (i, j) in enumerate(pairs):
        squares[:, i, j] = squares[:, j, i] = got[:, 1 + d + k]
    model = fit(got[:, 0], got[:, 1 : 1 + d], squares)
    if model is None:
        return None

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(d)])
            yield pa.RecordBatch.from_arrays([pa.array(model.difference(x)), b.column(d), b.column(d + 1)], ["x", "n1", "n0"])

    counts = train.select(*names, F.col("n1").cast("long"), F.col("n0").cast("long")).mapInArrow(compared, "x double, n1 long, n0 long")
    counts = counts.groupBy("x").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).toPandas()  # at most 1,001 rows
    return replace(model, **dict(zip(("slope", "shift"), calibrate(*counts.to_numpy(float).T), strict=True)))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", by: int = 4, out: int = 2, least: float = 0.7) -> DataFrame:
    """key, held_out, score, predicted for every row of docs.

    Every labelled row whose crc32(key) mod by is not out counts in the fit. One pass over the texts writes their
    statistics, a narrow table.
    Defined cases: null and empty texts are scored as texts without words; a null key is never labelled; equal keys share
    their labels and repeated rows repeat; conflicting labels count once each; with a class missing every score is 0.5; other
    columns are not read.
    """
    rows, names = _rows(docs, key, text, by, out)
    model = _train(rows, names, labels, label, key)
    kind = docs.schema[key].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(names))])
            p = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= least).astype(np.int32))], [key, "held_out", "score", "predicted"])

    return rows.select("_key", "held_out", *names).mapInArrow(scored, f"{key} {kind}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", by: int = 4, out: int = 2, least: float = 0.7) -> DataFrame:
    """The rows of docs that score least or more, whole: a second pass measures again, so that no text is shuffled.

    That pass sends the text alone to Python and takes a flag back; the rows stay in the JVM. Cases as for classify; without
    a model every row stays.
    """
    rows, names = _rows(docs, key, text, by, out)
    model = _train(rows, names, labels, label, key)
    if model is None:
        return docs

    def good(texts: pa.Array) -> pa.Array:
        kept = model.score(statistics(texts)) >= least
        pa.default_memory_pool().release_unused()
        return pa.array(kept)

    return docs.where(F.arrow_udf(good, "boolean")(F.col(text)))
