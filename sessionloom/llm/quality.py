"""Document quality by regularised quadratic discriminant analysis.

Each text gives a vector of statistics, transformed so that they are nearer to
normal.  Every class has a mean and a covariance, shrunk toward the pooled one
and toward its own diagonal; a score is the logistic of the difference of the
two log densities (Mahalanobis distance and log determinant), plus that of the
log priors.  Cholesky factors are computed once and sent to the workers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, lean, pick, prepare, staged

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_spread", "upper", "digits", "symbols", "bars", "marks", "exclaims",
    "lines", "distinct_words", "commonest_word", "adjacent_repeats", "distinct_triples", "repeated_lines",
)
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_SYMBOLS = b"*#%&$^~<>{}[]\\=+_@/"
_MARKS = b".,;:?"


def _rate(n: float, total: float) -> float:
    """A share, on a scale that spreads out small shares."""
    return float(np.log1p(1000.0 * n / total)) if total else 0.0


def statistics(text: str) -> list[float]:
    """The vector of :data:`FEATURES` for a whole text; an empty text has zeros."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)

    def count(chars: bytes) -> int:
        return n - len(raw.translate(None, chars))

    words = raw.lower().split()
    m = len(words)
    upper, lower = count(_UPPER), count(_LOWER)
    lengths = np.fromiter(map(len, words), np.int64, m)
    common = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    # hashed words: repeats of neighbours and of word triples
    h = np.fromiter(map(hash, words), np.int64, m)
    adjacent = int((h[1:] == h[:-1]).sum()) if m > 1 else 0
    triples = h[2:] * 31 + h[1:-1] * 17 + h[:-2] if m > 2 else h
    distinct = len(np.unique(triples)) / len(triples) if len(triples) else 1.0
    return [
        float(np.log1p(n)),
        float(np.log1p(m)),
        float(np.log1p(lengths.mean())) if m else 0.0,
        float(np.log1p(lengths.std())) if m else 0.0,
        float(np.log1p(100.0 * upper / (upper + lower))) if upper + lower else 0.0,
        _rate(count(_DIGITS), n),
        _rate(count(_SYMBOLS), n),
        _rate(raw.count(b"|"), n),
        _rate(count(_MARKS), n),
        _rate(raw.count(b"!"), n),
        _rate(len(lines), n),
        float(np.log(len(common) / m)) if m else 0.0,
        _rate(common.most_common(1)[0][1], m) if m else 0.0,
        _rate(adjacent, m),
        float(np.log(max(distinct, 1e-3))),
        _rate(len(lines) - len(set(lines)), len(lines)),
    ]


@lean
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(x or "") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])


@lean
def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one task for each class: count, vector and outer product, as (label, place, value)."""
    k = len(FEATURES)
    sums = {0: np.zeros(1 + k + k * k), 1: np.zeros(1 + k + k * k)}
    for batch in batches:
        if batch.num_rows:
            y = batch.column(0).to_numpy()
            x = np.array(batch.column(1).to_pylist(), dtype=np.float64)
            for label in (0, 1):
                z = x[y == label]
                sums[label] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
    for label, values in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([label] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()), pa.array(values)], ["label", "place", "value"]
        )


@dataclass
class Model:
    """Per class: log prior less half the log determinant, mean, inverse Cholesky factor."""

    constants: tuple[float, float]
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        g = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for c, m, f in zip(self.constants, self.means, self.factors)]
        return 1.0 / (1.0 + np.exp(-np.clip((g[1] - g[0]) / self.temperature, -500, 500)))


def fit(features: DataFrame, labels: DataFrame, pooled: float = 0.05, diagonal: float = 0.05, temperature: float = 2.0) -> Model | None:
    """Fit on rows of ``features`` (doc_id, x) with a label (doc_id, label).

    Covers every labelled row: tasks send sums, which add up to two small
    matrices.  ``pooled`` and ``diagonal`` are the shares of the two targets of
    shrinkage.  None if a class has no rows.
    """
    known = labels.where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    joined = features.join(known, "doc_id").select("label", "x")
    sums = {0: {}, 1: {}}
    for r in joined.mapInArrow(_moments, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        sums[r["label"]][r["place"]] = r["value"]
    k = len(FEATURES)
    v = [np.array([sums[c].get(i, 0.0) for i in range(1 + k + k * k)]) for c in (0, 1)]
    n = [x[0] for x in v]
    if min(n) < 1:
        return None
    means = [x[1 : 1 + k] / x[0] for x in v]
    scatter = [x[1 + k :].reshape(k, k) - x[0] * np.outer(m, m) for x, m in zip(v, means)]
    within = (scatter[0] + scatter[1]) / max(sum(n) - 2, 1)
    floor = 1e-2 * np.diag(within).mean() + 1e-6
    constants, factors = [], []
    for c in (0, 1):
        own = scatter[c] / max(n[c] - 1, 1)
        cov = (1 - pooled - diagonal) * own + pooled * within + diagonal * np.diag(np.diag(own)) + floor * np.eye(k)
        lower = np.linalg.cholesky(cov)
        constants.append(float(np.log(n[c] / sum(n)) - np.log(np.diag(lower)).sum()))
        factors.append(np.linalg.inv(lower))
    return Model(tuple(constants), tuple(means), tuple(factors), temperature)


def _score(model):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), dtype=np.float64)
                score = model.value.score(x) if model.value else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, holdout: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id, held_out, score`` of every row; learns from labels that aren't held out.

    A row is held out if crc32 of its id as text is divisible by ``holdout``.  A
    null text is an empty one, which has a score too; a null id stays null and
    never learns; repeated rows each get their score; repeated labels of an id
    count once (1 wins); without labels of both classes every score is 0.
    """
    spark = docs.sparkSession
    prepare(spark)
    features = staged(pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(_features, "doc_id long, x array<double>"), "quality")
    known = pick(labels, doc_id=id_col, label=label_col).where(F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), holdout) != 0))
    model = spark.sparkContext.broadcast(fit(features, known))  # two matrices
    scored = features.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), holdout) == 0).alias("held_out"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    return quality_scores(docs, labels).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def held_out(doc_id: int, modulus: int) -> bool:
    """The hold-out rule in Python."""
    return zlib.crc32(str(doc_id).encode()) % modulus == 0
