"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically.

Features: densities of a lexicon, nearness of its words to the second person,
capitals, punctuation and obfuscated words.  The lexicon is a short list of
insults plus the words that labelled rows show to be typical of toxic texts in
many different surroundings (so that copies of one text can't teach a word).
Everything is learned from a bounded sample of labelled rows and then applied to
every row; the model that goes to the workers has a fixed largest size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_index, crc_bucket, lean, pick, prepare, row_columns, staged, with_row

FEATURES = (
    "hits", "hit_rate", "distinct_hits", "weight", "weight_rate", "starter_rate", "near_you", "you_rate", "upper", "shouted",
    "exclaims", "marks", "runs", "odd_words", "undone_hits", "log_words",
)
#: Insults that need no labels to be known.
STARTERS = frozenset(b"idiot idiots moron stupid dumb loser scum trash pathetic worthless disgusting imbecile clown".split())
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi vous votre vos du dich dir dein deine ihr euch usted ustedes tus vosotros".split())
_YOU = frozenset(x.encode() for x in SECOND_PERSON)
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: ASCII letters in lower case, ASCII punctuation as spaces.
_PLAIN = bytes(32 if b in _PUNCT else b + 32 if 65 <= b <= 90 else b for b in range(256))
_UPPER = bytes(range(65, 91))
_ODD = re.compile(r"[A-Za-z]+(?:[0-9@$*!|.\-_]+[A-Za-z]+)+")
#: Signs that stand for letters in disguised words.
_UNDO = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None, ".": None, "-": None, "_": None})
_RUN = re.compile(r"([A-Za-z])\1\1+")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_PLAIN).split()


def features(text: str, lexicon: dict[bytes, float]) -> list[float]:
    """The vector of :data:`FEATURES` for a whole text; an empty text has zeros."""
    words = words_of(text)
    m = len(words)
    if not m:
        return [0.0] * len(FEATURES)
    found = [i for i, w in enumerate(words) if w in lexicon]
    distinct = {words[i] for i in found}
    weight = sum(lexicon[words[i]] for i in found)
    starters = sum(words[i] in STARTERS for i in found)
    you = sum(w in _YOU for w in words)
    near = sum(any(w in _YOU for w in words[max(0, i - 4) : i + 5]) for i in found) if you else 0
    raw = text.encode("utf-8", "replace")
    odd = _ODD.findall(text) if any(x in text for x in "0134579@$*!|") else []
    undone = sum(x.lower().translate(_UNDO).encode("utf-8", "replace") in lexicon for x in odd)
    runs = 0
    for x in _RUN.finditer(text):
        runs += 1
    return [
        float(np.log1p(len(found))),
        100.0 * len(found) / m,
        float(len(distinct)),
        float(np.log1p(weight)),
        100.0 * weight / m,
        100.0 * starters / m,
        float(near),
        100.0 * you / m,
        (len(raw) - len(raw.translate(None, _UPPER))) / len(raw),
        len(_SHOUT.findall(text)) / m,
        text.count("!") / m,
        (len(raw) - len(raw.translate(None, _PUNCT))) / len(raw),
        runs / m,
        len(odd) / m,
        float(undone),
        float(np.log1p(m)),
    ]


# --- lexicon ---------------------------------------------------------------


@lean
def _word_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, fold, toxic texts, other texts, surroundings) of one task; surroundings is a set of 62 hashed left neighbours."""
    import xxhash

    stats: dict[tuple[bytes, int], list[int]] = {}
    for batch in batches:
        for text, label, fold in zip(*(batch.column(k).to_pylist() for k in range(3))):
            words = words_of(text or "")
            seen = {}
            for left, w in zip([b"", *words], words):
                if w not in seen:
                    seen[w] = left
            for w, left in seen.items():
                s = stats.setdefault((w, fold), [0, 0, 0])
                if label:
                    s[0] += 1
                    s[2] |= 1 << xxhash.xxh32_intdigest(left) % 62
                else:
                    s[1] += 1
    keys = list(stats)
    for k in range(0, len(keys), 20000):
        part = keys[k : k + 20000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in part], pa.binary()), pa.array([f for _, f in part], pa.int32()), *(pa.array([stats[x][i] for x in part], pa.int64()) for i in range(3))],
            ["word", "fold", "toxic", "other", "around"],
        )


def learn_lexicons(sample: DataFrame, size: int = 2000, least: int = 3, surroundings: int = 3, odds: float = 12.0) -> list[dict[bytes, float]]:
    """Lexicons from fold 0, fold 1 and both, of ``size`` words at most each.

    A word is taken if ``least`` toxic texts hold it, after at least
    ``surroundings`` different words, and if texts that hold it are toxic
    ``odds`` times as often (smoothed) as texts are.
    """
    table = staged(sample.select("text", "label", "fold").mapInArrow(_word_stats, "word binary, fold int, toxic long, other long, around long"), "lexicon")
    totals = {r["fold"]: (r["toxic"] or 0, r["n"] or 0) for r in sample.groupBy("fold").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).collect()}
    out = []
    for folds in ([0], [1], [0, 1]):
        pos = sum(totals.get(f, (0, 0))[0] for f in folds)
        neg = sum(totals.get(f, (0, 0))[1] for f in folds) - pos
        part = table.where(F.col("fold").isin(folds)).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.bit_or("around").alias("around"))
        ratio = ((F.col("toxic") + 0.5) / (pos + 1)) / ((F.col("other") + 0.5) / (neg + 1))
        part = part.where((F.col("toxic") >= least) & (F.bit_count("around") >= surroundings)).withColumn("ratio", ratio).where(F.col("ratio") >= odds)
        best = part.orderBy(F.desc(F.col("ratio") * F.log1p("toxic")), "word").limit(size).collect()
        lexicon = {bytes(r["word"]): float(min(np.log(r["ratio"]), 8.0)) for r in best}
        out.append({**{w: 2.0 for w in STARTERS}, **lexicon})
    return out


# --- trees and calibration -------------------------------------------------


@dataclass
class Trees:
    """Boosted regression trees of one depth, over cut-off features."""

    base: float
    depth: int
    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss, on histograms of quantile bins."""
    n, k = x.shape
    mean = min(max(float(y.mean()) if n else 0.0, 1e-4), 1 - 1e-4)
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, k), np.int64)
    inner, margin = 2**depth - 1, np.full(n, base)
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, node = p - y, p * (1 - p), np.zeros(n, np.int64)
        for d in range(depth):
            first, width = 2**d - 1, 2**d
            local = node - first
            best = np.full(width, 1e-9)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                code = local * bins + codes[:, j]
                gs = np.bincount(code, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(code, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < 1e-3) | (ht - hs < 1e-3)] = -1
                gain = gain[:, : len(e)]
                at = gain.argmax(1)
                for w in range(width):
                    if gain[w, at[w]] > best[w]:
                        best[w] = gain[w, at[w]]
                        feature[t, first + w], cut[t, first + w] = j, e[at[w]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        local = node - inner
        leaf[t] = -rate * np.bincount(local, g, 2**depth) / (np.bincount(local, h, 2**depth) + ridge)
        margin += leaf[t, local]
    return Trees(base, depth, feature, cut, leaf)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending knots and the calibrated values there."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # [first, last, sum, count]
    for m, t in zip(margin[order], y[order]):
        if blocks and blocks[-1][1] == m:
            blocks[-1][2] += t
            blocks[-1][3] += 1
        else:
            blocks.append([m, m, t, 1.0])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, last, s, n = blocks.pop()
            blocks[-1][1] = last
            blocks[-1][2] += s
            blocks[-1][3] += n
    knots, values = [], []
    for first, last, s, n in blocks:
        for m in {first, last}:
            knots.append(m)
            values.append(s / n)
    order = np.argsort(np.array(knots), kind="stable")
    return np.array(knots)[order], np.maximum.accumulate(np.array(values)[order]) if values else np.array(values)


@dataclass
class Model:
    lexicon: dict[bytes, float] = field(default_factory=dict)
    trees: Trees | None = None
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not len(self.knots):
            return np.zeros(len(texts))
        x = np.array([features(t or "", self.lexicon) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))
        return np.interp(self.trees.margin(x), self.knots, self.values)


def _sample_features(lexicons):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, folds = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            # a row's features come from the lexicon of the other fold, as those of new texts will
            rows = [features(t or "", lexicons[1 - f]) for t, f in zip(texts, folds)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "label", "fold"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20000) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, label).

    ``max_labelled`` bounds the rows learned from (those whose hashed ids are
    least), and so what the driver holds: that many short vectors.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int"))
    # at most max_labelled ids
    sample = docs.join(F.broadcast(staged(chosen, "labelled")), "doc_id").groupBy("doc_id", "label", "fold").agg(F.min("text").alias("text")).select("text", "label", "fold")
    sample = staged(sample, "sample")
    lexicons = learn_lexicons(sample)
    rows = sample.mapInArrow(_sample_features(lexicons), "x array<double>, label int, fold int").collect()
    if len({r["label"] for r in rows}) < 2:
        return Model()
    x = np.array([r["x"] for r in rows], dtype=np.float64)
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    fold = np.array([r["fold"] for r in rows])
    order = np.lexsort((*x.T, fold, y))  # the same model, whatever order rows come in
    x, y, fold = x[order], y[order], fold[order]
    margin = np.zeros(len(y))
    for f in (0, 1):
        if (fold == f).any():
            margin[fold == f] = boost(x[fold != f], y[fold != f]).margin(x[fold == f])
    return Model(lexicons[2], boost(x, y), *isotonic(margin, y))


def _score(model):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return run


def _known(labels: DataFrame, holdout: int, rest: int, id_col: str, label_col: str) -> DataFrame:
    return pick(labels, doc_id=id_col, label=label_col).where(crc_bucket(F.col("doc_id"), holdout) != rest).select(F.col("doc_id").cast("long"), "label")


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, holdout: int = 3, rest: int = 1, max_labelled: int = 20000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """``doc_id, held_out, score`` of every row.

    A row is held out if crc32 of its id as text leaves ``rest`` on division by
    ``holdout``; labels of such rows aren't used.  A null text is an empty one,
    which has a score too; a null id stays null and never learns; repeated rows
    each get their score; an id labelled twice counts once (1 wins), and one with
    several texts is learned by the least of them; without labels of both classes
    every score is 0.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    model = spark.sparkContext.broadcast(fit(rows, _known(labels, holdout, rest, id_col, label_col), max_labelled))
    scored = rows.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), holdout) == rest).alias("held_out"), "score")


def _keep(model, threshold: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.score(batch.column(1).to_pylist())
            yield batch.select([0]).filter(pa.array(score < threshold))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, holdout: int = 3, rest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the rows of ``docs`` that score below ``threshold``.

    Scores are those of :func:`toxicity_scores`, for null and empty texts too;
    rows with a null id, repeated rows and extra columns are kept or dropped by
    their text alone; no rows, or no labels of both classes, drop nothing.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    model = spark.sparkContext.broadcast(fit(rows, _known(labels, holdout, rest, id_col, "toxic")))
    column_index(docs, text_col)
    carried = with_row(docs, text=text_col)
    kept = carried.mapInArrow(_keep(model, threshold), carried.select("row").schema)
    return row_columns(kept, docs)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    return toxicity_scores(docs, labels).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
