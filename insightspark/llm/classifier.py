"""Quality scores learnt from preference pairs (Bradley-Terry), with a threshold at a quantile of the scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insightspark.llm.common import free_name, slices, table_of, text_of

#: Labelled documents used for fitting at most, preference pairs drawn from them, and the strength of the ridge.
SAMPLE_ROWS, PAIRS, RIDGE = 20_000, 200_000, 1e-3
#: Bins of a raw score in which labels are counted for the threshold; raw scores are cut off at this size.
BINS, LARGEST = 1024, 64.0
#: Score at the learnt threshold.
ACCEPT = 0.7
_SYMBOLS, _UPPER, _DIGITS, _MARKS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:!?"


def features(text: str) -> list[float]:
    """Figures of a whole text; nothing but the text goes in."""
    data = text.encode()
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    lines = text.split("\n")
    distinct = len(set(words))
    symbols, upper = share(_SYMBOLS), share(_UPPER)
    return [
        np.log1p(len(words)), min(len(words), 10) / 10, min(len(data) / n, 20.0), min(symbols, 0.3), float(symbols > 0.01), upper, float(upper > 0.3), share(_DIGITS), share(_MARKS),
        min(data.count(b"!") / n, 1.0), distinct / n, np.log(distinct + 1) / np.log(n + 1.5), sum(map(eq, words, words[1:])) / n, (len(lines) - len(set(lines))) / len(lines),
        max(map(len, words), default=0) ** 0.5,
    ]


N_FEATURES = len(features(""))


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.clip((x - self.mean) / self.scale, -10, 10) @ self.weights, -LARGEST, LARGEST)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; exactly ``ACCEPT`` at the threshold."""
        shifted = np.clip(self.raw(x) - self.threshold, -30, 30)
        out = 1 / (1 + np.exp(-shifted) * (1 - ACCEPT) / ACCEPT)
        return np.where(shifted >= 0, np.maximum(out, ACCEPT), np.minimum(out, np.nextafter(ACCEPT, 0)))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 3) -> Ranker:
    """Newton steps on the logistic loss of feature differences (better minus worse).

    The threshold is the :func:`cut` of the rows given. Without both labels nothing can be learnt: all scores are then ``ACCEPT``.
    """
    good, bad = np.nonzero(label == 1)[0], np.nonzero(label == 0)[0]
    if not len(good) or not len(bad):
        return Ranker(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -10, 10)
    draw = np.random.default_rng(seed)
    d = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
        w += step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    ranker = Ranker(mean, scale, w, 0.0)
    bins, quality = np.floor(ranker.raw(x) * BINS).astype(np.int64), np.asarray(label)
    values = np.unique(bins)
    return replace(ranker, threshold=cut(values, *[np.bincount(np.searchsorted(values, bins[quality == q]), minlength=len(values)) for q in (1, 0)]))


def cut(bins: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The score quantile with the best balanced accuracy, from counts of both labels by score bin (ascending; a bin is ``1 / BINS`` wide).

    Of the thousandths of all scores counted, the middle one of the best is taken; its bin's lower edge is the cut.
    """
    both = np.cumsum(good + bad)
    at = np.unique(np.searchsorted(both, np.linspace(0.001, 0.999, 999) * both[-1], side="left"))
    kept_good = 1 - (np.cumsum(good) - good)[at] / max(1, good.sum())
    lost_bad = (np.cumsum(bad) - bad)[at] / max(1, bad.sum())
    balanced = kept_good + lost_bad
    best = bins[at[balanced >= balanced.max() - 1e-12]]
    return float(best[len(best) // 2]) / BINS


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        yield pa.record_batch({"quality": batch.column(0), "x": pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))})


def held_out(doc_id: str) -> F.Column:
    """Rows never learnt from; a NULL id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(True))


def usable_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, quality`` outside the held-out quarter, one row for each id; labels other than 0 and 1 are left out."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    return known.where(F.col("quality").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))


def _binned(ranker: Ranker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            x = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.record_batch({"doc_id": batch.column(0), "bin": pa.array(np.floor(ranker.raw(x) * BINS).astype(np.int64))})

    return run


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = SAMPLE_ROWS) -> Ranker:
    """Weights from at most ``rows`` labelled documents outside the held-out quarter, those first in the order of a hash of
    their id; the threshold from the scores of all labelled documents outside that quarter, counted by bins.

    Labels other than 0 and 1 are left out. Of documents that repeat an id one text is used for the weights, all count for the threshold.
    """
    usable = usable_labels(labels)
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))  # at most ``rows`` short rows are broadcast
    got = sample.select("quality", "text").mapInArrow(_features, "quality int, x array<double>").collect()
    got.sort(key=lambda r: (r.quality, r.x))
    ranker = fit(np.array([r.x for r in got]).reshape(-1, N_FEATURES), np.array([r.quality for r in got]))
    bins = texts.mapInArrow(_binned(ranker), T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("bin", T.LongType())]))
    met = bins.join(usable, "doc_id").groupBy("bin").agg(F.sum("quality").alias("good"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # as many rows as scores have bins
    if not met or not ranker.weights.any():
        return ranker
    at, good, n = (np.array([r[i] for r in met], np.int64) for i in range(3))
    return replace(ranker, threshold=cut(at, good, n - good))


def scored(docs: DataFrame, ranker: Ranker, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with all rows and columns and a score column, whose name is returned (chosen so as not to clash).

    NULL texts count as empty; empty texts are scored like any other; an empty table gives no rows.
    """
    columns = docs.columns
    name = free_name(docs, "score")
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            x = np.array([features(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.record_batch([*batch.columns, pa.array(ranker.score(x))], names=[*columns, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])), name


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the ranker accepts, with exactly their columns."""
    out, name = scored(docs, train(docs, labels))
    return out.where(F.col(name) >= ACCEPT).drop(name)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    out, name = scored(docs, train(docs, table_of(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col(name).alias("score"), (F.col(name) >= ACCEPT).cast("int").alias("predicted"))
