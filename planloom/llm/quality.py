"""A quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.statistics import NAMES, held_out, labelled_sample, statistics
from planloom.llm.words import byte_rows

# Labelled documents learned from, at most.
SAMPLE = 30_000
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.2
# Added to a leaf's curvature, and the least curvature of a leaf.
SMOOTHING = 1.0
LEAST_WEIGHT = 2.0


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays: tree t's node n has the children 2n + 1 and 2n + 2 and sits at [t, n]."""

    start: float
    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: every row goes down all trees at once, a level at a time."""
        trees = np.arange(len(self.features))[None, :]
        node = np.zeros((len(rows), len(self.features)), dtype=np.int64)
        line = np.arange(len(rows))[:, None]
        for _ in range(DEPTH):
            above = rows[line, self.features[trees, node]] > self.thresholds[trees, node]
            node = 2 * node + 1 + above
        margin = self.start + self.values[trees, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fitted(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Trees for the logistic loss, grown level by level on histograms of gradients. Without both labels they are all constant."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    mean = (labels.sum() + 0.5) / (len(labels) + 1)
    start = float(np.log(mean / (1 - mean)))
    count = TREES if 0 < labels.sum() < len(labels) else 0
    features = np.zeros((count, inner), dtype=np.int64)
    thresholds = np.full((count, inner), np.inf)
    values = np.zeros((count, leaves))
    if count == 0:
        return Trees(start, features, thresholds, values)

    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in rows.T]
    bins = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.T, strict=True)])
    cells = bins + np.arange(rows.shape[1]) * BINS
    margin = np.full(len(labels), start)
    for tree in range(count):
        chance = 1 / (1 + np.exp(-margin))
        slope, curve = labels - chance, chance * (1 - chance)
        node = np.zeros(len(labels), dtype=np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * rows.shape[1] * BINS + cells).ravel()
            shape, size = (width, rows.shape[1], BINS), width * rows.shape[1] * BINS
            slopes = np.bincount(at, np.repeat(slope, rows.shape[1]), size).reshape(shape).cumsum(axis=2)
            curves = np.bincount(at, np.repeat(curve, rows.shape[1]), size).reshape(shape).cumsum(axis=2)
            gain = _gain(slopes, curves)
            for place in range(width):
                best = int(gain[place].argmax())
                feature, cut = divmod(best, BINS)
                if gain[place, feature, cut] > 1e-6 and cut < len(edges[feature]):
                    features[tree, first + place], thresholds[tree, first + place] = feature, edges[feature][cut]
            above = rows[np.arange(len(rows)), features[tree, node]] > thresholds[tree, node]
            node = 2 * node + 1 + above
        leaf = node - inner
        values[tree] = RATE * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, curve, leaves) + SMOOTHING)
        margin += values[tree, leaf]
    return Trees(start, features, thresholds, values)


def _gain(slopes: np.ndarray, curves: np.ndarray) -> np.ndarray:
    """What a split after each bin gains, from running sums over bins; splits that leave too little on a side gain nothing."""
    all_slope, all_curve = slopes[:, :, -1:], curves[:, :, -1:]
    score = lambda s, c: s * s / (c + SMOOTHING)
    gain = score(slopes, curves) + score(all_slope - slopes, all_curve - curves) - score(all_slope, all_curve)
    enough = (curves >= LEAST_WEIGHT) & (all_curve - curves >= LEAST_WEIGHT)
    return np.where(enough, gain, 0.0)


def _scored(batches: Iterator[pa.RecordBatch], trees: Trees) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(data) for data in byte_rows(batch.column("text"))], dtype=np.float64)
        scores = trees.scores(rows.reshape(batch.num_rows, len(NAMES)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted for each row of `docs` (doc_id, text).

    Labels (`labels`: doc_id and `label`) are learned from at most SAMPLE documents, never from the held-out third. Null and empty texts
    are scored as texts without words. Where usable labels are missing or all alike, all scores are their
    smoothed mean, 0.5 for none. Repeated rows and null doc_ids, never held out, are rows as any other. Other columns are ignored.
    """
    trees = fitted(*labelled_sample(docs, labels, label, SAMPLE))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = rows.mapInArrow(lambda batches: _scored(batches, trees), "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
