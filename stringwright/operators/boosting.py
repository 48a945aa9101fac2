"""Many small boosted-tree models at once, for evaluation by folds and grids.

Every fold is a group of its own: the rows it learns from and those it is asked about. Within a fold
the models of all step sizes grow in lockstep: a tree level is one count and one sum per (model, node,
bin) and feature, whatever the number of models. A model of fewer trees is a beginning of one of more,
so each fold is fitted once for all tree counts. The rules are those of the library's gradient-boosted
classifier: log loss on -1 and 1, variance gain, cuts at equal shares, a first tree of weight one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32


def cuts_of(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cuts halfway between neighbouring values: all of them if they are fewer than ``bins``, else
    where the running count passes from nearer below a multiple of its share to nearer above."""
    seen, counts = np.unique(values, return_counts=True)
    middle = (seen[:-1] + seen[1:]) / 2
    most = min(bins, len(values)) - 1
    if len(middle) <= most:
        return middle
    upto = np.cumsum(counts)
    passing = (upto[:-1] + upto[1:]) / 2
    share, at, found = len(values) / (most + 1), -1, []
    while (at := max(int(np.searchsorted(passing, share * (len(found) + 1), "right")), at + 1)) < len(passing):
        found.append(at)
    return middle[found]


def _best_splits(bins: np.ndarray, widths: list[int], slot: np.ndarray, slots: int, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature and last left bin of the best split of every slot (model and node); the first among
    equals, and past the last bin, which leaves all rows left, if nothing is gained."""
    best = np.zeros(slots)
    feature, edge = np.zeros(slots, np.int64), np.full(slots, BINS + 1)
    for f, width in enumerate(widths):
        if width < 2:
            continue
        key = (slot * width + bins[f]).ravel()
        n = np.cumsum(np.bincount(key, minlength=slots * width).reshape(slots, width), axis=1)
        total = np.cumsum(np.bincount(key, rest.ravel(), slots * width).reshape(slots, width), axis=1)
        left, right = n[:, :-1], n[:, -1:] - n[:, :-1]
        both = (left > 0) & (right > 0)
        low, all_, count = total[:, :-1], total[:, -1:], n[:, -1:]
        gain = low**2 / np.maximum(left, 1) + (all_ - low) ** 2 / np.maximum(right, 1) - all_**2 / np.maximum(count, 1)
        gain = np.where(both, gain / np.maximum(count, 1), 0.0)
        at = gain.argmax(axis=1)
        top = gain[np.arange(slots), at]
        better = top > best + 1e-12
        best[better], feature[better], edge[better] = top[better], f, at[better]
    return feature, edge


def lockstep(x: np.ndarray, y: np.ndarray, asked: np.ndarray, steps: list[float], trees: list[int], depth: int) -> np.ndarray:
    """Raw scores (step, tree count, asked row) of models fitted on rows ``x`` with labels ``y`` of -1 and 1."""
    cuts = [cuts_of(column) for column in x.T]
    widths = [len(c) + 1 for c in cuts]
    bins, asked_bins = (np.array([np.searchsorted(c, v) for c, v in zip(cuts, rows.T)]).reshape(len(cuts), len(rows)) for rows in (x, asked))
    models = np.arange(len(steps))[:, None]
    score, asked_score = np.zeros((len(steps), len(x))), np.zeros((len(steps), len(asked)))
    at, asked_at = np.arange(len(x))[None, :], np.arange(len(asked))[None, :]
    found = np.zeros((len(steps), len(trees), len(asked)))
    for tree in range(1, max(trees) + 1):
        rest = 4 * y / (1 + np.exp(2 * y * score)) if tree > 1 else np.broadcast_to(y, score.shape)
        slot, asked_slot = np.broadcast_to(models, score.shape), np.broadcast_to(models, asked_score.shape)
        slots = len(steps)
        for _ in range(depth):
            feature, edge = _best_splits(bins, widths, slot, slots, rest)
            slot = 2 * slot + (bins[feature[slot], at] > edge[slot])
            asked_slot = 2 * asked_slot + (asked_bins[feature[asked_slot], asked_at] > edge[asked_slot])
            slots *= 2
        n = np.bincount(slot.ravel(), minlength=slots)
        leaf = np.bincount(slot.ravel(), rest.ravel(), slots) / np.maximum(n, 1)
        weight = np.ones((len(steps), 1)) if tree == 1 else np.array(steps)[:, None]
        score += weight * leaf[slot]
        asked_score += weight * leaf[asked_slot]
        for k, count in enumerate(trees):
            if count == tree:
                found[:, k] = asked_score
    return found


def held_out_scores(
    rows: DataFrame, features: list[str], fold: str, folds: int, steps: list[float], trees: list[int], depth: int
) -> DataFrame:
    """The rows with ``step``, ``trees``, ``score`` (probability of label 1) and ``prediction`` by models
    that have learnt from all other folds: one row per step and tree count.

    A fold is one task: its bins, one number per row and feature, and a score per row and step. A fold
    without other rows to learn from gives score 0.5 and prediction 0; null features count as 0.
    """
    names = rows.columns
    out = rows.withColumn("step", F.lit(0.0)).withColumn("trees", F.lit(0)).withColumn("score", F.lit(0.0)).withColumn("prediction", F.lit(0)).schema

    def fit(group: pa.Table) -> pa.Table:
        held = group.column("_held").to_numpy(zero_copy_only=False)
        x = np.stack([group.column(c).cast(pa.float64()).fill_null(0).to_numpy() for c in features], axis=1)
        y = group.column("label").cast(pa.float64()).to_numpy() * 2 - 1
        n = int(held.sum())
        raw = np.zeros((len(steps), len(trees), n)) if held.all() else lockstep(x[~held], y[~held], x[held], steps, trees, depth)
        own = group.select(names).filter(pa.array(held))
        copies = own.take(pa.array(np.tile(np.arange(n), len(steps) * len(trees))))
        added = {
            "step": np.repeat(np.array(steps, float), len(trees) * n),
            "trees": np.tile(np.repeat(np.array(trees, np.int32), n), len(steps)),
            "score": (1 / (1 + np.exp(-2 * raw))).ravel(),
            "prediction": (raw > 0).astype(np.int32).ravel(),
        }
        for name, column in added.items():
            copies = copies.append_column(name, pa.array(column))
        return copies

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = rows.withColumn("_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("_held", F.col("_fold") == F.col(fold))
    # fitting takes far longer than the few bytes of a fold suggest: keep it parallel
    return every.repartition(parts, "_fold").groupBy("_fold").applyInArrow(fit, out)
