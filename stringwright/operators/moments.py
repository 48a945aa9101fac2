"""Counts, sums and cross products of numeric columns with gaps, per pattern of gaps; what follows from them.

Rows are read once. Every task adds up outer products of its Arrow batches, one block of numbers per
pattern, and blocks are added as a tree. Pairwise covariances, Little's test and the normal distribution
that imputation draws on need nothing but this table.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringwright.session import settle

#: Numbers of the pattern table that the driver takes; beyond, tasks do its sums.
DRIVER_CELLS = 4_000_000
#: Numbers that a task holds before it passes its blocks on.
HELD_CELLS = 4_000_000
#: Blocks of one pattern are first added up in so many groups.
BRANCHES = 64
ROUNDS = 200
TOLERANCE = 1e-7


def _blocks(shift: np.ndarray, held_cells: int) -> Callable:
    """Per task and pattern: n, sums and cross products (upper triangle) of the columns less ``shift``."""
    k = len(shift)
    upper = np.triu_indices(k)

    def put(held: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        names = ["".join("01"[b] for b in np.unpackbits(np.frombuffer(p, np.uint8), count=k)) for p in held]
        branch = [TaskContext.get().partitionId() % BRANCHES] * len(held)
        cells = pa.array([x.tolist() for x in held.values()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(branch, pa.int32()), cells], ["pattern", "branch", "block"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            gaps = np.isnan(x)
            x = np.where(gaps, 0.0, x - shift)
            patterns, of = np.unique(np.packbits(gaps, axis=1), axis=0, return_inverse=True)
            order = np.argsort(of.ravel(), kind="stable")
            for p, rows in zip(patterns, np.split(x[order], np.cumsum(np.bincount(of.ravel()))[:-1])):
                block = np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows)[upper]])
                key = p.tobytes()
                held[key] = held[key] + block if key in held else block
            if len(held) * (k + 1) ** 2 // 2 > held_cells:
                yield put(held)
                held = {}
        yield put(held)

    return add


def _added(key: list[str]) -> Callable[[pa.Table], pa.Table]:
    def add(group: pa.Table) -> pa.Table:
        blocks = group.column("block").combine_chunks()
        total = blocks.flatten().to_numpy().reshape(len(group), -1).sum(axis=0)
        return group.select(key).slice(0, 1).append_column("block", pa.array([total.tolist()], pa.list_(pa.float64())))

    return add


def pattern_moments(df: DataFrame, cols: list[str], held_cells: int = HELD_CELLS) -> tuple[DataFrame, np.ndarray]:
    """``<pattern, n, s, q>`` per pattern of gaps (1 where null or NaN): rows, sums and cross products of
    the columns less their means, gaps counted as 0; and those means."""
    k = len(cols)
    numbers = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(cols)])
    means = numbers.agg(*[F.avg(c).alias(c) for c in numbers.columns]).first()
    shift = np.array([0.0 if x is None else x for x in means], dtype=float)
    parts = numbers.mapInArrow(_blocks(shift, held_cells), "pattern string, branch int, block array<double>")
    some = parts.groupBy("pattern", "branch").applyInArrow(_added(["pattern"]), "pattern string, block array<double>")
    all_ = some.groupBy("pattern").applyInArrow(_added(["pattern"]), "pattern string, block array<double>")
    table = all_.select(
        "pattern", F.col("block")[0].alias("n"), F.slice("block", 2, k).alias("s"), F.slice("block", k + 2, k * (k + 1) // 2).alias("q")
    )
    return settle(table), shift


class PatternTable:
    """Sums over the pattern table: on the driver while it is small, else in Spark tasks."""

    def __init__(self, table: DataFrame, width: int) -> None:
        self.table = table
        cells = (width + 1) * (width + 2) // 2
        patterns = table.count()
        self.rows = table.collect() if patterns * cells <= DRIVER_CELLS else None

    def total(self, share: Callable, size: int) -> np.ndarray:
        """Sum over patterns of ``share(pattern, n, s, q)``, a vector of ``size`` numbers."""
        if self.rows is not None:
            return sum((share(r["pattern"], r["n"], np.array(r["s"]), np.array(r["q"])) for r in self.rows), np.zeros(size))

        def add(batches):
            for batch in batches:
                rows = batch.itertuples(index=False)
                yield pd.DataFrame({"m": [sum((share(r.pattern, r.n, np.asarray(r.s), np.asarray(r.q)) for r in rows), np.zeros(size))]})

        parts = self.table.mapInPandas(add, "m array<double>").select(F.posexplode("m").alias("i", "x"))
        out = np.zeros(size)
        for r in parts.groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[r["i"]] = r["x"]
        return out


def _seen(pattern: str) -> np.ndarray:
    return np.frombuffer(pattern.encode(), np.uint8) == ord("0")


def _square(upper: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = upper
    return out + np.triu(out, 1).T


def pairwise(table: PatternTable, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean of each column, and covariances and row counts of each pair, over the rows where both are
    present; NaN where there are too few."""
    i, j = np.triu_indices(k)

    def sums(pattern, n, s, q):
        seen = _seen(pattern)
        both = seen[i] & seen[j]
        return np.concatenate([n * both, s[i] * both, s[j] * both, q * both])

    n, si, sj, q = table.total(sums, 4 * len(i)).reshape(4, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = (q - si * sj / n) / (n - 1)
        mean = np.diag(_square(si / n, k))
    return mean, _square(cov, k), _square(n, k)


def pairwise_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """``<a, b, mean_a, mean_b, cov>`` over the rows where both columns are present, one pass."""
    table, shift = pattern_moments(df, cols)
    mean, cov, _ = pairwise(PatternTable(table, len(cols)), len(cols))
    number = lambda x: None if math.isnan(x) else float(x)
    rows = [(cols[i], cols[j], number(mean[i] + shift[i]), number(mean[j] + shift[j]), number(cov[i, j])) for i, j in zip(*np.triu_indices(len(cols)))]
    return df.sparkSession.createDataFrame(rows, "a string, b string, mean_a double, mean_b double, cov double")


def little(table: PatternTable, k: int) -> tuple[float, int]:
    """Statistic and degrees of freedom of Little's test; NaN if a covariance is singular."""
    mean, cov, _ = pairwise(table, k)

    def share(pattern, n, s, q):
        seen = np.flatnonzero(_seen(pattern))
        if not len(seen):
            return np.zeros(2)
        away = s[seen] / n - mean[seen]
        try:
            return np.array([n * float(away @ np.linalg.solve(cov[np.ix_(seen, seen)], away)), len(seen)])
        except np.linalg.LinAlgError:
            return np.array([math.nan, len(seen)])

    d2, seen = table.total(share, 2)
    return float(d2), int(seen) - k


def swept(matrix: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A covariance matrix swept on columns: their rows then hold the regressions of the others on
    them, the rest what these leave unexplained. Columns that others explain wholly are left out;
    the second result are those swept."""
    a, done = matrix.copy(), []
    for j in on:
        pivot = a[j, j]
        if pivot <= 1e-9 * matrix[j, j]:
            continue
        column = a[:, j].copy()
        a -= np.outer(column, column) / pivot
        a[:, j] = a[j, :] = column / pivot
        a[j, j] = -1 / pivot
        done.append(j)
    return a, np.array(done, int)


class Normal:
    """A multivariate normal distribution of the columns, and how its fit ended."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray, rounds: int = 0, settled: bool = True) -> None:
        self.mean, self.cov, self.rounds, self.settled = mean, cov, rounds, settled

    def rule(self, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For rows of a pattern: gaps, predictors, coefficients (predictor, gap), unexplained covariance."""
        seen = _seen(pattern)
        gaps = np.flatnonzero(~seen)
        a, by = swept(self.cov, np.flatnonzero(seen))
        return gaps, by, a[np.ix_(by, gaps)], a[np.ix_(gaps, gaps)]


def fit_normal(table: PatternTable, shift: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Normal:
    """The most likely normal distribution given gaps: a round fills the gaps of every pattern by the
    regressions of the last distribution, all of them from one sweep, and takes the moments anew.

    It ends when means move by less than ``tolerance`` deviations and covariances by less than that
    share of their bound, else after ``rounds`` with a warning and ``settled`` off.
    """
    k = len(shift)
    mean, cov, n = pairwise(table, k)
    now = Normal(np.nan_to_num(mean), np.diag(np.nan_to_num(np.diag(cov))))
    rows = table.total(lambda pattern, n, s, q: np.array([n]), 1)[0]
    if not rows or not (np.diag(n) < rows).any():
        now.cov = np.nan_to_num(cov) if rows else now.cov
        now.mean = now.mean + shift
        return now
    for done in range(1, rounds + 1):

        def share(pattern, n, s, q, now=now):
            gaps, by, beta, left = now.rule(pattern)
            filled, base = np.diag(_seen(pattern).astype(float)), np.zeros(k)
            filled[np.ix_(gaps, by)] = beta.T
            base[gaps] = now.mean[gaps] - beta.T @ now.mean[by]
            first = filled @ s
            second = n * np.outer(base, base) + np.outer(base, first) + np.outer(first, base) + filled @ _square(q, k) @ filled.T
            second[np.ix_(gaps, gaps)] += n * left
            return np.concatenate([n * base + first, second.ravel()])

        sums = table.total(share, k + k * k) / rows
        mean = sums[:k]
        cov = sums[k:].reshape(k, k) - np.outer(mean, mean)
        width = np.sqrt(np.maximum(np.diag(cov), 1e-300))
        moved = max(np.max(np.abs(mean - now.mean) / width), np.max(np.abs(cov - now.cov) / np.outer(width, width)))
        now = Normal(mean, cov, done, bool(moved < tolerance))
        if now.settled:
            break
    if not now.settled:
        warnings.warn(f"the regressions still moved after {rounds} rounds", stacklevel=2)
    now.mean = now.mean + shift
    return now


def fill_normal(df: DataFrame, cols: list[str], normal: Normal, whole: list[str] | None = None) -> DataFrame:
    """Fill nulls of numeric columns with what is expected given the row's other columns, on Arrow
    batches of these columns only. Observed cells never change; filled ones of ``whole`` are rounded."""
    rounded = [i for i, c in enumerate(cols) if c in (whole or [])]

    def fill(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules: dict[str, tuple] = {}
        for block in blocks:
            x = block.to_numpy(dtype=float, na_value=np.nan)
            gaps = np.isnan(x)
            patterns, of = np.unique(gaps, axis=0, return_inverse=True)
            for p, bits in enumerate(patterns):
                if not bits.any():
                    continue
                name = "".join("01"[int(b)] for b in bits)
                if len(rules) * len(bits) ** 2 > HELD_CELLS:
                    rules.clear()
                rules[name] = rules.get(name) or normal.rule(name)
                at, by, beta, _ = rules[name]
                rows = np.flatnonzero(of.ravel() == p)
                x[np.ix_(rows, at)] = normal.mean[at] + (x[np.ix_(rows, by)] - normal.mean[by]) @ beta
            for j in rounded:
                x[gaps[:, j], j] = np.round(x[gaps[:, j], j])
            yield pd.DataFrame(x, columns=block.columns)

    schema = ", ".join(f"c{i} double" for i in range(len(cols)))
    filled = F.pandas_udf(fill, schema)
    packed = F.struct(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    done = df.withColumn("_filled", filled(packed))
    place = {c: i for i, c in enumerate(cols)}
    return done.select(
        *[F.coalesce(F.col(c).cast("double"), F.col("_filled")[f"c{place[c]}"]).alias(c) if c in place else F.col(c) for c in df.columns]
    )
