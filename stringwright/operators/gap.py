"""Gamma-Poisson factorisation of the n-gram counts of texts.

The count of n-gram ``g`` in text ``v`` is Poisson with mean ``sum_k h[v, k] * w[k, g]``; the weights
``h`` of a text have a gamma prior, the n-grams of a topic ``w`` sum to one. Each round shares every
count out among the topics in proportion to ``h * w`` and sums the shares up per text and per n-gram;
both sides follow from these sums, and the objective cannot rise. Counts stay a sparse table.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringwright.functions import text as X
from stringwright.operators.values import BROADCAST_BYTES
from stringwright.session import settle, stored

SHAPE = 1.1
SCALE = 1.0
ROUNDS = 200
TOLERANCE = 1e-4


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def start_weights(cells: DataFrame, topics: int, seed: int) -> DataFrame:
    """``<gram, w0, w1, ...>``: counts of every n-gram times numbers fixed by n-gram, topic and seed,
    squares of exponential deviates, so that topics start far apart."""
    counts = cells.groupBy("gram").agg(F.sum("x").alias("n"))
    unit = lambda k: F.pow(F.log((X.hash32(F.concat_ws("|", F.lit(str(seed)), F.lit(str(k)), "gram")) + 1) / 4294967296), 2)
    return counts.select("gram", *[(F.col("n") * unit(k)).alias(f"w{k}") for k in range(topics)])


class Factors:
    """Weights of texts, and what the rounds did to the objective."""

    def __init__(self, weights: DataFrame, objectives: list[float], settled: bool) -> None:
        self.weights, self.objectives, self.settled = weights, objectives, settled


def factorise(
    cells: DataFrame, topics: int, seed: int = 1, rounds: int = ROUNDS, tolerance: float = TOLERANCE, shape: float = SHAPE, scale: float = SCALE
) -> Factors:
    """Factors of ``<value, gram, x>``: weights ``<value, h0, h1, ...>`` after the round in which the
    objective fell by less than ``tolerance`` of itself, or after ``rounds`` of them.

    The weights of a text sum to (its count + topics * (shape - 1)) / (1 + 1 / scale). Each side is sent
    to all tasks while its size, counted once, allows it; else rows meet it by a shuffled join.
    """
    ks = range(topics)
    cells = settle(cells)
    w = settle(start_weights(cells, topics, seed))
    h = settle(cells.select("value").distinct().select("value", *[F.lit(1.0).alias(f"h{k}") for k in ks]))
    bytes_of = lambda side, key: side.agg(F.sum(F.octet_length(key)) + F.count(F.lit(1)) * (8 * topics + 32)).first()[0] or 0
    few_texts, few_grams = (bytes_of(side, key) <= BROADCAST_BYTES for side, key in ((h, "value"), (w, "gram")))

    def totals(step: DataFrame) -> list[float]:
        found = step.agg(*[F.sum(f"w{k}") for k in ks]).first()
        return [x or 1.0 for x in found]

    sums, prior, objectives = totals(w), None, []
    for _ in range(rounds):
        now = w.select("gram", *[(F.col(f"w{k}") / F.lit(sums[k])).alias(f"w{k}") for k in ks])
        met = cells.join(F.broadcast(h) if few_texts else h, "value").join(F.broadcast(now) if few_grams else now, "gram")
        part = [F.col(f"h{k}") * F.col(f"w{k}") for k in ks]
        met = met.withColumn("mean", _sum(part))
        shared = [F.sum(F.col("x") / F.col("mean") * part[k]).alias(f"s{k}") for k in ks]
        step = stored(met.groupingSets([["value"], ["gram"]], "value", "gram").agg(*shared, F.sum(F.col("x") * F.log("mean")).alias("fit")))
        by_text = F.col("value").isNotNull()
        weights = [((F.col(f"s{k}") + (shape - 1)) / (1 + 1 / scale)).alias(f"h{k}") for k in ks]
        h, w = step.where(by_text).select("value", *weights), step.where(~by_text).select("gram", *[F.col(f"s{k}").alias(f"w{k}") for k in ks])
        held = _sum([(1 + 1 / scale) * x - (shape - 1) * F.log(x) for x in weights])
        found = step.agg(
            F.sum(F.when(by_text, F.col("fit"))).alias("fit"), F.sum(F.when(by_text, held)).alias("prior"),
            *[F.sum(F.when(~by_text, F.col(f"s{k}"))).alias(f"w{k}") for k in ks],
        ).first()
        if found["fit"] is None:
            return Factors(h, objectives, True)
        if prior is None:
            prior = cells.select("value").distinct().count() * topics * (1 + 1 / scale)
        objectives.append(prior - found["fit"])
        prior, sums = found["prior"], [found[f"w{k}"] or 1.0 for k in ks]
        if len(objectives) > 1 and objectives[-2] - objectives[-1] <= tolerance * abs(objectives[-2]):
            return Factors(h, objectives, True)
    warnings.warn(f"the factorisation still moved after {rounds} rounds", stacklevel=2)
    return Factors(h, objectives, False)


def weights_of(values: DataFrame, tokens: Column, topics: int, seed: int = 1, **options) -> DataFrame:
    """``<value, code>``: the topic weights of distinct texts by their n-grams ``tokens``. A text without
    any has the weights that the prior alone gives."""
    cells = values.select("value", F.explode(tokens).alias("gram")).groupBy("value", "gram").agg(F.count(F.lit(1)).cast("double").alias("x"))
    factors = factorise(cells, topics, seed, **options)
    shape, scale = options.get("shape", SHAPE), options.get("scale", SCALE)
    code = F.array(*[F.col(f"h{k}") for k in range(topics)])
    bare = F.array(*[F.lit((shape - 1) / (1 + 1 / scale))] * topics)
    none = values.select("value", F.size(tokens).alias("_n")).where("_n = 0").select("value", bare.alias("code"))
    return settle(factors.weights.select("value", code.alias("code")).unionByName(none))
