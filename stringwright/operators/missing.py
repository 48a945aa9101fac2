"""Missing values: nulling tokens, row deletion, Little's test and imputation.

Everything that needs the whole table is reduced in Spark to one row per missing-value
pattern (count, sums and cross products of the observed columns). Little's test and the
regression imputer work on that table, so their rounds never touch the rows again.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringwright import constants as K
from stringwright.operators.moments import Normal, PatternTable, fill_normal, fit_normal, little, pairwise_moments, pattern_moments
from stringwright.operators.values import join_map, rank_values, small_enough, value_table
from stringwright.session import settle


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def tokens_to_null(df: DataFrame, tokens: dict[str, list[str]]) -> DataFrame:
    """Texts standing for a missing value become null, per column."""
    return df.select(
        *[
            F.when(~F.col(c).isin(tokens[c]), F.col(c)).alias(c) if tokens.get(c) else F.col(c)
            for c in df.columns
        ]
    )


def any_null(cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def incomplete_ratio(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row: the share of rows with any null."""
    return df.agg(F.avg(any_null(cols or df.columns).cast("double")).alias("ratio"))


def drop_incomplete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=cols)


def needs_code(df: DataFrame, types: dict[str, str], cols: list[str]) -> list[str]:
    """Columns to be coded for imputation: all but numbers of a plain data type."""
    numeric = {"integer", "long", "short", "byte", "double", "float"}
    return [
        c
        for c in cols
        if types.get(c) not in K.NUMERIC_TYPES or df.schema[c].dataType.typeName() not in numeric
    ]


def rank_maps(df: DataFrame, cols: list[str]) -> DataFrame:
    """``<col, value, n, code>``: rank of every non-null text among the sorted texts of its column."""
    return rank_values(value_table(df, cols), ["col"], [F.col("value")], "code")


def rank_encode(df: DataFrame, cols: list[str], maps: DataFrame) -> DataFrame:
    """Replace texts by their rank as doubles; nulls stay null."""

    small = bool(cols) and small_enough(maps)

    def one(frame: DataFrame, col: str) -> DataFrame:
        mapping = maps.where(F.col("col") == col).select(
            F.col("value").alias(col), F.col("code").cast("double").alias("_code")
        )
        text = frame.withColumn(col, F.col(col).cast("string"))
        return join_map(text, col, mapping, small=small or None).select(
            *[F.col("_code").alias(c) if c == col else F.col(c) for c in frame.columns]
        )

    return reduce(one, cols, df)


def decode_nearest(df: DataFrame, cols: list[str], maps: DataFrame) -> DataFrame:
    """Ranks back to texts; a number between ranks goes to the nearest, halves down."""

    small = bool(cols) and small_enough(maps)
    tops = {r["col"]: r["top"] for r in maps.groupBy("col").agg(F.max("code").alias("top")).collect()} if cols else {}

    def one(frame: DataFrame, col: str) -> DataFrame:
        mapping = maps.where(F.col("col") == col).select(F.col("code").alias("_code"), F.col("value").alias("_value"))
        top = tops.get(col)
        near = F.ceil(F.col(col) - 0.5)
        inside = F.greatest(F.lit(0), F.least(near, F.lit(top))).cast("bigint")
        coded = frame.withColumn("_code", F.when(F.col(col).isNotNull(), inside))
        return join_map(coded, "_code", mapping, small=small or None).select(
            *[F.col("_value").alias(c) if c == col else F.col(c) for c in frame.columns]
        )

    return reduce(one, cols, df)


def missing_patterns(df: DataFrame, cols: list[str]) -> DataFrame:
    """``<pattern, n, mean_<col>...>``: rows and means of the observed columns per pattern, one character
    per column: 1 where null."""
    table, shift = pattern_moments(df, cols)
    seen = lambda i: F.substring("pattern", i + 1, 1) == "0"
    means = [F.when(seen(i), F.col("s")[i] / F.col("n") + float(x)).alias(f"mean_{c}") for i, (c, x) in enumerate(zip(cols, shift))]
    return table.select("pattern", F.col("n").cast("bigint").alias("n"), *means)


def chi_square_tail(x: float, dof: float) -> float:
    """P(chi2 > x) by the series or continued fraction of the incomplete gamma function."""
    if x <= 0 or dof <= 0:
        return 1.0
    a, x = dof / 2.0, x / 2.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    b, c = x + 1 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return min(1.0, h * scale)


def _tested(table: PatternTable, k: int) -> tuple[float, int, float | None]:
    d2, dof = little(table, k)
    return d2, dof, None if math.isnan(d2) else chi_square_tail(d2, dof)


def mcar_test(df: DataFrame, cols: list[str]) -> DataFrame:
    """Little's test that values are missing completely at random: one row ``<d2, dof, p>``.
    Singular covariances give a null p."""
    table, _ = pattern_moments(df, cols)
    d2, dof, p = _tested(PatternTable(table, len(cols)), len(cols))
    return df.sparkSession.createDataFrame(
        [(None if math.isnan(d2) else d2, dof, p)], "d2 double, dof bigint, p double"
    )


def column_fill(df: DataFrame, types: dict[str, str], cols: list[str]) -> DataFrame:
    """``<col, fill>``: the commonest text (ties: smallest), or the mean for numeric columns."""
    texts = needs_code(df, types, cols)
    numbers = [c for c in cols if c not in texts]
    fills = None
    if texts:
        best = F.min(F.struct((-F.col("n")).alias("rank"), F.col("value")))
        fills = value_table(df, texts).groupBy("col").agg(best["value"].alias("fill"))
    if numbers:
        means = df.agg(*[F.avg(c).cast("string").alias(c) for c in numbers]).unpivot([], numbers, "col", "fill")
        fills = means if fills is None else fills.unionByName(means)
    return fills


def impute_mode_mean(df: DataFrame, types: dict[str, str], cols: list[str] | None = None) -> DataFrame:
    """Fill nulls with the mode of text columns and the mean of numeric ones."""
    cols = cols or df.columns
    fills = {r["col"]: r["fill"] for r in column_fill(df, types, cols).collect()}
    return fill_nulls(df, fills)


def fill_nulls(df: DataFrame, fills: dict[str, str]) -> DataFrame:
    out = []
    for field in df.schema.fields:
        value = fills.get(field.name)
        if value is None:
            out.append(F.col(field.name))
            continue
        kind = field.dataType.typeName()
        if kind in ("integer", "long", "short", "byte"):
            filler = F.round(F.lit(float(value))).cast(field.dataType)
        else:
            filler = F.lit(value).cast(field.dataType)
        out.append(F.coalesce(F.col(field.name), filler).alias(field.name))
    return df.select(*out)


def impute_iterative(df: DataFrame, cols: list[str], whole: list[str] | None = None, **options) -> DataFrame:
    """Fill the nulls of numeric columns by iterated regressions on the other columns."""
    table, shift = pattern_moments(df, cols)
    return fill_normal(df, cols, fit_normal(PatternTable(table, len(cols)), shift, **options), whole)


class MissingPlan:
    """What to do about missing values, decided once on the data it is fitted to."""

    def __init__(self, strategy: str, cols: list[str]) -> None:
        self.strategy = strategy
        self.cols = cols
        self.p_value: float | None = None
        self.fills: dict[str, str] = {}
        self.coded: list[str] = []
        self.maps: DataFrame | None = None
        self.normal: Normal | None = None
        self.whole: list[str] = []

    def transform(self, df: DataFrame) -> DataFrame:
        if self.strategy == "none":
            return df
        if self.strategy == "drop":
            return drop_incomplete(df, self.cols)
        if self.strategy == "mode_mean":
            return fill_nulls(df, self.fills)
        # what was observed rides along and comes back as it was; a text that has no code is only
        # left out of the regressions
        kept = df.withColumn("_seen", F.struct(*[F.col(c) for c in self.cols]))
        coded = rank_encode(kept, self.coded, self.maps)
        filled = fill_normal(coded, self.cols, self.normal, self.whole)
        decoded = decode_nearest(filled, self.coded, self.maps)
        return decoded.select(
            *[
                F.coalesce(F.col(f"_seen.{c}"), F.col(c).cast(df.schema[c].dataType)).alias(c)
                if c in self.cols
                else F.col(c)
                for c in df.columns
            ]
        )


def plan_missing(df: DataFrame, types: dict[str, str], cols: list[str] | None = None) -> MissingPlan:
    """Choose by the share of incomplete rows and Little's test, as the thresholds say:
    few incomplete rows are dropped; values missing at random get mode or mean; others,
    and tables the test cannot handle, get iterated regressions."""
    cols = cols or df.columns
    ratio = incomplete_ratio(df, cols).first()[0]
    if not ratio:
        return MissingPlan("none", cols)
    if ratio < K.MISSING_ROWS_RATIO:
        return MissingPlan("drop", cols)

    coded_cols = needs_code(df, types, cols)
    maps = settle(rank_maps(df, coded_cols)) if coded_cols else None
    moments, shift = pattern_moments(rank_encode(df, coded_cols, maps).select(*cols), cols)
    table = PatternTable(moments, len(cols))
    _, _, p = _tested(table, len(cols))
    plan = MissingPlan("regression", cols)
    plan.p_value = p
    if p is not None and p >= K.MCAR_P_VALUE:
        plan.strategy = "mode_mean"
        plan.fills = {r["col"]: r["fill"] for r in column_fill(df, types, cols).collect()}
        return plan
    plan.coded, plan.maps = coded_cols, maps
    plan.normal = fit_normal(table, shift)
    whole_types = {"integer", "long", "short", "byte"}
    plan.whole = coded_cols + [c for c in cols if df.schema[c].dataType.typeName() in whole_types]
    return plan


