"""Column type inference.

A column's score for a type is the log-probability of its texts under that type. The
probability of a text depends only on which recognisers accept it and on its length, so
texts are counted per (column, accepted types, length): a small table whatever the number
of distinct texts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringwright import constants as K
from stringwright.functions.recognise import TYPES, WORD_LISTS, looks_like
from stringwright.operators.values import long_form, string_columns

IMPOSSIBLE = -1e9
SHORT_TEXT = 64


class TypeRegistry:
    """The recognisers in use; ``register`` adds one for user-defined texts."""

    def __init__(self) -> None:
        self.tests = {t: (lambda v, t=t: looks_like(v, t)) for t in TYPES}
        self.alphabet = dict(K.ALPHABET)
        self.features = list(K.FEATURE_TYPES)
        self.processors: dict = {}

    def register(self, name: str, pattern: str, alphabet: float, processor=None) -> None:
        """Add a type: a whole-text pattern, its alphabet size and an optional
        ``Column -> Column`` processing rule."""
        anchored = rf"\A(?:{pattern})\z"
        self.tests[name] = lambda v: v.rlike(anchored)
        self.alphabet[name] = alphabet
        self.features.append(name)
        if processor is not None:
            self.processors[name] = processor

    @property
    def types(self) -> list[str]:
        return sorted(self.tests)


DEFAULT_TYPES = TypeRegistry()


def is_missing_token(value: Column) -> Column:
    return value.isin(K.NA_TOKENS)


def log_add(a: Column, b: Column) -> Column:
    """ln(e^a + e^b) without leaving logarithms."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def text_shapes(rows: DataFrame, registry: TypeRegistry = DEFAULT_TYPES) -> DataFrame:
    """Count rows ``<col, value>`` per column, length, accepted types and NA flag.

    Short texts are counted first, so that recognisers see each distinct one once; long
    texts are reduced to their shape where they lie and never travel.
    """
    value = F.col("value")
    short = F.length(value) <= SHORT_TEXT

    def shape(v: Column) -> Column:
        return F.struct(
            F.length(v).alias("len"),
            is_missing_token(v).alias("missing"),
            F.array(*[registry.tests[t](v) for t in registry.types]).alias("accepted"),
        )

    counted = (
        rows.where(value.isNotNull())
        .select("col", F.when(short, value).alias("text"), F.when(~short, shape(value)).alias("shape"))
        .groupBy("col", "text", "shape")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        counted.select("col", F.when(F.col("text").isNotNull(), shape(F.col("text"))).otherwise(F.col("shape")).alias("s"), "n")
        .groupBy("col", "s")
        .agg(F.sum("n").alias("n"))
        .select("col", "s.len", "s.missing", "s.accepted", "n")
    )


def type_scores(shapes: DataFrame, registry: TypeRegistry = DEFAULT_TYPES) -> DataFrame:
    """Mean log-likelihood per row of every column under every type."""
    size = F.col("len").cast("double")
    anomaly = (
        F.lit(math.log(K.WEIGHT_ANOMALY) + math.log(K.STOP_PROBABILITY) - K.ANOMALY_PENALTY)
        - size * math.log(K.ANOMALY_ALPHABET)
    )
    missing = F.when(
        F.col("missing"), F.lit(math.log(K.WEIGHT_MISSING) - math.log(len(K.NA_TOKENS)))
    ).otherwise(F.lit(IMPOSSIBLE))
    background = log_add(anomaly, missing)

    def typed(t: str) -> Column:
        if t in WORD_LISTS:
            return F.lit(math.log(K.WEIGHT_TYPE) - math.log(len(WORD_LISTS[t])))
        start = math.log(K.WEIGHT_TYPE) + math.log(K.STOP_PROBABILITY)
        return F.lit(start) - size * math.log(registry.alphabet[t])

    rows_of = F.sum("n").cast("double")
    sums = shapes.groupBy("col").agg(
        *[
            (
                F.sum(
                    F.col("n")
                    * log_add(
                        F.when(F.col("accepted")[i], typed(t)).otherwise(F.lit(IMPOSSIBLE)), background
                    )
                )
                / rows_of
            ).alias(t)
            for i, t in enumerate(registry.types)
        ]
    )
    return sums.unpivot(["col"], registry.types, "type", "score")


def infer_types(
    rows: DataFrame, registry: TypeRegistry = DEFAULT_TYPES
) -> DataFrame:
    """``<col, type, score>`` for long-form rows ``<col, value>``: the most probable type;
    ``string`` wins ties, then the alphabet."""
    scores = type_scores(text_shapes(rows, registry), registry)
    best = F.min(
        F.struct(
            (-F.round("score", 9)).alias("cost"),
            F.when(F.col("type") == "string", F.lit("")).otherwise(F.col("type")).alias("tie"),
            F.col("type"),
            F.col("score"),
        )
    )
    return scores.groupBy("col").agg(best.alias("best")).select(
        "col", F.col("best.type").alias("type"), F.round("best.score", 6).alias("score")
    )


def infer_table(df: DataFrame, registry: TypeRegistry = DEFAULT_TYPES) -> dict[str, str]:
    """Type of every column of a table. Texts are inferred, other columns follow the schema."""
    text = string_columns(df)
    types = {}
    if text:
        types = {r["col"]: r["type"] for r in infer_types(long_form(df, text), registry).collect()}
    for field in df.schema.fields:
        if field.name in types:
            continue
        kind = field.dataType.typeName()
        if kind in ("integer", "long", "short", "byte"):
            types[field.name] = "integer"
        elif kind in ("double", "float") or kind.startswith("decimal"):
            types[field.name] = "float"
        elif kind == "boolean":
            types[field.name] = "boolean"
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            types[field.name] = "date-iso-8601"
        else:
            types[field.name] = "string"
    return {c: types[c] for c in df.columns}


def value_label(value: Column, col_type: Column, registry: TypeRegistry = DEFAULT_TYPES) -> Column:
    """``missing``, ``normal`` or ``anomaly`` of a text in a column of a given type."""
    fits = reduce(
        lambda chain, t: chain.when(col_type == t, registry.tests[t](value)),
        registry.types[1:],
        F.when(col_type == registry.types[0], registry.tests[registry.types[0]](value)),
    ).otherwise(F.lit(False))
    return (
        F.when(is_missing_token(value), F.lit("missing")).when(fits, F.lit("normal")).otherwise(F.lit("anomaly"))
    )


def label_values(values: DataFrame, types: DataFrame, registry: TypeRegistry = DEFAULT_TYPES) -> DataFrame:
    """Value table plus type and label; the type table has one row per column."""
    typed = values.join(F.broadcast(types.select("col", "type")), "col")
    return typed.withColumn("label", value_label(F.col("value"), F.col("type"), registry))


def missing_tokens(labelled: DataFrame) -> DataFrame:
    """``<col, value, n>`` of the texts that stand for a missing value."""
    return labelled.where(F.col("label") == "missing").select("col", "value", "n")


def anomalies(labelled: DataFrame) -> DataFrame:
    """``<col, value, n>`` of the texts that fit neither the type nor the missing tokens."""
    return labelled.where(F.col("label") == "anomaly").select("col", "value", "n")


def column_group(col_type: Column, registry: TypeRegistry = DEFAULT_TYPES) -> Column:
    """The way a column of this type is treated."""
    return (
        F.when(col_type.isin(registry.features), F.lit("string_feature"))
        .when(col_type == "string", F.lit("string"))
        .when(col_type.isin(K.BOOLEAN_TYPES), F.lit("boolean"))
        .when(col_type.isin(K.DATE_TYPES), F.lit("date"))
        .otherwise(F.lit("other"))
    )


def route_columns(types: dict[str, str], registry: TypeRegistry = DEFAULT_TYPES) -> dict[str, list[str]]:
    """Column names per group, for a schema already on the driver."""
    groups: dict[str, list[str]] = {"other": [], "string": [], "boolean": [], "date": [], "string_feature": []}
    for col, kind in types.items():
        if kind in registry.features:
            groups["string_feature"].append(col)
        elif kind == "string":
            groups["string"].append(col)
        elif kind in K.BOOLEAN_TYPES:
            groups["boolean"].append(col)
        elif kind in K.DATE_TYPES:
            groups["date"].append(col)
        else:
            groups["other"].append(col)
    return groups


def type_confusion(predicted: DataFrame, truth: DataFrame, registry: TypeRegistry = DEFAULT_TYPES) -> DataFrame:
    """``<true_type, type, n>`` counts of true against predicted column types."""
    return (
        predicted.join(truth, "col")
        .groupBy("true_type", "type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
