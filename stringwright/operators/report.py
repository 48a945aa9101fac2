"""Per-column profile of what was found and done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringwright import constants as K


def shorten(first: Column, last: Column, count: Column, all_values: Column) -> Column:
    """Outlier list for display: up to three in full, else the first, dots and the last; a
    placeholder if the first is long."""
    return (
        F.when(count < 4, all_values)
        .when(F.length(first) < 50, F.array(first, F.lit("..."), last))
        .otherwise(F.array(F.lit("<outlier length too large>")))
    )


def outlier_lists(anomalies: DataFrame, cols: DataFrame) -> DataFrame:
    """``<col, n_outliers, outliers>`` from ``<col, value>``, shortened.

    Only the ends and the count are aggregated; full lists are gathered for columns with at
    most three outliers, which bounds what any task holds.
    """
    ends = anomalies.groupBy("col").agg(
        F.count(F.lit(1)).alias("n_outliers"), F.min("value").alias("first"), F.max("value").alias("last")
    )
    few = ends.where(F.col("n_outliers") < 4).select("col")
    listed = (
        anomalies.join(F.broadcast(few), "col", "left_semi")
        .groupBy("col")
        .agg(F.sort_array(F.collect_list("value")).alias("listed"))
    )
    return (
        cols.select("col")
        .join(ends, "col", "left")
        .join(listed, "col", "left")
        .select(
            "col",
            F.coalesce("n_outliers", F.lit(0)).alias("n_outliers"),
            F.when(F.col("n_outliers").isNull(), F.array().cast("array<string>"))
            .otherwise(shorten(F.col("first"), F.col("last"), F.col("n_outliers"), F.col("listed")))
            .alias("outliers"),
        )
    )


def profile(values: DataFrame, null_counts: DataFrame, labelled: DataFrame, types: DataFrame) -> DataFrame:
    """``<col, unique_values, type, missing_values, outliers>`` per column; null counts as one
    distinct value. Missing tokens come from a fixed list, so their set is small."""
    counts = values.groupBy("col").agg(F.count(F.lit(1)).alias("distinct_values"))
    tokens = (
        labelled.where(F.col("label") == "missing")
        .groupBy("col")
        .agg(F.sort_array(F.collect_set("value")).alias("missing_values"))
    )
    outliers = outlier_lists(labelled.where(F.col("label") == "anomaly"), types)
    unique = F.coalesce("distinct_values", F.lit(0)) + (F.coalesce("nulls", F.lit(0)) > 0).cast("int")
    return (
        types.select("col", "type")
        .join(counts, "col", "left")
        .join(null_counts, "col", "left")
        .join(tokens, "col", "left")
        .join(outliers, "col", "left")
        .select(
            "col",
            unique.cast("bigint").alias("unique_values"),
            "type",
            F.coalesce("missing_values", F.array().cast("array<string>")).alias("missing_values"),
            "outliers",
        )
    )


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``<col, nulls>`` of every column in one pass."""
    counted = df.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in cols])
    return counted.unpivot([], cols, "col", "nulls")


def encoder_label(col_type: Column, ordinal: Column, distinct_values: Column, balanced: Column) -> Column:
    """Name of the encoder a column gets: none for kinds their own rule already turns into
    numbers, the ordinal one where the column was found ordered, else by cardinality."""
    done = col_type.isin(
        *K.BOOLEAN_TYPES, *K.DATE_TYPES, *K.NUMERIC_TYPES, "coordinate", "month", "numerical", "ordinal"
    )
    return (
        F.when(done, F.lit("Custom"))
        .when(ordinal, F.lit("OrdinalEncoder"))
        .when((distinct_values < K.LOW_CARDINALITY) & balanced, F.lit("TargetEncoder"))
        .when(distinct_values < K.LOW_CARDINALITY, F.lit("SimilarityEncoder"))
        .when(distinct_values < K.HIGH_CARDINALITY, F.lit("GapEncoder"))
        .otherwise(F.lit("MinHashEncoder"))
    )


def encoder_labels(profile_rows: DataFrame, predictions: DataFrame, balanced: bool) -> DataFrame:
    """``<col, type, ordinal, encoding>``; ``ordinal`` is Yes, No or null where not asked."""
    asked = profile_rows.join(F.broadcast(predictions.select("col", "prediction")), "col", "left")
    ordinal = F.coalesce(F.col("prediction") == 0, F.lit(False))
    flag = F.when(F.col("prediction") == 0, F.lit("Yes")).when(F.col("prediction") == 1, F.lit("No"))
    label = encoder_label(F.col("type"), ordinal, F.col("unique_values"), F.lit(balanced))
    return asked.select("col", "type", flag.alias("ordinal"), label.alias("encoding"))
