"""Distinct-value tables, value maps and ordered positions.

A value table has one row ``<col, value, n>`` per column and distinct text. Most
operators work on it instead of on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from stringwright.functions import text as X
from stringwright.session import settle

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_KEYS = 1000
HOT_SAMPLE = 0.01
ROWS_PER_TASK = 1_000_000

#: Data types of numbers written as text.
TEXT_NUMBERS = {"integer": "bigint", "float": "double"}


def survives(value: Column, kind: str) -> Column:
    """Whether a text turned into a number still says what it said: a whole number written as it
    would be printed, a decimal one of up to fifteen digits."""
    if kind == "bigint":
        return value.try_cast("bigint").cast("string") == value
    digits = F.length(F.regexp_replace(value, r"[^0-9]|\A[^1-9]*", ""))
    return value.try_cast("double").isNotNull() & (digits <= 15)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def normalise_spaces(df: DataFrame) -> DataFrame:
    """Replace non-breaking spaces in every text column."""
    text = set(string_columns(df))
    return df.select(*[X.plain_spaces(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])


def empty_columns(df: DataFrame) -> list[str]:
    """Names of the columns without any value, found in one pass."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if counts[c] == 0]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*empty_columns(df))


def long_form(df: DataFrame, cols: list[str]) -> DataFrame:
    """``<col, value>`` rows of the given columns, values as text."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return texts.unpivot([], cols, "col", "value")


def value_table(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Frequency of every distinct text per column; counted before the shuffle."""
    rows = long_form(df, cols or string_columns(df)).where(F.col("value").isNotNull())
    return rows.groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))


def column_totals(values: DataFrame) -> DataFrame:
    """``<col, total, distinct_values>``: one row per column."""
    return values.groupBy("col").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_values")
    )


def row_bytes(schema: StructType) -> Column:
    """About what a row takes: lengths of texts and arrays, eight bytes for everything else."""

    def of(value: Column, kind: DataType) -> Column:
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(value), F.lit(0)) + 8
        if isinstance(kind, ArrayType):
            return F.coalesce(F.aggregate(value, F.lit(8).cast("bigint"), lambda a, x: a + of(x, kind.elementType)), F.lit(8))
        if isinstance(kind, StructType):
            return sum([of(value[f.name], f.dataType) for f in kind.fields], F.lit(8))
        return F.lit(8)

    return sum([of(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields], F.lit(16)).cast("bigint")


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table, measured row by row, fits the broadcast limit."""
    return (df.agg(F.sum(row_bytes(df.schema))).first()[0] or 0) <= limit


def join_map(
    df: DataFrame, key: str, mapping: DataFrame, limit: int = BROADCAST_BYTES, small: bool | None = None
) -> DataFrame:
    """Left join of rows with a map ``<key, new columns...>`` keyed on distinct values.

    Maps under the size limit are broadcast. Larger ones are shuffled; then at most a
    thousand of the commonest keys, found on a sample, are still served by broadcast, and
    rows already served or without a key are spread over random partitions. So no key,
    however common, gathers in one task. Which keys count as common never changes a result.
    ``small`` passes on a size already checked.
    """
    fields = [c for c in mapping.columns if c != key]
    if small_enough(mapping, limit) if small is None else small:
        return df.join(F.broadcast(mapping), key, "left").select(*df.columns, *fields)

    packed = F.struct(*fields)
    keys = df.select(key).where(F.col(key).isNotNull())
    common = (
        keys.sample(fraction=HOT_SAMPLE, seed=1)
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), key)
        .limit(HOT_KEYS)
        .select(key)
    )
    hot = common.join(mapping, key, "left").select(key, packed.alias("_hot"), F.lit(True).alias("_is_hot"))
    served = df.join(F.broadcast(hot), key, "left")
    done = F.col("_is_hot").isNotNull() | F.col(key).isNull()
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(c) for c in df.columns]).cast("string"))
    probe = served.withColumn("_key", F.when(done, spread).otherwise(F.col(key).cast("string")))
    cold = mapping.select(F.col(key).cast("string").alias("_key"), packed.alias("_cold"))
    joined = probe.join(cold, "_key", "left")
    found = F.when(F.col("_is_hot"), F.col("_hot")).otherwise(F.col("_cold"))
    return joined.select(*df.columns, *[found[f].alias(f) for f in fields])


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    weight: Column,
    name: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Inclusive running sum of ``weight`` within ``keys`` along ``order``.

    A long group is cut into ranges: rows are range-partitioned and written once, each range
    is summed on its own, and the ranges are offset by the sums before them. No task ever
    holds a whole group; only one row per range is broadcast.
    """
    rows = df.count()
    if rows <= rows_per_task:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(weight).over(window))
    parts = -(-rows // rows_per_task)
    ranged = settle(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_weight", weight)
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_part")
        .agg(F.sum("_weight").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("_inside", F.sum("_weight").over(inside))
        .join(F.broadcast(offsets), [*keys, "_part"])
        .withColumn(name, F.col("_inside") + F.col("_before"))
        .select(*df.columns, name)
    )


def rank_values(
    values: DataFrame,
    keys: list[str],
    order: list[Column],
    name: str = "code",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """0-based position of every distinct value within its column."""
    ranked = running_total(values, keys, order, F.lit(1).cast("bigint"), name, rows_per_task)
    return ranked.withColumn(name, F.col(name) - 1)


def sorted_codes(df: DataFrame, col: str) -> DataFrame:
    """Map ``<col, n, code>``: rank of each distinct text in sorted order."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return rank_values(counts, [], [F.col(col)], "code")


def label_encode(df: DataFrame, col: str) -> DataFrame:
    """Replace a non-numeric column by the rank of its value in sorted order."""
    if df.schema[col].dataType.typeName() in ("long", "integer", "double", "float", "short", "byte", "decimal"):
        return df
    codes = settle(sorted_codes(df, col)).withColumnRenamed("code", "_code")
    coded = join_map(df, col, codes.drop("n"))
    return coded.select(*[F.col("_code").alias(c) if c == col else F.col(c) for c in df.columns])
