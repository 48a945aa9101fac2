"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, **options) -> DataFrame:
    """A CSV file with a header, every column as text unless a schema is given, or a parquet
    table with its own types."""
    if path.rstrip("/").lower().endswith((".csv", ".csv.gz", ".txt")):
        reader = spark.read.option("header", True).option("inferSchema", False).options(**options)
        return (reader.schema(schema) if schema else reader).csv(path)
    return spark.read.options(**options).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a table as parquet, or as CSV where the path says so; CSV has no arrays, so
    vector columns are written as JSON text there."""
    if path.rstrip("/").lower().endswith(".csv"):
        flat = df.select(
            *[
                F.to_json(f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
                for f in df.schema.fields
            ]
        )
        flat.write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).parquet(path)


def sample_head(df: DataFrame, order: list[str | Column], rows: int = 200) -> DataFrame:
    """The first rows by an explicit order (tables have no row order of their own)."""
    return df.orderBy(*order).limit(rows)


def load_labelled_features(spark: SparkSession, nominal_path: str, ordinal_path: str) -> DataFrame:
    """Two tables of column features stacked, as read."""
    return read_table(spark, nominal_path).unionByName(read_table(spark, ordinal_path))


def load_word_vectors(spark: SparkSession, first_path: str, second_path: str) -> DataFrame:
    """Two word-vector tables merged; the second wins."""
    from stringwright.operators.ordinality import merge_vectors

    return merge_vectors(read_table(spark, first_path), read_table(spark, second_path))
