"""Category encoders. Each learns a map ``<value, ...>`` on distinct values."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringwright import constants as K
from stringwright.functions import text as X
from stringwright.operators.gap import weights_of
from stringwright.operators.values import join_map, rank_values
from stringwright.session import settle

GRAMS = (2, 4)
HASH_PRIME = 4294967311


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """One row ``<spread, balanced>``: population deviation of the class sizes over their mean."""
    sizes = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    spread = (F.stddev_pop("n") / F.avg("n")).alias("spread")
    return sizes.agg(spread).select("spread", (F.col("spread") < K.BALANCE_RATIO).alias("balanced"))


def encoder_for(distinct_values: Column, balanced: Column) -> Column:
    """Encoder of an unordered column."""
    return (
        F.when((distinct_values < K.LOW_CARDINALITY) & balanced, F.lit("target"))
        .when(distinct_values < K.LOW_CARDINALITY, F.lit("similarity"))
        .when(distinct_values < K.HIGH_CARDINALITY, F.lit("gap"))
        .otherwise(F.lit("minhash"))
    )


def choose_encoder(directive: str, distinct_values: int, balanced: bool) -> str:
    if directive in ("none", "ordinal"):
        return directive
    if distinct_values < K.LOW_CARDINALITY:
        return "target" if balanced else "similarity"
    return "gap" if distinct_values < K.HIGH_CARDINALITY else "minhash"


def valence_scores(values: DataFrame, valence: DataFrame) -> DataFrame:
    """``<value, score>``: summed polarity of the words times their strongest intensity."""
    tokens = values.select("value", F.explode(F.split(F.lower("value"), r"[^\p{L}]+")).alias("word"))
    known = join_map(tokens, "word", valence.select("word", "polarity", "intensity"))
    return known.groupBy("value").agg(
        (F.coalesce(F.sum("polarity"), F.lit(0.0)) * F.coalesce(F.max("intensity"), F.lit(1.0))).alias("score")
    )


def valence_order(values: DataFrame, valence: DataFrame) -> DataFrame:
    """``<value, score, code>``: 0-based position by score, then alphabetically."""
    return rank_values(valence_scores(values, valence), [], [F.col("score"), F.col("value")], "code")


def ordinal_map(values: DataFrame, valence: DataFrame | None, order: list[str] | None = None) -> DataFrame:
    """``<value, code>`` by an explicit order, by valence, or alphabetically."""
    if order is not None:
        at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("value")) - 1
        return values.select("value", F.when(at >= 0, at).alias("code"))
    if valence is None:
        return rank_values(values.select("value"), [], [F.col("value")], "code")
    return valence_order(values, valence).select("value", "code")


def target_map(df: DataFrame, col: str, target: str) -> DataFrame:
    """``<value, code>``: class mean shrunk to the overall mean with weight
    1 / (1 + exp(-(n - 1))); a category seen once gets the overall mean."""
    known = df.where(F.col(col).isNotNull() & F.col(target).isNotNull())
    prior = F.lit(known.agg(F.avg(target)).first()[0])
    stats = known.groupBy(F.col(col).alias("value")).agg(F.count(target).alias("n"), F.avg(target).alias("mean"))
    weight = 1 / (1 + F.exp(-(F.col("n") - 1)))
    smooth = prior * (1 - weight) + F.col("mean") * weight
    return stats.select("value", F.when(F.col("n") <= 1, prior).otherwise(smooth).alias("code"))


def similarity_map(values: DataFrame) -> DataFrame:
    """``<value, code>``: n-gram similarity to each of fewer than 30 categories, sorted.

    The values are written first: a filter that Spark derives from a later explode of the codes would
    otherwise reckon them for every row below the distinct.
    """
    values = settle(values.select("value"))
    categories = sorted(r["value"] for r in values.limit(K.LOW_CARDINALITY).collect())
    if len(categories) >= K.LOW_CARDINALITY:
        raise ValueError("similarity encoding is for fewer than 30 categories")
    grams = X.char_ngrams_between(F.col("value"), *GRAMS)
    axes = [X.jaccard(F.col("_grams"), X.char_ngrams_between(F.lit(c), *GRAMS)) for c in categories]
    return values.select("value", grams.alias("_grams")).select("value", F.array(*axes).alias("code"))


def gram_tokens(value: Column) -> Column:
    """All character n-grams of the encoder lengths, repeats kept."""

    def of(n: int) -> Column:
        last = F.length(value) - n + 1
        return F.when(
            last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(value, i, n))
        ).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(GRAMS[0], GRAMS[1] + 1)])


def gap_map(values: DataFrame, topics: int = K.GAP_TOPICS, seed: int = 1) -> DataFrame:
    """``<value, code>``: topic weights of the n-gram counts of the distinct values, by a Gamma-Poisson
    factorisation. No n-gram is left out."""
    return weights_of(values, gram_tokens(F.lower("value")), topics, seed)


def hash_seeds(size: int = K.MINHASH_SIZE) -> list[tuple[int, int]]:
    """Multiplier and offset of each hash, derived from the position."""

    def number(text: str, top: int) -> int:
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % top

    return [(1 + number(f"a{i}", 2**30 - 1), number(f"b{i}", 2**31)) for i in range(size)]


def minhash_map(values: DataFrame, size: int = K.MINHASH_SIZE) -> DataFrame:
    """``<value, code>``: for each hash the smallest hashed n-gram, scaled to [0, 1).

    One md5 per n-gram feeds all hashes. N-grams are exploded and reduced by plain minimum
    aggregates, which run in generated code. The values are dealt out before: adaptive execution
    would judge by their few bytes and leave all their n-grams to one task.
    """
    low, high = GRAMS
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = values.repartition(parts)
    grams = values.select("value", F.explode_outer(X.char_ngrams_between(F.col("value"), low, high)).alias("gram"))
    hashed = grams.select("value", X.hash32(F.col("gram")).alias("h"))
    mins = hashed.groupBy("value").agg(
        *[F.min((F.col("h") * a + b) % HASH_PRIME).alias(f"m{i}") for i, (a, b) in enumerate(hash_seeds(size))]
    )
    vector = F.array(*[F.coalesce(F.col(f"m{i}") / HASH_PRIME, F.lit(0.0)) for i in range(size)])
    return mins.select("value", vector.alias("code"))


def encode_dense(df: DataFrame, col: str, mapping: DataFrame) -> DataFrame:
    """Replace a column by its code (a number or a vector)."""
    joined = join_map(df, col, mapping.select(F.col("value").alias(col), F.col("code").alias("_code")))
    return joined.select(*[F.col("_code").alias(c) if c == col else F.col(c) for c in df.columns])


def widen(df: DataFrame, col: str, size: int) -> DataFrame:
    """Split a vector column into ``col0 .. colK`` at the end of the table."""
    parts = [F.get(F.col(col), F.lit(i)).alias(f"{col}{i}") for i in range(size)]
    return df.select(*[c for c in df.columns if c != col], *parts)


def encode_wide(df: DataFrame, col: str, mapping: DataFrame, size: int) -> DataFrame:
    return widen(encode_dense(df, col, mapping), col, size)


def exact_below(df: DataFrame, cols: list[str], clear: int = 10 * K.HIGH_CARDINALITY) -> dict[str, int]:
    """Distinct counts that are exact wherever they could decide an encoder.

    A sketch sorts out columns far above every threshold in one pass; only the others are
    counted exactly, so no high-cardinality column is shuffled to be counted.
    """
    if not cols:
        return {}
    rough = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first().asDict()
    near = [c for c in cols if rough[c] < clear]
    if near:
        rough |= df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in near]).first().asDict()
    return rough


def vector_size(mapping: DataFrame) -> int:
    """Length of the codes of a map; 0 for plain numbers."""
    if mapping.schema["code"].dataType.typeName() != "array":
        return 0
    return mapping.agg(F.max(F.size("code"))).first()[0] or 0


def encoder_map(
    df: DataFrame,
    col: str,
    encoder: str,
    target: str | None = None,
    valence: DataFrame | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Learn the map of the named encoder for one column."""
    if encoder == "target":
        return target_map(df, col, target)
    values = df.select(F.col(col).alias("value")).where(F.col(col).isNotNull()).distinct()
    if encoder == "ordinal":
        return ordinal_map(values, valence, order)
    return {"similarity": similarity_map, "gap": gap_map, "minhash": minhash_map}[encoder](values)
