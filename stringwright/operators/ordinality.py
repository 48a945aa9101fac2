"""Is a text column ordered or unordered? Column features and a boosted-tree classifier.

Features are computed in Spark from value tables; the classifier sees one row per column.
Label 1 is nominal (unordered), 0 ordinal.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import zip_longest

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringwright import constants as K
from stringwright.functions import text as X
from stringwright.operators.boosting import held_out_scores
from stringwright.operators.values import column_totals, join_map, rank_values, running_total, settle

FEATURES = [
    "total", "distinct_values", "ratio", "variance", "name_nom", "name_ord", "key_ord", "common",
]


def column_counts(values: DataFrame) -> DataFrame:
    """``<col, total, distinct_values, ratio>``."""
    return column_totals(values).withColumn("ratio", F.col("distinct_values") / F.col("total"))


def seeded_vector(word: Column, dims: int) -> Column:
    """Normal deviates (sd 0.6) fixed by the word, for words without a vector."""

    def deviate(d: Column) -> Column:
        key = F.concat(word, F.lit("|"), d.cast("string"))
        u = (X.hash32(F.concat(key, F.lit("|a"))) + 1) / 4294967297
        v = X.hash32(F.concat(key, F.lit("|b"))) / 4294967296
        return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(v * 6.283185307179586) * K.EMBEDDING_SCALE

    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), deviate)


def merge_vectors(first: DataFrame, second: DataFrame) -> DataFrame:
    """One vector table out of two ``<word, vec>``; the second wins."""
    both = first.select("word", "vec", F.lit(1).alias("rank")).unionByName(
        second.select("word", "vec", F.lit(2).alias("rank"))
    )
    return both.groupBy("word").agg(F.max_by("vec", "rank").alias("vec"))


def embedding_variance(values: DataFrame, vectors: DataFrame | None, dims: int = K.EMBEDDING_DIMS) -> DataFrame:
    """``<col, variance>``: squared distances of the mean word vectors of the distinct texts
    from their centre, summed over texts and averaged over dimensions."""
    tokens = values.select("col", "value", F.explode(F.split(F.lower("value"), "[ \\-_]")).alias("word"))
    # Making vectors costs far more than the few bytes of a word suggest: keep it parallel.
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = tokens.select("word").distinct().repartition(parts, "word")
    if vectors is None:
        known = words.withColumn("vec", seeded_vector(F.col("word"), dims))
    else:
        table = vectors.select("word", F.col("vec").cast("array<double>").alias("_vec"))
        known = join_map(words, "word", table).select(
            "word", F.coalesce("_vec", seeded_vector(F.col("word"), dims)).alias("vec")
        )
    placed = join_map(tokens, "word", settle(known))
    means = placed.groupBy("col", "value").agg(*[F.avg(F.col("vec")[d]).alias(f"d{d}") for d in range(dims)])
    spread = reduce(lambda a, b: a + b, [F.var_pop(f"d{d}") for d in range(dims)])
    return means.groupBy("col").agg((spread * F.count(F.lit(1)) / dims).alias("variance"))


def name_kind(name: Column) -> Column:
    """``nominal``, ``ordinal`` or null by known column names, either containing the other;
    the two lists take turns and the first hit decides."""
    name = F.lower(name)
    turns = [
        (word, kind)
        for pair in zip_longest(K.NOMINAL_NAMES, K.ORDINAL_NAMES)
        for word, kind in zip(pair, ("nominal", "ordinal"))
        if word
    ]
    hits = [F.when(name.contains(word) | F.lit(word).contains(name), F.lit(kind)) for word, kind in turns]
    return F.coalesce(*hits)


def name_flags(cols: DataFrame) -> DataFrame:
    """``<col, name_nom, name_ord>``."""
    kind = name_kind(F.col("col"))
    return cols.select(
        "col",
        F.coalesce((kind == "nominal").cast("int"), F.lit(0)).alias("name_nom"),
        F.coalesce((kind == "ordinal").cast("int"), F.lit(0)).alias("name_ord"),
    )


def keyword_flag(values: DataFrame) -> DataFrame:
    """``<col, key_ord>``: 1 if ordinal keywords occur, per distinct text, 0.2 times or more."""
    text = F.lower("value")
    hits = reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in K.ORDINAL_KEYWORDS])
    share = F.sum(hits) / F.count(F.lit(1))
    return values.groupBy("col").agg((share >= K.KEYWORD_SHARE).cast("int").alias("key_ord"))


def common_substring(values: DataFrame, most_distinct: int | None = None) -> DataFrame:
    """``<col, common>``: 1 if two distinct texts share more than three characters in a row.
    Nearly unique columns get 0, as do those of more than ``most_distinct`` texts if that is given."""
    few = F.lit(True) if most_distinct is None else F.col("distinct_values") <= most_distinct
    counts = column_counts(values).withColumn("open", (F.col("ratio") <= K.DISTINCT_RATIO) & few)
    looked = values.join(F.broadcast(counts.where("open").select("col")), "col", "left_semi")
    grams = looked.select("col", F.explode(X.char_ngrams(F.col("value"), 4)).alias("gram"))
    shared = (
        grams.groupBy("col", "gram")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("col")
        .agg((F.max("n") >= 2).cast("int").alias("common"))
    )
    return counts.join(F.broadcast(shared), "col", "left").select(
        "col", F.coalesce("common", F.lit(0)).alias("common")
    )


def column_features(
    values: DataFrame,
    vectors: DataFrame | None = None,
    dims: int = K.EMBEDDING_DIMS,
    names: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row of eight features per column of a value table. ``names`` turns the ``col``
    key into the column name to be judged, where they differ."""
    counts = column_counts(values)
    flags = name_kind(names(F.col("col")) if names else F.col("col"))
    return (
        counts.join(embedding_variance(values, vectors, dims), "col")
        .join(keyword_flag(values), "col")
        .join(common_substring(values), "col")
        .select(
            "col",
            "total",
            "distinct_values",
            "ratio",
            "variance",
            F.coalesce((flags == "nominal").cast("int"), F.lit(0)).alias("name_nom"),
            F.coalesce((flags == "ordinal").cast("int"), F.lit(0)).alias("name_ord"),
            "key_ord",
            "common",
        )
    )


def tidy_features(raw: DataFrame) -> DataFrame:
    """Raw labelled features to numbers: flags to 0/1, a bracketed list of variances to its
    mean, the label to nominal = 1, the unused flag dropped."""
    flags = ["name_nom", "name_ord", "key_ord", "common"]
    inner = F.regexp_extract("variance", r"\[([^\]]*)\]", 1)
    numbers = F.transform(
        F.filter(F.split(inner, r"\s+"), lambda x: x != ""), lambda x: x.cast("double")
    )
    mean = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers)
    return raw.select(
        *[
            F.col(c).cast("boolean").cast("int").alias(c)
            if c in flags
            else mean.alias(c)
            if c == "variance"
            else F.when(F.col(c) == "nominal", 1).otherwise(0).alias(c)
            if c == "label"
            else F.col(c)
            for c in raw.columns
            if c != "key_nom"
        ]
    )


def classifier(trees: int = 100, depth: int = 3, step: float = 0.1, seed: int = 1) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=FEATURES, outputCol="features"),
            GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, seed=seed),
        ]
    )


def train(features: DataFrame, **params) -> PipelineModel:
    """Fit the classifier on labelled column features."""
    return classifier(**params).fit(features.withColumn("label", F.col("label").cast("double")))


def predict(features: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``score`` (probability of nominal) and ``prediction`` to column features."""
    kept = features.columns
    return model.transform(features).select(
        *kept,
        vector_to_array("probability")[1].alias("score"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def by_rule(features: DataFrame) -> DataFrame:
    """Prediction without a trained model: ordinal if the name or the words say so."""
    ordinal = (F.col("name_nom") == 0) & ((F.col("name_ord") == 1) | (F.col("key_ord") == 1))
    return features.withColumn("prediction", F.when(ordinal, 0).otherwise(1))


def split_train_test(features: DataFrame, share: float = 0.7, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Fixed random split: decided by a hash of the column key and the seed."""
    cut = int(share * 1_000_000)
    here = F.pmod(X.hash32(F.concat_ws("|", F.lit(str(seed)), "col")), F.lit(1_000_000)) < cut
    return features.where(here), features.where(~here)


def fold_numbers(features: DataFrame, folds: int) -> DataFrame:
    """Add ``fold`` by the rank of the column key's hash, so that folds differ by one row at most."""
    order = [F.md5(F.col("col").cast("binary")), F.col("col")]
    return rank_values(features, [], order, "fold").withColumn("fold", F.col("fold") % folds)


def evaluated(features: DataFrame, steps: list[float], trees: list[int], depth: int, folds: int | None = None) -> DataFrame:
    """The rows with ``step``, ``trees``, ``score`` and ``prediction``, once for every step and tree
    count, by models that have not seen the row's fold: one fold per row, or as many as asked for."""
    features = settle(features.withColumn("label", F.col("label").cast("double")))
    rows = features.count()
    folds = min(folds or rows, rows)
    labelled = fold_numbers(features, max(folds, 1))
    scored = held_out_scores(labelled, FEATURES, "fold", max(folds, 1), steps, trees, depth)
    return scored.withColumn("label", F.col("label").cast("int"))


def leave_one_out(features: DataFrame, folds: int | None = None, trees: int = 100, depth: int = 2, step: float = 0.1) -> DataFrame:
    """Predictions of every row by a model that has not seen it, or with ``folds`` none of its fold."""
    return evaluated(features, [step], [trees], depth, folds).drop("step", "trees")


def hold_out(features: DataFrame, source: str, held: list[str], **params) -> DataFrame:
    """Predictions for the columns of some sources by a model fitted on all other sources."""
    away = F.col(source).isin(held)
    model = train(features.where(~away), **{"depth": 2, **params})
    return predict(features.where(away), model)


# Learning rates and tree counts of the search.
GRID_STEPS = [0.005, 0.01, 0.05, 0.1, 0.2, 0.3, 0.5]
GRID_TREES = [25, 50, 75, 100, 125, 150, 175, 200]


def grid_search(
    features: DataFrame, steps: list[float] | None = None, trees: list[int] | None = None, folds: int | None = None, depth: int = 3
) -> DataFrame:
    """``<step, trees, accuracy>`` of every grid point over pooled held-out predictions, one job for all."""
    predicted = evaluated(features, steps or GRID_STEPS, trees or GRID_TREES, depth, folds)
    right = (F.col("prediction") == F.col("label")).cast("double")
    return predicted.groupBy("step", "trees").agg(F.avg(right).alias("accuracy"))


def metrics(predicted: DataFrame) -> DataFrame:
    """One row ``<accuracy, precision, recall, f1>`` for label and prediction columns."""

    def cases(label: int, prediction: int) -> Column:
        hit = (F.col("label") == label) & (F.col("prediction") == prediction)
        return F.sum(F.when(hit, 1).otherwise(0)).cast("double")

    tp, fp, fn = cases(1, 1), cases(0, 1), cases(1, 0)
    right = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    return predicted.agg(
        right.alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def confusion(predicted: DataFrame) -> DataFrame:
    """Rows of true labels, columns ``predicted_0`` and ``predicted_1``."""
    return (
        predicted.groupBy("label")
        .pivot("prediction", [0, 1])
        .agg(F.count(F.lit(1)))
        .select(
            "label",
            F.coalesce(F.col("0"), F.lit(0)).alias("predicted_0"),
            F.coalesce(F.col("1"), F.lit(0)).alias("predicted_1"),
        )
    )


def roc_points(predicted: DataFrame, score: str = "score", rows_per_task: int = 1_000_000) -> DataFrame:
    """``<threshold, fpr, tpr>``: rates when everything scored at or above the threshold is
    called positive. One row per distinct score."""
    steps = predicted.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("neg"),
    )
    down = [F.desc("threshold")]
    both = running_total(
        running_total(steps, [], down, F.col("pos"), "tp", rows_per_task), [], down, F.col("neg"), "fp", rows_per_task
    )
    sums = steps.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")).first()
    return both.select(
        "threshold",
        F.try_divide(F.col("fp"), F.lit(sums["q"])).alias("fpr"),
        F.try_divide(F.col("tp"), F.lit(sums["p"])).alias("tpr"),
    )


def roc_auc(predicted: DataFrame, score: str = "score", rows_per_task: int = 1_000_000) -> DataFrame:
    """One row ``<auc>``: chance that a positive outscores a negative, ties counted half."""
    steps = predicted.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("neg"),
    )
    below = running_total(steps, [], [F.col("threshold")], F.col("neg"), "upto", rows_per_task)
    wins = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    return below.agg(
        F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc")
    )
