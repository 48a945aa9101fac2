"""Checks of the ordinality features and the classifier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringwright import constants as K
from stringwright.catalog.fixtures import table
from stringwright.catalog.registry import check, grams, md5_32, quoted
from stringwright.catalog.repairs import vals_sql, value_counts
from stringwright.functions import text as X
from stringwright.operators import ordinality as L
from stringwright.session import settle, work_folder
from stringwright.sources import tables as S

DIMS = 64

PLAIN = [
    ("fx_likert", "opinion", ""),
    ("fx_likert", "event_type", ""),
    ("fx_numrange", "qty_band", ""),
    ("part", "p_type", ""),
    ("part", "p_brand", ""),
    ("part", "p_name", ""),
    ("orders", "o_orderpriority", ""),
    ("customer", "c_mktsegment", ""),
    ("documents", "lang", ""),
    ("documents", "source", ""),
    ("nation", "n_name", ""),
    ("region", "r_name", ""),
    ("pages", "url", ""),
    ("fx_email", "email", ""),
]
VALS = f"WITH {vals_sql(PLAIN)}"
COUNTS = (
    "counts AS (SELECT col, sum(n)::BIGINT AS total, count(*) AS distinct_values, "
    "count(*)::DOUBLE / sum(n) AS ratio FROM vals GROUP BY col)"
)


@check(
    "col_counts",
    f"{VALS}, {COUNTS} SELECT col, total, distinct_values, round(ratio, 9) AS ratio FROM counts",
)
def col_counts(spark, sf_dir):
    return L.column_counts(value_counts(spark, sf_dir, PLAIN)).withColumn("ratio", F.round("ratio", 9))


VARIANCE = f"""tokens AS (SELECT col, value, unnest(regexp_split_to_array(lower(value), '[ _-]')) AS word FROM vals),
    cells AS (SELECT word, d, CASE WHEN v.vec IS NOT NULL THEN v.vec[d + 1]::DOUBLE ELSE
        sqrt(-2.0 * ln(({md5_32("word || '|' || d || '|a'")} + 1) / 4294967297.0))
        * cos({md5_32("word || '|' || d || '|b'")} / 4294967296.0 * 6.283185307179586) * {K.EMBEDDING_SCALE} END AS x
      FROM (SELECT word, unnest(range({DIMS})) AS d FROM (SELECT DISTINCT word FROM tokens) u) w LEFT JOIN fx_wordvec v USING (word)),
    means AS (SELECT col, value, d, avg(x) AS m FROM tokens JOIN cells USING (word) GROUP BY col, value, d),
    variances AS (SELECT col, avg(s) AS variance FROM (SELECT col, d, var_pop(m) * count(*) AS s FROM means GROUP BY col, d) q GROUP BY col)"""


@check("embed_variance", f"{VALS}, {VARIANCE} SELECT col, round(variance, 5) AS variance FROM variances")
def embed_variance(spark, sf_dir):
    found = L.embedding_variance(value_counts(spark, sf_dir, PLAIN), table(spark, sf_dir, "fx_wordvec"), DIMS)
    return found.withColumn("variance", F.round("variance", 5))


def name_sql(name: str) -> str:
    """CASE over the two lists in turn."""
    whens = []
    for i in range(max(len(K.NOMINAL_NAMES), len(K.ORDINAL_NAMES))):
        for words, kind in ((K.NOMINAL_NAMES, "nominal"), (K.ORDINAL_NAMES, "ordinal")):
            if i < len(words):
                w = quoted(words[i])
                whens.append(f"WHEN contains(lower({name}), {w}) OR contains({w}, lower({name})) THEN '{kind}'")
    return "CASE " + " ".join(whens) + " END"


@check(
    "name_flags",
    f"""WITH cols AS (SELECT DISTINCT lower(replace(p_name, ' ', '_')) || '_' || s AS col FROM part, (VALUES ('stage'), ('type'),
      ('year'), ('x'), ('city_rank')) AS v(s)), k AS (SELECT col, {name_sql("col")} AS kind FROM cols)
      SELECT col, coalesce((kind = 'nominal')::INT, 0) AS name_nom, coalesce((kind = 'ordinal')::INT, 0) AS name_ord FROM k""",
)
def name_flags(spark, sf_dir):
    endings = F.explode(F.array(*[F.lit(s) for s in ("stage", "type", "year", "x", "city_rank")]))
    names = table(spark, sf_dir, "part").select(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("p"))
    cols = names.distinct().select("p", endings.alias("s")).select(F.concat_ws("_", "p", "s").alias("col"))
    return L.name_flags(cols.distinct())


KEYWORD = (
    "keywords AS (SELECT col, (sum("
    + " + ".join(f"contains(lower(value), {quoted(w)})::INT" for w in K.ORDINAL_KEYWORDS)
    + ")::DOUBLE / count(*) >= 0.2)::INT AS key_ord FROM vals GROUP BY col)"
)


@check("keyword_flag", f"{VALS}, {KEYWORD} SELECT col, key_ord FROM keywords")
def keyword_flag(spark, sf_dir):
    return L.keyword_flag(value_counts(spark, sf_dir, PLAIN))


COMMON = f"""shared AS (SELECT c.col, CASE WHEN c.ratio > 0.8 THEN 0 ELSE coalesce(s.hit, 0) END AS common
      FROM counts c LEFT JOIN (SELECT col, max(k >= 2)::INT AS hit FROM (SELECT col, g, count(*) AS k FROM
        (SELECT col, unnest({grams('value', 4)}) AS g FROM vals) u GROUP BY col, g) x GROUP BY col) s ON c.col = s.col)"""


@check("common_substring", f"{VALS}, {COUNTS}, {COMMON} SELECT col, common FROM shared")
def common_substring(spark, sf_dir):
    return L.common_substring(value_counts(spark, sf_dir, PLAIN))


@check(
    "col_features",
    f"""{VALS}, {COUNTS}, {VARIANCE}, {KEYWORD}, {COMMON} SELECT col, total, distinct_values, round(ratio, 9) AS ratio,
      round(variance, 5) AS variance, coalesce(({name_sql("col")} = 'nominal')::INT, 0) AS name_nom,
      coalesce(({name_sql("col")} = 'ordinal')::INT, 0) AS name_ord, key_ord, common
      FROM counts JOIN variances USING (col) JOIN keywords USING (col) JOIN shared USING (col)""",
)
def col_features(spark, sf_dir):
    found = L.column_features(settle(value_counts(spark, sf_dir, PLAIN)), table(spark, sf_dir, "fx_wordvec"), DIMS)
    return found.withColumns({"ratio": F.round("ratio", 9), "variance": F.round("variance", 5)})


@check(
    "merge_vectors",
    """SELECT label AS word, pos - 1 AS pos, round(x, 6) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos
      FROM (SELECT coalesce(b.label, a.label) AS label, coalesce(b.embedding, a.embedding) AS embedding
        FROM (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) a
        FULL JOIN (SELECT label, arg_max(embedding, vec_id) AS embedding FROM embeddings WHERE label % 2 = 0 GROUP BY label) b
        ON a.label = b.label) m) u""",
)
def merge_vectors(spark, sf_dir):
    """The first vector of every label merged with the last of every even one."""
    rows = table(spark, sf_dir, "embeddings")
    folder = work_folder(spark)
    S.write_table(rows.groupBy(F.col("label").alias("word")).agg(F.min_by("embedding", "vec_id").alias("vec")), folder + "/a")
    even = rows.where(F.col("label") % 2 == 0).groupBy(F.col("label").alias("word"))
    S.write_table(even.agg(F.max_by("embedding", "vec_id").alias("vec")), folder + "/b")
    merged = S.load_word_vectors(spark, folder + "/a", folder + "/b")
    return merged.select("word", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


# Labelled column features as a collector would write them: flags as True/False, the variance
# as a bracketed list, the label as a word.
def raw_sql(table_name: str, group: str, value: str, a: str, label: str) -> str:
    return (
        f"SELECT count(*)::VARCHAR AS total, count(DISTINCT {value})::VARCHAR AS distinct_values, "
        f"'[' || (count(*) % 7)::VARCHAR || '.5 ' || (count(*) % 5)::VARCHAR || '.0]' AS variance, "
        f"CASE WHEN {group} % 2 = 0 THEN 'True' ELSE 'False' END AS name_nom, 'False' AS name_ord, 'False' AS key_nom, "
        f"CASE WHEN {group} % 3 = 0 THEN 'True' ELSE 'False' END AS key_ord, '{a}' AS common, '{label}' AS label "
        f"FROM {table_name} GROUP BY {group}"
    )


RAW = [
    raw_sql("customer", "c_nationkey", "c_mktsegment", "False", "nominal"),
    raw_sql("lineitem", "l_suppkey", "l_returnflag", "True", "ordinal"),
]


def raw_features(spark, sf_dir):
    folder = work_folder(spark)
    sources = [
        ("customer", "c_nationkey", "c_mktsegment", "False", "nominal"),
        ("lineitem", "l_suppkey", "l_returnflag", "True", "ordinal"),
    ]
    for name, group, value, common, label in sources:
        size = F.count(F.lit(1))
        rows = table(spark, sf_dir, name).groupBy(group).agg(
            size.alias("total"), F.count_distinct(F.col(value)).alias("distinct_values")
        )
        flag = lambda cond: F.when(cond, "True").otherwise("False")
        S.write_table(
            rows.select(
                "total",
                "distinct_values",
                F.format_string("[%d.5 %d.0]", F.col("total") % 7, F.col("total") % 5).alias("variance"),
                flag(F.col(group) % 2 == 0).alias("name_nom"),
                F.lit("False").alias("name_ord"),
                F.lit("False").alias("key_nom"),
                flag(F.col(group) % 3 == 0).alias("key_ord"),
                F.lit(common).alias("common"),
                F.lit(label).alias("label"),
            ),
            f"{folder}/{label}.csv",
        )
    return S.load_labelled_features(spark, f"{folder}/nominal.csv", f"{folder}/ordinal.csv")


@check("load_labelled", " UNION ALL ".join(RAW))
def load_labelled(spark, sf_dir):
    return raw_features(spark, sf_dir)


@check(
    "tidy_labelled",
    f"""SELECT total, distinct_values, round((split_part(trim(variance, '[]'), ' ', 1)::DOUBLE
      + split_part(trim(variance, '[]'), ' ', 2)::DOUBLE) / 2, 6) AS variance, (name_nom = 'True')::INT AS name_nom,
      (name_ord = 'True')::INT AS name_ord, (key_ord = 'True')::INT AS key_ord, (common = 'True')::INT AS common,
      (label = 'nominal')::INT AS label FROM ({' UNION ALL '.join(RAW)}) r""",
)
def tidy_labelled(spark, sf_dir):
    return L.tidy_features(raw_features(spark, sf_dir)).withColumn("variance", F.round("variance", 6))


# Training rows: every column of known kind, cut into parts by a hash of the row's key, with
# the features of each part. Label 1 nominal, 0 ordinal.
TRAINING = [
    ("orders", "o_orderpriority", "o_orderkey", 0),
    ("fx_likert", "opinion", "event_id", 0),
    ("fx_numrange", "qty_band", "l_orderkey", 0),
    ("customer", "c_mktsegment", "c_custkey", 1),
    ("part", "p_type", "p_partkey", 1),
    ("part", "p_brand", "p_partkey", 1),
    ("part", "p_name", "p_partkey", 1),
    ("fx_likert", "event_type", "event_id", 1),
    ("documents", "lang", "doc_id", 1),
    ("documents", "source", "doc_id", 1),
    ("pages", "url", "page_id", 1),
]
PARTS = 6


def training_features(spark, sf_dir) -> DataFrame:
    rows = []
    for name, col, key, label in TRAINING:
        part = F.pmod(X.hash32(F.col(key).cast("string")), F.lit(PARTS)).cast("string")
        rows.append(
            table(spark, sf_dir, name).select(
                F.concat(F.lit(f"{col}#"), part).alias("col"), F.col(col).alias("value"), F.lit(label).alias("label")
            )
        )
    every = reduce(DataFrame.unionByName, rows)
    counted = settle(every.groupBy("col", "value", "label").agg(F.count(F.lit(1)).alias("n")))
    features = L.column_features(
        counted, table(spark, sf_dir, "fx_wordvec"), DIMS, names=lambda c: F.substring_index(c, "#", 1)
    )
    labels = counted.select("col", "label").distinct()
    return settle(features.join(F.broadcast(labels), "col").withColumn("source", F.substring_index("col", "#", 1)))


def shown(predicted: DataFrame) -> DataFrame:
    return predicted.select("col", "label", "prediction")


@check("gbt_fit_predict")
def gbt_fit_predict(spark, sf_dir):
    train, test = L.split_train_test(training_features(spark, sf_dir))
    return shown(L.predict(test, L.train(train)))


@check("model_save_load")
def model_save_load(spark, sf_dir):
    rows = training_features(spark, sf_dir)
    path = work_folder(spark) + "/model"
    L.save_model(L.train(rows), path)
    return shown(L.predict(rows, L.load_model(path)))


@check("loo")
def loo(spark, sf_dir):
    return shown(L.leave_one_out(training_features(spark, sf_dir)))


@check("holdout")
def holdout(spark, sf_dir):
    return shown(L.hold_out(training_features(spark, sf_dir), "source", ["p_brand", "qty_band", "lang"]))


@check("grid")
def grid(spark, sf_dir):
    return L.grid_search(training_features(spark, sf_dir))


PARTS_SQL = " UNION ".join(
    f"SELECT '{col}' AS source, '{col}#' || ({md5_32(f'{key}::VARCHAR')} % {PARTS}) AS col, {label} AS label FROM {name}" for name, col, key, label in TRAINING
)


@check("loo_rows", f"SELECT col, label, TRUE AS known, 100.0::DOUBLE AS percent FROM ({PARTS_SQL}) t")
def loo_rows(spark, sf_dir):
    """Every training row is predicted once, one class or the other, by a model with a score."""
    found = L.leave_one_out(training_features(spark, sf_dir), trees=20)
    known = F.col("prediction").isin(0, 1) & ((F.col("score") > 0.5) == (F.col("prediction") == 1))
    return found.groupBy("col", "label").agg(F.bool_and(known).alias("known"), (F.count(F.lit(1)) * 100.0).alias("percent"))


@check(
    "grid_points",
    f"""SELECT step, trees, TRUE AS whole FROM (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in L.GRID_STEPS)}]) AS step) s,
      (SELECT unnest([{', '.join(str(x) for x in L.GRID_TREES)}]) AS trees) t""",
)
def grid_points(spark, sf_dir):
    """Every point of the search has the share of an integral number of rows."""
    features = training_features(spark, sf_dir)
    right = F.col("accuracy") * features.count()
    whole = (F.abs(right - F.round(right)) < 1e-6) & F.col("accuracy").between(0, 1)
    return L.grid_search(features, folds=6).select("step", "trees", whole.alias("whole"))


@check("holdout_rows", f"SELECT col, label, TRUE AS known FROM ({PARTS_SQL}) t WHERE source IN ('p_brand', 'qty_band', 'lang')")
def holdout_rows(spark, sf_dir):
    found = L.hold_out(training_features(spark, sf_dir), "source", ["p_brand", "qty_band", "lang"], trees=10)
    return found.select("col", "label", F.col("prediction").isin(0, 1).alias("known"))


@check("split_rows", f"SELECT col, label, {md5_32("'1|' || col")} % 1000000 < 700000 AS learnt FROM ({PARTS_SQL}) t")
def split_rows(spark, sf_dir):
    """The rows that the classifier learns from and those it is asked about."""
    learnt, asked = L.split_train_test(training_features(spark, sf_dir))
    asked = L.predict(asked, L.train(learnt, trees=5)).where(F.col("prediction").isin(0, 1))
    side = lambda rows, known: rows.select("col", "label", F.lit(known).alias("learnt"))
    return side(learnt, True).unionByName(side(asked, False))


@check("model_round_trip", f"SELECT col, label, TRUE AS same FROM ({PARTS_SQL}) t")
def model_round_trip(spark, sf_dir):
    """A saved and loaded model scores every row as the one that was saved."""
    rows = training_features(spark, sf_dir)
    model, path = L.train(rows, trees=20), work_folder(spark) + "/model"
    L.save_model(model, path)
    loaded = L.predict(rows, L.load_model(path)).select("col", F.col("score").alias("again"), F.col("prediction").alias("predicted"))
    same = (F.col("score") == F.col("again")) & (F.col("prediction") == F.col("predicted"))
    return L.predict(rows, model).join(loaded, "col").select("col", "label", same.alias("same"))


SCORED = """scored AS (SELECT quality AS label, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS prediction,
      round(n_chars / 500.0, 0) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def scored(spark, sf_dir):
    """Quality labels, and the length of the text as a naive score."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.select(
        F.col("quality").alias("label"),
        F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("prediction"),
        F.round(F.col("n_chars") / 500.0, 0).alias("score"),
    )


@check(
    "metrics",
    f"""WITH {SCORED}, c AS (SELECT sum((label = 1 AND prediction = 1)::INT)::DOUBLE AS tp, sum((label = 0 AND prediction = 1)::INT)::DOUBLE AS fp,
      sum((label = 1 AND prediction = 0)::INT)::DOUBLE AS fn, avg((label = prediction)::INT) AS acc FROM scored)
      SELECT round(acc, 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall,
      round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
)
def metrics(spark, sf_dir):
    found = L.metrics(scored(spark, sf_dir))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@check(
    "confusion",
    f"""WITH {SCORED} SELECT label, sum((prediction = 0)::INT)::BIGINT AS predicted_0, sum((prediction = 1)::INT)::BIGINT AS predicted_1
      FROM scored GROUP BY label""",
)
def confusion(spark, sf_dir):
    return L.confusion(scored(spark, sf_dir))


@check(
    "roc_auc",
    f"""WITH {SCORED} SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) / count(*), 6) AS auc
      FROM scored a, scored b WHERE a.label = 1 AND b.label = 0""",
)
def roc_auc(spark, sf_dir):
    return L.roc_auc(scored(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


@check(
    "roc_points",
    f"""WITH {SCORED}, t AS (SELECT DISTINCT score AS threshold FROM scored)
      SELECT threshold, round(sum((score >= threshold AND label = 0)::INT)::DOUBLE / sum((label = 0)::INT), 6) AS fpr,
      round(sum((score >= threshold AND label = 1)::INT)::DOUBLE / sum((label = 1)::INT), 6) AS tpr FROM t, scored GROUP BY threshold""",
)
def roc_points(spark, sf_dir):
    found = L.roc_points(scored(spark, sf_dir))
    return found.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))
