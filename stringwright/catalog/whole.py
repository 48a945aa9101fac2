"""Checks of the report and of the complete job."""

from __future__ import annotations

from pyspark.sql import functions as F

from stringwright.catalog.fixtures import table
from stringwright.catalog.modelled import DIMS, PLAIN, training_features
from stringwright.catalog.registry import check, in_list
from stringwright.catalog.repairs import SPOILED, value_counts
from stringwright.catalog.typed import labelled, labelled_sql, long_rows, types_sql
from stringwright import constants as K
from stringwright.functions import text as X
from stringwright.operators import missing as M
from stringwright.operators import ordinality as L
from stringwright.operators import report as R
from stringwright.operators import types as T
from stringwright.operators import values as V
from stringwright.plans.cleaner import StringCleaner
from stringwright.plans.stored import load_cleaner, save_cleaner
from stringwright.session import settle, work_folder

ORDER_TEXTS = [("fx_orders_wide", c, "") for c in ("status", "prio", "month", "d_iso", "d_eu", "done", "gender")]
LISTS_SQL = """outl AS (SELECT col, count(*) AS n, min(value) AS a, max(value) AS z, list_sort(list(value)) AS every
      FROM labelled WHERE label = 'anomaly' GROUP BY col),
    short AS (SELECT col, n, CASE WHEN n < 4 THEN array_to_string(every, '|') WHEN length(a) < 50 THEN a || '|...|' || z
      ELSE '<outlier length too large>' END AS outliers FROM outl)"""


@check(
    "outlier_short",
    labelled_sql(SPOILED) + f""", {LISTS_SQL} SELECT t.col, coalesce(n, 0) AS n_outliers, coalesce(outliers, '') AS outliers
      FROM types t LEFT JOIN short s ON t.col = s.col""",
)
def outlier_short(spark, sf_dir):
    marked = labelled(spark, sf_dir, SPOILED)
    lists = R.outlier_lists(marked.where(F.col("label") == "anomaly"), marked.select("col").distinct())
    return lists.select("col", "n_outliers", F.array_join("outliers", "|").alias("outliers"))


@check(
    "profile_report",
    labelled_sql(ORDER_TEXTS) + f""", {LISTS_SQL},
    every AS (SELECT col, count(DISTINCT value) + max((value IS NULL)::INT) AS u FROM (SELECT * FROM long_rows UNION ALL
      SELECT 'o_orderkey', o_orderkey::VARCHAR FROM fx_orders_wide UNION ALL SELECT 'price', price::VARCHAR FROM fx_orders_wide) x GROUP BY col),
    miss AS (SELECT col, array_to_string(list_sort(list(value)), '|') AS m FROM labelled WHERE label = 'missing' GROUP BY col)
    SELECT e.col, e.u::BIGINT AS unique_values, coalesce(t.type, CASE e.col WHEN 'price' THEN 'float' ELSE 'integer' END) AS type,
      coalesce(m, '') AS missing_values, coalesce(outliers, '') AS outliers
    FROM every e LEFT JOIN types t ON e.col = t.col LEFT JOIN miss ON e.col = miss.col LEFT JOIN short s ON e.col = s.col""",
)
def profile_report(spark, sf_dir):
    df = M.nan_to_null(table(spark, sf_dir, "fx_orders_wide"))
    kinds = spark.createDataFrame(list(T.infer_table(df).items()), "col string, type string")
    values = V.value_table(df, df.columns)
    text = values.where(F.col("col").isin(V.string_columns(df)))
    rows = R.profile(values, R.null_counts(df, df.columns), T.label_values(text, kinds), kinds)
    return rows.select(
        "col",
        "unique_values",
        "type",
        F.array_join("missing_values", "|").alias("missing_values"),
        F.array_join("outliers", "|").alias("outliers"),
    )


DONE = in_list([*K.BOOLEAN_TYPES, *K.DATE_TYPES, *K.NUMERIC_TYPES, "coordinate", "month", "numerical", "ordinal"])


@check(
    "encoder_label",
    types_sql(PLAIN) + f""", d AS (SELECT col, count(*) AS u FROM vals GROUP BY col),
      ask AS (SELECT col, type, u, CASE WHEN type = 'string' THEN col IN ('opinion', 'o_orderpriority') END AS ord FROM types JOIN d USING (col))
      SELECT col, type, CASE WHEN ord THEN 'Yes' WHEN NOT ord THEN 'No' END AS ordinal, CASE WHEN type IN {DONE} THEN 'Custom'
        WHEN ord THEN 'OrdinalEncoder' WHEN u < 30 THEN 'SimilarityEncoder' WHEN u < 100 THEN 'GapEncoder' ELSE 'MinHashEncoder' END
        AS encoding FROM ask""",
)
def encoder_label(spark, sf_dir):
    kinds = T.infer_types(long_rows(spark, sf_dir, PLAIN))
    values = value_counts(spark, sf_dir, PLAIN)
    rows = kinds.join(L.column_counts(values).select("col", F.col("distinct_values").alias("unique_values")), "col")
    features = L.column_features(values, table(spark, sf_dir, "fx_wordvec"), DIMS)
    asked = L.by_rule(features).join(kinds.where(F.col("type") == "string").select("col"), "col", "left_semi")
    return R.encoder_labels(rows, asked, False)


def orders_cleaner(spark, sf_dir, **settings) -> StringCleaner:
    return StringCleaner(
        gazetteer=table(spark, sf_dir, "fx_gazetteer"),
        nouns=table(spark, sf_dir, "fx_nouns"),
        valence=table(spark, sf_dir, "fx_valence"),
        word_vectors=table(spark, sf_dir, "fx_wordvec"),
        vector_dims=DIMS,
        **settings,
    )


def flat(df):
    """Vectors as comma-separated text."""
    return df.select(
        *[
            F.array_join(F.transform(f.name, lambda x: F.round(x, 6).cast("string")), ",").alias(f.name)
            if f.dataType.typeName() == "array"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


@check("clean_only")
def clean_only(spark, sf_dir):
    df = table(spark, sf_dir, "fx_orders_wide")
    return flat(orders_cleaner(spark, sf_dir, encode=False).fit(df).transform(df))


@check(
    "clean_observed",
    """SELECT o.o_orderkey, price, CASE WHEN month(strptime(d_iso, '%Y-%m-%d')) IS NOT NULL THEN epoch(strptime(d_iso, '%Y-%m-%d'))::BIGINT END AS d_iso,
      epoch(strptime(d_eu, '%d/%m/%Y'))::BIGINT AS d_eu, (done = 'yes')::INT AS done, (gender = 'M')::INT AS gender FROM fx_orders_wide o""",
)
def clean_observed(spark, sf_dir):
    """Cleaning only: columns without gaps or misspellings come out as their rules say, for every row."""
    df = table(spark, sf_dir, "fx_orders_wide")
    done = orders_cleaner(spark, sf_dir, encode=False).fit(df).transform(df)
    return done.select("o_orderkey", "price", *[F.col(c).cast("long").alias(c) for c in ("d_iso", "d_eu")], *[F.col(c).cast("int").alias(c) for c in ("done", "gender")])


@check(
    "trained_job",
    "SELECT c_custkey, round(c_acctbal, 4) AS balance, TRUE AS coded, TRUE AS asked FROM customer",
)
def trained_job(spark, sf_dir):
    """The whole job with a trained classifier: text columns it calls ordered get one number, others a
    vector, as the classifier itself says of the job's features."""
    classifier = L.train(training_features(spark, sf_dir), trees=20)
    df = table(spark, sf_dir, "fx_customer_wide").select("c_custkey", "balance", "segment", "seg")
    model = orders_cleaner(spark, sf_dir, ordinality_model=classifier, plain_strings=True).fit(df)
    said = {r["col"]: r["prediction"] for r in L.predict(model.predictions.drop("score", "prediction", "rawPrediction", "probability", "features"), classifier).collect()}
    done = model.transform(df)
    ordered = all((done.schema[c].dataType.typeName() != "array") == (p == 0) for c, p in said.items() if c in done.columns)
    filled = F.col("segment").isNotNull() & F.col("seg").isNotNull()
    return done.select("c_custkey", F.round("balance", 4).alias("balance"), filled.alias("coded"), F.lit(ordered and len(said) == 2).alias("asked"))


@check("stored_job", "SELECT c_custkey, TRUE AS same FROM customer")
def stored_job(spark, sf_dir):
    """A saved and loaded job gives every row what the fitted one gives it."""
    df = table(spark, sf_dir, "fx_customer_wide")
    model, path = orders_cleaner(spark, sf_dir, plain_strings=True, dense=False).fit(df), work_folder(spark) + "/job"
    save_cleaner(model, path)
    row = lambda done: F.to_json(F.struct(*[c for c in done.columns if c != "c_custkey"]))
    first, second = model.transform(df), load_cleaner(spark, path).transform(df)
    again = second.select("c_custkey", row(second).alias("again"))
    same = (F.col("row") == F.col("again")) & F.lit(first.schema.simpleString() == second.schema.simpleString())
    return first.select("c_custkey", row(first).alias("row")).join(again, "c_custkey").select("c_custkey", same.alias("same"))


@check("clean_encode")
def clean_encode(spark, sf_dir):
    df = table(spark, sf_dir, "fx_customer_wide")
    return flat(orders_cleaner(spark, sf_dir, plain_strings=True).fit(df).transform(df))


@check("clean_encode_wide")
def clean_encode_wide(spark, sf_dir):
    df = table(spark, sf_dir, "fx_orders_wide")
    return flat(orders_cleaner(spark, sf_dir, target="status", dense=False).fit(df).transform(df))


@check(
    "clean_parts",
    f"""WITH paths AS (SELECT p_partkey, p_type, p_brand, p_name, p_size, lower(p_type) AS t,
        CASE WHEN p_partkey % 100 = 3 THEN 'x' ELSE 'v' END AS e FROM part),
      counted AS (SELECT *, sum((e = 'x')::INT) OVER (PARTITION BY t) AS nx, sum((e = 'v')::INT) OVER (PARTITION BY t) AS nv,
        count(*) OVER () AS total FROM paths),
      fixed AS (SELECT *, CASE WHEN nx / nv < {K.REPAIR_RATIO} AND nx / total < {K.RARE_FREQUENCY} THEN 'v' ELSE e END AS e2 FROM counted),
      ended AS (SELECT *, bool_or(e2 = 'x') OVER () AS left_over FROM fixed)
      SELECT p_partkey, p_type, p_brand, p_name, t || ' ' || trim(regexp_replace(p_name || ' ' || p_size::VARCHAR, '[^a-zA-Z0-9]+', ' ', 'g')) AS path,
      CASE WHEN left_over THEN t || ' part cs' || e2 ELSE t END AS part_file, p_size::VARCHAR || ',' || (p_partkey % 10)::VARCHAR AS dims,
      CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 21 WHEN 3 THEN 20 WHEN 4 THEN 5 ELSE 112 END AS rnk FROM ended""",
)
def clean_parts(spark, sf_dir):
    """Cleaning only, on a table whose result can be told in SQL: where all misspelt file
    names are repaired, nothing but the kind of part is left of them."""
    df = table(spark, sf_dir, "fx_part_wide")
    return flat(orders_cleaner(spark, sf_dir, encode=False).fit(df).transform(df))


@check(
    "output_order",
    """SELECT 0 AS pos, 'p_partkey' AS name, count(*) AS n FROM part UNION ALL SELECT 1, 'p_type', count(*) FROM part
      UNION ALL SELECT 2, 'p_brand', count(*) FROM part UNION ALL SELECT 3, 'p_name', count(*) FROM part
      UNION ALL SELECT 4, 'path', count(*) FROM part UNION ALL SELECT 5, 'part_file', count(*) FROM part
      UNION ALL SELECT 6, 'dims', count(*) FROM part UNION ALL SELECT 7, 'rnk', count(*) FROM part""",
)
def output_order(spark, sf_dir):
    df = table(spark, sf_dir, "fx_part_wide").select("rnk", "dims", "p_type", "path", "p_brand", "part_file", "p_name", "p_partkey")
    done = orders_cleaner(spark, sf_dir, encode=False).fit(df.select(table(spark, sf_dir, "fx_part_wide").columns)).transform(df)
    counts = done.agg(*[F.count(c).alias(c) for c in done.columns]).unpivot([], done.columns, "name", "n")
    places = F.create_map(*[F.lit(x) for i, c in enumerate(done.columns) for x in (c, i)])
    return counts.select(places[F.col("name")].alias("pos"), "name", "n")


@check("model_report")
def model_report(spark, sf_dir):
    df = table(spark, sf_dir, "fx_customer_wide")
    return flat(orders_cleaner(spark, sf_dir, plain_strings=True).fit(df).report())


@check(
    "clean_keeps_ids",
    "SELECT c_custkey, lpad(c_custkey::VARCHAR, 22, '9') AS long_id, lpad(c_custkey::VARCHAR, 9, '0') AS padded, "
    "c_custkey + 5 AS plain FROM customer",
)
def clean_keeps_ids(spark, sf_dir):
    """Numbers written as text stay text where a number would not say the same."""
    key = F.col("c_custkey").cast("string")
    df = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lpad(key, 22, "9").alias("long_id"), F.lpad(key, 9, "0").alias("padded"),
        (F.col("c_custkey") + 5).cast("string").alias("plain"),
    )
    return StringCleaner(encode=False).fit(df).transform(df).select("c_custkey", "long_id", "padded", "plain")


@check(
    "clean_long_text",
    "SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN repeat('long text ', 200) ELSE (10000 + n_nationkey)::VARCHAR END AS mixed FROM nation",
)
def clean_long_text(spark, sf_dir):
    """One long text among numbers is seen at its full length and keeps the column text."""
    key = F.col("n_nationkey")
    mixed = F.when(key == 0, F.repeat(F.lit("long text "), 200)).otherwise((key + 10000).cast("string"))
    df = table(spark, sf_dir, "nation").select("n_nationkey", mixed.alias("mixed"))
    return StringCleaner(encode=False).fit(df).transform(df).select("n_nationkey", "mixed")


@check(
    "impute_unseen",
    "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS observed, TRUE AS filled FROM customer",
)
def impute_unseen(spark, sf_dir):
    """Regressions learnt without one segment leave that segment's rows as they are."""
    hole = F.col("c_custkey") % 7 == 0
    df = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(~hole, F.col("c_mktsegment")).alias("seg"), F.col("c_acctbal").alias("bal")
    )
    learnt = df.where("seg IS NULL OR seg <> 'BUILDING'")
    plan = M.MissingPlan("regression", ["seg", "bal"])
    plan.coded, plan.whole = ["seg"], ["seg"]
    plan.maps = settle(M.rank_maps(learnt, plan.coded))
    moments, shift = M.pattern_moments(M.rank_encode(learnt, plan.coded, plan.maps).select(*plan.cols), plan.cols)
    plan.normal = M.fit_normal(M.PatternTable(moments, len(plan.cols)), shift)
    done = plan.transform(df)
    return done.select("c_custkey", F.when(~hole, F.col("seg")).alias("observed"), F.col("seg").isNotNull().alias("filled"))


@check(
    "registered_type",
    "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'hello%%world~~' ELSE 'SK-' || lpad((c_custkey % 9)::VARCHAR, 3, '0') END AS sku FROM customer",
)
def registered_type(spark, sf_dir):
    """An anomaly in a column of a user's own type is not a plain value to be drawn anew."""
    registry = T.TypeRegistry()
    registry.register("sku", "SK-[0-9]{3}", 20)
    key = F.col("c_custkey")
    sku = F.concat(F.lit("SK-"), F.lpad((key % 9).cast("string"), 3, "0"))
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(key == 1, "hello%%world~~").otherwise(sku).alias("sku"))
    return StringCleaner(encode=False, types=registry).fit(df).transform(df).select("c_custkey", "sku")


@check(
    "odd_numbers",
    "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 2001 ELSE -1 END AS month, "
    "CASE WHEN c_custkey % 4 = 3 THEN 7 ELSE -1 END AS middle, -1 AS compared FROM customer",
)
def odd_numbers(spark, sf_dir):
    """Numbers of any length end no job."""
    texts = ["12345678901 Jan 2020", "1-99999999999999999999", "$99999999999999999999", "5-9"]
    value = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("c_custkey") % 4 + 1).cast("int"))
    df = table(spark, sf_dir, "customer").select("c_custkey", value.alias("value"))
    value, none = F.col("value"), F.lit(-1)
    found = {"month": X.month_number(value), "middle": X.range_mean(value), "compared": X.compared_number(value)}
    return df.select("c_custkey", *[F.coalesce(x, none).alias(name) for name, x in found.items()])
