"""Checks of outliers, misspellings and missing values."""

from __future__ import annotations

from pyspark.sql import functions as F

from stringwright import constants as K
from stringwright.catalog.fixtures import table
from stringwright.catalog.registry import check, grams, in_list, jaccard, md5_60
from stringwright.catalog.typed import labelled, labelled_sql, long_rows, rows_sql
from stringwright.operators import missing as M
from stringwright.operators import outliers as O
from stringwright.operators import values as V

# Columns with misspellings or with many similar texts.
SIMILAR = [
    ("fx_typo", "segment", "string"),
    ("fx_path_typo", "path", "filepath"),
    ("fx_email", "email", "email"),
    ("fx_url", "url", "url"),
    ("part", "p_name", "string"),
    ("fx_month", "month", "month"),
]
# Columns with values that do not fit the rest.
SPOILED = [
    ("fx_type_outlier", "qty", "integer"),
    ("fx_date_typo", "d_iso", "date-iso-8601"),
    ("fx_day_typo", "day", "day"),
    ("fx_path_typo", "path", "filepath"),
    ("fx_typo", "segment", "string"),
    ("fx_missing", "prio", "string"),
    ("part", "p_brand", "string"),
]


def value_counts(spark, sf_dir, wanted):
    rows = long_rows(spark, sf_dir, wanted).where(F.col("value").isNotNull())
    return rows.groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))


def vals_sql(wanted) -> str:
    return (
        f"vals AS (SELECT col, value, count(*) AS n FROM ({rows_sql(wanted)}) r WHERE value IS NOT NULL "
        "GROUP BY col, value)"
    )


def pairs_sql(source: str = "vals", suspect: str = "true", target: str = "true", accept: str = "true") -> str:
    """``best``: the partner of each value of a relation <col, value, n, ...>."""
    return (
        f"g AS (SELECT *, {grams('value')} AS gr FROM {source}),\n"
        f"pairs AS (SELECT a.col, a.value AS old, b.value AS new, a.n AS n_old, b.n AS n_new, "
        f"{jaccard('a.gr', 'b.gr')} AS similarity FROM g a JOIN g b ON a.col = b.col "
        f"AND (b.n > a.n OR (b.n = a.n AND b.value < a.value)) AND ({suspect}) AND ({target}) AND ({accept})"
        f" AND len(a.gr) >= {K.NGRAM_JACCARD} * len(b.gr) AND len(b.gr) >= {K.NGRAM_JACCARD} * len(a.gr)),\n"
        f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY col, old ORDER BY similarity DESC, "
        f"n_new DESC, new) AS k FROM pairs WHERE similarity >= {K.NGRAM_JACCARD}) s WHERE k = 1)"
    )


@check("trigram", f"WITH {vals_sql(SIMILAR)} SELECT col, value, gram FROM (SELECT col, value, unnest({grams('value')}) AS gram FROM vals) u")
def trigram(spark, sf_dir):
    from stringwright.functions import text as X

    values = value_counts(spark, sf_dir, SIMILAR)
    return values.select("col", "value", F.explode(X.char_ngrams(F.col("value"))).alias("gram"))


@check(
    "similar_pairs",
    f"WITH {vals_sql(SIMILAR)},\n{pairs_sql()} SELECT col, old, new, n_old, n_new, round(similarity, 6) AS similarity FROM best",
)
def similar_pairs(spark, sf_dir):
    found = O.similar_pairs(value_counts(spark, sf_dir, SIMILAR))
    return found.withColumn("similarity", F.round("similarity", 6))


@check(
    "order_pair",
    """WITH v AS (SELECT c_mktsegment AS a, count(*) AS n_a FROM customer GROUP BY c_mktsegment),
    p AS (SELECT v.a, v.n_a, w.segment AS b, w.n AS n_b FROM v JOIN (SELECT segment, count(*) AS n FROM fx_typo
      GROUP BY segment) w ON substr(v.a, 1, 3) = substr(w.segment, 1, 3))
    SELECT CASE WHEN n_a < n_b OR (n_a = n_b AND a <= b) THEN a ELSE b END AS rare, least(n_a, n_b) AS n_rare,
      CASE WHEN n_a < n_b OR (n_a = n_b AND a <= b) THEN b ELSE a END AS common, greatest(n_a, n_b) AS n_common FROM p""",
)
def order_pair(spark, sf_dir):
    clean = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("a")).agg(F.count("*").alias("n_a"))
    typed = table(spark, sf_dir, "fx_typo").groupBy(F.col("segment").alias("b")).agg(F.count("*").alias("n_b"))
    pairs = clean.join(typed, F.substring("a", 1, 3) == F.substring("b", 1, 3))
    return O.order_pair(pairs, "a", "n_a", "b", "n_b")


@check(
    "freq_ratio",
    f"""WITH {vals_sql(SIMILAR)},\n{pairs_sql()} SELECT col, old, new, round(n_old::DOUBLE / n_new, 6) AS ratio,
      n_old::DOUBLE / n_new < {K.REPAIR_RATIO} AS rare FROM best""",
)
def freq_ratio(spark, sf_dir):
    pairs = O.similar_pairs(value_counts(spark, sf_dir, SIMILAR))
    ratio = F.col("n_old") / F.col("n_new")
    return pairs.select(
        "col", "old", "new", F.round(ratio, 6).alias("ratio"), O.far_rarer(F.col("n_old"), F.col("n_new")).alias("rare")
    )


@check(
    "demote",
    labelled_sql(SPOILED) + """ SELECT col, 'string' AS type FROM labelled GROUP BY col
      HAVING count(*) = sum(CASE WHEN label = 'anomaly' THEN 1 ELSE 0 END)""",
)
def demote(spark, sf_dir):
    marked = labelled(spark, sf_dir, SPOILED)
    return O.demoted_columns(marked, marked.where(F.col("label") == "anomaly"))


TOTALS = "totals AS (SELECT col, sum(n) AS total, count(*) AS dv FROM labelled GROUP BY col)"
FEATURES = in_list(K.FEATURE_TYPES)


@check(
    "anomaly_candidates",
    labelled_sql(SPOILED) + f""", {TOTALS} SELECT l.col, value, n, type FROM labelled l JOIN totals t ON l.col = t.col
      WHERE label = 'anomaly' AND type <> 'sentence' AND ((n / total < 0.025 AND dv / total < 0.8)
        OR (type NOT IN {FEATURES} AND type <> 'string'))""",
)
def anomaly_candidates(spark, sf_dir):
    return O.anomaly_candidates(labelled(spark, sf_dir, SPOILED))


INFREQUENT = [*SIMILAR[:4], *SPOILED[:3]]


@check(
    "infrequent_candidates",
    labelled_sql([c for c in INFREQUENT if c[1] != "qty"]) + f""", {TOTALS}
      SELECT l.col, value, n, type FROM labelled l JOIN totals t ON l.col = t.col
      WHERE type IN {FEATURES} AND type <> 'sentence' AND n / total < 0.025 AND dv / total < 0.8
        AND l.col NOT IN (SELECT col FROM labelled WHERE label = 'anomaly')""",
)
def infrequent_candidates(spark, sf_dir):
    return O.infrequent_candidates(labelled(spark, sf_dir, [c for c in INFREQUENT if c[1] != "qty"]))


@check(
    "typo_repair",
    f"""WITH fixed AS (WITH vals AS (SELECT 'segment' AS col, segment AS value, count(*) AS n FROM fx_typo GROUP BY segment),
      t AS (SELECT *, sum(n) OVER () AS total, count(*) OVER () AS dv FROM vals),
      {pairs_sql("t", "a.n / a.total < 0.025 AND a.dv / a.total < 0.8", "true", f"a.n / b.n < {K.REPAIR_RATIO}")}
      SELECT coalesce(b.new, f.segment) AS segment FROM fx_typo f
      LEFT JOIN (SELECT old, new FROM best WHERE new NOT IN (SELECT old FROM best)) b ON f.segment = b.old)
    SELECT segment, count(*) AS n FROM fixed GROUP BY segment""",
)
def typo_repair(spark, sf_dir):
    """Plain text column with the gate for such columns opened."""
    rows = table(spark, sf_dir, "fx_typo")
    marked = V.value_table(rows, ["segment"]).select("*", F.lit("string").alias("type"), F.lit("normal").alias("label"))
    repairs = O.repair_pairs(marked, plain_strings=True)
    fixed = O.apply_repairs(rows, repairs, ["segment"])
    return fixed.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


REPAIR_SQL = (
    labelled_sql(SPOILED)
    + f""", {TOTALS},
    spoiled AS (SELECT DISTINCT col FROM labelled WHERE label = 'anomaly'),
    marked AS (SELECT l.*, total, dv, s.col IS NOT NULL AS spoiled,
      n / total < 0.025 AND dv / total < 0.8 AS rare, label = 'anomaly' AS bad,
      type NOT IN {FEATURES} AND type <> 'string' AS plain, type IN {FEATURES} AND type <> 'sentence' AS feature
      FROM labelled l JOIN totals t ON l.col = t.col LEFT JOIN spoiled s ON l.col = s.col),
    """
    + pairs_sql(
        "marked",
        "CASE WHEN a.plain THEN a.bad WHEN a.type = 'sentence' THEN false ELSE a.rare AND "
        "CASE WHEN a.spoiled THEN a.bad ELSE a.feature END END",
        "NOT (b.plain AND b.bad)",
        f"a.plain OR a.n / b.n < {K.REPAIR_RATIO}",
    )
    + ", repairs AS (SELECT col, old, new, n_old, n_new FROM best b WHERE NOT EXISTS "
    "(SELECT 1 FROM best c WHERE c.col = b.col AND c.old = b.new))"
)


@check("repair_map", REPAIR_SQL + " SELECT * FROM repairs")
def repair_map(spark, sf_dir):
    return O.repair_pairs(labelled(spark, sf_dir, SPOILED))


@check(
    "type_outlier_repair",
    REPAIR_SQL + """ SELECT f.o_orderkey, coalesce(r.new, f.d_iso) AS d_iso FROM fx_date_typo f
      LEFT JOIN repairs r ON r.col = 'd_iso' AND r.old = f.d_iso""",
)
def type_outlier_repair(spark, sf_dir):
    repairs = O.repair_pairs(labelled(spark, sf_dir, SPOILED[:2]))
    return O.apply_repairs(table(spark, sf_dir, "fx_date_typo"), repairs, ["d_iso"])


@check(
    "random_fill",
    REPAIR_SQL + f""",
    clean AS (SELECT col, value, n, sum(n) OVER (PARTITION BY col ORDER BY value) AS upto FROM marked
      WHERE plain AND label = 'normal'),
    sums AS (SELECT col, sum(n) AS clean_rows FROM clean GROUP BY col),
    draws AS (SELECT m.col, m.value AS old, ({md5_60("'0|' || m.col || '|' || m.value")}) % clean_rows AS draw
      FROM marked m JOIN sums s ON m.col = s.col WHERE plain AND bad
      AND NOT EXISTS (SELECT 1 FROM repairs r WHERE r.col = m.col AND r.old = m.value))
    SELECT d.col, d.old, c.value AS new FROM draws d JOIN clean c ON d.col = c.col AND d.draw < c.upto
      AND d.draw >= c.upto - c.n""",
)
def random_fill(spark, sf_dir):
    marked = labelled(spark, sf_dir, SPOILED)
    return O.random_fill(marked, O.repair_pairs(marked))


# Missing values -------------------------------------------------------------------------

NA = in_list(K.NA_TOKENS)
NULLED = f"nulled AS (SELECT o_orderkey, CASE WHEN prio IN {NA} THEN NULL ELSE prio END AS prio, price, status FROM fx_missing)"


def nulled(spark, sf_dir, view="fx_missing"):
    df = table(spark, sf_dir, view)
    return M.tokens_to_null(M.nan_to_null(df), {"prio": K.NA_TOKENS})


@check("na_to_null", f"WITH {NULLED} SELECT * FROM nulled")
def na_to_null(spark, sf_dir):
    return nulled(spark, sf_dir)


@check(
    "incomplete_ratio",
    f"WITH {NULLED} SELECT round(avg(CASE WHEN prio IS NULL OR price IS NULL OR status IS NULL THEN 1.0 ELSE 0.0 END), 9) AS ratio FROM nulled",
)
def incomplete_ratio(spark, sf_dir):
    return M.incomplete_ratio(nulled(spark, sf_dir)).select(F.round("ratio", 9).alias("ratio"))


@check("drop_rows", f"SELECT * FROM fx_rare_missing WHERE prio NOT IN {NA}")
def drop_rows(spark, sf_dir):
    return M.drop_incomplete(nulled(spark, sf_dir, "fx_rare_missing"))


CODED = f"""{NULLED}, coded AS (SELECT o_orderkey,
      CASE WHEN prio IS NULL THEN NULL ELSE (dense_rank() OVER (ORDER BY prio NULLS LAST) - 1)::DOUBLE END AS prio,
      price / 1000 AS price, (dense_rank() OVER (ORDER BY status) - 1)::DOUBLE AS status FROM nulled)"""


def coded(spark, sf_dir):
    rows = nulled(spark, sf_dir)
    maps = M.rank_maps(rows, ["prio", "status"])
    return M.rank_encode(rows, ["prio", "status"], maps).withColumn("price", F.col("price") / 1000)


@check("rank_encode", f"WITH {CODED} SELECT o_orderkey, prio, round(price, 6) AS price, status FROM coded")
def rank_encode(spark, sf_dir):
    return coded(spark, sf_dir).withColumn("price", F.round("price", 6))


@check(
    "missing_patterns",
    f"""WITH {CODED} SELECT CASE WHEN prio IS NULL THEN '1' ELSE '0' END || CASE WHEN price IS NULL THEN '1' ELSE '0' END
      || CASE WHEN status IS NULL THEN '1' ELSE '0' END AS pattern, count(*) AS n, round(avg(prio), 6) AS mean_prio,
      round(avg(price), 6) AS mean_price, round(avg(status), 6) AS mean_status FROM coded GROUP BY 1""",
)
def missing_patterns(spark, sf_dir):
    found = M.missing_patterns(coded(spark, sf_dir), ["prio", "price", "status"])
    return found.select("pattern", "n", *[F.round(f"mean_{c}", 6).alias(f"mean_{c}") for c in ("prio", "price", "status")])


def _pair_sql(a: str, b: str) -> str:
    return (
        f"SELECT '{a}' AS a, '{b}' AS b, round(avg({a}), 6) AS mean_a, round(avg({b}), 6) AS mean_b, "
        f"round(covar_samp({a}, {b}), 6) AS cov FROM coded"
    )


PAIRS = [("prio", "prio"), ("prio", "price"), ("prio", "status"), ("price", "price"), ("price", "status"), ("status", "status")]


@check("pairwise_cov", f"WITH {CODED} " + " UNION ALL ".join(_pair_sql(a, b) for a, b in PAIRS))
def pairwise_cov(spark, sf_dir):
    found = M.pairwise_moments(coded(spark, sf_dir), ["prio", "price", "status"])
    return found.select("a", "b", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "cov")])


@check("mcar_test")
def mcar_test(spark, sf_dir):
    return M.mcar_test(coded(spark, sf_dir), ["prio", "price", "status"])


@check(
    "mcar_statistic",
    f"""WITH {CODED}, m AS (SELECT avg(prio) AS ma, avg(price) AS mb, avg(status) AS mc, var_samp(prio) AS aa, var_samp(price) AS bb,
      var_samp(status) AS cc, covar_samp(prio, price) AS ab, covar_samp(prio, status) AS ac, covar_samp(price, status) AS bc FROM coded),
    g AS (SELECT prio IS NOT NULL AS a, price IS NOT NULL AS b, status IS NOT NULL AS c, count(*) AS n, avg(prio) - any_value(ma) AS x,
      avg(price) - any_value(mb) AS y, avg(status) - any_value(mc) AS z FROM coded, m GROUP BY 1, 2, 3),
    d AS (SELECT a::INT + b::INT + c::INT AS seen, n * CASE
      WHEN a AND b AND c THEN (x * x * (bb * cc - bc * bc) + y * y * (aa * cc - ac * ac) + z * z * (aa * bb - ab * ab)
        + 2 * x * y * (ac * bc - ab * cc) + 2 * x * z * (ab * bc - ac * bb) + 2 * y * z * (ab * ac - aa * bc))
        / (aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac))
      WHEN a AND b THEN (x * x * bb - 2 * x * y * ab + y * y * aa) / (aa * bb - ab * ab)
      WHEN a AND c THEN (x * x * cc - 2 * x * z * ac + z * z * aa) / (aa * cc - ac * ac)
      WHEN b AND c THEN (y * y * cc - 2 * y * z * bc + z * z * bb) / (bb * cc - bc * bc)
      WHEN a THEN x * x / aa WHEN b THEN y * y / bb WHEN c THEN z * z / cc ELSE 0 END AS d2 FROM g, m)
    SELECT round(sum(d2), 6) AS d2, (sum(seen) - 3)::BIGINT AS dof FROM d""",
)
def mcar_statistic(spark, sf_dir):
    """Little's statistic and its degrees of freedom; SQL inverts the covariances by hand."""
    return M.mcar_test(coded(spark, sf_dir), ["prio", "price", "status"]).select(F.round("d2", 6).alias("d2"), "dof")


TYPES = {"prio": "string", "price": "float", "status": "string"}


@check(
    "impute_mode_mean",
    f"""WITH {NULLED} SELECT o_orderkey, coalesce(prio, (SELECT prio FROM nulled WHERE prio IS NOT NULL GROUP BY prio
      ORDER BY count(*) DESC, prio LIMIT 1)) AS prio, round(coalesce(price, (SELECT avg(price) FROM nulled)), 4) AS price,
      status FROM nulled""",
)
def impute_mode_mean(spark, sf_dir):
    done = M.impute_mode_mean(nulled(spark, sf_dir), TYPES, ["prio", "price", "status"])
    return done.withColumn("price", F.round("price", 4))


@check("impute_iterative")
def impute_iterative(spark, sf_dir):
    return M.impute_iterative(coded(spark, sf_dir), ["prio", "price", "status"], ["prio", "status"])


@check(
    "impute_observed",
    f"WITH {CODED} SELECT o_orderkey, prio, round(price, 6) AS price, status, TRUE AS whole FROM coded",
)
def impute_observed(spark, sf_dir):
    """Imputation leaves what was observed and fills every gap; codes come out whole."""
    gaps = coded(spark, sf_dir)
    done = M.impute_iterative(gaps, ["prio", "price", "status"], ["prio", "status"])
    met = gaps.join(done.select("o_orderkey", *[F.col(c).alias(f"{c}_done") for c in ("prio", "price", "status")]), "o_orderkey")
    whole = (F.col("prio_done") == F.round("prio_done")) & (F.col("status_done") == F.round("status_done")) & F.col("price_done").isNotNull()
    was = lambda c: F.when(F.col(c).isNotNull(), F.col(f"{c}_done"))
    return met.select("o_orderkey", was("prio").alias("prio"), F.round(was("price"), 6).alias("price"), was("status").alias("status"), whole.alias("whole"))


@check(
    "impute_one_gap",
    """WITH o AS (SELECT o_orderkey, o_custkey::DOUBLE AS a, (o_orderkey % 1000)::DOUBLE AS b,
      CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 100 + o_custkey / 10.0 END AS y FROM orders),
    k AS (SELECT * FROM o WHERE y IS NOT NULL),
    m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab,
      covar_samp(a, y) AS ay, covar_samp(b, y) AS yb FROM k)
    SELECT o_orderkey, round(coalesce(y, my + (ay * bb - yb * ab) / (aa * bb - ab * ab) * (a - ma)
      + (yb * aa - ay * ab) / (aa * bb - ab * ab) * (b - mb)), 4) AS y FROM o, m""",
)
def impute_one_gap(spark, sf_dir):
    """With gaps in one column only, the fixed point is its regression on the others over the rows without."""
    a, key = F.col("o_custkey").cast("double"), F.col("o_orderkey")
    y = F.when(key % 7 != 0, F.col("o_totalprice") / 100 + F.col("o_custkey") / 10.0)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), (key % 1000).cast("double").alias("b"), y.alias("y"))
    return M.impute_iterative(rows, ["a", "b", "y"], tolerance=1e-12).select("o_orderkey", F.round("y", 4).alias("y"))


@check(
    "decode_nearest",
    f"""WITH {NULLED}, known AS (SELECT prio, (dense_rank() OVER (ORDER BY prio) - 1) AS code FROM
      (SELECT DISTINCT prio FROM nulled WHERE prio IS NOT NULL) d),
    guess AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 8 - 0.5 AS x FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, k.prio AS x FROM guess JOIN known k ON k.code =
      greatest(0, least(ceil(x - 0.5), (SELECT max(code) FROM known)))""",
)
def decode_nearest(spark, sf_dir):
    maps = M.rank_maps(nulled(spark, sf_dir), ["prio"]).withColumn("col", F.lit("x"))
    guess = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") / 8 - 0.5).alias("x")
    )
    return M.decode_nearest(guess, ["x"], maps)


@check(
    "missing_plan_rows",
    f"""SELECT 'fx_missing' AS view, count(*) AS n, 0::BIGINT AS incomplete, FALSE AS dropped FROM fx_missing
      UNION ALL SELECT 'fx_rare_missing', count(*) FILTER (prio NOT IN {NA}), 0, TRUE FROM fx_rare_missing
      UNION ALL SELECT 'fx_typo', count(*), 0, FALSE FROM fx_typo""",
)
def missing_plan_rows(spark, sf_dir):
    """Few incomplete rows are dropped, many are filled, complete tables stay; nothing is left incomplete."""
    return missing_plan(spark, sf_dir).select("view", "n", "incomplete", (F.col("strategy") == "drop").alias("dropped"))


@check("missing_plan")
def missing_plan(spark, sf_dir):
    """The strategy chosen for each fixture, and the rows and nulls after applying it."""
    out = []
    for view in ("fx_missing", "fx_rare_missing", "fx_typo"):
        rows = nulled(spark, sf_dir, view) if view != "fx_typo" else table(spark, sf_dir, view)
        cols = [c for c in ("prio", "price", "status", "segment") if c in rows.columns]
        types = {c: TYPES.get(c, "string") for c in cols}
        plan = M.plan_missing(rows, types, cols)
        done = plan.transform(rows)
        out.append(
            done.agg(
                F.lit(view).alias("view"),
                F.lit(plan.strategy).alias("strategy"),
                F.count(F.lit(1)).alias("n"),
                F.sum(M.any_null(cols).cast("int")).alias("incomplete"),
            )
        )
    return out[0].unionByName(out[1]).unionByName(out[2])
