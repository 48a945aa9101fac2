"""Checks of value tables and column type inference."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringwright import constants as K
from stringwright.catalog.fixtures import table
from stringwright.catalog.registry import check, in_list, quoted
from stringwright.functions import recognise
from stringwright.operators import types as T
from stringwright.operators import values as V
from stringwright.session import settle, work_folder
from stringwright.sources import tables as S

# Columns with the type each is known to hold.
LABELLED = [
    ("fx_email", "email", "email"),
    ("fx_filepath", "path", "filepath"),
    ("fx_url", "url", "url"),
    ("fx_day", "day", "day"),
    ("fx_month", "month", "month"),
    ("fx_numrange", "qty_band", "numerical"),
    ("fx_numlist", "dims", "numerical"),
    ("fx_ordinal", "rnk", "ordinal"),
    ("fx_zip", "zip", "zipcode"),
    ("fx_coord", "coord", "coordinate"),
    ("fx_dms", "dms", "coordinate"),
    ("fx_dates", "d_iso", "date-iso-8601"),
    ("fx_dates", "d_eu", "date-eu"),
    ("fx_decimal", "balance_text", "float"),
    ("fx_bool", "done", "boolean"),
    ("fx_bool", "gender", "gender"),
    ("fx_missing", "prio", "string"),
    ("fx_missing", "status", "string"),
    ("fx_typo", "segment", "string"),
    ("fx_type_outlier", "qty", "integer"),
    ("fx_likert", "opinion", "string"),
    ("documents", "text", "sentence"),
    ("documents", "lang", "string"),
    ("documents", "source", "string"),
    ("part", "p_type", "string"),
    ("part", "p_brand", "string"),
    ("part", "p_name", "string"),
    ("customer", "c_mktsegment", "string"),
    ("events", "event_type", "string"),
    ("lineitem", "l_returnflag", "string"),
    ("lineitem", "l_linestatus", "string"),
    ("orders", "o_orderpriority", "string"),
    ("nation", "n_name", "string"),
    ("region", "r_name", "string"),
]


def long_rows(spark: SparkSession, sf_dir: str, wanted=None) -> DataFrame:
    """``<col, value>`` of the labelled columns, one scan per table."""
    by_table: dict[str, list[str]] = {}
    for name, col, _ in wanted or LABELLED:
        by_table.setdefault(name, []).append(col)
    parts = [V.long_form(table(spark, sf_dir, n), cols) for n, cols in by_table.items()]
    return reduce(DataFrame.unionByName, parts)


def true_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, t) for _, c, t in LABELLED], "col string, true_type string")


def rows_sql(wanted=None) -> str:
    return " UNION ALL ".join(
        f"SELECT {quoted(c)} AS col, {c} AS value FROM {t}" for t, c, _ in wanted or LABELLED
    )


def matches_sql(kind: str, value: str = "value") -> str:
    """SQL condition that a text is of a kind."""
    if kind in recognise.WORD_LISTS:
        return f"{value} IN {in_list(recognise.WORD_LISTS[kind])}"
    if kind == "sentence":
        rule = f"(?:{recognise.SENTENCE_WORD}+{recognise.SENTENCE_GAP}+){{5}}"
        return f"regexp_matches({value}, {quoted(rule)})"
    return f"regexp_full_match({value}, {quoted(recognise.PATTERNS[kind])})"


def scores_sql() -> str:
    """Common table expressions ``vals`` and ``scores`` over a relation ``long_rows``."""
    size = "length(value)"
    anomaly = (
        f"({math.log(K.WEIGHT_ANOMALY) + math.log(K.STOP_PROBABILITY) - K.ANOMALY_PENALTY!r}"
        f" - {size} * {math.log(K.ANOMALY_ALPHABET)!r})"
    )
    missing = (
        f"CASE WHEN value IN {in_list(K.NA_TOKENS)}"
        f" THEN {math.log(K.WEIGHT_MISSING) - math.log(len(K.NA_TOKENS))!r} ELSE -1e9 END"
    )
    parts = []
    for kind in recognise.TYPES:
        if kind in recognise.WORD_LISTS:
            own = repr(math.log(K.WEIGHT_TYPE) - math.log(len(recognise.WORD_LISTS[kind])))
        else:
            own = (
                f"({math.log(K.WEIGHT_TYPE) + math.log(K.STOP_PROBABILITY)!r}"
                f" - {size} * {math.log(K.ALPHABET[kind])!r})"
            )
        parts.append(
            f"SELECT col, {quoted(kind)} AS type, n, bg, {size} AS len,"
            f" CASE WHEN {matches_sql(kind)} THEN {own} ELSE -1e9 END AS lp FROM base"
        )
    return (
        "vals AS (SELECT col, value, count(*) AS n FROM long_rows WHERE value IS NOT NULL GROUP BY col, value),\n"
        f"raw AS (SELECT *, {anomaly} AS an, {missing} AS mi FROM vals),\n"
        "base AS (SELECT *, greatest(an, mi) + ln(1 + exp(-abs(an - mi))) AS bg FROM raw),\n"
        "fits AS (" + "\nUNION ALL ".join(parts) + "),\n"
        "scores AS (SELECT col, type, sum(n * (greatest(lp, bg) + ln(1 + exp(-abs(lp - bg))))) / sum(n) AS score\n"
        "  FROM fits GROUP BY col, type),\n"
        "types AS (SELECT col, type, score FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY\n"
        "  round(score, 9) DESC, CASE WHEN type = 'string' THEN '' ELSE type END) AS k FROM scores) s WHERE k = 1)"
    )


def types_sql(wanted=None) -> str:
    return f"WITH long_rows AS ({rows_sql(wanted)}),\n{scores_sql()}"


def labelled_sql(wanted=None) -> str:
    """Common table expression ``labelled`` <col, value, n, type, label>."""
    fits = " ".join(f"WHEN t.type = {quoted(k)} THEN {matches_sql(k)}" for k in recognise.TYPES)
    return (
        types_sql(wanted) + ",\nlabelled AS (SELECT v.col, v.value, v.n, t.type, CASE WHEN value IN "
        f"{in_list(K.NA_TOKENS)} THEN 'missing' WHEN CASE {fits} ELSE false END THEN 'normal' ELSE 'anomaly' END"
        " AS label FROM vals v JOIN types t ON v.col = t.col)"
    )


def labelled(spark: SparkSession, sf_dir: str, wanted=None) -> DataFrame:
    rows = long_rows(spark, sf_dir, wanted)
    counts = rows.where(F.col("value").isNotNull()).groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    return settle(T.label_values(counts, T.infer_types(rows)))


@check("load_csv", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def load_csv(spark, sf_dir):
    """The customer table written as CSV and read back, every column as text."""
    path = work_folder(spark) + "/customer.csv"
    S.write_table(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return S.read_table(spark, path)


@check("load_parquet", "SELECT p_partkey, p_name, p_type, p_size FROM part")
def load_parquet(spark, sf_dir):
    return S.read_table(spark, f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type", "p_size")


@check("sample_head", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 200")
def sample_head(spark, sf_dir):
    return S.sample_head(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"])


@check("nbsp", "SELECT c_custkey, replace(seg, chr(160), ' ') AS seg FROM fx_nbsp")
def nbsp(spark, sf_dir):
    return V.normalise_spaces(table(spark, sf_dir, "fx_nbsp")).select("c_custkey", "seg")


@check("drop_empty", "SELECT c_custkey, seg FROM fx_nbsp")
def drop_empty(spark, sf_dir):
    return V.drop_empty_columns(table(spark, sf_dir, "fx_nbsp"))


@check(
    "label_encode",
    "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders",
)
def label_encode(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return V.label_encode(rows, "o_orderpriority")


@check("value_freq", f"SELECT col, value, count(*) AS n FROM ({rows_sql()}) r WHERE value IS NOT NULL GROUP BY col, value")
def value_freq(spark, sf_dir):
    rows = long_rows(spark, sf_dir)
    return rows.where(F.col("value").isNotNull()).groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))


@check("infer_types", types_sql() + " SELECT col, type, round(score, 6) AS score FROM types")
def infer_types(spark, sf_dir):
    return T.infer_types(long_rows(spark, sf_dir))


@check(
    "type_scores",
    types_sql() + " SELECT col, type, round(score, 4) AS score FROM scores WHERE score > -1000",
)
def type_scores(spark, sf_dir):
    """Stop probability, alphabets and mixture behind every column's choice."""
    scores = T.type_scores(T.text_shapes(long_rows(spark, sf_dir)))
    return scores.where(F.col("score") > -1000).select("col", "type", F.round("score", 4).alias("score"))


@check("na_tokens", labelled_sql() + " SELECT col, value, n FROM labelled WHERE label = 'missing'")
def na_tokens(spark, sf_dir):
    return T.missing_tokens(labelled(spark, sf_dir))


@check("anomalies", labelled_sql() + " SELECT col, value, n FROM labelled WHERE label = 'anomaly'")
def anomalies(spark, sf_dir):
    return T.anomalies(labelled(spark, sf_dir))


def _recogniser(kind: str) -> None:
    """One check per recogniser: how many distinct texts and rows of each column it accepts."""
    sql = (
        f"SELECT col, count(*) AS texts, sum(n)::BIGINT AS n FROM (SELECT col, value, count(*) AS n FROM "
        f"({rows_sql()}) r GROUP BY col, value) v WHERE {matches_sql(kind)} GROUP BY col"
    )

    @check("is_" + kind.replace("-", "_"), sql)
    def accepts(spark, sf_dir):
        rows = long_rows(spark, sf_dir)
        fitting = rows.where(recognise.looks_like(F.col("value"), kind))
        per_text = fitting.groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
        return per_text.groupBy("col").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"))


for _kind in recognise.TYPES:
    _recogniser(_kind)


@check(
    "route_columns",
    types_sql() + f""" SELECT col, type, CASE WHEN type IN {in_list(K.FEATURE_TYPES)} THEN 'string_feature'
      WHEN type = 'string' THEN 'string' WHEN type IN ('boolean', 'gender') THEN 'boolean'
      WHEN type IN ('date-iso-8601', 'date-eu') THEN 'date' ELSE 'other' END AS grp FROM types""",
)
def route_columns(spark, sf_dir):
    types = T.infer_types(long_rows(spark, sf_dir))
    return types.select("col", "type", T.column_group(F.col("type")).alias("grp"))


@check(
    "type_confusion",
    types_sql() + ", truth(col, true_type) AS (VALUES "
    + ", ".join(f"({quoted(c)}, {quoted(t)})" for _, c, t in LABELLED)
    + ") SELECT true_type, type, count(*) AS n FROM types JOIN truth USING (col) GROUP BY true_type, type",
)
def type_confusion(spark, sf_dir):
    return T.type_confusion(T.infer_types(long_rows(spark, sf_dir)), true_types(spark))
