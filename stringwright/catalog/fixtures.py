"""Views derived from the test tables; one SQL text serves both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS = {
    "fx_email": r"""
        SELECT c_custkey, lower(replace(c_name,'#','.')) || '@mail' || CAST(c_custkey % 7 AS STRING)
        || '.example.com' AS email FROM customer""",
    "fx_filepath": r"""
        SELECT p_partkey, '/data/lake/' || lower(p_type) || '/' || replace(p_name,' ','_') || '_'
        || CAST(p_size AS STRING) || '.csv' AS path FROM part""",
    "fx_url": r"""
        SELECT page_id, url FROM pages""",
    "fx_day": r"""
        SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN
        'Wednesday' WHEN 3 THEN 'Thursday' WHEN 4 THEN 'Friday' WHEN 5 THEN 'Saturday' ELSE 'Sunday'
        END AS day FROM events""",
    "fx_month": r"""
        SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN m WHEN 1 THEN m || ' ' || CAST(y AS
        STRING) WHEN 2 THEN m || ' ''' || substr(CAST(y AS STRING),3,2) ELSE CAST(d AS STRING)
        || ' ' || m || ' ' || CAST(y AS STRING) END AS month FROM (SELECT o_orderkey, substr('JanFebMarAprMayJunJulAugSepOctNovDec',
        CAST(month(o_orderdate)*3-2 AS INT), 3) AS m, year(o_orderdate) AS y, day(o_orderdate)
        AS d FROM orders) t""",
    "fx_numrange": r"""
        SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 40 THEN '40+' ELSE CAST(CAST(floor(l_quantity/10)*10
        AS INT) AS STRING) || '-' || CAST(CAST(floor(l_quantity/10)*10+9 AS INT) AS STRING) END
        AS qty_band FROM lineitem""",
    "fx_numlist": r"""
        SELECT p_partkey, CAST(p_size AS STRING) || '+' || CAST(p_partkey % 10 AS STRING) AS dims
        FROM part""",
    "fx_ordinal": r"""
        SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'first' WHEN 1 THEN 'Second' WHEN 2 THEN
        'twenty-first' WHEN 3 THEN 'twentieth' WHEN 4 THEN '5th' ELSE 'one hundred and twelfth'
        END AS rnk FROM part""",
    "fx_zip": r"""
        SELECT c_custkey, CAST(1000 + c_custkey % 50 AS STRING) || ' AB' AS zip FROM customer""",
    "fx_gazetteer": r"""
        SELECT DISTINCT CAST(1000 + n_nationkey AS STRING) || ' AB' AS zip, 'City_' || CAST(n_nationkey
        AS STRING) AS city, lower(substr(n_name,1,2)) AS country, CAST(-60 + n_nationkey*5 AS DOUBLE)
        AS lat, CAST(-170 + n_nationkey*14 AS DOUBLE) AS lon FROM nation""",
    "fx_coord": r"""
        SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN 'N' ELSE 'S' END || CAST(10 + s_suppkey
        % 70 AS STRING) || '.' || lpad(CAST(s_suppkey % 60 AS STRING),2,'0') || '.30 ' || CASE
        s_suppkey % 3 WHEN 0 THEN 'W' ELSE 'E' END || CAST(10 + s_suppkey % 80 AS STRING) || '.15.'
        || lpad(CAST(s_suppkey*7 % 60 AS STRING),2,'0') AS coord FROM supplier""",
    "fx_dms": r"""
        SELECT s_suppkey, CAST(s_suppkey % 89 AS STRING) || 'º ' || CAST(s_suppkey % 60 AS STRING)
        || ''' ' || '30.5" ' || CASE WHEN s_suppkey % 2 = 0 THEN 'N' ELSE 'W' END AS dms FROM supplier""",
    "fx_dates": r"""
        SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d_iso, lpad(CAST(day(o_orderdate)
        AS STRING),2,'0') || '/' || lpad(CAST(month(o_orderdate) AS STRING),2,'0') || '/' || CAST(year(o_orderdate)
        AS STRING) AS d_eu FROM orders""",
    "fx_decimal": r"""
        SELECT c_custkey, CAST(c_acctbal AS STRING) AS balance_text FROM customer""",
    "fx_bool": r"""
        SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN 'yes' ELSE 'no' END AS done, CASE WHEN
        o_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender FROM orders""",
    "fx_missing": r"""
        SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN
        'N/A' ELSE o_orderpriority END AS prio, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice
        END AS price, o_orderstatus AS status FROM orders""",
    "fx_rare_missing": r"""
        SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN '-' ELSE o_orderpriority END AS
        prio, o_totalprice AS price FROM orders""",
    "fx_typo": r"""
        SELECT c_custkey, CASE WHEN c_custkey % 100 = 3 THEN substr(c_mktsegment,1,length(c_mktsegment)-1)
        || 'X' ELSE c_mktsegment END AS segment FROM customer""",
    "fx_type_outlier": r"""
        SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 501 = 0 THEN 'unknown' ELSE CAST(CAST(l_quantity
        AS INT) AS STRING) END AS qty FROM lineitem""",
    "fx_likert": r"""
        SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'strongly disagree' WHEN 1 THEN 'slightly disagree'
        WHEN 2 THEN 'neutral' WHEN 3 THEN 'slightly agree' ELSE 'strongly agree' END AS opinion,
        event_type FROM events""",
    "fx_wordvec": r"""
        SELECT word, embedding AS vec FROM (SELECT word, row_number() OVER (ORDER BY word) - 1
        AS rn FROM (SELECT DISTINCT lower(p_type) AS word FROM part) t) u JOIN embeddings ON vec_id
        = rn""",
    "fx_valence": r"""
        SELECT word, CAST(p AS DOUBLE) AS polarity, CAST(i AS DOUBLE) AS intensity FROM (VALUES
        ('strongly',0,2),('slightly',0,0.5),('agree',1,1),('disagree',-1,1),('neutral',0,1)) AS
        v(word,p,i)""",
    "fx_nouns": r"""
        SELECT DISTINCT split_part(p_name,' ',2) AS word FROM part""",
    "fx_nbsp": r"""
        SELECT c_custkey, replace(c_mktsegment,'I',chr(160)) AS seg, CAST(NULL AS STRING) AS empty_col
        FROM customer""",
    "fx_labelled": r"""
        SELECT col, value, label FROM (SELECT 'priority' AS col, o_orderpriority AS value, 0 AS
        label FROM orders UNION ALL SELECT 'segment', c_mktsegment, 1 FROM customer UNION ALL SELECT
        'type', p_type, 1 FROM part UNION ALL SELECT 'event', event_type, 1 FROM events) t""",
    "fx_path_typo": r"""
        SELECT p_partkey, '/data/lake/' || lower(p_type) || '/part.cs' || CASE WHEN p_partkey %
        100 = 3 THEN 'x' ELSE 'v' END AS path FROM part""",
}

# Views that combine several of the above, for whole-table operators.
VIEWS["fx_orders_wide"] = """
        SELECT o.o_orderkey, o.o_orderstatus AS status, o.o_totalprice AS price,
          m.prio AS prio, h.month AS month, d.d_iso AS d_iso, d.d_eu AS d_eu, b.done AS done,
          b.gender AS gender
        FROM orders o JOIN fx_missing m ON o.o_orderkey = m.o_orderkey
          JOIN fx_month h ON o.o_orderkey = h.o_orderkey
          JOIN fx_dates d ON o.o_orderkey = d.o_orderkey
          JOIN fx_bool b ON o.o_orderkey = b.o_orderkey"""
VIEWS["fx_customer_wide"] = """
        SELECT c.c_custkey, c.c_acctbal AS balance, s.segment AS segment, e.email AS email,
          z.zip AS zip, n.seg AS seg, n.empty_col AS empty_col
        FROM customer c JOIN fx_typo s ON c.c_custkey = s.c_custkey
          JOIN fx_email e ON c.c_custkey = e.c_custkey
          JOIN fx_zip z ON c.c_custkey = z.c_custkey
          JOIN fx_nbsp n ON c.c_custkey = n.c_custkey"""
VIEWS["fx_part_wide"] = """
        SELECT p.p_partkey, p.p_type AS p_type, p.p_brand AS p_brand, p.p_name AS p_name,
          f.path AS path, t.path AS part_file, l.dims AS dims, r.rnk AS rnk
        FROM part p JOIN fx_filepath f ON p.p_partkey = f.p_partkey
          JOIN fx_path_typo t ON p.p_partkey = t.p_partkey
          JOIN fx_numlist l ON p.p_partkey = l.p_partkey
          JOIN fx_ordinal r ON p.p_partkey = r.p_partkey"""
VIEWS["fx_date_typo"] = """
        SELECT o_orderkey, d_iso || CASE WHEN o_orderkey % 501 = 0 THEN 'x' ELSE '' END AS d_iso FROM fx_dates"""
VIEWS["fx_day_typo"] = """
        SELECT event_id, day || CASE WHEN event_id % 199 = 0 THEN 'y' ELSE '' END AS day FROM fx_day"""


def needed(sql: str) -> list[str]:
    """Names of the views a query uses, dependencies first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in VIEWS and name not in found:
                visit(VIEWS[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def with_views(sql: str) -> str:
    """The query with the views it needs in front as common table expressions."""
    names = needed(sql)
    if not names:
        return sql
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    body = sql.strip()
    if re.match(r"(?i)with\s", body):
        return "WITH " + ",\n".join(parts) + ",\n" + re.sub(r"(?i)\Awith\s+", "", body)
    return "WITH " + ",\n".join(parts) + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, or one of the views over the test tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return query(spark, sf_dir, f"SELECT * FROM {name}")


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL over the test tables and views."""
    text = with_views(sql)
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text)
