"""Checks of the processing rules and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from stringwright import constants as K
from stringwright.catalog.fixtures import table
from stringwright.catalog.registry import check, grams, jaccard, md5_32
from stringwright.functions import text as X
from stringwright.operators import encode as E
from stringwright.operators import gap as G
from stringwright.operators import features as P
from stringwright.operators import values as V


@check(
    "proc_boolean",
    """SELECT o_orderkey, dense_rank() OVER (ORDER BY done) - 1 AS done, dense_rank() OVER (ORDER BY gender) - 1 AS gender
      FROM fx_bool""",
)
def proc_boolean(spark, sf_dir):
    return V.label_encode(V.label_encode(table(spark, sf_dir, "fx_bool"), "done"), "gender")


@check(
    "proc_date",
    """SELECT o_orderkey, epoch(strptime(d_iso, '%Y-%m-%d'))::BIGINT AS d_iso, epoch(strptime(d_eu, '%d/%m/%Y'))::BIGINT AS d_eu
      FROM fx_dates""",
)
def proc_date(spark, sf_dir):
    dates = table(spark, sf_dir, "fx_dates")
    return dates.select("o_orderkey", X.to_epoch(F.col("d_iso")).alias("d_iso"), X.to_epoch(F.col("d_eu")).alias("d_eu"))


@check("proc_day", "SELECT event_id, substr(day, 1, 2) AS day FROM fx_day")
def proc_day(spark, sf_dir):
    return table(spark, sf_dir, "fx_day").withColumn("day", X.day_code(F.col("day")))


def prefix_sql(view: str, col: str, reverse: bool = False) -> str:
    """Scalar subquery: length of the prefix common to all values, found position by position."""
    v = f"reverse({col})" if reverse else col
    return (
        f"(SELECT coalesce(max(i), 0) FROM (SELECT unnest(range(1, (SELECT min(length({col})) FROM {view})::BIGINT + 1)) AS i) p "
        f"WHERE (SELECT count(DISTINCT substr({v}, 1, i::INT)) FROM {view}) = 1)"
    )


@check(
    "common_affix",
    f"""WITH ends AS (SELECT {prefix_sql('fx_filepath', 'path')} AS pre, {prefix_sql('fx_email', 'email', True)} AS suf)
      SELECT 'path' AS col, p_partkey AS k, substr(path, (pre + 1)::INT) AS value FROM fx_filepath, ends
      UNION ALL SELECT 'email', c_custkey, substr(email, 1, (length(email) - suf)::INT) FROM fx_email, ends""",
)
def common_affix(spark, sf_dir):
    paths = P.strip_common(table(spark, sf_dir, "fx_filepath"), "path")
    mails = P.strip_common(table(spark, sf_dir, "fx_email"), "email", suffix=True)
    return paths.select(F.lit("path").alias("col"), F.col("p_partkey").alias("k"), F.col("path").alias("value")).unionByName(
        mails.select(F.lit("email").alias("col"), F.col("c_custkey").alias("k"), F.col("email").alias("value"))
    )


@check(
    "proc_email",
    f"""WITH cut AS (SELECT c_custkey, substr(email, 1, (length(email) - {prefix_sql('fx_email', 'email', True)})::INT) AS e FROM fx_email)
      SELECT c_custkey, CASE WHEN contains(e, '@') THEN split_part(e, '@', 1) || ' ' ||
        split_part(substr(e, strpos(e, '@') + 1), '.', 1) ELSE e END AS email FROM cut""",
)
def proc_email(spark, sf_dir):
    mails = table(spark, sf_dir, "fx_email")
    rules = P.fit_features(mails, {"email": "email"}, True, {})
    return P.apply_feature(mails, rules["email"], True, {})


def words_sql(view: str, key: str, col: str, scheme: bool) -> str:
    middle = "CASE WHEN strpos(v, '://') > 0 THEN substr(v, strpos(v, '://') + 3) ELSE v END" if scheme else "v"
    return f"""WITH ends AS (SELECT {prefix_sql(view, col)} AS pre, {prefix_sql(view, col, True)} AS suf,
        (SELECT min(length({col})) FROM {view}) AS short),
      cut AS (SELECT {key}, substr({col}, (pre + 1)::INT, (length({col}) - pre - least(suf, short - pre))::INT) AS v
        FROM {view}, ends)
      SELECT {key}, trim(regexp_replace({middle}, '[^a-zA-Z0-9]+', ' ', 'g')) AS {col} FROM cut"""


@check("proc_url", words_sql("fx_url", "page_id", "url", True))
def proc_url(spark, sf_dir):
    rows = table(spark, sf_dir, "fx_url")
    return rows.withColumn("url", P.url_rule(F.col("url"), P.fit_ends(rows, "url")))


@check("proc_filepath", words_sql("fx_filepath", "p_partkey", "path", False))
def proc_filepath(spark, sf_dir):
    rows = table(spark, sf_dir, "fx_filepath")
    return rows.withColumn("path", P.filepath_rule(F.col("path"), P.fit_ends(rows, "path")))


def _months(name: str, rest: int, sql: str) -> None:
    @check(name, f"SELECT o_orderkey, ({sql})::INTEGER AS month FROM orders WHERE o_orderkey % 4 {'= 3' if rest == 3 else '= 0' if rest == 0 else 'IN (1, 2)'}")
    def months(spark, sf_dir):
        rows = table(spark, sf_dir, "fx_month")
        kind = F.col("o_orderkey") % 4
        kept = rows.where(kind.isin(1, 2) if rest == 1 else kind == rest)
        return kept.withColumn("month", X.month_number(F.col("month")))


# One check per form of a month text; each form is one of the fixture's four kinds of rows.
_months("proc_month_only", 0, "month(o_orderdate)")
_months("proc_month_year", 1, "(year(o_orderdate) % 100) * 10000 + month(o_orderdate) * 100 + 1")
_months(
    "proc_month_dmy",
    3,
    """CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN (year(o_orderdate) % 100) * 100 + 2
      ELSE (year(o_orderdate) % 100) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) END""",
)

RANGE_SQL = "regexp_full_match(qty_band, '[0-9]+-[0-9]+')"


@check(
    "num_range",
    f"""SELECT l_orderkey, l_linenumber, qty_band, ((split_part(qty_band, '-', 1)::BIGINT + split_part(qty_band, '-', 2)::BIGINT) // 2)
      AS middle FROM fx_numrange WHERE {RANGE_SQL}""",
)
def num_range(spark, sf_dir):
    rows = table(spark, sf_dir, "fx_numrange").withColumn("middle", X.range_mean(F.col("qty_band")))
    return rows.where(F.col("middle").isNotNull())


@check(
    "num_compare",
    """SELECT l_orderkey, l_linenumber, qty_band, replace(qty_band, '+', '')::BIGINT AS number FROM fx_numrange
      WHERE qty_band LIKE '%+'""",
)
def num_compare(spark, sf_dir):
    rows = table(spark, sf_dir, "fx_numrange").withColumn("number", X.compared_number(F.col("qty_band")))
    return rows.where(F.col("number").isNotNull())


@check(
    "num_rank",
    f"""WITH d AS (SELECT DISTINCT qty_band FROM fx_numrange),
      v AS (SELECT qty_band, CASE WHEN {RANGE_SQL} THEN (split_part(qty_band, '-', 1)::BIGINT + split_part(qty_band, '-', 2)::BIGINT) // 2
        ELSE regexp_replace(qty_band, '[^0-9]', '', 'g')::BIGINT END AS number FROM d),
      r AS (SELECT qty_band, row_number() OVER (ORDER BY number, qty_band) - 1 AS code FROM v)
      SELECT f.l_orderkey, f.l_linenumber, f.qty_band, r.code FROM fx_numrange f JOIN r ON f.qty_band = r.qty_band""",
)
def num_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "fx_numrange")
    return V.join_map(rows, "qty_band", P.number_ranks(rows, "qty_band").select("qty_band", "code"))


@check("num_list", "SELECT p_partkey, p_size::BIGINT AS dims0, (p_partkey % 10)::BIGINT AS dims1 FROM part")
def num_list(spark, sf_dir):
    rows = table(spark, sf_dir, "fx_numlist")
    rules = P.fit_features(rows, {"dims": "numerical"}, False, {})
    return P.apply_feature(rows, rules["dims"], False, {})


@check(
    "proc_ordinal",
    """SELECT p_partkey, CASE lower(rnk) WHEN 'first' THEN 1 WHEN 'second' THEN 2 WHEN 'twenty-first' THEN 21
      WHEN 'twentieth' THEN 20 WHEN '5th' THEN 5 WHEN 'one hundred and twelfth' THEN 112 END::BIGINT AS rnk FROM fx_ordinal""",
)
def proc_ordinal(spark, sf_dir):
    return table(spark, sf_dir, "fx_ordinal").withColumn("rnk", X.ordinal_number(F.col("rnk")))


@check(
    "proc_sentence",
    r"""WITH texts AS (SELECT doc_id AS id, text || ' ' || CASE WHEN doc_id % 2 = 0 THEN 'a Small Ring and a bolt' ELSE '' END AS t
        FROM documents),
      kept AS (SELECT id, t, [w for w in regexp_extract_all(t, '\p{L}+') if list_contains(ws, lower(w))] AS k
        FROM texts, (SELECT list(word) AS ws FROM fx_nouns) n)
      SELECT id, CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') ELSE t END AS t FROM kept""",
)
def proc_sentence(spark, sf_dir):
    extra = F.when(F.col("doc_id") % 2 == 0, F.lit("a Small Ring and a bolt")).otherwise(F.lit(""))
    texts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat("text", F.lit(" "), extra).alias("t")
    )
    return P.keep_nouns(texts, "t", table(spark, sf_dir, "fx_nouns"))


COORDS_SQL = """WITH parts AS (SELECT s_suppkey, coord, split_part(coord, ' ', 1) AS a, split_part(coord, ' ', 2) AS b FROM fx_coord),
      deg AS (SELECT s_suppkey, coord,
        CASE WHEN substr(a, 1, 1) IN ('S', 'Z', 'W') THEN -1 ELSE 1 END * (split_part(substr(a, 2), '.', 1)::DOUBLE
          + split_part(substr(a, 2), '.', 2)::DOUBLE / 60 + split_part(substr(a, 2), '.', 3)::DOUBLE / 3600) AS lat,
        CASE WHEN substr(b, 1, 1) IN ('S', 'Z', 'W') THEN -1 ELSE 1 END * (split_part(substr(b, 2), '.', 1)::DOUBLE
          + split_part(substr(b, 2), '.', 2)::DOUBLE / 60 + split_part(substr(b, 2), '.', 3)::DOUBLE / 3600) AS lon FROM parts)"""
XYZ_SQL = """round(cos(radians(lat)) * cos(radians(lon)), 6) AS x, round(cos(radians(lat)) * sin(radians(lon)), 6) AS y,
      round(sin(radians(lat)), 6) AS z"""


@check(
    "coord_parse",
    COORDS_SQL + """ SELECT s_suppkey, round(lat, 6) AS first, round(lon, 6) AS second FROM deg
      UNION ALL SELECT s_suppkey + 1000000000, round(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END * (s_suppkey % 89 + (s_suppkey % 60) / 60.0
        + 30.5 / 3600), 6), NULL FROM supplier""",
)
def coord_parse(spark, sf_dir):
    def degrees(rows, key, col):
        pair = X.coordinate_degrees(F.col(col))
        return rows.select(
            key, F.round(F.get(pair, F.lit(0)), 6).alias("first"), F.round(F.get(pair, F.lit(1)), 6).alias("second")
        )

    pairs = degrees(table(spark, sf_dir, "fx_coord"), F.col("s_suppkey"), "coord")
    single = degrees(table(spark, sf_dir, "fx_dms"), (F.col("s_suppkey") + 1000000000).alias("s_suppkey"), "dms")
    return pairs.unionByName(single)


@check(
    "coord_letter_last",
    """SELECT s_suppkey, round(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END * (s_suppkey % 89 + (s_suppkey % 60) / 60.0 + 30.5 / 3600), 6) AS lat,
      round(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE -1 END * (s_suppkey % 179 + 15 / 60.0 + (s_suppkey % 50) / 3600.0), 6) AS lon,
      CASE s_suppkey % 4 WHEN 0 THEN -1 ELSE 1 END * (1 + s_suppkey % 80)::DOUBLE AS alone FROM supplier""",
)
def coord_letter_last(spark, sf_dir):
    """Pairs and single coordinates whose letters stand behind the numbers."""
    key = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    lat = F.concat(text(key % 89), F.lit("º "), text(key % 60), F.lit("' 30.5\" "), F.when(key % 2 == 0, "N").otherwise("S"))
    lon = F.concat(text(key % 179), F.lit("º 15' "), text(key % 50), F.lit("\" "), F.when(key % 3 == 0, "O").otherwise("W"))
    alone = F.concat(text(1 + key % 80), F.lit("º 0' 0\" "), F.when(key % 4 == 0, "Z").otherwise("N"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws(" ", lat, lon).alias("pair"), alone.alias("alone"))
    pair, single = X.coordinate_degrees(F.col("pair")), X.coordinate_degrees(F.col("alone"))
    return rows.select("s_suppkey", F.round(pair[0], 6).alias("lat"), F.round(pair[1], 6).alias("lon"), F.round(single[0], 6).alias("alone"))


@check("coord_xyz", COORDS_SQL + f" SELECT s_suppkey, {XYZ_SQL} FROM deg")
def coord_xyz(spark, sf_dir):
    pair = X.coordinate_degrees(F.col("coord"))
    xyz = X.unit_sphere(F.get(pair, F.lit(0)), F.get(pair, F.lit(1)))
    return table(spark, sf_dir, "fx_coord").select(
        "s_suppkey", *[F.round(xyz[i], 6).alias(a) for i, a in enumerate("xyz")]
    )


NEAR_SQL = """, near AS (SELECT * FROM (SELECT s_suppkey, g.zip, g.country, row_number() OVER (PARTITION BY s_suppkey ORDER BY km, g.zip) AS k
      FROM (SELECT d.s_suppkey, g.zip, g.country, round(2 * 6371.0 * asin(sqrt(least(1.0, sin(radians(g.lat - d.lat) / 2) * sin(radians(g.lat - d.lat) / 2)
        + cos(radians(d.lat)) * cos(radians(g.lat)) * sin(radians(g.lon - d.lon) / 2) * sin(radians(g.lon - d.lon) / 2)))), 9) AS km
        FROM deg d, fx_gazetteer g) g WHERE km <= 3000) s WHERE k = 1)"""


@check(
    "coord_enrich",
    COORDS_SQL + NEAR_SQL + """ SELECT d.s_suppkey, coalesce(n.country, 'unknown') AS country, coalesce(n.zip, 'unknown') AS zip
      FROM deg d LEFT JOIN near n ON d.s_suppkey = n.s_suppkey""",
)
def coord_enrich(spark, sf_dir):
    done = P.coordinate_columns(
        table(spark, sf_dir, "fx_coord"), "coord", table(spark, sf_dir, "fx_gazetteer"), True, cell_degrees=10.0, radius_km=3000.0
    )
    return done.select("s_suppkey", F.col("coord_country").alias("country"), F.col("coord_zipcode").alias("zip"))


@check(
    "coord_wide",
    COORDS_SQL + NEAR_SQL + f""", w AS (SELECT d.s_suppkey, lat, lon, n.country, n.zip, {XYZ_SQL} FROM deg d
      LEFT JOIN near n ON d.s_suppkey = n.s_suppkey)
      SELECT s_suppkey, round(lat, 6) AS coord_lat, round(lon, 6) AS coord_long, coalesce(country, 'unknown') AS coord_country,
      coalesce(zip, 'unknown') AS coord_zipcode, x AS coord_x, y AS coord_y, z AS coord_z FROM w""",
)
def coord_wide(spark, sf_dir):
    done = P.coordinate_columns(
        table(spark, sf_dir, "fx_coord"), "coord", table(spark, sf_dir, "fx_gazetteer"), False, cell_degrees=10.0, radius_km=3000.0
    )
    floats = ["coord_lat", "coord_long", "coord_x", "coord_y", "coord_z"]
    return done.select(*[F.round(c, 6).alias(c) if c in floats else F.col(c) for c in done.columns])


ZIP_SQL = "fx_zip z LEFT JOIN fx_gazetteer g ON upper(replace(z.zip, ' ', '')) = upper(replace(g.zip, ' ', ''))"


@check(
    "zip_geo",
    f"""SELECT z.c_custkey, z.zip, coalesce(city, 'unknown') AS zip_city, coalesce(country, 'unknown') AS zip_country,
      coalesce(lat, 0) AS lat, coalesce(lon, 0) AS long FROM {ZIP_SQL}""",
)
def zip_geo(spark, sf_dir):
    done = P.zip_columns(table(spark, sf_dir, "fx_zip"), "zip", table(spark, sf_dir, "fx_gazetteer"), True)
    return done.select(
        "c_custkey", "zip", "zip_city", "zip_country", F.col("zip_latlong")[0].alias("lat"), F.col("zip_latlong")[1].alias("long")
    )


@check(
    "zip_wide",
    f"""WITH j AS (SELECT z.c_custkey, z.zip AS code, city, country, lat, lon, g.zip IS NULL AS none, {XYZ_SQL} FROM {ZIP_SQL})
      SELECT c_custkey, code AS zip, coalesce(city, 'unknown') AS zip_city, coalesce(country, 'unknown') AS zip_country,
      coalesce(lat, 0) AS zip_lat, coalesce(lon, 0) AS zip_long, coalesce(x, 0) AS zip_x, coalesce(y, 0) AS zip_y,
      coalesce(z, 0) AS zip_z FROM j""",
)
def zip_wide(spark, sf_dir):
    done = P.zip_columns(table(spark, sf_dir, "fx_zip"), "zip", table(spark, sf_dir, "fx_gazetteer"), False)
    return done.select(
        *[F.round(c, 6).alias(c) if c in ("zip_x", "zip_y", "zip_z") else F.col(c) for c in done.columns]
    )


# Encoders ---------------------------------------------------------------------------------

NOMINAL = [
    ("part", "p_type"), ("part", "p_brand"), ("part", "p_name"), ("pages", "url"), ("events", "props"),
    ("documents", "lang"), ("customer", "c_mktsegment"),
]


@check(
    "class_balance",
    """SELECT round(stddev_pop(n) / avg(n), 6) AS spread, stddev_pop(n) / avg(n) < 0.5 AS balanced
      FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality) s""",
)
def class_balance(spark, sf_dir):
    return E.class_balance(table(spark, sf_dir, "labels"), "quality").withColumn("spread", F.round("spread", 6))


@check(
    "encoder_choice",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS col, d, CASE WHEN d < 30 AND b THEN 'target' WHEN d < 30 THEN 'similarity' WHEN d < 100 THEN 'gap'
      ELSE 'minhash' END AS encoder FROM (SELECT count(DISTINCT {c}) AS d FROM {t}) x,
      (SELECT stddev_pop(n) / avg(n) < 0.5 AS b FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality) s) y"""
        for t, c in NOMINAL
    ),
)
def encoder_choice(spark, sf_dir):
    balanced = E.class_balance(table(spark, sf_dir, "labels"), "quality").first()["balanced"]
    counts = [
        table(spark, sf_dir, t).agg(F.lit(c).alias("col"), F.count_distinct(F.col(c)).alias("d")) for t, c in NOMINAL
    ]
    every = counts[0]
    for one in counts[1:]:
        every = every.unionByName(one)
    return every.withColumn("encoder", E.encoder_for(F.col("d"), F.lit(balanced)))


VALENCE_SQL = r"""WITH d AS (SELECT DISTINCT opinion AS value FROM fx_likert),
      t AS (SELECT value, unnest(string_split(lower(value), ' ')) AS word FROM d),
      s AS (SELECT t.value, coalesce(sum(polarity), 0) * coalesce(max(intensity), 1) AS score FROM t
        LEFT JOIN fx_valence v ON t.word = v.word GROUP BY t.value),
      o AS (SELECT value, score, row_number() OVER (ORDER BY score, value) - 1 AS code FROM s)"""


def opinions(spark, sf_dir):
    return table(spark, sf_dir, "fx_likert").select(F.col("opinion").alias("value")).distinct()


@check("valence_order", VALENCE_SQL + " SELECT value, score, code FROM o")
def valence_order(spark, sf_dir):
    return E.valence_order(opinions(spark, sf_dir), table(spark, sf_dir, "fx_valence"))


@check(
    "ordinal_encode",
    VALENCE_SQL + " SELECT f.event_id, o.code AS opinion FROM fx_likert f JOIN o ON f.opinion = o.value",
)
def ordinal_encode(spark, sf_dir):
    mapping = E.ordinal_map(opinions(spark, sf_dir), table(spark, sf_dir, "fx_valence"))
    return E.encode_dense(table(spark, sf_dir, "fx_likert").select("event_id", "opinion"), "opinion", mapping)


@check(
    "target_encode",
    """WITH j AS (SELECT d.doc_id, d.source, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
      s AS (SELECT source, count(*) AS n, avg(quality) AS m FROM j GROUP BY source)
      SELECT j.doc_id, round(CASE WHEN n <= 1 THEN p ELSE p * (1 - 1 / (1 + exp(-(n - 1)))) + m * (1 / (1 + exp(-(n - 1)))) END, 6)
      AS source FROM j JOIN s ON j.source = s.source, (SELECT avg(quality) AS p FROM j) q""",
)
def target_encode(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(
        table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"
    )
    coded = E.encode_dense(rows, "source", E.target_map(rows, "source", "quality"))
    return coded.select("doc_id", F.round("source", 6).alias("source"))


def grams_between_sql(value: str) -> str:
    parts = ", ".join(grams(value, n, distinct=False) for n in range(2, 5))
    return f"list_distinct(flatten([{parts}]))"


def spread(df, key: str, vector: str):
    """One row per position of a vector, so that both engines return plain numbers."""
    return df.select(key, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.round("x", 6))


@check(
    "similarity_encode",
    f"""WITH d AS (SELECT DISTINCT p_brand AS value FROM part), g AS (SELECT value, {grams_between_sql('value')} AS gr FROM d),
      o AS (SELECT value, gr, row_number() OVER (ORDER BY value) - 1 AS pos FROM g)
      SELECT a.value, o.pos, round({jaccard('a.gr', 'o.gr')}, 6) AS x FROM g a, o""",
)
def similarity_encode(spark, sf_dir):
    values = table(spark, sf_dir, "part").select(F.col("p_brand").alias("value")).distinct()
    return spread(E.similarity_map(values), "value", "code")


@check("gap_encode")
def gap_encode(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    values = parts.select(F.col("p_name").alias("value")).distinct()
    return E.encode_wide(parts, "p_name", E.gap_map(values), K.GAP_TOPICS)


@check(
    "gap_sums",
    f"""WITH d AS (SELECT DISTINCT p_name AS value FROM part),
      n AS (SELECT value, list_sum([greatest(length(lower(value)) - g + 1, 0) FOR g IN [2, 3, 4]]) AS grams FROM d)
      SELECT value, {K.GAP_TOPICS}::BIGINT AS topics, round((grams + {K.GAP_TOPICS} * ({G.SHAPE} - 1)) / (1 + 1 / {G.SCALE}), 4)::DOUBLE AS total,
      true AS positive FROM n""",
)
def gap_sums(spark, sf_dir):
    """Topic weights of a text: as many as topics, positive, and of the sum that its n-grams and the prior give."""
    values = table(spark, sf_dir, "part").select(F.col("p_name").alias("value")).distinct()
    total = F.aggregate("code", F.lit(0.0), lambda a, x: a + x)
    return E.gap_map(values).select(
        "value", F.size("code").cast("long").alias("topics"), F.round(total, 4).alias("total"), (F.array_min("code") > 0).alias("positive")
    )


SEEDS_SQL = ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(E.hash_seeds()))


@check(
    "minhash_encode",
    f"""WITH d AS (SELECT DISTINCT url AS value FROM pages),
      h AS (SELECT value, {md5_32('g')} AS h FROM (SELECT value, unnest({grams_between_sql('value')}) AS g FROM d) u),
      seeds(pos, a, b) AS (VALUES {SEEDS_SQL})
      SELECT value, pos, round(min((h * a + b) % {E.HASH_PRIME}) / {E.HASH_PRIME}.0, 6) AS x FROM h, seeds GROUP BY value, pos""",
)
def minhash_encode(spark, sf_dir):
    values = table(spark, sf_dir, "pages").select(F.col("url").alias("value")).distinct()
    return spread(E.minhash_map(values), "value", "code")


WIDE_SQL = f"""WITH d AS (SELECT DISTINCT c_mktsegment AS value FROM customer), g AS (SELECT value, {grams_between_sql('value')} AS gr FROM d),
      o AS (SELECT value, gr, row_number() OVER (ORDER BY value) - 1 AS pos FROM g),
      m AS (SELECT a.value, o.pos, round({jaccard('a.gr', 'o.gr')}, 6) AS x FROM g a, o)"""


def segment_map(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    values = customers.select(F.col("c_mktsegment").alias("value")).distinct()
    return customers, E.similarity_map(values)


@check(
    "wide_layout",
    WIDE_SQL + " SELECT c_custkey, " + ", ".join(
        f"max(CASE WHEN pos = {i} THEN x END) AS c_mktsegment{i}" for i in range(5)
    ) + " FROM customer c JOIN m ON c.c_mktsegment = m.value GROUP BY c_custkey",
)
def wide_layout(spark, sf_dir):
    customers, mapping = segment_map(spark, sf_dir)
    wide = E.encode_wide(customers, "c_mktsegment", mapping, E.vector_size(mapping))
    return wide.select(*[F.round(c, 6).alias(c) if c != "c_custkey" else c for c in wide.columns])


@check("dense_layout", WIDE_SQL + " SELECT c_custkey, pos, x FROM customer c JOIN m ON c.c_mktsegment = m.value")
def dense_layout(spark, sf_dir):
    customers, mapping = segment_map(spark, sf_dir)
    return spread(E.encode_dense(customers, "c_mktsegment", mapping), "c_custkey", "c_mktsegment")

