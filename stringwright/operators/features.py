"""Processing rules of the recognised kinds of text."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringwright import constants as K
from stringwright.functions import text as X
from stringwright.operators.values import join_map, rank_values, settle, sorted_codes


class Ends(NamedTuple):
    """Numbers of characters all texts of a column share at the front and at the back."""

    prefix: int
    suffix: int


def shared_start(a: str, b: str) -> int:
    """Number of leading characters two texts share."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def ends_of(low: str | None, high: str | None, rlow: str | None, rhigh: str | None, shortest: int | None) -> Ends:
    """Common ends of a set of texts from its smallest and largest member, read forwards and
    backwards: what these share, all share. The suffix is measured on what the prefix leaves."""
    if low is None:
        return Ends(0, 0)
    prefix = shared_start(low, high)
    return Ends(prefix, min(shared_start(rlow, rhigh), shortest - prefix))


def end_stats(value: Column) -> Column:
    return F.struct(
        F.min(value), F.max(value), F.min(F.reverse(value)), F.max(F.reverse(value)), F.min(F.length(value))
    )


def fit_ends(df: DataFrame, col: str) -> Ends:
    """Common ends of a column, in one aggregation."""
    return ends_of(*df.agg(end_stats(F.col(col)).alias("e")).first()["e"])


def suffix_only(low: str | None, high: str | None, rlow: str | None, rhigh: str | None, shortest: int | None) -> Ends:
    return Ends(0, 0) if low is None else Ends(0, shared_start(rlow, rhigh))


def strip_common(df: DataFrame, col: str, suffix: bool = False) -> DataFrame:
    """Remove the longest common prefix (or suffix) of a column from every text."""
    found = df.agg(end_stats(F.col(col)).alias("e")).first()["e"]
    ends = suffix_only(*found) if suffix else Ends(ends_of(*found).prefix, 0)
    return df.withColumn(col, X.strip_ends(F.col(col), ends.prefix, ends.suffix))


def email_rule(value: Column, ends: Ends) -> Column:
    return X.email_words(X.strip_ends(value, 0, ends.suffix))


def url_rule(value: Column, ends: Ends) -> Column:
    return X.url_words(X.strip_ends(value, ends.prefix, ends.suffix))


def filepath_rule(value: Column, ends: Ends) -> Column:
    return X.path_words(X.strip_ends(value, ends.prefix, ends.suffix))


def number_ranks(df: DataFrame, col: str) -> DataFrame:
    """``<col, number, code>``: position of every distinct text in the order of its number;
    texts without a number have no position."""
    number = F.coalesce(X.range_mean(F.col(col)), X.compared_number(F.col(col)))
    distinct = df.select(col).where(F.col(col).isNotNull()).distinct().withColumn("number", number)
    numbered = settle(distinct.where(F.col("number").isNotNull()))
    return rank_values(numbered, [], [F.col("number"), F.col(col)], "code")


def keep_nouns(df: DataFrame, col: str, nouns: DataFrame) -> DataFrame:
    """Words of every text that are in the table ``<word>``, in order; the text itself if none is.
    The table is joined to the words of the distinct texts."""
    words = nouns.select(F.lower("word").alias("word")).distinct()
    tokens = df.select(F.col(col).alias("_text")).distinct().select(
        "_text", F.posexplode(F.regexp_extract_all("_text", F.lit(r"(\p{L}+)"), 1)).alias("_at", "_word")
    )
    flagged = join_map(
        tokens.withColumn("word", F.lower("_word")), "word", words.withColumn("_noun", F.lit(True))
    )
    kept = flagged.where("_noun").groupBy("_text").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_word"))).alias("_kept")
    )
    mapping = kept.select(
        F.col("_text").alias(col), F.concat_ws(" ", F.transform("_kept", lambda w: w["_word"])).alias("_new")
    )
    return join_map(df, col, mapping).select(
        *[F.coalesce("_new", col).alias(c) if c == col else F.col(c) for c in df.columns]
    )


def nearest_place(
    points: DataFrame, gazetteer: DataFrame, cell_degrees: float = 1.0, radius_km: float = 100.0
) -> DataFrame:
    """``<key, zip, country, km>``: the closest gazetteer place within the radius of each
    ``<key, lat, lon>``; points without one are left out.

    Each point looks into the grid cells its search circle can touch (all of a latitude band
    next to the poles, across the date line where needed), so places join by equality.
    """
    around = math.ceil(360.0 / cell_degrees)
    reach = math.degrees(radius_km / 6371.0)
    sin_reach = math.sin(math.radians(min(reach, 90.0)))
    lat, lon = F.col("lat"), F.col("lon")
    polar = F.abs(lat) + reach >= 90.0
    swing = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.lit(sin_reach) / F.cos(F.radians(lat)))))

    def cell(x: Column) -> Column:
        return F.floor(x / cell_degrees)

    rows = F.sequence(cell(lat - reach), cell(lat + reach))
    first = cell(lon + 180.0 - swing)
    last = F.least(cell(lon + 180.0 + swing), first + around - 1)
    columns = F.transform(F.sequence(first, last), lambda c: F.pmod(c, F.lit(around)))
    probes = points.where(lat.isNotNull() & lon.isNotNull()).select(
        "key", "lat", "lon", F.explode(rows).alias("_row"), F.array_distinct(columns).alias("_columns")
    ).select("key", "lat", "lon", "_row", F.explode("_columns").alias("_column"))
    places = gazetteer.select(
        "zip",
        "country",
        F.col("lat").alias("_lat"),
        F.col("lon").alias("_lon"),
        cell(F.col("lat")).alias("_row"),
        F.pmod(cell(F.col("lon") + 180.0), F.lit(around)).alias("_column"),
    )
    km = X.great_circle_km(lat, lon, F.col("_lat"), F.col("_lon"))
    near = probes.join(places, ["_row", "_column"]).withColumn("km", km).where(F.col("km") <= radius_km)
    best = F.min(F.struct(F.round("km", 9).alias("km"), F.col("zip"), F.col("country")))
    return near.groupBy("key").agg(best.alias("b")).select("key", "b.zip", "b.country", "b.km")


def coordinate_columns(
    df: DataFrame,
    col: str,
    gazetteer: DataFrame | None,
    dense: bool,
    in_degrees: bool = True,
    cell_degrees: float = 1.0,
    radius_km: float = 100.0,
) -> DataFrame:
    """Replace a column of coordinate pairs by position, country, postal code and x, y, z."""
    parsed = df.withColumn("_pair", X.coordinate_degrees(F.col(col)))
    if gazetteer is not None:
        points = df.select(F.col(col).alias("key")).where(F.col(col).isNotNull()).distinct()
        pair = X.coordinate_degrees(F.col("key"))
        points = points.select("key", F.get(pair, F.lit(0)).alias("lat"), F.get(pair, F.lit(1)).alias("lon"))
        found = settle(nearest_place(points, gazetteer, cell_degrees, radius_km)).select(
            F.col("key").alias(col), F.col("country").alias("_country"), F.col("zip").alias("_zip")
        )
        parsed = join_map(parsed, col, found)
    else:
        parsed = parsed.withColumns({"_country": F.lit(None).cast("string"), "_zip": F.lit(None).cast("string")})
    lat, lon = F.get("_pair", F.lit(0)), F.get("_pair", F.lit(1))
    xyz = X.unit_sphere(lat, lon, in_degrees)
    country = F.when(F.col(col).isNotNull(), F.coalesce("_country", F.lit("unknown")))
    code = F.when(F.col(col).isNotNull(), F.coalesce("_zip", F.lit("unknown")))
    names = df.columns
    if dense:
        kept = [F.col("_pair").alias(c) if c == col else F.col(c) for c in names]
        extra = [country.alias(f"{col}_country"), code.alias(f"{col}_zipcode"), xyz.alias(f"{col}_xyz")]
    else:
        kept = [F.col(c) for c in names if c != col]
        extra = [
            lat.alias(f"{col}_lat"),
            lon.alias(f"{col}_long"),
            country.alias(f"{col}_country"),
            code.alias(f"{col}_zipcode"),
            *[xyz[i].alias(f"{col}_{axis}") for i, axis in enumerate("xyz")],
        ]
    return parsed.select(*kept, *extra)


def places_by_zip(gazetteer: DataFrame) -> DataFrame:
    """One place per normalised postal code, the alphabetically first city."""
    first = F.min(F.struct("city", "country", "lat", "lon"))
    return (
        gazetteer.groupBy(X.zip_key(F.col("zip")).alias("_zip"))
        .agg(first.alias("p"))
        .select("_zip", *[F.col(f"p.{c}").alias(f"_{c}") for c in ("city", "country", "lat", "lon")])
    )


def zip_columns(
    df: DataFrame, col: str, gazetteer: DataFrame, dense: bool, in_degrees: bool = True
) -> DataFrame:
    """Add city, country and position of a postal code; unknown codes get ``unknown`` and zeros."""
    keyed = df.withColumn("_zip", X.zip_key(F.col(col)))
    joined = join_map(keyed, "_zip", places_by_zip(gazetteer))
    known = F.col("_city").isNotNull() | F.col("_lat").isNotNull()

    def or_zero(c: Column) -> Column:
        return F.when(known, c).otherwise(F.lit(0.0))

    lat, lon = or_zero(F.col("_lat")), or_zero(F.col("_lon"))
    xyz = X.unit_sphere(F.col("_lat"), F.col("_lon"), in_degrees)
    axes = [or_zero(xyz[i]) for i in range(3)]
    extra = [
        F.coalesce("_city", F.lit("unknown")).alias(f"{col}_city"),
        F.coalesce("_country", F.lit("unknown")).alias(f"{col}_country"),
    ]
    if dense:
        extra += [F.array(lat, lon).alias(f"{col}_latlong"), F.array(*axes).alias(f"{col}_xyz")]
    else:
        extra += [lat.alias(f"{col}_lat"), lon.alias(f"{col}_long")]
        extra += [x.alias(f"{col}_{axis}") for x, axis in zip(axes, "xyz")]
    return joined.select(*df.columns, *extra)


class FeatureRule:
    """The processing of one column, with all it has learnt from the fitted data.

    ``directives`` maps every resulting column to ``nominal`` (still to be encoded) or
    ``none``.
    """

    def __init__(self, col: str, kind: str) -> None:
        self.col = col
        self.kind = kind
        self.ends = Ends(0, 0)
        self.ranked = False
        self.length = 0
        self.pair = False
        self.maps: DataFrame | None = None
        self.directives: dict[str, str] = {}


def feature_stats(value: Column, kind: str) -> Column | None:
    """What a rule must know of the whole column, as one aggregate."""
    if kind in ("email", "filepath", "url"):
        return end_stats(value)
    if kind == "numerical":
        number = F.coalesce(X.range_mean(value), X.compared_number(value))
        return F.struct(F.max(number.isNotNull()), F.max(F.size(F.split(value, X.LIST_SEPARATOR))))
    if kind == "coordinate":
        return F.struct(F.max(F.size(X.coordinate_degrees(value))))
    return None


def fit_features(df: DataFrame, kinds: dict[str, str], dense: bool, options: dict) -> dict[str, FeatureRule]:
    """Learn what the columns of these kinds need (common ends, shapes, label maps). All plain
    statistics come from a single pass over the table."""
    wanted = {c: feature_stats(F.col(c), k) for c, k in kinds.items()}
    stats = [e.alias(c) for c, e in wanted.items() if e is not None]
    found = df.agg(*stats).first().asDict() if stats else {}
    return {c: _feature_rule(df, c, k, found.get(c), dense, options) for c, k in kinds.items()}


def _feature_rule(df: DataFrame, col: str, kind: str, found, dense: bool, options: dict) -> FeatureRule:
    rule = FeatureRule(col, kind)
    rule.directives = {col: "none"}
    if kind in K.BOOLEAN_TYPES:
        rule.maps = settle(sorted_codes(df, col))
    elif kind in ("email", "filepath", "url"):
        rule.ends = suffix_only(*found) if kind == "email" else ends_of(*found)
        rule.directives = {col: "nominal"}
    elif kind in ("day", "sentence"):
        rule.directives = {col: "nominal"}
    elif kind == "numerical":
        rule.ranked, rule.length = bool(found[0]), found[1] or 0
        if rule.ranked:
            rule.maps = settle(number_ranks(df, col))
        elif not dense:
            rule.directives = {f"{col}{i}": "none" for i in range(rule.length)}
    elif kind == "coordinate":
        rule.pair = (found[0] or 0) > 1
        if rule.pair and dense:
            rule.directives = {
                col: "none", f"{col}_country": "nominal", f"{col}_zipcode": "nominal", f"{col}_xyz": "none"
            }
        elif rule.pair:
            rule.directives = {
                f"{col}_{s}": "nominal" if s in ("country", "zipcode") else "none"
                for s in ("lat", "long", "country", "zipcode", "x", "y", "z")
            }
    elif kind == "zipcode":
        rule.directives = {col: "nominal"}
        if options.get("gazetteer") is not None:
            extra = ("latlong", "xyz") if dense else ("lat", "long", "x", "y", "z")
            rule.directives |= {f"{col}_city": "nominal", f"{col}_country": "nominal"}
            rule.directives |= {f"{col}_{s}": "none" for s in extra}
    elif kind not in (*K.DATE_TYPES, "month", "ordinal") and "registry" in options and kind not in options["registry"].processors:
        rule.directives = {col: "nominal"}
    return rule


def apply_feature(df: DataFrame, rule: FeatureRule, dense: bool, options: dict) -> DataFrame:
    """Process one column of a table."""
    col, kind, value = rule.col, rule.kind, F.col(rule.col)
    custom = options["registry"].processors.get(kind) if "registry" in options else None
    if custom is not None:
        return df.withColumn(col, custom(value))
    if kind in K.BOOLEAN_TYPES or (kind == "numerical" and rule.ranked):
        mapping = rule.maps.select(F.col(col).cast("string").alias(col), F.col("code").alias("_code"))
        joined = join_map(df.withColumn(col, value.cast("string")), col, mapping)
        return joined.select(*[F.col("_code").alias(c) if c == col else F.col(c) for c in df.columns])
    if kind in K.DATE_TYPES:
        typed = df.schema[col].dataType.typeName() in ("date", "timestamp", "timestamp_ntz")
        seconds = F.unix_timestamp(value.cast("timestamp")) if typed else X.to_epoch(value)
        return df.withColumn(col, seconds)
    simple = {
        "day": X.day_code,
        "month": X.month_number,
        "ordinal": X.ordinal_number,
        "email": lambda v: email_rule(v, rule.ends),
        "url": lambda v: url_rule(v, rule.ends),
        "filepath": lambda v: filepath_rule(v, rule.ends),
    }
    if kind in simple:
        return df.withColumn(col, simple[kind](value))
    if kind == "sentence":
        nouns = options.get("nouns")
        return df if nouns is None else keep_nouns(df, col, nouns)
    if kind == "numerical":
        if dense:
            return df.withColumn(col, X.number_list(value))
        parts = [F.get(X.number_list(value), F.lit(i)).alias(f"{col}{i}") for i in range(rule.length)]
        return df.select(*[c for c in df.columns if c != col], *parts)
    grid = {k: options[k] for k in ("in_degrees", "cell_degrees", "radius_km") if k in options}
    if kind == "coordinate":
        if rule.pair:
            return coordinate_columns(df, col, options.get("gazetteer"), dense, **grid)
        return df.withColumn(col, F.get(X.coordinate_degrees(value), F.lit(0)))
    if kind == "zipcode" and options.get("gazetteer") is not None:
        return zip_columns(df, col, options["gazetteer"], dense, options.get("in_degrees", True))
    return df
