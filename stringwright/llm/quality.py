"""Quality rules: base limits, then robust outliers among documents of one language and source.

Only DataFrame functions. Each document's statistics become a vector of five numbers. For every
language and source the minimum-covariance-determinant estimate is refined by concentration steps:
mean and covariance of the nearest half give new distances, whose nearest half gives the next
estimate. Of several starts the one of least determinant is kept; the documents it finds usual give the
final estimate. A document is rejected when its Mahalanobis distance to that passes ``CUTOFF``. A bad
cluster of less than half a group has no part in the estimate.

All numbers are on a fixed grid and all sums and quantiles are exact, so reruns agree to the bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringwright.llm.store import settle, small

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS = 50
#: Words, lines and characters of an average text added to each ratio, so that short texts do not stray.
SMOOTH_WORDS, SMOOTH_LINES = 50, 5
#: Steps of the grid per unit.
GRID = 1000
VECTOR = ("length", "symbols", "lines", "repeats", "capitals")
#: Least standard deviation of each number: smaller differences never count as strange.
FLOOR = {"length": 0.04, "symbols": 0.03, "lines": 0.08, "repeats": 0.08, "capitals": 0.02}
#: What the covariance of the nearest half of five-dimensional normal data has to be multiplied by: 0.5
#: over the chance that chi-square of 7 degrees lies below the median of 5 degrees.
CONSISTENT = 1.912
#: Squared distance up to which a document takes part in the final estimate, the 0.975 quantile of
#: chi-square, five degrees, and the factor of its covariance.
USUAL, CONSISTENT_USUAL = 12.83, 1.056
#: Concentration steps after which a start that still moves is taken as it is.
STEPS = 12
#: Starts: the quantile of each number in the middle, and whether its spread or only ``FLOOR`` is the scale.
STARTS = ((0.5, False), (0.5, True), (0.25, True), (0.75, True))
#: Squared distance beyond which a document is rejected: the 0.99999 quantile of chi-square, five degrees.
CUTOFF = 30.86
#: Documents a language and source needs for an estimate of its own; smaller ones are pooled by
#: language, then all together. A pool below ``LEAST_POOL`` rejects nothing.
LEAST_GROUP, LEAST_POOL = 100, 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text.

    Windows are told apart by their 64-bit hash.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(t: Column) -> Column:
        placed = F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(placed, lambda s: let(_repeated(s), _three))

    def _repeated(s: Column) -> Column:
        twin = lambda k: ((k > 0) & (s[k - 1]["x"] == s[k]["x"])) | (
            (k < F.size(s) - 1) & (F.get(s, k + 1)["x"] == s[k]["x"])
        )
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), twin), lambda k: s[k]["i"])

    def _three(at: Column) -> Column:
        every = F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2))
        return F.size(F.array_distinct(every))

    found = let(windows, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(covered(t)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(found)


def statistics(docs: DataFrame) -> DataFrame:
    """The counts of every row: doc_id, lang, source, n_words and what the rules look at."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = let(
        F.regexp_extract_all(text, F.lit(WORD), 0),
        lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )
    lines = let(
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0),
        lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")),
    )
    chars = let(
        F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""),
        lambda x: F.struct(
            F.length(x).alias("word_chars"),
            F.regexp_count(x, F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
            F.regexp_count(x, F.lit("[A-Z]")).alias("n_capitals"),
        ),
    )
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.to_json(F.struct(F.col("lang").cast("string").alias("l"), F.col("source").cast("string").alias("s"))).alias("own"),
        F.to_json(F.struct(F.col("lang").cast("string").alias("l"))).alias("wider"),
        counts.alias("a"), lines.alias("b"), chars.alias("c"),
    ).select("doc_id", "own", "wider", *[F.col(f"{s}.{n}").cast("long").alias(n) for s, n in _COUNTS])


_COUNTS = [
    ("a", "n_words"), ("c", "word_chars"), ("c", "n_symbols"), ("b", "n_dup_lines"), ("a", "n_repeat_words"),
    ("b", "n_lines"), ("c", "n_capitals"),
]


def vectors(counted: DataFrame, usual_length: float) -> DataFrame:
    """The five numbers of each row in steps of the grid, and whether the base limits reject it."""
    n = F.col("n_words") + SMOOTH_WORDS
    numbers = {
        "length": F.log((F.col("word_chars") + usual_length * SMOOTH_WORDS) / n),
        "symbols": F.log1p(F.col("n_symbols") / n),
        "lines": F.col("n_dup_lines") / (F.col("n_lines") + SMOOTH_LINES),
        "repeats": F.col("n_repeat_words") / n,
        "capitals": F.col("n_capitals") / (F.col("word_chars") + usual_length * SMOOTH_WORDS),
    }
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select(
        "*", failed.alias("base_failed"), *[F.round(x * GRID).cast("int").alias(k) for k, x in numbers.items()]
    )


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with the group whose estimate judges them."""
    usable = rows.where("NOT base_failed")
    own = usable.groupBy("own", "wider").agg(F.count("*").alias("n_own"))
    poor = own.where(F.col("n_own") < LEAST_GROUP).groupBy("wider").agg(F.sum("n_own").alias("n_wider"))
    names = settle(own.join(poor, "wider", "left"), "groups")
    name = (
        F.when(F.col("n_own") >= LEAST_GROUP, F.col("own"))
        .when(F.col("n_wider") >= LEAST_GROUP, F.concat(F.lit("pool "), F.col("wider")))
        .otherwise(F.lit("pool"))
    )
    names = names.select("own", name.alias("grp"))
    return rows.join(small(names, 200), "own", "left")


def _sums(weight: Column) -> list[Column]:
    """Sums of the rows' numbers and products, exact."""
    big = lambda x: F.sum((x * weight).cast("decimal(20,0)"))
    sums = [big(F.col(v).cast("long")).alias(f"s_{v}") for v in VECTOR]
    return [F.sum(weight).alias("n"), *sums, *[
        big(F.col(v).cast("long") * F.col(w)).alias(f"p_{v}_{w}") for i, v in enumerate(VECTOR) for w in VECTOR[: i + 1]
    ]]


def _nearest(measured: DataFrame) -> DataFrame:
    """Sums over the nearest half (grp, start, n, ...), the rows at the cut by the share that fits.

    Half of n rows are (n + p + 1) / 2. Distances are compared on a grid of the logarithm, equal ones alike.
    """
    step = F.floor(F.log1p("distance") * 200).cast("int")
    held = measured.groupBy("grp", "start", step.alias("step")).agg(*_sums(F.lit(1)))
    every = Window.partitionBy("grp", "start")
    upto = F.sum("n").over(every.orderBy("step"))
    half = F.floor((F.sum("n").over(every) + len(VECTOR) + 1) / 2)
    taken = F.greatest(F.lit(0), F.least(F.col("n"), half - upto + F.col("n")))
    held = held.withColumn("taken", taken.cast("long")).where("taken > 0")
    # only the rows at the cut are taken in part, one step of each group
    names = [c for c in held.columns if c[:2] in ("s_", "p_")]
    whole = lambda c: F.coalesce(F.sum(F.when(F.col("taken") == F.col("n"), F.col(c))).cast("double"), F.lit(0.0))
    cut = lambda c: F.coalesce(F.sum(F.when(F.col("taken") < F.col("n"), F.col(c).cast("double") * F.col("taken") / F.col("n"))), F.lit(0.0))
    return held.groupBy("grp", "start").agg(F.sum("taken").alias("taken_n"), *[(whole(c) + cut(c)).alias(c) for c in names]).withColumnRenamed("taken_n", "n")


def _moments(sums: DataFrame, factor: float) -> DataFrame:
    """Mean and Cholesky factor of the floored covariance, and its determinant's logarithm, of every (grp, start)."""
    n = F.col("n").cast("double")
    out = sums.select("grp", "start", *[(F.col(f"s_{v}").cast("double") / n).alias(f"m_{v}") for v in VECTOR], *[
        (factor * (F.col(f"p_{v}_{w}").cast("double") / n - F.col(f"s_{v}").cast("double") / n * (F.col(f"s_{w}").cast("double") / n))).alias(f"c_{v}_{w}")
        for i, v in enumerate(VECTOR) for w in VECTOR[: i + 1]
    ])
    # the floor is added to the diagonal: as if every number came with independent noise of that size
    for i, v in enumerate(VECTOR):
        for w in VECTOR[: i + 1]:
            left = F.col(f"c_{v}_{w}")
            for u in VECTOR[: VECTOR.index(w)]:
                left = left - F.col(f"l_{v}_{u}") * F.col(f"l_{w}_{u}")
            if v == w:
                value = F.sqrt(F.greatest(left, F.lit(0.0)) + (FLOOR[v] * GRID) ** 2)
            else:
                value = left / F.col(f"l_{w}_{w}")
            out = out.withColumn(f"l_{v}_{w}", value)
    kept = [c for c in out.columns if c[:2] in ("m_", "l_")]
    spread = sum(F.log(F.col(f"l_{v}_{v}")) for v in VECTOR).alias("spread")
    return settle(out.select("grp", "start", spread, *kept), "moments")


def _starts(usable: DataFrame) -> DataFrame:
    """Distances of all rows from every start's middle (grp, start, distance and the numbers)."""
    quantiles = sorted({q for q, _ in STARTS})
    middles = usable.groupBy("grp").agg(*[F.percentile(v, F.array(*map(F.lit, quantiles))).alias(f"q_{v}") for v in VECTOR])
    rows = usable.join(small(settle(middles, "middles"), 400), "grp")
    off = lambda v, q: F.col(v) - F.col(f"q_{v}")[quantiles.index(q)]
    spreads = rows.groupBy("grp").agg(*[F.percentile(F.abs(off(v, 0.5)), 0.5).alias(f"d_{v}") for v in VECTOR])
    rows = rows.join(small(settle(spreads, "spreads"), 200), "grp")

    def apart(q: float, spread: bool) -> Column:
        # the median deviation of normal data is 0.6745 standard deviations
        square = lambda v: (F.col(f"d_{v}") / 0.6745) ** 2 * int(spread) + (FLOOR[v] * GRID) ** 2
        return sum(off(v, q) ** 2 / square(v) for v in VECTOR)

    found = F.array(*[F.struct(F.lit(k).alias("start"), apart(*x).alias("distance")) for k, x in enumerate(STARTS)])
    return rows.select("grp", *VECTOR, F.inline(found))


def _distances(rows: DataFrame, moments: DataFrame) -> DataFrame:
    """``rows`` with the squared distance to their group's estimate."""
    out = rows.join(small(moments, 400), "grp", "left")
    for i, v in enumerate(VECTOR):
        left = F.col(v) - F.col(f"m_{v}")
        for w in VECTOR[:i]:
            left = left - F.col(f"l_{v}_{w}") * F.col(f"y_{w}")
        out = out.withColumn(f"y_{v}", left / F.col(f"l_{v}_{v}"))
    return out.withColumn("distance", sum(F.col(f"y_{v}") * F.col(f"y_{v}") for v in VECTOR))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, distance (squared) and grp for every row.

    ``docs`` (doc_id, text, lang, source). Null texts have no words and fail the base limits; null
    languages and sources are values of their own. A row of a pool without an estimate is kept unless
    the base limits reject it, then with a null distance. Repeated rows count each; a null doc_id is
    passed on; other columns are ignored; an empty table gives no rows.
    """
    counted = settle(statistics(docs), "counts")
    total = counted.agg(F.sum("word_chars"), F.sum("n_words")).first()
    usual = round((total[0] or 0) / max(total[1] or 0, 1), 3)
    rows = settle(_grouped(vectors(counted, usual)), "vectors")
    usable = settle(rows.where("NOT base_failed").select("grp", *VECTOR), "usable")
    moments = _moments(_nearest(_starts(usable)), CONSISTENT)
    for _ in range(STEPS - 1):
        before, moments = moments, _moments(_nearest(_distances(usable, moments)), CONSISTENT)
        if not moments.exceptAll(before).limit(1).count():
            break
    best = F.min(F.struct("spread", "start", *[c for c in moments.columns if c[:2] in ("m_", "l_")]))
    moments = settle(moments.groupBy("grp").agg(best.alias("best")).select("grp", "best.*"), "best")
    measured = _distances(usable, moments).where(F.col("distance") <= USUAL)
    moments = _moments(measured.groupBy("grp", "start").agg(*_sums(F.lit(1))), CONSISTENT_USUAL)
    sizes = usable.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_POOL)
    moments = settle(moments.join(sizes, "grp", "left_semi"), "judges")
    out = _distances(rows, moments)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return out.withColumn("kept", kept).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "grp"
    )
