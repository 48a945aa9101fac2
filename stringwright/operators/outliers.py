"""Misspellings and values of the wrong type.

Repairs are decided on the value table and applied as a map ``<col, old, new>``. All
decisions are taken at once from the original frequencies: each value goes to its most
similar partner, then the commoner one, then the alphabetically first; a value that is
itself repaired is never a target, so repairs do not chain.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringwright import constants as K
from stringwright.functions import text as X
from stringwright.operators.types import DEFAULT_TYPES, TypeRegistry
from stringwright.operators.values import column_totals, join_map, running_total, small_enough
from stringwright.session import settle

HEAVY_GRAM = 200
WIDE_SHARE = 10
#: 64-bit words for the commonest wide grams, a bit each, and for the hashes of all others.
WIDE_WORDS = 2
HASH_WORDS = 2


def is_rare(n: Column, total: Column, distinct_values: Column) -> Column:
    """Infrequent enough to be a misspelling, in a column that is not nearly unique."""
    return (n / total < K.RARE_FREQUENCY) & (distinct_values / total < K.DISTINCT_RATIO)


def demoted_columns(values: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Columns all of whose texts are anomalies; they are treated as plain text."""
    bad = anomalies.groupBy("col").agg(F.count(F.lit(1)).alias("anomalies"))
    return (
        column_totals(values)
        .join(bad, "col")
        .where(F.col("distinct_values") == F.col("anomalies"))
        .select("col", F.lit("string").alias("type"))
    )


def _with_totals(labelled: DataFrame) -> DataFrame:
    """Labelled values with the totals of their column and whether it has anomalies (``_spoiled``)."""
    spoiled = labelled.where(F.col("label") == "anomaly").select("col").distinct().withColumn("_bad", F.lit(True))
    known = labelled.join(F.broadcast(column_totals(labelled)), "col").join(F.broadcast(spoiled), "col", "left")
    return known.withColumn("_spoiled", F.col("_bad").isNotNull()).drop("_bad")


def is_plain(registry: TypeRegistry) -> Column:
    """A column of a plain data type: neither a string feature nor text."""
    return ~F.col("type").isin(registry.features) & (F.col("type") != "string")


def is_anomaly_candidate(registry: TypeRegistry) -> Column:
    rare = is_rare(F.col("n"), F.col("total"), F.col("distinct_values"))
    return (F.col("label") == "anomaly") & (F.col("type") != "sentence") & (rare | is_plain(registry))


def is_infrequent_candidate(registry: TypeRegistry, plain_strings: bool) -> Column:
    kinds = [t for t in registry.features if t != "sentence"] + (["string"] if plain_strings else [])
    return F.col("type").isin(kinds) & is_rare(F.col("n"), F.col("total"), F.col("distinct_values")) & ~F.col("_spoiled")


def anomaly_candidates(labelled: DataFrame, registry: TypeRegistry = DEFAULT_TYPES) -> DataFrame:
    """Anomalies worth repairing, from ``<col, value, n, type, label>``: rare ones, and all
    of them in columns of a plain data type."""
    return _with_totals(labelled).where(is_anomaly_candidate(registry)).select("col", "value", "n", "type")


def infrequent_candidates(
    labelled: DataFrame, plain_strings: bool = False, registry: TypeRegistry = DEFAULT_TYPES
) -> DataFrame:
    """Rare values of anomaly-free columns of a string-feature type (optionally also of
    plain text columns)."""
    return _with_totals(labelled).where(is_infrequent_candidate(registry, plain_strings)).select("col", "value", "n", "type")


def _bits(values: Column, bit: Callable[[Column], Column], word: int) -> Column:
    """One 64-bit word of the bits that the entries of an array stand for."""
    one = F.lit(1).cast("bigint")
    mine = F.filter(values, lambda g: F.floor(bit(g) / 64) == word)
    return F.aggregate(mine, F.lit(0).cast("bigint"), lambda a, g: a.bitwiseOR(F.call_function("shiftleft", one, (bit(g) % 64).cast("int"))))


def _sorted_grams(values: DataFrame, threshold: float, n: int, drop_last: int, heavy: int) -> DataFrame:
    """Ids with the n-grams of their values (rare to common) split by how many values of the column
    hold them: ``_cold`` (up to ``heavy``) and ``_hot``, with their places among all, and ``_wide``
    (more than one value in ten). Cold and hot ones are limited to the prefix that decides similarity.

    Two sets with Jaccard >= t share an element among the first ``size - ceil(t * size) + 1``
    of each in a common order, and two elements among one more. Texts stay behind: what two values
    share is told by a bit for each of the commonest wide grams and by the list of all others.
    """
    coded = X.gram_codes(X.char_ngrams(F.col("value"), n, drop_last), n)
    keys = ["id", "col", "n", "_suspect", "_target", "_size"]
    grams = values.withColumn("_grams", coded).withColumn("_size", F.size("_grams")).where(F.col("_size") > 0)
    single = grams.select(*keys, F.explode("_grams").alias("_gram"))
    bounds = values.where(F.length("value") >= n + drop_last).groupBy("col").agg(F.greatest(F.lit(heavy), F.count(F.lit(1)) / WIDE_SHARE).alias("_bound"))
    counted = single.groupBy("col", "_gram").agg(F.count(F.lit(1)).alias("_freq")).join(F.broadcast(bounds), "col")
    counted = settle(counted.withColumn("_is_wide", F.col("_freq") > F.col("_bound")).drop("_bound"))
    # at most WIDE_SHARE times as many wide grams as a value has grams
    turn = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("_freq"), "_gram")) - 1
    bits = counted.where("_is_wide").select("col", "_gram", turn.alias("_bit")).where(F.col("_bit") < 64 * WIDE_WORDS)
    frequency = counted.join(bits, ["col", "_gram"], "left")
    if small_enough(counted):
        frequency = F.broadcast(frequency)
    entry = F.struct("_freq", "_gram", "_is_wide", "_bit")
    ordered = (
        single.join(frequency, ["col", "_gram"]).groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_sorted"))
    )
    length = F.col("_size") - F.ceil(F.col("_size") * F.lit(threshold) - 1e-9).cast("int") + 1

    def names(entries: Column) -> Column:
        return F.transform(entries, lambda g: g["_gram"])

    def placed(entries: Column) -> Column:
        return F.transform(entries, lambda g, i: F.struct(g["_gram"].alias("g"), i.alias("at"), g["_freq"].alias("f"), g["_is_wide"].alias("w")))

    first, longer = placed(F.slice("_sorted", F.lit(1), length)), placed(F.slice("_sorted", F.lit(1), length + 1))
    ordered = ordered.withColumn("_rest", names(F.filter("_sorted", lambda g: g["_bit"].isNull())))
    return ordered.select(
        *keys,
        F.filter(first, lambda g: g["f"] <= heavy).alias("_cold"),
        F.filter(longer, lambda g: (g["f"] > heavy) & ~g["w"]).alias("_hot"),
        names(F.filter("_sorted", lambda g: g["_is_wide"])).alias("_wide"),
        *[_bits(F.col("_sorted"), lambda g: g["_bit"], k).alias(f"_w{k}") for k in range(WIDE_WORDS)],
        *[_bits(F.col("_rest"), lambda g: F.pmod(F.xxhash64(g), F.lit(64 * HASH_WORDS)), k).alias(f"_h{k}") for k in range(HASH_WORDS)],
        F.size("_rest").cast("double").alias("_others"),
        "_rest",
    )


_SIDE = ["id", "n", "_size"]
_SET = [*[f"_w{k}" for k in range(WIDE_WORDS)], *[f"_h{k}" for k in range(HASH_WORDS)], "_others", "_rest"]


def _blocks(sorted_values: DataFrame, kept: list[str]) -> DataFrame:
    """One row per value and blocking key, a cold gram or two hot ones, with how many grams stand before
    the last of the key and are not in it. Of the columns only ids, counts and sizes need to travel."""
    cold = F.transform("_cold", lambda g: F.struct(g["g"].alias("a"), g["g"].alias("b"), g["at"].alias("at")))
    pairs = F.flatten(
        F.transform(
            "_hot",
            lambda a, i: F.transform(
                F.slice("_hot", i + 2, F.size("_hot")),
                lambda b: F.struct(F.least(a["g"], b["g"]).alias("a"), F.greatest(a["g"], b["g"]).alias("b"), (b["at"] - 1).alias("at")),
            ),
        )
    )
    mine = ["col", *kept, "_suspect", "_target"]
    return sorted_values.select(*mine, F.explode(F.concat(cold, pairs)).alias("_key")).select(
        *mine, F.col("_key.a").alias("_a"), F.col("_key.b").alias("_b"), F.col("_key.at").alias("_at")
    )


def partner_candidates(
    values: DataFrame,
    threshold: float = K.NGRAM_JACCARD,
    n: int = 3,
    drop_last: int = 0,
    suspect: Column | None = None,
    target: Column | None = None,
    accept: Callable[[Column, Column], Column] | None = None,
    heavy: int = HEAVY_GRAM,
) -> DataFrame:
    """``<col, old, new, n_old, n_new, similarity>``: for every value that has similar commoner values
    (equal counts: alphabetically earlier ones) the best of them: most similar, then commonest, then first.

    ``suspect`` and ``target`` limit the two sides and ``accept(n_old, n_new)``, which must
    not get stricter as ``n_new`` grows, limits the pairs. Three kinds of pairs are looked at:

    * sharing a cold gram or two hot ones: an equality join on these keys, whose blocks are
      small; sides no pair of a block can accept are dropped before pairing;
    * sharing one hot gram and otherwise only wide ones: their similarity depends on nothing
      but the wide grams and the size, so of all such values with the same wide grams and
      size only the commonest can be the best. One representative stands for the group;
    * sharing only wide grams: the same with groups of equal wide grams and size.

    So a prefix or a word in a third of all values never forms a block of its own.

    Values go by ids, commoner ones first, then by their texts, so of equally similar partners the one
    with the smallest id is the best. Pairs whose first common grams stand too late in either value for
    what is left to suffice are dropped; the smaller value brings only keys that are early enough for one
    of its own size, so most of them are not formed. Every pair is judged where it is formed and goes into
    the minimum of its value and similarity there: no pair is ever written. Texts are fetched for the best.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = values.select(
        "col",
        "value",
        "n",
        (F.lit(True) if suspect is None else suspect).alias("_suspect"),
        (F.lit(True) if target is None else target).alias("_target"),
    ).where(F.col("_suspect") | F.col("_target"))
    order = ["col", F.desc("n"), "value"]
    in_order = sides.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sides = settle(in_order.withColumn("id", F.monotonically_increasing_id()))
    asked = [r["col"] for r in sides.where("_suspect").select("col").distinct().collect()]
    if not asked:
        return values.sparkSession.createDataFrame(
            [], "col string, old string, new string, n_old bigint, n_new bigint, similarity double"
        )
    sides = sides.where(F.col("col").isin(asked))
    limited = not (suspect is None and target is None and accept is None)
    listed = settle(_sorted_grams(sides, threshold, n, drop_last, heavy))

    def allowed(n_old: Column, n_new: Column) -> Column:
        return n_new >= n_old if accept is None else (n_new >= n_old) & accept(n_old, n_new)

    # Few rows in, many pairs out: a fixed number of partitions keeps the join parallel
    # where adaptive execution would judge by the small input and merge them.
    if limited:
        keyed = _blocks(listed, _SIDE).repartition(parts, "col", "_a", "_b")
        useful = settle(_useful(keyed, ["col", "_a", "_b"], allowed))
        sets = listed.select("id", *_SET)
        useful = useful.join(F.broadcast(sets) if small_enough(sets) else sets, "id")
    else:
        useful = _blocks(listed, [*_SIDE, *_SET])
    # The smaller set of a pair has the key early, so late ones meet in no block. Whether the smaller one
    # or the larger one is the suspect, is told by the ids.
    size, left = F.col("_size").cast("double"), (F.col("_size") - F.col("_at")).cast("double")
    early = F.col("_left") * (1 + threshold) >= F.col("_size") * (2 * threshold) - 1e-9
    useful = useful.withColumns({"_size": size, "_left": left}).drop("_at")

    def meet(small: Column, large: Column) -> DataFrame:
        sides = [
            _renamed(useful.where(c).repartition(parts, "col", "_a", "_b"), end, "col", "_a", "_b")
            for c, end in ((early & small, "_1"), (large, "_2"))
        ]
        pairs = sides[0].join(sides[1], ["col", "_a", "_b"]).where(_meeting(threshold, accept))
        return _best_by_similarity(pairs.withColumns({"id_old": F.greatest("id_1", "id_2"), "id_new": F.least("id_1", "id_2")}), threshold, "_1", "_2")

    ways = [meet(F.col("_suspect"), F.lit(True))]
    if limited:
        ways.append(meet(~F.col("_suspect"), F.col("_suspect")))

    # Wide grams alone (with one more) can only reach the threshold where there are enough.
    least = F.ceil(F.col("_size") * F.lit(threshold) - 1e-9).cast("int")
    nearly = listed.where(F.size("_wide") + 1 >= least)
    best = F.min(F.struct("id", "n", *_SET)).alias("b")
    hot = nearly.select("col", *_SIDE, *_SET, "_wide", "_suspect", "_target", F.explode("_hot.g").alias("_h"))
    hot = _useful(hot, ["col", "_h"], allowed) if limited else hot
    by_hot = hot.where("_target").groupBy("col", "_h", "_wide", "_size").agg(best)
    reps = by_hot.select("col", "_h", "_size", "b.*")
    mine = hot.where("_suspect").drop("_wide", "_suspect", "_target")
    one_hot = _renamed(mine, "_old", "col", "_h").join(_renamed(reps, "_new", "col", "_h"), ["col", "_h"])

    # Two sets of wide grams that alone suffice share one of the rarest few.
    enough = listed.where(F.size("_wide") >= least).withColumn(
        "_first", F.slice("_wide", F.lit(1), F.size("_wide") - least + 1)
    )
    groups = enough.where("_target").groupBy("col", "_wide", "_size", "_first").agg(best)
    shapes = enough.where("_suspect").select("col", "_wide", "_size", "_first").distinct()
    wide_only = _wide_pairs(enough.where("_suspect"), shapes, groups, threshold)
    ways += [_best_by_similarity(x.where(_possible(threshold, allowed)), threshold) for x in (one_hot, wide_only)]
    top = F.min(F.struct((-F.col("similarity")).alias("cost"), "id_new")).alias("top")
    best_ids = settle(reduce(DataFrame.union, ways).groupBy("id_old").agg(top).select("id_old", "top.id_new", (-F.col("top.cost")).alias("similarity")))
    old = sides.select(F.col("id").alias("id_old"), "col", F.col("value").alias("old"), F.col("n").alias("n_old"))
    new = sides.select(F.col("id").alias("id_new"), F.col("value").alias("new"), F.col("n").alias("n_new"))
    return best_ids.join(old, "id_old").join(new, "id_new").select("col", "old", "new", "n_old", "n_new", "similarity")


def _useful(rows: DataFrame, keys: list[str], allowed: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows as suspects and targets only where some row of the same keys can be accepted with them."""
    limits = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("_target"), F.col("n"))).alias("_top"),
        F.min(F.when(F.col("_suspect"), F.col("n"))).alias("_low"),
    )
    return (
        rows.join(limits, keys)
        .withColumn("_suspect", F.col("_suspect") & F.coalesce(allowed(F.col("n"), F.col("_top")), F.lit(False)))
        .withColumn("_target", F.col("_target") & F.coalesce(allowed(F.col("_low"), F.col("n")), F.lit(False)))
        .where(F.col("_suspect") | F.col("_target"))
        .drop("_top", "_low")
    )


def _renamed(rows: DataFrame, end: str, *keys: str) -> DataFrame:
    """One side of a join: all columns but the keys get an ending."""
    return rows.select(*keys, *[F.col(c).alias(c + end) for c in rows.columns if c not in keys])


def _possible(threshold: float, allowed: Callable[[Column, Column], Column]) -> Column:
    """Pairs in the right order of frequency, accepted and near."""
    return (F.col("id_new") < F.col("id_old")) & allowed(F.col("n_old"), F.col("n_new")) & _near(threshold, "_old", "_new")


def _meeting(threshold: float, accept: Callable[[Column, Column], Column] | None) -> Column:
    """Pairs of a smaller and a larger set (equal ones: the suspect first) of which the commoner value is a
    target of the other, with enough grams left from the key on, and near."""
    size, other = F.col("_size_1"), F.col("_size_2")
    later = F.col("id_1") > F.col("id_2")
    roles = F.when(later, F.col("_suspect_1") & F.col("_target_2")).otherwise(F.col("_suspect_2") & F.col("_target_1"))
    if accept is not None:
        roles = roles & accept(F.least("n_1", "n_2"), F.greatest("n_1", "n_2"))
    enough = F.least("_left_1", "_left_2") * (1 + threshold) >= (size + other) * threshold - 1e-9
    return ((size < other) | ((size == other) & later)) & enough & roles & _near(threshold, "_1", "_2")


def _near(threshold: float, a: str, b: str) -> Column:
    """Not too different in size, and with enough common bits. Of the grams without a bit of their own at
    least as many differ as bits of their hashes do."""
    size, other = F.col(f"_size{a}"), F.col(f"_size{b}")
    differ = _bits_set(*[F.col(f"_h{k}{a}").bitwiseXOR(F.col(f"_h{k}{b}")) for k in range(HASH_WORDS)])
    shared = _common_bits(a, b) + (F.col(f"_others{a}") + F.col(f"_others{b}") - differ) / F.lit(2.0)
    near = (other >= size * threshold) & (size >= other * threshold)
    return near & (shared * (1 + threshold) >= (size + other) * threshold - 1e-9)


def _common_bits(a: str, b: str) -> Column:
    """How many of the grams with bits of their own both values have."""
    return _bits_set(*[F.col(f"_w{k}{a}").bitwiseAND(F.col(f"_w{k}{b}")) for k in range(WIDE_WORDS)])


def _bits_set(*words: Column) -> Column:
    """How many bits are set. Doubles, as Spark adds whole numbers by way of a call that looks for overflow."""
    return sum([F.bit_count(w).cast("double") for w in words[1:]], F.bit_count(words[0]).cast("double"))


def _best_by_similarity(pairs: DataFrame, threshold: float, a: str = "_old", b: str = "_new") -> DataFrame:
    """``<id_old, similarity, id_new>``: of all truly similar partners of a value the best for each
    similarity. Only numbers are gathered, so the minimum is taken by hashing, before any shuffle.

    Spark would move the comparison of the lists into the join, before the cheaper conditions there. It
    leaves conditions above a random number, so each pair that those let pass is compared, and only once."""
    shared = _common_bits(a, b) + F.size(F.array_intersect(f"_rest{a}", f"_rest{b}")).cast("double")
    both = F.col(f"_size{a}") + F.col(f"_size{b}")
    alike = pairs.select("id_old", "id_new", shared.alias("_shared"), both.alias("_both"), F.rand(0).alias("_here"))
    alike = alike.withColumn("similarity", F.col("_shared") / (F.col("_both") - F.col("_shared")))
    alike = alike.where((F.col("similarity") >= threshold) & (F.col("_here") >= 0))
    return alike.groupBy("id_old", "similarity").agg(F.min("id_new").alias("id_new"))


def _wide_pairs(suspects: DataFrame, shapes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Suspects with the representatives of all groups their wide grams alone make similar."""
    mine = shapes.select(
        "col", F.col("_wide").alias("_w_old"), F.col("_size").alias("_s_old"), F.explode("_first").alias("_g")
    )
    theirs = groups.select(
        "col", F.col("_wide").alias("_w_new"), F.col("_size").alias("_size_new"), "b", F.explode("_first").alias("_g")
    )
    shared = F.size(F.array_intersect("_w_old", "_w_new"))
    needed = (F.col("_s_old") + F.col("_size_new")) * threshold - 1e-9
    reps = (
        mine.join(theirs, ["col", "_g"])
        .where(shared * (1 + threshold) >= needed)
        .select("col", F.col("_w_old").alias("_wide"), F.col("_s_old").alias("_size"), "_size_new", *[F.col(f"b.{c}").alias(f"{c}_new") for c in ("id", "n", *_SET)])
        .dropDuplicates(["col", "_wide", "_size", "id_new"])
    )
    mine = suspects.select("col", "_wide", "_size", *[F.col(c).alias(f"{c}_old") for c in (*_SIDE, *_SET)])
    return mine.join(reps, ["col", "_wide", "_size"])


def best_partner(pairs: DataFrame) -> DataFrame:
    """One partner per value: most similar, then commoner, then alphabetically first."""
    best = F.min(
        F.struct(
            (-F.col("similarity")).alias("cost"),
            (-F.col("n_new")).alias("rarity"),
            F.col("new"),
            F.col("n_new"),
            F.col("similarity"),
        )
    )
    return (
        pairs.groupBy("col", "old", "n_old")
        .agg(best.alias("best"))
        .select("col", "old", "best.new", "n_old", "best.n_new", "best.similarity")
    )


def similar_pairs(values: DataFrame, **options) -> DataFrame:
    """The most similar commoner partner of every value, n-gram Jaccard >= 0.75."""
    return best_partner(partner_candidates(values, **options))


def order_pair(pairs: DataFrame, a: str, n_a: str, b: str, n_b: str) -> DataFrame:
    """Rename the two members of a pair to ``rare`` and ``common`` by frequency."""
    first, second = F.struct(F.col(n_a).alias("n"), F.col(a).alias("v")), F.struct(
        F.col(n_b).alias("n"), F.col(b).alias("v")
    )
    low, high = F.least(first, second), F.greatest(first, second)
    kept = [c for c in pairs.columns if c not in (a, n_a, b, n_b)]
    return pairs.select(
        *kept,
        low["v"].alias("rare"),
        low["n"].alias("n_rare"),
        high["v"].alias("common"),
        high["n"].alias("n_common"),
    )


def far_rarer(n_old: Column, n_new: Column, threshold: float = K.REPAIR_RATIO) -> Column:
    """The rarer count is a small fraction of the commoner one."""
    return n_old / n_new < threshold


def without_chains(repairs: DataFrame) -> DataFrame:
    """Drop repairs whose target is itself repaired."""
    olds = repairs.select("col", F.col("old").alias("new"))
    return repairs.join(olds, ["col", "new"], "left_anti").select("col", "old", "new", "n_old", "n_new")


def repair_pairs(
    labelled: DataFrame,
    plain_strings: bool = False,
    drop_last: int = 0,
    heavy: int = HEAVY_GRAM,
    registry: TypeRegistry = DEFAULT_TYPES,
) -> DataFrame:
    """``<col, old, new, n_old, n_new>`` for all columns of ``<col, value, n, type, label>``.

    In text columns the rarer value must be less than 5% as frequent as the commoner. In
    columns of a plain data type an anomaly goes to any similar value that is not one.
    """
    known = _with_totals(labelled)
    anomalous, plain = is_anomaly_candidate(registry), is_plain(registry)
    by_ratio = partner_candidates(
        known.where(~plain & (F.col("type") != "sentence")),
        drop_last=drop_last,
        suspect=anomalous | is_infrequent_candidate(registry, plain_strings),
        accept=far_rarer,
        heavy=heavy,
    )
    is_anomaly = F.col("label") == "anomaly"
    by_type = partner_candidates(known.where(plain), drop_last=drop_last, suspect=anomalous, target=~is_anomaly, heavy=heavy)
    return without_chains(best_partner(by_ratio.unionByName(by_type)))


def random_fill(
    labelled: DataFrame,
    repaired: DataFrame,
    seed: int = 0,
    rows_per_task: int = 1_000_000,
    registry: TypeRegistry = DEFAULT_TYPES,
) -> DataFrame:
    """``<col, old, new>`` for anomalies of plain data types that no repair covers: a clean
    value of the column drawn with its frequency as weight, fixed by the seed."""
    plain = ~F.col("type").isin(registry.features) & (F.col("type") != "string")
    clean = labelled.where(plain & (F.col("label") == "normal")).select("col", "value", "n")
    ends = running_total(clean, ["col"], [F.col("value")], F.col("n"), "upto", rows_per_task)
    totals = clean.groupBy("col").agg(F.sum("n").alias("clean_rows"))
    left = (
        labelled.where(plain & (F.col("label") == "anomaly"))
        .select("col", F.col("value").alias("old"))
        .join(repaired.select("col", "old"), ["col", "old"], "left_anti")
    )
    draw = F.pmod(X.hash60(F.concat_ws("|", F.lit(str(seed)), "col", "old")), F.col("clean_rows"))
    draws = left.join(F.broadcast(totals), "col").withColumn("draw", draw)
    return _interval_of(draws, ends)


def _interval_of(draws: DataFrame, ends: DataFrame) -> DataFrame:
    """For each draw the value whose interval [upto - n, upto) holds it.

    Intervals are cut into cells of equal width and every interval is listed once per cell
    it touches, so cells join by equality; a common value is cut into many cells.
    """
    totals = ends.groupBy("col").agg(F.max("upto").alias("rows"), F.count(F.lit(1)).alias("intervals"))
    width = F.greatest(F.floor(F.col("rows") / F.col("intervals")), F.lit(1)).cast("bigint")
    cells = totals.select("col", width.alias("width"))
    spans = ends.join(F.broadcast(cells), "col").select(
        "col",
        "value",
        (F.col("upto") - F.col("n")).alias("start"),
        "upto",
        F.explode(
            F.sequence(
                F.floor((F.col("upto") - F.col("n")) / F.col("width")),
                F.floor((F.col("upto") - 1) / F.col("width")),
            )
        ).alias("cell"),
    )
    placed = draws.join(F.broadcast(cells), "col").withColumn("cell", F.floor(F.col("draw") / F.col("width")))
    inside = (F.col("draw") >= F.col("start")) & (F.col("draw") < F.col("upto"))
    return placed.join(spans, ["col", "cell"]).where(inside).select("col", "old", F.col("value").alias("new"))


def apply_repairs(df: DataFrame, repairs: DataFrame, cols: list[str]) -> DataFrame:
    """Replace old by new texts. One map per column, broadcast while it is small."""

    small = bool(cols) and small_enough(repairs)

    def one(frame: DataFrame, col: str) -> DataFrame:
        mapping = repairs.where(F.col("col") == col).select(
            F.col("old").alias(col), F.col("new").alias("_new")
        )
        return join_map(frame, col, mapping, small=small or None).select(
            *[F.coalesce("_new", col).alias(c) if c == col else F.col(c) for c in frame.columns]
        )

    return reduce(one, cols, df)

