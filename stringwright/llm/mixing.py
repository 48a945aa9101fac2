"""Mixing sources to target weights by hash-random order and exact cuts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stringwright.llm.store import settle

WORD = r"[^\x20\x09-\x0D]+"
#: Most rows that share one range of keys of one source, on average.
RANGE_ROWS = 20_000
WEIGHTS = (1, 2, 3)
MOST = 3


def _targets(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row per source: source_size, target, n_rows.

    Sources in code point order (null last) weigh by ``weights`` in turn and share all sizes. No
    target passes ``most`` times its source: with caps taken in order of cap over weight, the level
    that shares out what the caps leave is the largest of all partial levels.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)
    ranked = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.max((F.col("total") - F.col("before")) / F.col("rest")).over(everything)
    return (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("before", before)
        .withColumn("rest", rest)
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * level))
        .select("source", "source_size", "target", "n_rows")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, carry: bool = True) -> DataFrame:
    """doc (all columns of the row), doc_id, size, source_size, target, taken for every row.

    Documents of a source are taken in the order of the md5 of their id, whole epochs first, then
    up to the exact word where the budget (the target, rounded down) ends. The order is sorted in
    ranges of the hash, each a share of one source, and the sizes before a range are summed from the
    sums of the ranges. Reruns agree.

    A null text has size 0, a null source is a source of its own (last), a null doc_id hashes as the
    empty text; equal ids are told apart by size. Sources without words have target 0; nothing is
    taken from them. Any other columns ride
    along in ``doc``, unless ``carry`` is off.
    """
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if carry or c == "doc_id"]).alias("doc"),
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
    )
    sized = settle(sized, "sized")
    targets = settle(_targets(sized, weights, most), "targets")
    hot = targets.agg(F.max("n_rows")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(hot / RANGE_ROWS, 1), 16)))
    sized = sized.withColumn("range", F.substring("key", 1, digits))
    sums = sized.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "range", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("offset"))
    offsets = (
        offsets.join(targets, offsets.source.eqNullSafe(targets.source))
        .select(offsets.source.alias("s"), F.col("range").alias("r"), "offset", "source_size", "target")
    )
    inside = (
        Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(
        F.broadcast(offsets) if _few(targets, digits) else offsets,
        placed.source.eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")),
    )
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("doc", "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _few(targets: DataFrame, digits: int) -> bool:
    """Whether the offsets, one for each source and range, surely fit a broadcast."""
    return targets.count() * 16**digits <= 100_000


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: rows of ``docs`` repeated once for each epoch, the last one cut where the budget ends.

    A cut text ends after its last taken word; ``n_chars`` is kept in step if there is one. A row of
    which no word is taken is absent.
    """
    parts = mixed(docs, weights, most).where("taken > 0").select("doc", "size", "taken")
    copies = parts.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size")).cast("int")
    pieces = F.regexp_extract_all(F.col("doc.text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    cut = F.when(left < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), left), "")).otherwise(F.col("doc.text"))
    out = copies.withColumn("cut", cut)
    as_given = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        whole = F.col("cut") == F.col("doc.text")
        as_given["n_chars"] = F.when(whole, F.col("doc.n_chars")).otherwise(F.length("cut"))
    return out.select(*[as_given.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
