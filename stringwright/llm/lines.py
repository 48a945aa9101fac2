"""Lines that many documents share are kept in one document only.

Only DataFrame functions. Lines are exploded with their places and named by two hashes of their
normal form; documents are counted per line by partial aggregates; the places of lines that go are
gathered per text, and the text is joined anew from the stretches between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringwright.llm.decontaminate import lowered
from stringwright.llm.store import BROADCAST_BYTES, settle, small

# What is stripped from a line, the shortest line that counts, documents that are too many.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
LEAST_CHARS = 20
DOCUMENTS = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def keyed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """row, doc_id, mark, place, h1, h2: the lines of ``docs`` (doc_id, text, mark) that are long enough.

    ``row`` tells rows apart while the result is written; it means nothing afterwards.
    """
    rows = docs.withColumn("row", F.monotonically_increasing_id())  # before lines are exploded, so that they share it
    placed = rows.select("row", "doc_id", "mark", F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    stripped = placed.withColumn("line", F.trim("line", F.lit(SPACES))).where(F.length("line") >= least_chars)
    key = lowered(F.col("line"))
    return stripped.select("row", "doc_id", "mark", "place", *[F.xxhash64(F.lit(seed), key).alias(f"h{seed}") for seed in (1, 2)])


def shared_lines(lines: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """h1, h2, n_documents, last: lines of so many documents or more, and the largest id among these.

    A row counts once for each of its lines. The first step is spread by row, so no hot line meets in
    one task; the second gets sums.
    """
    once = lines.select("h1", "h2", "row", "doc_id").distinct()
    counted = once.groupBy("h1", "h2").agg(F.count("*").alias("n_documents"), F.max("doc_id").alias("last"))
    return counted.where(F.col("n_documents") >= documents)


def outside(items: Column, gone: Column) -> Column:
    """The items of an array outside the sorted, disjoint ranges ``gone`` (lo, hi): stretches between
    two ranges are cut out whole, so the work is linear in both."""

    def stretches(x: Column) -> Column:
        start = lambda j: F.coalesce(F.get(x["gone"], j - 1)["hi"], F.lit(0)).cast("int")
        end = lambda j: F.coalesce(F.get(x["gone"], j)["lo"], F.size(x["items"])).cast("int")
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["gone"])), lambda j: F.slice(x["items"], start(j) + 1, end(j) - start(j))))

    # bound once, so that the items are not made anew for every stretch
    return F.transform(F.array(F.struct(items.alias("items"), gone.alias("gone"))), stretches)[0]


def without_shared_lines(docs: DataFrame, documents: int = DOCUMENTS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row of ``docs`` (doc_id, text).

    A line's key is the line stripped of ``SPACES``, A-Z lowered. Keys of ``least_chars`` code points or
    more that are found in ``documents`` rows or more lose all their lines but those of the largest
    doc_id that holds them. Every row is a document, repeated rows too; rows that share the largest id
    all keep theirs, and so do rows without an id if no other row holds the line, else a null id is
    smaller than any. Null and empty texts are one empty line. An empty table gives no rows; other
    columns are ignored. Keys are told apart by 128 bits of hashes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    lines = settle(keyed_lines(docs, least_chars), "lines")
    shared = settle(shared_lines(lines, documents).select("h1", "h2", "last"), "shared-lines")
    gone = lines.join(small(shared, 40), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = gone.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(F.sort_array(F.collect_set("place")).alias("gone"))
    gone = settle(gone, "gone")
    n_bytes = gone.agg(F.sum(F.size("gone") * 4 + 48)).first()[0] or 0
    gone = F.broadcast(gone) if n_bytes <= BROADCAST_BYTES else gone
    out = docs.join(gone, docs.doc_id.eqNullSafe(F.col("d")) & (docs.mark == F.col("m")), "left")
    ranges = F.transform("gone", lambda place: F.struct(place.alias("lo"), (place + 1).alias("hi")))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(outside(_lines(F.col("text")), ranges), "\n"))
    return out.select(
        "doc_id",
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: the kept text as its SHA-256."""
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
