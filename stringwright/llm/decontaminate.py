"""Benchmark passages in training texts, by a positional inverted index.

Only DataFrame functions. Of the words of the benchmark all occurrences in the corpus are counted.
Every window of a benchmark item is looked up by its rarest words: their postings (word, text,
position) are stored, moved back by the word's place in the window, and intersected. What is left is
compared word by word. Windows with a word that no text has are dropped before.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringwright.llm.store import settle, small

# Fixed value: words, before A-Z are lowered: [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+, spelt out character by
# character. Java looks single characters up in one table, but compares each letter with every range.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
LENGTH = 10
#: Rarest words of a window whose postings are intersected.
ANCHORS = 2

_TEXT = ["doc_id", "mark"]


def lowered(word: Column) -> Column:
    """``word`` with A-Z lowered and nothing else."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    """All words as they stand; null has none."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), 0)


def windows_of(benchmark: DataFrame, length: int) -> DataFrame:
    """item_id (string), wid, words: the windows of every item; a shorter item is one window."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), F.transform(words_of(F.col("text")), lowered).alias("all")
    ).where(F.size("all") > 0)
    slices = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("all") - length, F.lit(0))), lambda i: F.slice("all", i + 1, length)
    )
    cut = items.select("item_id", F.explode(slices).alias("words"))
    return cut.select("item_id", F.md5(F.array_join("words", " ")).alias("wid"), "words").distinct()


class Index:
    """Postings of the words that the windows of a benchmark are looked up by.

    ``docs`` (doc_id, text): rows are told apart by id and text hash, so null and repeated ids do no
    harm; equal rows share their postings.
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, length: int = LENGTH) -> None:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        self.docs = self.docs.withColumn("mark", F.xxhash64("text"))
        self.windows = settle(windows_of(benchmark, length), "windows")
        distinct = self.windows.select("wid", "words").dropDuplicates(["wid"])
        terms = distinct.select("wid", F.size("words").alias("n"), F.posexplode("words").alias("place", "term"))
        terms = settle(terms, "terms")
        vocabulary = settle(terms.select("term").distinct(), "vocabulary")
        every = self.docs.select(F.explode(words_of(F.col("text"))).alias("raw")).select(lowered(F.col("raw")).alias("term"))
        counted = every.join(small(vocabulary, 40), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_found"))
        self.counts = settle(counted, "counts")
        known = terms.join(small(self.counts, 48), "term")
        whole = Window.partitionBy("wid")
        rarest = Window.partitionBy("wid").orderBy("n_found", "term", "place")
        anchors = (
            known.withColumn("n_known", F.count("*").over(whole)).withColumn("turn", F.row_number().over(rarest))
            .where((F.col("n_known") == F.col("n")) & (F.col("turn") <= ANCHORS))
            .select("wid", "n", "term", "place", "turn")
        )
        self.anchors = settle(anchors, "anchors")
        wanted = settle(self.anchors.select("term").distinct(), "wanted")
        placed = self.docs.select(*_TEXT, F.posexplode(words_of(F.col("text"))).alias("position", "raw"))
        placed = placed.select(*_TEXT, "position", lowered(F.col("raw")).alias("term"))
        self.postings = settle(placed.join(small(wanted, 40), "term", "left_semi").distinct(), "postings")

    def _starts(self) -> DataFrame:
        """Where each window would start by each of its anchors."""
        met = self.postings.join(small(self.anchors, 100), "term")
        met = met.withColumn("start", F.col("position") - F.col("place"))
        return met.select(*_TEXT, "wid", "n", "turn", "start")

    def exact(self) -> DataFrame:
        """doc_id, mark, wid, start, n: windows that occur word by word."""
        need = F.least(F.col("n"), F.lit(ANCHORS))
        met = self._starts().where("start >= 0").groupBy(*_TEXT, "wid", "start", "n").agg(F.count("*").alias("agree"))
        candidates = settle(met.where(F.col("agree") == need).drop("agree"), "candidates")
        wanted = settle(candidates.select(F.col("doc_id").alias("d"), F.col("mark").alias("m")).distinct(), "texts")
        same = self.docs.doc_id.eqNullSafe(F.col("d")) & (self.docs.mark == F.col("m"))
        texts = self.docs.join(small(wanted, 16), same, "left_semi").dropDuplicates(_TEXT)
        texts = settle(texts.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.transform(words_of(F.col("text")), lowered).alias("all")), "words")
        windows = self.windows.select("wid", "words").dropDuplicates(["wid"])
        both = candidates.join(small(windows, 200), "wid").join(
            texts, candidates.doc_id.eqNullSafe(F.col("d")) & (candidates.mark == F.col("m"))
        )
        return both.where(F.slice("all", F.col("start") + 1, F.col("n")) == F.col("words")).select(*_TEXT, "wid", "start", "n")

    def near(self, slop: int) -> DataFrame:
        """doc_id, mark, wid, start: windows whose rarest words occur up to ``slop`` words out of place.

        Postings meet in cells of ``slop`` positions and their neighbours, an interval join.
        """
        at = self._starts().withColumn("cell", F.floor(F.col("start") / max(slop, 1)))
        first = at.where("turn = 1").withColumn("cell", F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)])))
        second = at.where("turn = 2").select(
            F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("wid").alias("w"), F.col("start").alias("other"), F.col("cell").alias("c")
        )
        same = (
            first.doc_id.eqNullSafe(F.col("d")) & (first.mark == F.col("m")) & (first.wid == F.col("w")) & (first.cell == F.col("c"))
        )
        out = first.join(second, same).where(F.abs(F.col("start") - F.col("other")) <= slop)
        return out.select(*_TEXT, "wid", "start").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items for every row of ``docs``.

    Null and word-less texts hit nothing; items without words have no windows. Items of one id count
    once, an item with a null id marks words but is not counted. Repeated rows are answered each, a
    null doc_id is passed on; an empty table on either side gives no hits; other columns are ignored.
    """
    index = Index(docs, benchmark, length)
    found = settle(index.exact(), "found")
    covered = F.aggregate(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))),
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach")),
        lambda s, w: F.struct(
            (s["hit"] + F.greatest(F.lit(0), w["end"] - F.greatest(w["start"], s["reach"]))).alias("hit"),
            F.greatest(s["reach"], w["end"]).alias("reach"),
        ),
        lambda s: s["hit"],
    )
    hits = found.groupBy(*_TEXT).agg(covered.alias("n_hit"))
    items = index.windows.select("wid", "item_id").where("item_id IS NOT NULL")
    named = found.select(*_TEXT, "wid").distinct().join(small(items, 80), "wid")
    named = named.groupBy(*_TEXT).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    # one row per text with hits, joined null-safe
    hits = hits.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "n_hit")
    named = named.select(F.col("doc_id").alias("e"), F.col("mark").alias("o"), "items")
    hits = settle(hits.join(named, F.col("d").eqNullSafe(F.col("e")) & (F.col("m") == F.col("o")), "left").select("d", "m", "n_hit", "items"), "hits")
    n_words = F.regexp_count("text", F.lit(WORD)).cast("long")
    rows = index.docs.select("doc_id", "mark", n_words.alias("n_words"))
    out = rows.join(small(hits, 400), rows.doc_id.eqNullSafe(F.col("d")) & (rows.mark == F.col("m")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), items.alias("items"),
    )
