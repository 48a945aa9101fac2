"""Removal of byte strings of ``LENGTH`` that start more than once in the corpus.

Every window of ``LENGTH`` bytes is tied to one of its own positions, its anchor: the smallest hash
among the first ``REACH`` places. Equal windows have equal anchors at equal offsets, so a repeat can
only be found where the bytes after an anchor repeat. The order of all text places that a suffix array
would give is refined step by step instead, from short common prefixes to full windows, and only
where a block of equal prefixes is left with more than one member:

1. anchors by the ``LENGTH - REACH + 1`` bytes that follow them,
2. the run of all windows tied to one anchor,
3. within unresolved runs, blocks of ``BLOCK`` windows by what they all hold and by what they span,
4. single windows.

Each step counts hashes over the whole corpus by partial sums and passes on no text. Texts are fetched
once more for the few places that are still open. See the README for why this replaces the merging of
Burrows-Wheeler transforms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringwright.llm.kernel import U, mix, prefix_sums, span_hash, text_slices
from stringwright.llm.store import settle, small

LENGTH = 400
REACH = 128
GRAM = 16
BLOCK = 16
PREFIX = LENGTH - REACH + 1
#: Windows of a text that are tied to anchors at once; places take 26 bits.
SPAN = 1 << 25

_ODD = U(0xC2B2AE3D27D4EB4F)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first window, last window) for every run of windows with one anchor.

    Positions count from the start of the slice. Of equal hashes the leftmost counts.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    sums = prefix_sums(data)
    n = len(data) - GRAM + 1
    place = np.arange(n, dtype=U)
    low = U((1 << 26) - 1)
    least = (span_hash(sums, np.arange(n), np.arange(GRAM, n + GRAM)) & ~low) | place
    step = 1
    while step < REACH:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    # windows that end within their text
    lengths = np.diff(offsets)
    count = np.maximum(lengths - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    window = np.repeat(offsets[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    if not len(window):
        return none, none, none, none
    anchor = (least[window] & low).astype(np.int64)
    change = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(text) != 0)) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [len(window)]]) - 1
    return text[first], anchor[first], window[first], window[last]


def _packed(anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Anchor and the offsets of its first and last window in one number that sorts by anchor."""
    return (anchor << 14) | ((anchor - first) << 7) | (anchor - last)


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    anchor = place >> 14
    return anchor, anchor - ((place >> 7) & 127), anchor - (place & 127)


def _with(value: np.ndarray, *more: np.ndarray) -> np.ndarray:
    for x in more:
        value = mix(value ^ (x.astype(U) + U(1)) * _ODD)
    return value


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, U).view(np.int64))


def _parts(data: np.ndarray, offsets: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Where a part begins, its bytes, its text limits. A slice of one text with more than ``span``
    windows is cut by windows: parts overlap by all but one byte of a window."""
    if len(offsets) > 2 or len(data) - LENGTH < span:
        yield 0, data, offsets
        return
    for at in range(0, len(data) - LENGTH + 1, span):
        part = data[at : at + span + LENGTH - 1]
        yield at, part, np.array([0, len(part)], np.int64)


def _runs(texts: DataFrame, span: int) -> DataFrame:
    """node, place, prefix, run: every anchor with the hashes of what follows it and of its windows' run."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                nodes = batch.column(0).slice(a, b - a).to_numpy()
                for at, part, limits in _parts(data, offsets, span):
                    text, anchor, first, last = anchors(part, limits)
                    if not len(text):
                        continue
                    sums = prefix_sums(part)
                    prefix = span_hash(sums, anchor, anchor + PREFIX)
                    run = _with(span_hash(sums, first, last + LENGTH), anchor - first, anchor - last)
                    begin = limits[text] - at
                    place = _packed(anchor - begin, first - begin, last - begin)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[text]), pa.array(place), _signed(prefix), _signed(run)], ["node", "place", "prefix", "run"])

    return texts.select("node", "text").mapInArrow(cut, "node long, place long, prefix long, run long")


def _asked(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """Per slice of (node, text, asked): the slice's prefix sums, where each question's text begins, the questions."""
    asked = batch.column(2)
    ends = asked.offsets.to_numpy()
    values = {n: asked.values.field(n).to_numpy() for n in names}
    for a, b, data, offsets in text_slices(batch.column(1)):
        which = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
        part = {n: v[ends[a] : ends[b]] for n, v in values.items()}
        part["node"] = batch.column(0).slice(a, b - a).to_numpy()[which]
        yield prefix_sums(data), offsets[which], part


def _blocks(asked: DataFrame) -> DataFrame:
    """node, at, prefix, spans, inner for the blocks of the asked runs (node, text, asked)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sums, begin, q in _asked(batch, ["place", "prefix"]):
                anchor, first, last = _unpacked(q["place"])
                low, high = (anchor - last) // BLOCK, (anchor - first) // BLOCK
                n = high - low + 1
                of = np.repeat(np.arange(len(n)), n)
                block = low[of] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                anchor, begin_, place = anchor[of], begin[of], q["place"][of]
                far = np.minimum(block * BLOCK + BLOCK - 1, anchor - first[of])
                near = np.maximum(block * BLOCK, anchor - last[of])
                base = begin_ + anchor
                spans = _with(span_hash(sums, base - far, base - near + LENGTH), far, near)
                inner = _with(span_hash(sums, base - block * BLOCK, base - block * BLOCK - BLOCK + 1 + LENGTH), block)
                at = (place << 3) | block
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q["node"][of]), pa.array(at), pa.array(q["prefix"][of]), _signed(spans), _signed(inner)],
                    ["node", "at", "prefix", "spans", "inner"],
                )

    return asked.mapInArrow(cut, "node long, at long, prefix long, spans long, inner long")


def _block_windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, largest and smallest offset of the windows of a block."""
    anchor, first, last = _unpacked(at >> 3)
    block = at & 7
    return anchor, np.minimum(block * BLOCK + BLOCK - 1, anchor - first), np.maximum(block * BLOCK, anchor - last)


def _windows(asked: DataFrame) -> DataFrame:
    """node, start, prefix, whole for the windows of the asked blocks (node, text, asked)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sums, begin, q in _asked(batch, ["at", "prefix"]):
                anchor, far, near = _block_windows(q["at"])
                n = far - near + 1
                of = np.repeat(np.arange(len(n)), n)
                offset = near[of] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                start = anchor[of] - offset
                whole = _with(span_hash(sums, begin[of] + start, begin[of] + start + LENGTH), offset)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q["node"][of]), pa.array(start), pa.array(q["prefix"][of]), _signed(whole)],
                    ["node", "start", "prefix", "whole"],
                )

    return asked.mapInArrow(cut, "node long, start long, prefix long, whole long")


def _twice(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys held by two rows or more, each with one of them (its least ``node`` and place) as witness."""
    where = "place" if "place" in rows.columns else "at" if "at" in rows.columns else "start"
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("node", where)).alias("witness"))
    return counted.where("n > 1").drop("n")


def _fetched(texts: DataFrame, asked: DataFrame, *names: str) -> DataFrame:
    """(node, text, asked): texts with their questions."""
    lists = asked.groupBy("node").agg(F.collect_list(F.struct(*names)).alias("asked"))
    return texts.join(lists, "node").select("node", "text", "asked")


def _kept(texts: DataFrame) -> DataFrame:
    """node, n_removed, n_spans, kept_sha256 of texts with the ranges (lo, hi) of their repeated starts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digests = [], [], []
            whole = batch.column(1).cast(pa.large_binary())
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            lows, highs = (lists.values.field(x).to_numpy() for x in ("lo", "hi"))
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                text = whole[i].as_py()
                order = np.argsort(lows[a:b], kind="stable")
                low, high = lows[a:b][order], np.maximum.accumulate(highs[a:b][order] + LENGTH)
                new = np.concatenate([[True], low[1:] > high[:-1]])
                begin, end = low[new], high[np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)]
                digest, at = hashlib.sha256(), 0
                for x, y in zip(begin.tolist(), end.tolist()):
                    digest.update(text[at:x])
                    at = y
                digest.update(text[at:])
                removed.append(int((end - begin).sum()))
                spans.append(len(begin))
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                ["node", "n_removed", "n_spans", "kept_sha256"],
            )

    return texts.mapInArrow(cut, "node long, n_removed long, n_spans long, kept_sha256 string")


def _starts(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """node, lo, hi: ranges of places where repeated windows start, enough to cover all their bytes."""
    same_run = settle(_twice(open_, "prefix", "run"), "same-run")
    marked = open_.join(same_run, ["prefix", "run"], "left").withColumn("whole", F.col("witness").isNotNull())

    # a run between two repeated ones of its text is covered by them
    first, last = _run_windows("place")
    in_text = Window.partitionBy("node").orderBy("place")
    before = F.coalesce(F.lag("whole").over(in_text) & (F.lag(last).over(in_text) + 1 == first), F.lit(False))
    after = F.coalesce(F.lead("whole").over(in_text) & (F.lead(first).over(in_text) == last + 1), F.lit(False))
    marked = settle(marked.withColumn("needed", ~F.col("whole") & ~(before & after)), "marked")
    found = marked.where("whole").select("node", first.alias("lo"), last.alias("hi"))

    # who can be a partner of a needed run: all single runs and one witness of every repeated run
    is_witness = F.col("witness") == F.struct("node", "place")
    needy = marked.where("needed").select("prefix").distinct()
    asked = marked.where(~F.col("whole") | is_witness).join(needy, "prefix", "left_semi")
    blocks = settle(_blocks(_fetched(texts, asked.select("node", "place", "prefix"), "place", "prefix")), "blocks")
    same_span = settle(_twice(blocks, "prefix", "spans"), "same-span")
    same_inner = settle(_twice(blocks, "prefix", "inner").select("prefix", "inner"), "same-inner")
    judged = blocks.join(same_span, ["prefix", "spans"], "left").join(same_inner, ["prefix", "inner"], "left_semi")
    judged = settle(judged.withColumn("whole", F.col("witness").isNotNull()), "judged")
    place = F.shiftright("at", 3)
    first, last = _run_windows(place)
    anchor, block = F.shiftright(place, 14), F.col("at").bitwiseAND(F.lit(7))
    low = F.greatest(first, anchor - block * BLOCK - (BLOCK - 1))
    high = F.least(last, anchor - block * BLOCK)
    found = found.union(judged.where("whole").select("node", low, high))

    is_witness = F.col("witness") == F.struct("node", "at")
    needy = judged.where("NOT whole").select("prefix", "inner").distinct()
    asked = judged.where(~F.col("whole") | is_witness).join(needy, ["prefix", "inner"], "left_semi")
    windows = settle(_windows(_fetched(texts, asked.select("node", "at", "prefix"), "at", "prefix")), "windows")
    same = windows.groupBy("prefix", "whole").agg(F.count("*").alias("n")).where("n > 1").select("prefix", "whole")
    single = windows.join(same, ["prefix", "whole"]).select("node", F.col("start").alias("lo"), F.col("start").alias("hi"))
    return found.union(single)


def _run_windows(place: str | Column) -> tuple[Column, Column]:
    """First and last window of a packed run."""
    place = F.col(place) if isinstance(place, str) else place
    anchor = F.shiftright(place, 14)
    return anchor - F.shiftright(place, 7).bitwiseAND(F.lit(127)), anchor - place.bitwiseAND(F.lit(127))


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text).

    A byte goes if a string of ``LENGTH`` bytes that covers it starts at another place, too; strings do
    not cross texts and are judged on the input. Texts with an equal one lose everything and stand for
    each other in the search. Null and empty texts lose nothing; repeated rows are copies of each
    other; null ids and ids with several texts are told apart by text; an empty table gives no rows;
    other columns are ignored. Strings are told apart by 128 bits of hashes. Bytes need not be valid
    UTF-8. Texts may have any length; those with more than ``span`` (2**25 at most) windows are tied to
    anchors part by part.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    narrow = settle(docs.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("mark")), "narrow")
    several = narrow.groupBy("doc_id").agg((F.min("sha") < F.max("sha")).alias("several"))
    several = settle(several.where("several OR doc_id IS NULL").select(F.col("doc_id").alias("odd")), "odd")
    is_odd = F.col("doc_id").eqNullSafe(F.col("odd"))

    def named(rows: DataFrame) -> DataFrame:
        """Rows with their node: the id, or a hash of id and text for ids that do not name one text."""
        if not several.limit(1).count():
            return rows.withColumn("node", F.col("doc_id"))
        tagged = several.withColumn("tagged", F.lit(True))
        by_text = F.xxhash64("doc_id", "mark")
        return rows.join(small(tagged, 16), is_odd, "left").withColumn("node", F.when(F.col("tagged"), by_text).otherwise(F.col("doc_id"))).drop("odd", "tagged")

    nodes = settle(named(narrow), "nodes")
    copies = settle(nodes.groupBy("sha").agg(F.count("*").alias("n"), F.min("node").alias("rep")).where("n > 1"), "copies")
    others = nodes.join(small(copies, 120), "sha").where("node <> rep").select("node").distinct()
    others = settle(others, "others")
    texts = named(docs.withColumn("mark", F.xxhash64("text"))).join(small(others, 8), "node", "left_anti")
    texts = texts.where(F.octet_length("text") >= LENGTH).select("node", "text")
    runs = settle(_runs(texts, span), "runs")
    heads = settle(runs.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix"), "heads")
    open_runs = settle(runs.join(heads, "prefix"), "open")
    alike = settle(open_runs.select("node").distinct(), "alike")
    open_texts = settle(texts.join(small(alike, 8), "node", "left_semi").dropDuplicates(["node"]), "open-texts")
    ranges = _starts(open_runs, open_texts).groupBy("node").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    # copies lose everything anyway
    reps = copies.select(F.col("rep").alias("node"))
    ranges = ranges.join(small(settle(reps, "reps"), 8), "node", "left_anti")
    results = settle(_kept(open_texts.join(ranges, "node").select("node", "text", "ranges")), "results")
    out = nodes.join(small(copies.select("sha", "n"), 120), "sha", "left").join(results, "node", "left")
    gone = F.col("n").isNotNull() & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", zero)).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
