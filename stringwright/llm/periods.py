"""Runs: stretches of words that repeat with a period, found tile by tile.

Periods are taken by octaves, ``half <= period < 2 * half``. Tiles of an octave are ``2 * half`` words
long, and a run of exponent 3 or more holds at least one tile boundary. At a boundary ``b`` and for a
period ``q`` the words that go on to agree with those ``q`` further, to the right and to the left of
``b``, give a fragment ``[lo, hi)`` of the places whose word is equal to the one ``q`` places on. Only
the boundary's neighbours decide, so tiles are solved apart from each other; a run is the union of its
fragments, stitched per document and period.

Short documents are a single group of tiles and solved where they lie, many at once. Documents of more
than ``LONG`` words are cut into groups of tiles that overlap by what a boundary needs, and dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringwright.llm.kernel import U, mix, prefix_sums, span_hash, text_slices
from stringwright.llm.kernel import words as word_limits
from stringwright.llm.lines import outside
from stringwright.llm.mixing import WORD
from stringwright.llm.store import BROADCAST_BYTES, settle

LEAST = 6
TIMES = 4
#: Words of a document beyond which its tiles are dealt out; a power of two.
LONG = 1 << 20

SPACE = r"[\x20\x09-\x0D]+"
_PRIME = (1 << 31) - 1
_BASES = (1_103_515_245, 747_796_405)
_ODD = U(0xC2B2AE3D27D4EB4F)


class Ranges:
    """Equality of ranges of words: prefix sums of two polynomials modulo a prime, 62 bits in all."""

    def __init__(self, word: np.ndarray) -> None:
        n = len(word)
        self.powers, self.sums = [], []
        for base, part in zip(_BASES, (word & U(0xFFFFFFFF), word >> U(32))):
            power = np.ones(n + 1, np.int64)
            done, factor = 1, base % _PRIME
            while done <= n:
                more = min(done, n + 1 - done)
                power[done : done + more] = power[:more] * factor % _PRIME
                factor, done = factor * factor % _PRIME, done + more
            sums = np.zeros(n + 1, np.int64)
            np.cumsum(part.astype(np.int64) % _PRIME * power[:n] % _PRIME, out=sums[1:])
            self.powers.append(power)
            self.sums.append(sums)

    def same(self, at: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Are the words from ``at`` those from ``at + shift``?"""
        out = np.ones(len(at), bool)
        for power, sums in zip(self.powers, self.sums):
            left = (sums[at + length] - sums[at]) % _PRIME * power[shift] % _PRIME
            out &= left == (sums[at + shift + length] - sums[at + shift]) % _PRIME
        return out

    def reach(self, at: np.ndarray, shift: np.ndarray, most: np.ndarray, step: int, side: int) -> np.ndarray:
        """How many words, ``most`` at most, agree with those ``shift`` further, rightwards from ``at``
        (side 1) or leftwards (side -1); ``step`` is a power of two not below any ``most``."""
        got = np.zeros(len(at), np.int64)
        while step:
            open_ = np.flatnonzero(got + step <= most)
            start = at[open_] + got[open_] if side == 1 else at[open_] - got[open_] - step
            good = open_[self.same(start, shift[open_], np.full(len(open_), step))]
            got[good] += step
            step //= 2
        return got


def _smallest_factors(n: int) -> np.ndarray:
    out = np.arange(n + 1)
    for p in range(2, int(n**0.5) + 1):
        if out[p] == p:
            multiples = out[p * p :: p]
            multiples[multiples == np.arange(p * p, n + 1, p)] = p
    return out


def _primitive(ranges: Ranges, period: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Is no proper divisor of the period a period, too? One period's length decides for the whole run."""
    out = np.ones(len(period), bool)
    if len(period):
        factors, rest = _smallest_factors(int(period.max())), period.copy()
        while (open_ := np.flatnonzero(out & (rest > 1))).size:
            prime = factors[rest[open_]]
            out[open_[ranges.same(lo[open_], period[open_] // prime, period[open_])]] = False
            rest[open_] //= prime
    return out


def _merged(owner: np.ndarray, period: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Fragments of one owner and period that meet, made one."""
    order = np.lexsort((lo, period, owner))
    owner, period, lo, hi = owner[order], period[order], lo[order], hi[order]
    new = np.ones(len(lo), bool)
    # fragments of one run begin and end in the same order
    new[1:] = (owner[1:] != owner[:-1]) | (period[1:] != period[:-1]) | (lo[1:] > hi[:-1])
    first = np.flatnonzero(new)
    return owner[first], period[first], lo[first], np.maximum.reduceat(hi, first) if len(first) else hi


def fragments(word: np.ndarray, first: int, last: int, begin: int, end: int, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """period, lo, hi of the fragments at boundaries in ``[begin, end)`` for octaves ``first`` to
    ``last``, which is left out. ``word`` are 64-bit names of words.

    A fragment counts if it is as long as a run of exponent ``times`` needs, or is cut off by the tile;
    either way half a tile agrees on one side of the boundary, which hashes of half a tile tell.
    """
    n, out, block = len(word), [], word
    ranges = Ranges(word)
    for octave in range(last):
        half = 1 << octave
        tile = 2 * half
        if n < times * half:
            break
        if octave >= first:
            rows = -(-n // tile)
            grid = np.arange(rows * tile, dtype=U)  # what follows the last block equals nothing
            grid[: len(block)] = block
            grid = grid.reshape(rows, tile)
            right, more = np.nonzero(grid[:, half:] == grid[:, :1])
            left, less = np.nonzero(grid[1:, :half] == grid[:-1, half : half + 1])
            found = np.unique(np.concatenate([right * tile + more, (left + 1) * tile + less]))
            at, period = found // tile * tile, half + found % tile
            inside = (at >= begin) & (at < end)
            at, period = at[inside], period[inside]
            ahead = ranges.reach(at, period, np.minimum(tile, n - at - period), tile, 1)
            behind = ranges.reach(at, period, np.minimum(tile, at), tile, -1)
            good = (ahead + behind >= (times - 1) * period) | (ahead == tile) | (behind == tile)
            period, lo, hi = period[good], (at - behind)[good], (at + ahead)[good]
            good = _primitive(ranges, period, lo)
            out.append(_merged(np.zeros(int(good.sum()), np.int64), period[good], lo[good], hi[good])[1:])
        if n < times * tile:
            break
        block = mix(block[:-half] * _ODD + block[half:])
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _groups(n: int, times: int, long: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(first octave, octave after the last, slice start, slice end, boundaries' begin and end) of the
    groups of tiles of a document of ``n`` words; places count from the slice's start."""
    octave = max(long.bit_length() - 4, 0)  # tiles of up to a quarter of a group share their slices
    span, first = long, 0
    while times << first <= n:
        tile = 2 << octave
        span = max(span, tile)
        for at in range(0, n, span):
            start, end = max(at - tile, 0), min(at + span + 2 * tile, n)
            yield first, octave + 1, start, end, at - start, min(at + span, n) - start
        octave += 1
        first = octave


_FOUND = "doc_id long, mark long, period long, lo long, hi long, first int, last int, start long, begin long, end long, words binary"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _rows(ids: pa.Array, marks: pa.Array, **columns) -> pa.RecordBatch:
    kinds = {"first": pa.int32(), "last": pa.int32(), "words": pa.binary()}
    arrays = [ids, marks] + [pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(len(ids), kinds.get(c, pa.int64())) for c in _NAMES[2:]]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def _searched(times: int, long: int):
    """Per batch of (doc_id, mark, text): fragments of documents, and groups of tiles of long ones."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(2)):
                starts, ends, firsts = word_limits(data, offsets)
                named = span_hash(prefix_sums(data), starts, ends)
                counts = np.diff(firsts)
                for i in np.flatnonzero(counts > long).tolist():
                    words = np.unique(named[firsts[i] : firsts[i + 1]], return_inverse=True)[1].astype(np.uint32)
                    for first, last, start, end, begin, until in _groups(len(words), times, long):
                        one = [a + i]
                        yield _rows(
                            batch.column(0).take(one), batch.column(1).take(one), first=[first], last=[last],
                            start=[start], begin=[begin], end=[until], words=[words[start:end].tobytes()],
                        )
                short = np.flatnonzero(counts <= long)
                if not counts[short].any():
                    continue
                # short documents one after the other, each with a word of its own behind it
                length = counts[short] + 1
                place = np.cumsum(length) - length
                of = np.repeat(np.arange(len(short)), length)
                inner = np.arange(int(length.sum())) - place[of]
                word = mix(~np.arange(len(of), dtype=U))
                real = inner < counts[short][of]
                word[real] = named[(firsts[short][of] + inner)[real]]
                longest = int(counts[short].max())
                period, lo, hi = fragments(word, 0, longest.bit_length(), 0, len(word), times)
                owner = np.searchsorted(place, lo, "right") - 1
                owner, period, lo, hi = _merged(owner, period, lo, hi)
                row = pa.array(a + short[owner])
                if len(row):
                    yield _rows(batch.column(0).take(row), batch.column(1).take(row), period=period, lo=lo - place[owner], hi=hi - place[owner])

    return search


def _solved(times: int):
    """Fragments of the dealt groups of tiles."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                first, last, start, begin, end, words = (batch.column(c)[i].as_py() for c in range(2, 8))
                word = mix(np.frombuffer(words, np.uint32).astype(U) + U(1))
                period, lo, hi = fragments(word, first, last, begin, end, times)
                one = pa.array(np.full(len(period), i))
                if len(period):
                    yield _rows(batch.column(0).take(one), batch.column(1).take(one), period=period, lo=lo + start, hi=hi + start)

    return solve


def _islands(rows: DataFrame, *keys: str) -> DataFrame:
    """The intervals (lo, hi) of each key, those that meet made one."""
    before = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(before.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("lo") <= reach, 0).otherwise(1)
    numbered = rows.withColumn("new", new).withColumn("island", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, long: int = LONG) -> DataFrame:
    """doc_id, n_words, runs, collapsed_text for every row of ``docs`` (doc_id, text).

    ``runs`` are (start, period, length) in words, sorted: stretches with smallest period ``period``, of
    ``least`` words or more and ``times`` (3 or more) periods or more, that cannot be extended. In
    ``collapsed_text`` all words that lie in a run after its first period are left out, and the others
    joined by one space. Null and blank texts have no words, no runs and an empty collapsed text. Rows
    are told apart by id and text, so null and repeated ids and repeated rows do no harm; an empty table
    gives no rows; other columns are ignored. Words are told apart by 64-bit hashes.

    A document of ``long`` words (a power of two) or less is solved within a batch of its partition. A longer one is dealt
    out as 32-bit words; the group of tiles of its longest periods still holds them all in one task, 4
    bytes a word and some 50 to work on them.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods may hold no tile boundary")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    found = settle(docs.select("doc_id", "mark", "text").mapInArrow(_searched(times, long), _FOUND), "fragments")
    dealt = found.where("words IS NOT NULL").select("doc_id", "mark", "first", "last", "start", "begin", "end", "words")
    solved = dealt.repartition("mark", "first", "start").mapInArrow(_solved(times), _FOUND)
    names = ["doc_id", "mark", "period", "lo", "hi"]
    every = found.where("period IS NOT NULL").select(names).union(solved.select(names))
    whole = _islands(every, "doc_id", "mark", "period").withColumn("length", F.col("hi") - F.col("lo") + F.col("period"))
    whole = whole.where((F.col("length") >= least) & (F.col("length") >= times * F.col("period")))
    runs = settle(whole.select("doc_id", "mark", F.col("lo").alias("start"), "period", "length"), "runs")
    gone = _islands(runs.select("doc_id", "mark", (F.col("start") + F.col("period")).alias("lo"), (F.col("start") + F.col("length")).alias("hi")), "doc_id", "mark")
    keys = [F.col("doc_id").alias("d"), F.col("mark").alias("m")]
    listed = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    cuts = gone.groupBy(F.col("doc_id").alias("e"), F.col("mark").alias("o")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("gone"))
    both = settle(listed.join(cuts, F.col("d").eqNullSafe(F.col("e")) & (F.col("m") == F.col("o"))).select("d", "m", "runs", "gone"), "listed")
    n_bytes = both.agg(F.sum(F.size("runs") * 24 + F.size("gone") * 16 + 64)).first()[0] or 0
    both = F.broadcast(both) if n_bytes <= BROADCAST_BYTES else both
    out = docs.join(both, docs.doc_id.eqNullSafe(F.col("d")) & (docs.mark == F.col("m")), "left")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    plain = F.regexp_replace(F.regexp_replace("text", f"^{SPACE}|{SPACE}$", ""), SPACE, " ")
    none = F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")
    return out.select(
        "doc_id",
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"),
        F.coalesce("runs", none).alias("runs"),
        F.when(F.col("runs").isNull(), plain).otherwise(F.array_join(outside(words, F.col("gone")), " ")).alias("collapsed_text"),
    )


def planted(doc_id: Column, text: Column) -> Column:
    """The text with words from a place on repeated with a period, for every tenth document by the
    CRC-32 of its id; the others as they are. A null id counts as an empty one."""
    mark = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(mark / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        at = F.pmod(g, n)
        period = 1 + F.floor((n - at) / (3 + F.pmod(g, F.lit(8))))
        index = lambda i: F.when(i < at, i).otherwise(at + F.pmod(i - at, period)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, index(i))), " ")

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    chosen = (F.pmod(mark, F.lit(10)) == 0) & text.rlike(WORD)
    return F.when(chosen, F.transform(F.array(words), repeated)[0]).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: number of runs, the longest one, and hashes of all runs and of the text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), "collapsed_text", listed.alias("listed")
    ).select(
        "doc_id", "n_runs", (-F.col("longest.back")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.less")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.less")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
