"""Near-duplicate documents by HyperMinHash.

Every text's set of word shingles is cut into ``REGISTERS`` buckets by hash value. A register keeps
of the smallest hash in its bucket the number of leading zeros (6 bits) and the ten bits that follow
the first one (mantissa): 16 bits, whatever the size of the set. Empty buckets borrow the register of
the first filled one on a fixed random walk of their own. Four registers make a band, which is a
64-bit join key as it stands; texts that share a band are candidates. Before texts are fetched the
registers estimate the similarity, corrected for the chance that two different minima leave the same
register. Links are confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringwright.llm.components import components
from stringwright.llm.kernel import U, mix, shingle_sets
from stringwright.llm.store import settle, small

ROWS = 4
BANDS = 48
REGISTERS = ROWS * BANDS
MANTISSA = 10
#: Standard deviations below the threshold at which an estimate rules a pair out.
SLACK = 6.0
#: Members of a bucket compared in one block.
BLOCK = 256
#: Smallest shingle hashes that members of a bucket are compared by: all of them for most texts.
LEAST = 256

_CUTS = np.array([(k << 64) // REGISTERS for k in range(REGISTERS)], dtype=U)
_WALKS = np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=U)).reshape(REGISTERS, REGISTERS), axis=1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The registers of a sorted, non-empty set of hashes."""
    at = np.searchsorted(shingles, _CUTS)
    ends = np.append(at[1:], len(shingles))
    filled = ends > at
    least = shingles[np.minimum(at, len(shingles) - 1)] - _CUTS
    # 53 bits of the smallest hash, scaled to its bucket, are exact as a double
    place = np.minimum(least.astype(np.float64) * REGISTERS, 2.0**64 * (1 - 2**-53))
    fraction, length = np.frexp(np.maximum(place, 1.0))
    zeros = np.minimum(64 - length, 63).astype(np.uint16)
    mantissa = ((fraction - 0.5) * (2 << MANTISSA)).astype(np.uint16)
    out = (zeros << MANTISSA) | np.minimum(mantissa, (1 << MANTISSA) - 1)
    empty = np.flatnonzero(~filled)
    if len(empty):
        walks = _WALKS[empty]
        out[empty] = out[walks[np.arange(len(empty)), filled[walks].argmax(axis=1)]]
    return out


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that two different minima of sets of n and m shingles leave equal registers.

    Minima are exponential with rates n and m; a register's cell around x is x / (2 ln 2) of 2^-10
    wide on average, which integrates to nm / (n + m)^2 times that factor.
    """
    n, m = n.astype(np.float64), m.astype(np.float64)
    return n * m / (n + m) ** 2 / (2 * math.log(2)) / (1 << MANTISSA)


def may_link(equal: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether ``equal`` shared registers leave a similarity of ``percent`` possible."""
    by_chance = chance(n, m)
    estimate = (equal / REGISTERS - by_chance) / (1 - by_chance)
    used = np.minimum(REGISTERS, np.minimum(n, m))
    need = percent / 100
    slack = SLACK * np.sqrt(need * (1 - need) / used)
    return (estimate >= need - slack) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the set (k1, k2) and the bands as 64-bit numbers."""
    schema = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, bands = [], [], [], []
            for s in shingle_sets(batch.column(1)):
                n.append(len(s))
                k1.append(mix(s).sum(dtype=U))
                k2.append(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U))
                bands.append(registers(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(k1, dtype=U).view(np.int64)),
                    pa.array(np.array(k2, dtype=U).view(np.int64)),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "k1", "k2", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, np.int64).view(np.uint16).reshape(len(column), REGISTERS)


def _estimated(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and registers leave possible."""
    side = lambda x: signed.select(
        F.col("rep").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("bands").alias(f"s{x}")
    )
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                equal = (_matrix(batch.column(4)) == _matrix(batch.column(5))).sum(axis=1)
                n, m = (batch.column(i).to_numpy() for i in (2, 3))
                good = pa.array(may_link(equal, n, m, percent))
                yield batch.select(["a", "b"]).filter(good)

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(keep, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets agree by ``percent``."""
    ids = settle(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    # one text for each id, also where rows repeat
    texts = settle(docs.join(small(ids, 8), "doc_id", "left_semi"), "texts")
    if texts.count() > ids.count():
        texts = texts.dropDuplicates(["doc_id"])
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] | None = None
        for batch in batches:
            good = []
            hubs = batch.column(1).to_pylist()
            for i, left in enumerate(shingle_sets(batch.column(2))):
                if last is None or last[0] != hubs[i]:
                    last = hubs[i], next(shingle_sets(batch.column(3).slice(i, 1)))
                right = last[1]
                few, many = (left, right) if len(left) < len(right) else (right, left)
                at = np.searchsorted(many, few)
                common = int((many[np.minimum(at, len(many) - 1)] == few).sum()) if len(few) else 0
                good.append(100 * common >= percent * (len(left) + len(right) - common) and common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(confirm, "a long, b long")


def _sketches(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """rep, least: the ``LEAST`` smallest shingle hashes of each wanted text, the whole set if it has no more."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [s[:LEAST].view(np.int64) for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least, pa.list_(pa.int64()))], ["rep", "least"])

    wanted = docs.join(small(ids, 8), "doc_id", "left_semi").select("doc_id", "text")
    return wanted.mapInArrow(sketch, "rep long, least array<long>").dropDuplicates(["rep"])


def _compared(x: int, others: np.ndarray, n: np.ndarray, least: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of ``others`` may link with member x, which surely do, and their similarity.

    Smallest hashes up to the lower of the two last ones are a fair sample of the union; where both
    sketches are whole sets it is the union, and the answer is exact.
    """
    own = least[x]
    sizes = np.array([len(least[o]) for o in others])
    all_of_x, whole = len(own) == n[x], sizes == n[others]
    flat = np.concatenate([least[o] for o in others])
    of = np.repeat(np.arange(len(others)), sizes)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    common = np.bincount(of[own[at] == flat], minlength=len(others))
    top = np.iinfo(np.uint64).max
    limit = np.minimum(np.where(whole, U(top), np.array([least[o][-1] for o in others])), U(top) if all_of_x else own[-1])
    union = np.searchsorted(own, limit, side="right") + np.bincount(of[flat <= limit[of]], minlength=len(others)) - common
    sure = whole & all_of_x
    need = percent / 100
    close = common / union >= need - SLACK * np.sqrt(need * (1 - need) / union)
    linked = 100 * common >= percent * union
    return np.where(sure, linked, close), sure & linked, common / union


def _dealt(members: DataFrame) -> DataFrame:
    """key, i, j, own, pos, rep, component: members in groups (key, i, j) of those of block ``own`` = i and
    of ``own`` = j that are to be compared.

    A bucket of up to ``BLOCK`` members is one group. In a larger one the members of its largest component
    need no comparison among themselves: each goes to one block of ``BLOCK``, and the members of all other
    components, the strays (i = -1), to every such block. Strays of several components are compared among
    themselves by pairs of blocks. So a large component costs one row a member and each stray one row a
    block, and no bucket meets in one task.
    """
    counts = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", (-F.col("component")).alias("minus"))).alias("top")
    sized = counts.groupBy("key").agg(top, F.sum("n").alias("all"), F.count("*").alias("components"))
    of = lambda n: F.greatest(F.ceil(n / F.lit(BLOCK)), F.lit(1)).cast("int")
    sized = sized.select(
        "key", "all", "components", (-F.col("top.minus")).alias("main"), of(F.col("top.n")).alias("blocks"), of(F.col("all") - F.col("top.n")).alias("stray_blocks")
    )
    rows = settle(members.select("key", "pos", "rep", "component").join(sized, "key"), "sized")
    at = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shape = lambda df, i, j, own: df.select("key", i.alias("i"), j.alias("j"), own.alias("own"), "pos", "rep", "component")
    outside, zero, few = F.lit(-1), F.lit(0), F.col("all") <= BLOCK
    is_main = F.col("component") == F.col("main")
    main = rows.where(~few & is_main).withColumn("own", at("blocks"))
    strays = rows.where(~few & ~is_main)
    met = strays.withColumn("other", each("blocks"))
    among = strays.where("components > 2").withColumn("own", at("stray_blocks")).withColumn("other", each("stray_blocks"))
    return (
        shape(rows.where(few), zero, zero, zero)
        .union(shape(main, outside, F.col("own"), F.col("own")))
        .union(shape(met, outside, F.col("other"), outside))
        .union(shape(among, F.least("own", "other"), F.greatest("own", "other"), F.col("own")))
    )


def _across(members: DataFrame, reps: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Links (a, b, sure) between one bucket's members that lie in different components.

    ``members`` (key, pos, rep, component) are dealt out in groups as ids; their registers (rep,
    n_shingles, bands) and sketches (rep, least) follow. A pair is looked at in the first bucket it shares. Of the sure links of a member with a
    component one is given, which joins the two; pairs whose sketches are samples are given unsure.
    """
    rows = settle(_dealt(members), "dealt").join(reps, "rep").join(sketches, "rep")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs_of(table: pa.Table) -> list[tuple[int, int, bool]]:
        names = ("i", "j", "own", "pos", "rep", "component", "n_shingles")
        i, j, own, pos, rep, comp, n = (table.column(c).to_numpy() for c in names)
        regs = _matrix(table.column("bands").combine_chunks())
        bands = regs.view(np.int64)
        column = table.column("least").combine_chunks()
        ends = column.offsets.to_numpy()
        flat = column.values.to_numpy().view(U)
        least = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        right = np.flatnonzero(own == j[0])
        out = []
        for x in np.flatnonzero(own == i[0]).tolist():
            others = right[comp[right] != comp[x]]
            if i[0] == j[0]:
                others = others[rep[others] > rep[x]]
            others = others[(bands[others] == bands[x]).argmax(axis=1) == pos[0]]
            equal = (regs[others] == regs[x]).sum(axis=1)
            others = others[may_link(equal, n[others], np.full(len(others), n[x]), percent)]
            if len(others):
                near, sure, how = _compared(x, others, n, least, percent)
                unsure = near & ~sure
                order = np.flatnonzero(sure)[np.argsort(-how[sure], kind="stable")]
                best = order[np.unique(comp[others[order]], return_index=True)[1]]
                for o, s in [(o, True) for o in best.tolist()] + [(o, False) for o in np.flatnonzero(unsure).tolist()]:
                    y = others[o]
                    out.append((int(max(rep[x], rep[y])), int(min(rep[x], rep[y])), s))
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(table: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table | None]:
            k = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
            limits = [0, *cuts.tolist(), table.num_rows]
            parts = [table.slice(a, b - a) for a, b in zip(limits, limits[1:])]
            return (parts, None) if last else (parts[:-1], parts[-1])

        def answer(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                if out := pairs_of(part):
                    a, b, sure = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sure)], ["a", "b", "sure"])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                parts, rest = groups(pa.concat_tables([rest, table]) if rest is not None else table, False)
                yield from answer(parts)
        if rest is not None:
            yield from answer(groups(rest, True)[0])

    return rows.mapInArrow(compare, "a long, b long, sure boolean")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Texts with equal sets form a class, whose smallest id stands for it. In every bucket (texts with
    an equal band) members are first compared with the smallest, each text with the partner it meets
    in most buckets; then all members that are still in different components are compared, in blocks,
    by their smallest hashes, which for most texts are the full set; other pairs are confirmed on it.
    So no link is lost within a bucket, and copies never meet pair by pair. A pair at the threshold
    shares no band with probability (1 - 0.75^4)^48 = 1e-8.

    Null and word-less texts have an empty set and are linked with nothing. A null doc_id is linked
    with nothing, has a null component and is kept. Rows with one doc_id are one node if their texts
    are equal, else each follows its own text. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = settle(signatures(docs), "signed")
    usable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = settle(
        usable.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes"
    )
    reps = settle(
        usable.join(classes, ["k1", "k2", "n_shingles"])
        .where("doc_id = rep")
        .select("rep", "n_shingles", "bands")
        .dropDuplicates(["rep"]),
        "reps",
    )
    bands = reps.select("rep", F.posexplode("bands")).select(F.xxhash64("pos", "col").alias("key"), "pos", "rep")
    buckets = bands.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n_members"))
    met = settle(bands.join(buckets.where("n_members > 1"), "key"), "met")

    firsts = (
        met.where("rep <> hub").groupBy(F.col("rep").alias("a"), F.col("hub").alias("b")).count()
        .groupBy("a").agg(F.max(F.struct("count", (-F.col("b")).alias("minus_b"))).alias("best"))
        .select("a", (-F.col("best.minus_b")).alias("b"))
    )
    firsts = settle(_estimated(firsts, reps, percent), "firsts")
    links = settle(_confirmed(firsts, docs, percent), "links")
    first_found = components(links)
    placed = (
        met.join(first_found, met.rep == first_found.node, "left")
        .select("key", "pos", "n_members", "rep", F.coalesce("component", "rep").alias("component"))
    )
    placed = settle(placed, "placed")
    split = (
        placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo < hi").select("key")
    )
    members = settle(placed.join(split, "key"), "members")
    wanted = settle(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    sketches = settle(_sketches(wanted, docs), "sketches")
    seconds = settle(_across(members, reps, sketches, percent), "seconds")
    unsure = seconds.where("NOT sure").select("a", "b").distinct().join(firsts, ["a", "b"], "left_anti")
    more = seconds.where("sure").select("a", "b")
    unsure = settle(unsure, "unsure")
    if unsure.limit(1).count():
        more = more.union(settle(_confirmed(unsure, docs, percent), "more"))
    found = components(links.union(more)) if more.limit(1).count() else first_found
    return (
        signed.join(classes, ["k1", "k2", "n_shingles"], "left")
        .join(found, F.col("rep") == F.col("node"), "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
