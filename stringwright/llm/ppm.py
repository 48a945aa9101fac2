"""Language-model scores by prediction by partial matching over bytes.

A text is the bytes of its lower-cased words, one space between words and a line feed at the end, so
words and bytes determine each other. The model is a trie of contexts of up to ``ORDER`` bytes with
counts of the bytes that follow, gathered from all training texts. A byte is predicted by the longest
context that was seen; if that context has not seen the byte, an escape is paid and the next shorter
one is asked, without the symbols that the longer one has excluded. In a context with n occurrences of
q different bytes, one seen c times has (2c - 1) / 2n and the escape q / 2n. Below all contexts all
256 bytes are equally likely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringwright.llm.kernel import LOWER, U, prefix_sums, span_hash, text_slices, words
from stringwright.llm.store import settle

ORDER = 5
#: Most nodes (context and next byte) of an order that go to every task; longer contexts are dealt out by
#: their endings. Only the route differs.
NODES = 1 << 20
#: Grams that a task of longer contexts has on average.
DEALT = 1 << 19
#: Most grams whose scores go to every task; the others are joined. Only the route differs.
GRAMS = 1 << 21
#: Scores of bytes are multiples of this, so that their sums are exact in any order.
GRID = 2.0**-24
#: Most words whose counts go to every task; the others are joined. Only the route differs.
COMMON = 1 << 19
#: Bytes of text counted and scored at once, and different keys that a task holds.
COUNTED, SCORED = 1 << 20, 2 << 20
PENDING = 2 << 20
TEXT_START = 10


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts in model form and where each ends."""
    starts, ends, firsts = words(data, offsets)
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    # every word is followed by a space, every text by a line feed instead of its last space
    n_words = np.diff(firsts)
    empty = n_words == 0
    shift = np.cumsum(empty) - empty
    begin = at[:-1] + np.repeat(shift, n_words)
    total = int(at[-1] + empty.sum())
    out = np.full(total, 32, np.uint8)
    source = np.repeat(starts - (at[:-1]), lengths) + _within(at[:-1], lengths)
    out[np.repeat(begin - at[:-1], lengths) + _within(at[:-1], lengths)] = LOWER[data[source]]
    text_ends = at[firsts[1:]] + np.cumsum(empty)
    out[text_ends - 1] = TEXT_START
    return out, text_ends


def _within(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``at[i], at[i] + 1, ...`` for every run."""
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(first - at, lengths)


def grams(out: np.ndarray, text_ends: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For every byte the number made of its ``order`` predecessors and itself, highest byte first.

    Before a text's first byte there are line feeds.
    """
    begins = np.concatenate([[0], text_ends[:-1]])
    place = np.arange(len(out)) - np.repeat(begins, np.diff(np.concatenate([[0], text_ends])))
    value = np.zeros(len(out), dtype=U)
    for back in range(order, 0, -1):
        earlier = np.full(len(out), TEXT_START, np.uint8)
        earlier[back:] = out[:-back]
        earlier[place < back] = TEXT_START
        value = (value << U(8)) | earlier
    return (value << U(8)) | out


def gather(docs: DataFrame) -> DataFrame:
    """(word, key, n, m): of all texts (text) the grams and, with ``word`` true, the word hashes.

    ``n`` counts the rows to learn from, ``m`` all of them; with a column ``held_out``, rows for which it
    is not false are not learnt from, and their words are left out. Tasks sum up what they read; a text's
    end counts as word 0.
    """
    if "held_out" not in docs.columns:
        docs = docs.withColumn("held_out", F.lit(False))
    docs = docs.select("text", F.coalesce("held_out", F.lit(True)))

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*parts))
        keys, which = np.unique(keys, return_inverse=True)
        return keys, np.bincount(which, weights=n).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [(False, True), (False, False), (True, True)]  # word, learnt
        held: dict[tuple[bool, bool], list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in kinds}
        pending = dict.fromkeys(kinds, 0)

        def rows(kind: tuple[bool, bool]) -> Iterator[pa.RecordBatch]:
            keys, n = merge(held[kind])
            held[kind], pending[kind] = [], 0
            arrays = [pa.array(np.full(len(keys), kind[0])), pa.array(keys.view(np.int64)), pa.array(n * kind[1]), pa.array(n)]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "key", "n", "m"])

        for batch in batches:
            away = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, data, offsets in text_slices(batch.column(0), COUNTED):
                out, ends = stream(data, offsets)
                hashes, firsts = token_hashes(data, offsets)
                values = grams(out, ends)
                at = np.repeat(away[a:b], np.diff(np.concatenate([[0], ends])))
                learnt = np.append(hashes[~np.repeat(away[a:b], np.diff(firsts))], np.zeros((~away[a:b]).sum(), U))
                for kind, found in zip(kinds, (values[~at], values[at], learnt)):
                    if not len(found):
                        continue
                    held[kind].append(np.unique(found, return_counts=True))
                    pending[kind] += len(held[kind][-1][0])
                    if pending[kind] > PENDING:
                        held[kind] = [merge(held[kind])]
                        # what does not shrink is passed on
                        if len(held[kind][0][0]) > PENDING // 2:
                            yield from rows(kind)
                        else:
                            pending[kind] = len(held[kind][0][0])
        for kind in kinds:
            if held[kind]:
                yield from rows(kind)

    parts = docs.mapInArrow(count, "word boolean, key long, n long, m long")
    return parts.groupBy("word", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, never 0, and where each text's begin."""
    starts, ends, firsts = words(data, offsets)
    return np.maximum(span_hash(prefix_sums(LOWER[data]), starts, ends), U(1)), firsts


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """Rows of ``counts`` (n, ...) with a count so high that no more than ``most`` have it.

    Counts fall into sixteen classes for each doubling; classes are taken from the highest on. So equal
    counts are treated alike and only some hundred sums reach the driver.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"])
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return counts.where(F.lit(False) if least is None else level >= least)


class Trie:
    """The model: per order the nodes in sorted order, and what a prediction needs of each.

    A node is a context of ``order`` bytes with its next byte, as a number. Of order k, ``gain`` is the
    logarithm of twice the node's count less one; of its context, ``total`` is the logarithm of twice
    the occurrences, ``escape`` that of escaping from it when it is asked first, and for a context
    asked after its longer one failed, kept with the longer one, ``rest`` and ``on``: the same two
    after exclusion.
    """

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.order = len(nodes) - 1
        self.keys = [k for k, _ in nodes]
        self.gain = [np.log10(2.0 * n - 1).astype(np.float32) for _, n in nodes]
        self.contexts, self.total, self.escape, self.rest, self.on = [], [], [], [], []
        sums, kinds = [], []
        for order, (keys, n) in enumerate(nodes):
            contexts, first = np.unique(keys >> U(8), return_index=True)
            count = np.add.reduceat(n, first) if len(first) else n[:0]
            different = np.diff(np.append(first, len(keys)))
            sums.append(count.astype(np.float64))
            kinds.append(different.astype(np.float64))
            self.contexts.append(contexts)
            self.total.append(np.log10(2 * sums[-1]))
            self.escape.append(np.log10(kinds[-1]) - self.total[-1])
            if order == 0:
                # below the empty context: the bytes it has not seen, equally likely
                left = np.maximum(256.0 - kinds[0], 1.0)
                self.rest.append(np.log10(left))
                self.on.append(np.zeros(len(left)))
                continue
            shorter = U((1 << (8 * (order - 1))) - 1)
            parent = np.searchsorted(self.contexts[order - 1], contexts & shorter)
            same = np.searchsorted(nodes[order - 1][0], keys & U((1 << (8 * order)) - 1))
            excluded = np.add.reduceat(nodes[order - 1][1][same], first).astype(np.float64)
            free = np.maximum(sums[order - 1][parent] - excluded, 0.0)
            kinds_left = kinds[order - 1][parent] - kinds[order]
            # with no new byte left the shorter context is passed at no cost
            over = 2 * free
            self.rest.append(np.log10(np.where(over > 0, over, 1.0)))
            self.on.append(np.where(over > 0, np.log10(np.where(kinds_left > 0, kinds_left, 1.0)) - self.rest[-1], 0.0))
        for part in (self.total, self.escape, self.rest, self.on):
            part[:] = [x.astype(np.float32) for x in part]

    def log10(self, values: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram, given the bytes before it."""
        out = np.zeros(len(values))
        open_ = np.ones(len(values), bool)
        asked = np.zeros(len(values), bool)
        above = np.zeros(len(values), np.int64)
        for order in range(self.order, -1, -1):
            at = np.flatnonzero(open_)
            node = values[at] & U((1 << (8 * (order + 1))) - 1)
            context = np.searchsorted(self.contexts[order], node >> U(8))
            context = np.minimum(context, max(len(self.contexts[order]) - 1, 0))
            seen = self.contexts[order][context] == node >> U(8) if len(self.contexts[order]) else np.zeros(len(at), bool)
            at, node, context = at[seen], node[seen], context[seen]
            spot = np.minimum(np.searchsorted(self.keys[order], node), max(len(self.keys[order]) - 1, 0))
            hit = self.keys[order][spot] == node
            later = asked[at]
            longer = above[at]
            rest, on = (self.rest[order + 1], self.on[order + 1]) if order < self.order else (np.zeros(1), np.zeros(1))
            over = np.where(later, rest[np.where(later, longer, 0)], self.total[order][context])
            pay = np.where(later, on[np.where(later, longer, 0)], self.escape[order][context])
            out[at] += np.where(hit, self.gain[order][spot] - over, pay)
            open_[at[hit]] = False
            asked[at] = True
            above[at] = context
        left = np.flatnonzero(open_)
        if len(left):
            out[left] -= self.rest[0][above[left]] if len(self.rest[0]) else math.log10(256)
        return out


def _low(order: int) -> int:
    """The bytes of a node of ``order``: its context and its next byte."""
    return (1 << (8 * (order + 1))) - 1


def _levels(keys: np.ndarray, n: np.ndarray, first: int, last: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted nodes of the orders ``first`` to ``last``, summed up from nodes that are at least as long."""
    out = []
    for k in range(last, first - 1, -1):
        keys, which = np.unique(keys & U(_low(k)), return_inverse=True)
        n = np.bincount(which, weights=n, minlength=len(keys)).astype(np.int64)
        out.append((keys, n))
    return out[::-1]


def _trie(nodes: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
    while len(nodes) > 1 and not len(nodes[-1][0]):
        nodes = nodes[:-1]
    return Trie(nodes)


def shared_levels(grams_: DataFrame, order: int = ORDER, nodes: int = NODES) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nodes of the orders 0, 1, ... of all counted grams (key, n), as far as an order has no more than ``nodes``.

    Orders 0 and 1 (65,536 nodes at most) are always among them. Rows reach the driver of one order only.
    """
    rows = grams_.where("n > 0").select("key", "n")
    for k in range(order, -1, -1):
        if k < ORDER:
            cut = F.col("key").bitwiseAND(F.lit(_low(k)))
            rows = settle(rows.groupBy(cut.alias("key")).agg(F.sum("n").alias("n")), f"order{k}")
        if k <= 1 or rows.count() <= nodes:
            table = rows.toArrow()
            return _levels(table.column("key").to_numpy().view(U), table.column("n").to_numpy(), 0, k)
    raise ValueError("order below 0")


def train(grams_: DataFrame, order: int = ORDER, nodes: int = NODES) -> Trie:
    """The trie of all counted grams (key, n), of the orders that ``shared_levels`` gives."""
    return _trie(shared_levels(grams_, order, nodes))


def gram_scores(grams_: DataFrame, order: int = ORDER, nodes: int = NODES) -> DataFrame:
    """(key, n, score) of every gram of ``order`` in ``grams_`` (key, n, m): its occurrences ``m`` as ``n`` and
    log10 probability under the whole model.

    The shared orders go to every task. What a longer context is asked for depends on contexts with the
    same ending alone, so grams are dealt out by the shortest ending that is not shared, and each task
    has the whole trie above its endings.
    """
    if order < ORDER:
        cut = F.col("key").bitwiseAND(F.lit(_low(order)))
        grams_ = settle(grams_.groupBy(cut.alias("key")).agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "cut")
    base = shared_levels(grams_, order, nodes)
    held = grams_.sparkSession.sparkContext.broadcast(base)
    rows = grams_.select("key", "n", "m")
    whole = len(base) > order
    tasks = max(1, math.ceil(rows.count() / DEALT))
    if whole:
        rows = rows.coalesce(tasks)
    else:
        # the ending in base + 1 bytes, before the next byte
        ending = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(_low(len(base) - 1)))
        rows = rows.repartition(tasks, ending)

    def found(trie: Trie, keys: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        scores = np.round(trie.log10(keys) / GRID) * GRID
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(m), pa.array(scores)], ["key", "n", "score"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = held.value
        parts = [[x.to_numpy(zero_copy_only=False) for x in b.columns] for b in batches if b.num_rows]
        if parts:
            keys, n, m = (np.concatenate(x) for x in zip(*parts))
            keys, learnt = keys.view(U), n > 0
            longer = [] if whole else _levels(keys[learnt], n[learnt], len(shared), order)
            trie = _trie(shared + longer)
            for k in range(0, len(keys), DEALT):
                yield found(trie, keys[k : k + DEALT], m[k : k + DEALT])

    return rows.mapInArrow(score, "key long, n long, score double")


def language_scores(docs: DataFrame, held_out: Column, order: int = ORDER, nodes: int = NODES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Rows for which ``held_out`` is false are learnt from. ``base_score`` is the unigram score with one
    added to every count; words are told apart by a 64-bit hash. Counts of the commonest ``COMMON``
    words go to every task, those of all others are joined. ``score`` is the trie's log10 probability; every
    distinct gram is scored once by the whole model, then grams are looked up as words are.

    Null and empty texts are an end alone. With nothing to learn from every byte costs log10 256. A null
    doc_id is passed on; repeated rows count and are answered each; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    gathered = settle(gather(docs), "gathered")
    of_grams = settle(gram_scores(gathered.where("NOT word"), order, nodes), "scores")
    word_counts = gathered.where("word").select("key", "n")
    total = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    each = math.log10(total[0] + total[1] + 1)

    def sorted_table(rows: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
        table = rows.select("key", value).toArrow()
        keys = table.column("key").to_numpy().view(U)
        by_key = np.argsort(keys)
        return keys[by_key], table.column(value).to_numpy()[by_key]

    few = of_grams if of_grams.count() <= GRAMS else commonest(of_grams, GRAMS)
    shared = spark.sparkContext.broadcast((*sorted_table(few, "score"), *sorted_table(commonest(word_counts, COMMON), "n")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_keys, gram_scores_, keys, n = shared.value
        gain = np.log10(n + 1.0)
        sums = lambda x, firsts: np.diff(np.concatenate([[0.0], np.cumsum(x)])[firsts])

        def looked_up(distinct: np.ndarray, among: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which are ``among`` the shared keys, and their values or 0."""
            if not len(among):
                return np.zeros(len(distinct), bool), np.zeros(len(distinct))
            spot = np.minimum(np.searchsorted(among, distinct), len(among) - 1)
            there = among[spot] == distinct
            return there, np.where(there, values[spot], 0.0)

        def lists(values: np.ndarray, rare: np.ndarray, firsts: np.ndarray) -> pa.ListArray:
            """Per text the values that are not shared."""
            at = np.concatenate([[0], np.cumsum(rare)])[firsts]
            return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values[rare].view(np.int64)))

        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1), SCORED):
                out, ends = stream(data, offsets)
                values, which = np.unique(grams(out, ends, order), return_inverse=True)
                ends = np.concatenate([[0], ends])
                held, by_gram = looked_up(values, gram_keys, gram_scores_)
                more_grams = lists(values[which], ~held[which], ends)
                by_byte = by_gram[which]
                hashes, firsts = token_hashes(data, offsets)
                # every text's words, then its end
                tokens = np.insert(hashes, firsts[1:], U(0))
                firsts = firsts + np.arange(len(firsts))
                distinct, of = np.unique(tokens, return_inverse=True)
                common, logs = looked_up(distinct, keys, gain)
                rare, logs = ~common[of], logs[of]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array(np.diff(firsts)),
                        pa.array(sums(~rare, firsts).astype(np.int64)),
                        pa.array(sums(logs, firsts)),
                        pa.array(sums(by_byte, ends)),
                        lists(tokens, rare, firsts),
                        more_grams,
                    ],
                    ["doc_id", "held_out", "n_tokens", "common", "logs", "score", "rest", "grams"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, common long, logs double, score double, rest array<long>, grams array<long>"
    rows = docs.mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id())
    rows = settle(rows, "rows")
    rare = rows.select("row", F.explode("rest").alias("key")).groupBy("row", "key").count()
    rare = rare.join(word_counts, "key").groupBy("row").agg(
        F.sum("count").alias("known"), F.sum(F.col("count") * F.log10(F.col("n") + 1)).alias("more")
    )
    rare_grams = rows.select("row", F.explode("grams").alias("key")).groupBy("row", "key").count()
    rare_grams = rare_grams.join(of_grams.select("key", F.col("score").alias("each")), "key")
    rare_grams = rare_grams.groupBy("row").agg(F.sum(F.col("count") * F.col("each")).alias("bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.join(rare, "row", "left").join(rare_grams, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("common") + zero("known")).alias("n_known"),
        F.lit(total[0]).cast("long").alias("train_tokens"),
        (F.col("logs") + zero("more") - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        (F.col("score") + zero("bytes")).alias("score"),
    )
