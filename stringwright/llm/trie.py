"""Shared beginnings of conversations: the trie of their turns, by vertical bitmaps.

Conversations are dealt out to shards by ranges of ids. A shard indexes (position, turn) to the bitset
of its conversations with that turn there. Depth first, the bitset of a node is intersected with the
postings of the next position: the parts are its children, their bits its members, and what has no
further turn ends there. Nodes of all shards are summed up by a hash of their turns; each node belongs
to its smallest member, so that what a subtree holds only once is added by one shard only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stringwright.llm.mixing import WORD
from stringwright.llm.store import settle

#: Ids that share a shard; a multiple of 20 below 32768.
SHARD = 1000
BLOCK = 20


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place, a, b, words: the turns of ``conversations`` (conv_id, turn, role, text) in order.

    Null turns come first; equal turn numbers are ordered by role and then by the turn's hash, and
    repeated rows are turns of their own. A null role or text counts as empty. Rows without conv_id
    belong to no conversation. ``a`` and ``b`` are 128 bits that stand for role and text.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role").alias("role"), empty("text").alias("text")
    )
    named = rows.select(
        "conv_id", "turn", "role", *[F.xxhash64(F.lit(seed), "role", "text").alias(n) for seed, n in ((1, "a"), (2, "b"))],
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "a", "b")
    return named.select("conv_id", (F.row_number().over(in_order) - 1).cast("long").alias("place"), "a", "b", "words")


def grafted(turns: DataFrame) -> DataFrame:
    """Turns of conversations whose first h turns are those of the block's first conversation, h the
    CRC-32 of the id modulo 4; a row without place stands for each conversation.

    Fewer turns there give fewer, none if that conversation is absent. A block is ``BLOCK`` ids whose
    remainder is cut off towards zero.
    """
    turns = settle(turns, "turns")
    conversations = turns.select("conv_id").distinct()
    conversations = conversations.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("long"))
    conversations = conversations.withColumn("head", F.col("conv_id") - F.col("conv_id") % BLOCK)
    heads = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("place") < 3)).withColumnRenamed("conv_id", "head")
    front = conversations.join(heads, "head").where(F.col("place") < F.col("h")).select(turns.columns)
    own = turns.where(F.col("place") >= F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4)
    none = [F.lit(None).cast("long").alias(c) for c in ("place", "a", "b", "words")]
    return front.union(own).union(conversations.select("conv_id", *none))


_GROWN = "shard long, node long, last long, up long, depth long, k1 long, k2 long, n long, low long, words long, ends binary"
_NODE = [x.split()[0] for x in _GROWN.split(", ")]


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, which the batches are sorted by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(0)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _postings(row: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, list[int]]:
    """The posting of every turn, and the postings' bitsets over ``n`` conversations."""
    order = np.lexsort((b, a, place))
    new = np.ones(len(order), bool)
    for x in (place, a, b):
        new[1:] &= x[order][1:] == x[order][:-1]
    new[1:] = ~new[1:]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    bits = []
    for members in np.split(row[order], np.flatnonzero(new)[1:]) if len(order) else []:
        if len(members) < 8:
            bits.append(sum(1 << i for i in members.tolist()))  # one turn per place, so no bit twice
        else:
            mask = np.zeros(n, bool)
            mask[members] = True
            bits.append(int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little"))
    return of, bits


def grow(ids: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray, words: np.ndarray) -> dict[str, list]:
    """The trie of one shard in preorder: ``last`` is the node after a node's subtree, ``up`` its parent.

    ``ids`` are sorted; turns are sorted by ``row`` (of ids) and place. ``ends`` are the ids that end at
    a node as 16-bit differences to its smallest member, ``low``.
    """
    n = len(ids)
    length = np.bincount(row, minlength=n)
    first = np.cumsum(length) - length
    of, bits = _postings(row, np.arange(len(row)) - first[row], a, b, n)
    ends_at: dict[int, int] = {}
    for i, m in enumerate(length.tolist()):
        ends_at[m] = ends_at.get(m, 0) | 1 << i
    out: dict[str, list] = {x: [] for x in _NODE[1:]}
    turn = np.stack([a, b], 1).tobytes()
    word, begin, size, conv = words.tolist(), first.tolist(), length.tolist(), ids.tolist()

    def add(up: int, depth: int, key: bytes, members: int, low: int, ends: bytes) -> int:
        at = begin[low] + depth - 1
        for name, x in zip(_NODE[1:], (len(out["node"]), 0, up, depth, *np.frombuffer(key, np.int64).tolist(), members, conv[low], word[at] if depth else 0, ends)):
            out[name].append(x)
        return len(out["node"]) - 1

    def chained(key: bytes, low: int, depth: int) -> bytes:
        """The key of the child by the turn of conversation ``low`` at ``depth``."""
        at = 16 * (begin[low] + depth)
        return hashlib.blake2b(key + turn[at : at + 16], digest_size=16).digest()

    stack = [((1 << n) - 1, -1, 0, bytes(16))]
    while stack:
        members, up, depth, key = stack.pop()
        low = (members & -members).bit_length() - 1
        if members == 1 << low:  # alone from here on
            while True:
                done = depth == size[low]
                up = add(up, depth, key, 1, low, bytes(2) if done else b"")
                if done:
                    break
                key, depth = chained(key, low, depth), depth + 1
            continue
        ending = members & ends_at.get(depth, 0)
        rest, ends = members & ~ending, []
        while ending:
            i = (ending & -ending).bit_length() - 1
            ends.append(conv[i] - conv[low])
            ending &= ending - 1
        up = add(up, depth, key, members.bit_count(), low, np.array(ends, np.uint16).tobytes())
        children = []
        while rest:
            i = (rest & -rest).bit_length() - 1
            child = rest & bits[of[begin[i] + depth]]
            children.append((child, up, depth + 1, chained(key, i, depth)))
            rest &= ~child
        stack += reversed(children)
    nodes = np.ones(len(out["up"]), np.int64)
    for i in range(len(nodes) - 1, 0, -1):
        nodes[out["up"][i]] += nodes[i]
    out["last"] = (np.arange(len(nodes)) + nodes).tolist()
    return out


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_group(batches):
        conv = rows.column("conv_id").to_numpy()
        ids, row = np.unique(conv, return_inverse=True)
        real = rows.column("place").is_valid().to_numpy()
        a, b, words = (rows.column(c).combine_chunks().fill_null(0).to_numpy()[real] for c in ("a", "b", "words"))
        found = grow(ids, row[real], a, b, words)
        shard = pa.array(np.full(len(found["node"]), rows.column(0)[0].as_py()))
        kinds = [pa.binary() if x == "ends" else pa.int64() for x in _NODE[1:]]
        yield pa.RecordBatch.from_arrays([shard, *[pa.array(found[x], k) for x, k in zip(_NODE[1:], kinds)]], _NODE)


def _ids(low: int, ends: bytes) -> str:
    return ",".join(map(str, (np.frombuffer(ends, np.uint16).astype(np.int64) + low).tolist()))


_SUMMED = (
    "k1 long, k2 long, shards long, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, low long, ends binary"
)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's share of what the subtrees of its nodes hold. A node is counted by its owner's shard;
    only there is its parent named."""
    for rows in _by_group(batches):
        col = {c: rows.column(c).to_numpy() for c in rows.column_names if c != "ends"}
        node, last, up, low = col["node"], col["last"], col["up"], col["low"]
        owned = col["conv_id"] == low
        leaf = owned & (col["n_convs"] == col["n_ends"])
        sums = lambda x: np.concatenate([[0], np.cumsum(x)])
        within = lambda s: s[last] - s[node]
        saved = within(sums(col["n"] * col["words"])) - within(sums(owned * col["words"]))
        counted = owned & (up >= 0)
        children = np.bincount(up[counted], minlength=len(node))
        parent = pa.array(col["conv_id"][up], mask=~counted)
        single = col["shards"] == 1
        ends = rows.column("ends").to_pylist()
        hashed = [hashlib.sha256(_ids(x, e).encode()).hexdigest() if s else None for x, e, s in zip(low.tolist(), ends, single.tolist())]
        listed = [e if e and not s else None for e, s in zip(ends, single.tolist())]
        arrays = [col["k1"], col["k2"], col["shards"], col["conv_id"], col["depth"], parent, col["n_convs"], children, within(sums(leaf)), saved]
        arrays = [x if isinstance(x, pa.Array) else pa.array(x.astype(np.int64)) for x in arrays]
        yield pa.RecordBatch.from_arrays(
            [*arrays, pa.array(hashed, pa.string()), pa.array(low), pa.array(listed, pa.binary())], [x.split()[0] for x in _SUMMED.split(", ")]
        )


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k1, k2, ends_sha256 of nodes whose ends several shards hold, sorted by node and id. The ids run
    through the hash as they come and are never held together."""
    key, digest = None, None
    found: tuple[list, list, list] = ([], [], [])

    def put() -> None:
        if key is not None:
            for x, y in zip(found, (*key, digest.hexdigest())):
                x.append(y)

    for batch in batches:
        for k1, k2, low, ends in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if key != (k1, k2):
                put()
                key, digest = (k1, k2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(_ids(low, ends).encode())
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.string())], ["k1", "k2", "ends_sha256"])
        found = ([], [], [])
    put()
    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.string())], ["k1", "k2", "ends_sha256"])


def _sharded(rows: DataFrame, solve: Callable, schema: str, *order: str) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions("shard", *order).mapInArrow(solve, schema)


def prefix_trie(turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, place, a, b, words), as ``turns_of`` gives them.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves
    (childless nodes of the subtree), saved_tokens (words of the subtree's turns that a shared prefix
    stores once instead of for each member), ends_sha256 (of the comma-joined ids that end here). A row
    without place makes a conversation known that may have no turns; it is a member of the root only.
    No conversations, no rows. Other columns are ignored. Turns and nodes are told apart by 128 bits.

    A task holds one shard at a time: up to ``shard`` ids with some 150 bytes a turn. Nodes that several
    shards know are summed by partial aggregates, one row per shard and node at most.
    """
    if shard % BLOCK or not 0 < shard < 1 << 15:
        raise ValueError("a shard is a multiple of 20 ids, fewer than 32768")
    at = (F.col("conv_id") - F.col("conv_id") % shard).alias("shard")
    rows = turns.select(at, "conv_id", "place", "a", "b", "words")
    grown = settle(_sharded(rows, _grown, _GROWN, "conv_id", "place"), "grown")
    n_ends = F.sum(F.octet_length("ends") / 2).cast("long").alias("n_ends")
    whole = grown.groupBy("k1", "k2").agg(F.sum("n").alias("n_convs"), n_ends, F.min("low").alias("conv_id"), F.count("*").alias("shards"))
    known = grown.join(settle(whole, "nodes"), ["k1", "k2"]).select(*_NODE, "n_convs", "n_ends", "conv_id", "shards")
    summed = settle(_sharded(known, _summed, _SUMMED, "node"), "summed")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = summed.where("shards > 1")
    added = shared.groupBy("k1", "k2").agg(
        *[F.max(c).alias(c) for c in names[:4]], *[F.sum(c).alias(c) for c in names[4:7]]
    )
    ended = shared.where("ends IS NOT NULL").select("k1", "k2", "low", "ends")
    ended = ended.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "low").mapInArrow(_ended, "k1 long, k2 long, ends_sha256 string")
    added = added.join(ended, ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return summed.where("shards = 1").select(names).union(added.select(names))
