"""Vectorised work on whole UTF-8 texts: words, hashes, slices of Arrow batches.

Texts are handled as one run of bytes per slice; separators are ASCII, so bytes and characters
agree on word limits. Hashes are 64-bit: a sum of mixed bytes times powers of an odd base, computed
once per slice for all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; a longer text makes a slice of its own.
SLICE = 1 << 20

SPACES = b" \t\n\x0b\x0c\r"
IN_WORD = np.ones(256, bool)
IN_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(31)
    x *= U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 1), base, dtype=U)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """``p`` with which ``span_hash`` gives the hash of any range of ``data``."""
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(BYTE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges ``[start, end)``; the length counts."""
    start, end = np.asarray(start), np.asarray(end)
    value = (p[end] - p[start]) * powers(_UNBASE, len(p))[start]
    return mix(value + (end - start).astype(U) * U(0xA24BAED4963EE407))


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"") if len(column) else column
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of marked bytes that do not cross a text limit."""
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    limits = offsets[:-1][offsets[:-1] < len(inside)]
    before[limits] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin (one entry more than texts)."""
    starts, ends = runs(IN_WORD[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with A-Z lowered, and where each text's words begin."""
    starts, ends, firsts = words(data, offsets)
    return span_hash(prefix_sums(LOWER[data]), starts, ends), firsts


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles; a short text is one shingle."""
    odd = mix(np.arange(11, 11 + width, dtype=U)) | U(1)
    for _, _, data, offsets in text_slices(column):
        hashes, firsts = word_hashes(data, offsets)
        count = max(len(hashes) - width + 1, 0)
        rolled = np.zeros(count, dtype=U)
        for k in range(width):
            rolled += hashes[k : k + count] * odd[k]
        rolled = mix(rolled)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                yield mix((hashes[a:b] * odd[: b - a]).sum(keepdims=True) + U(b - a))
            else:
                yield hashes[:0]
