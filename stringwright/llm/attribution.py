"""Token counts of fields and sections from one encoding of the whole document.

Fields are joined to one text and encoded once. Tokens and sections are both intervals of characters;
sections do not overlap and follow each other, so the join of the two is a search in sorted ends.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringwright.llm.token_files import LETTERS

#: Pieces whose tokens a worker remembers.
REMEMBERED = 500_000
RULES = ("first", "last", "most", "share")
#: Latin-1 texts in which every character above ASCII is a letter are cut into the vocabulary's own pieces.
_LATIN_OK = bytes([*range(128), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
# Fixed value: the pieces of the byte-level vocabulary, for such texts.
_PIECES = re.compile(
    rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xc0-\xff]+| ?[0-9]+| ?[^\sA-Za-z0-9\xc0-\xff]+|\s+(?!\S)|\s+"
).findall

_cutters: dict[str, Callable[[str], tuple[np.ndarray, np.ndarray]]] = {}


class Known:
    """Token spans of pieces, in one growing table: piece i has the rows firsts[i] to firsts[i + 1]."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.firsts = np.zeros(1024, np.int64)
        self.spans = np.zeros((4096, 2), np.int64)

    def add(self, pieces: list[bytes], offsets: list[list[tuple[int, int]]]) -> None:
        n, rows = len(self.index), int(self.firsts[len(self.index)])
        ends = rows + np.cumsum([len(o) for o in offsets])
        while len(self.firsts) <= n + len(pieces):
            self.firsts = np.concatenate([self.firsts, np.zeros_like(self.firsts)])
        while len(self.spans) < ends[-1]:
            self.spans = np.concatenate([self.spans, np.zeros_like(self.spans)])
        self.firsts[n + 1 : n + 1 + len(pieces)] = ends
        self.spans[rows : ends[-1]] = [span for o in offsets for span in o]
        self.index.update(zip(pieces, range(n, n + len(pieces))))


def cutter(path: str) -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """Character starts and ends of all tokens of a whole text.

    The pieces of a Latin-1 text are encoded once by a worker; no token reaches across pieces, so their
    spans, moved to where the pieces stand, are those of the text. Other texts are encoded as they are.
    """
    if path in _cutters:
        return _cutters[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    model = tokenizer.model
    known = Known()

    def spans_of(piece: str) -> list[tuple[int, int]]:
        """Character spans of a piece's tokens; one that holds part of a character spans it."""
        body = piece.encode()
        ends = list(accumulate(len(t.value) for t in model.tokenize(body.decode("latin-1").translate(LETTERS))))
        spans = zip([0, *ends], ends)
        if len(body) == len(piece):
            return list(spans)
        owner = [k for k, c in enumerate(piece) for _ in c.encode()]
        return [(owner[a], owner[b - 1] + 1) for a, b in spans]

    def cut(text: str) -> tuple[np.ndarray, np.ndarray]:
        nonlocal known
        try:
            latin = text.encode("latin-1")
        except UnicodeEncodeError:
            latin = b"\xa0"
        if latin.translate(None, _LATIN_OK):
            spans = np.array(tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
            return spans[:, 0], spans[:, 1]
        pieces = _PIECES(latin)
        new = list(set(pieces).difference(known.index))
        if new and len(known.index) + len(new) > REMEMBERED:
            known = Known()
            new = list(set(pieces))
        if new:
            known.add(new, [spans_of(p.decode("latin-1")) for p in new])
        which = np.fromiter(map(known.index.__getitem__, pieces), np.int64, len(pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = known.firsts[which]
        n = known.firsts[which + 1] - first
        row = np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)
        at = np.repeat(np.cumsum(lengths) - lengths, n)
        return known.spans[row, 0] + at, known.spans[row, 1] + at

    _cutters[path] = cut
    return cut


def allot(starts: np.ndarray, ends: np.ndarray, limits: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section and tokens that cross a section's end.

    Section i holds the characters from ``limits[i]`` to ``limits[i + 1]``. A token that lies in
    several goes to that of its first or last character, to the one with most of its characters (the
    earlier of equals), or in shares by characters.
    """
    sections = len(limits) - 1
    first = np.searchsorted(limits, starts, side="right") - 1
    last = np.searchsorted(limits, np.maximum(ends - 1, starts), side="right") - 1
    first, last = np.clip(first, 0, sections - 1), np.clip(last, 0, sections - 1)
    crossing = np.flatnonzero(first < last)
    counts = np.bincount((last if rule == "last" else first), minlength=sections).astype(np.float64)
    if rule in ("most", "share"):
        for k in crossing.tolist():
            parts = np.arange(first[k], last[k] + 1)
            held = np.minimum(limits[parts + 1], ends[k]) - np.maximum(limits[parts], starts[k])
            counts[first[k]] -= 1
            if rule == "most":
                counts[parts[held.argmax()]] += 1
            else:
                counts[parts] += held / (ends[k] - starts[k])
    return counts, np.bincount(first[crossing], minlength=sections)


def attributed(
    docs: DataFrame, path: str, fields: list[str], lines_of: str | None = None, rule: str = "most", between: str = " "
) -> DataFrame:
    """doc_id, n_tokens, n_crossing and sections, array<struct<field, line, start, end, tokens>>.

    The fields of a row, null as empty, are joined by ``between``, which belongs to the field before
    it; field ``lines_of`` is cut further after every line feed. Sections without characters are
    reported with no tokens. A null doc_id is passed on; repeated rows are answered each; an empty
    table gives no rows; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = ["doc_id", "n_tokens", "n_crossing", "sections"]

    def lengths_of(values: list[str]) -> tuple[list[int], list[int], list[int]]:
        """Field, line and length of every section of a row."""
        field, line, length = [], [], []
        for k, (name, value) in enumerate(zip(fields, values)):
            parts = [len(x) + 1 for x in value.split("\n")] if name == lines_of else [len(value) + 1]
            parts[-1] += (len(between) if k + 1 < len(fields) else 0) - 1
            field += [k] * len(parts)
            line += range(len(parts))
            length += parts
        return field, line, length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter(path)
        labels = pa.array(fields)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = zip(*(part.column(i + 1) for i in range(len(fields))))
                field, line, start, end, tokens, sizes, counts, crossings = [], [], [], [], [], [], [], []
                for row in texts:
                    values = [v.as_py() or "" for v in row]
                    of, number, length = lengths_of(values)
                    limits = np.concatenate([[0], np.cumsum(length)])
                    starts, ends = cut(between.join(values))
                    # sections without characters hold nothing: search among the others
                    full = np.flatnonzero(length)
                    held, crossed = np.zeros(len(length)), 0
                    if len(full):
                        held[full], by_section = allot(starts, ends, np.append(limits[full], limits[-1]), rule)
                        crossed = int(by_section.sum())
                    field += of
                    line += number
                    start.append(limits[:-1])
                    end.append(limits[1:])
                    tokens.append(held)
                    sizes.append(len(length))
                    counts.append(len(starts))
                    crossings.append(crossed)
                sections = pa.StructArray.from_arrays(
                    [
                        labels.take(pa.array(field, pa.int32())),
                        pa.array(line, pa.int32()),
                        pa.array(np.concatenate(start), pa.int32()),
                        pa.array(np.concatenate(end), pa.int32()),
                        pa.array(np.concatenate(tokens)),
                    ],
                    ["field", "line", "start", "end", "tokens"],
                )
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), sections)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(crossings, pa.int64()), lists], names
                )

    schema = (
        "doc_id long, n_tokens long, n_crossing long, "
        "sections array<struct<field: string, line: int, start: int, end: int, tokens: double>>"
    )
    columns = [F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)]
    return docs.select(F.col("doc_id").cast("long"), *columns).mapInArrow(run, schema)
