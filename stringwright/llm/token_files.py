"""Token ids in binary files: frequency ranks in byte-aligned variable length.

File layout, all numbers little-endian: ``MAGIC``; int64 counts of documents and ids; per document
int64 doc_id, one byte that is 1 for a null id, uint32 number of ids; then control bytes, two bits for
each id, lowest first, holding its number of data bytes less one; then the data bytes. What is coded
is an id's rank by falling frequency over all documents (equal counts: smaller id first), so common
ids take one byte. A reader looks control bytes up in a table of 256 rows to find all lengths at once.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stringwright.llm.store import new_path, settle

MAGIC = b"RANKVB01"
#: Ids in a file, beyond which the next one begins; a longer document makes a file of its own.
FILE_IDS = 1 << 20
#: Words whose ids a worker remembers.
REMEMBERED = 600_000

#: Lengths of the four ids of every control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1

#: What Latin-1 texts are made of when every character above ASCII is a letter, which normal forms leave
#: alone, and the letters' lower case. Such texts are cut into the vocabulary's own pieces.
_LATIN_OK = bytes([*range(128), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_LATIN_LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
# Fixed value: the pieces of the vocabulary, for Latin-1 in lower case.
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xc0-\xff]+|[0-9]|[^\sa-z0-9\xc0-\xff]+").findall

#: The letter that stands for every byte in a byte-level vocabulary: itself if printable, else the next
#: one from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
LETTERS = {b: 256 + k for k, b in enumerate(_OTHERS)}

_encoders: dict[str, Callable[[str | None], bytes]] = {}


def id_type(path: str) -> str:
    """The narrowest of uint16 and uint32 that holds all ids of the tokenizer."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def encoder(path: str, kind: str) -> Callable[[str | None], bytes]:
    """Ids of a whole text as bytes of type ``kind``.

    The vocabulary drops white space and forms no token across it, so the ids of a Latin-1 text are its
    words' ids in order; each different word is cut and each different piece encoded once by a worker.
    Other texts are encoded as they are.
    """
    if path in _encoders:
        return _encoders[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    code = "H" if kind == "<u2" else "I"
    known: dict[bytes, bytes] = {}
    pieces: dict[bytes, bytes] = {}

    def of_piece(piece: bytes) -> bytes:
        """Ids of one piece of a Latin-1 text: its UTF-8 bytes, by their letters, merged by the model."""
        if piece not in pieces:
            letters = piece.decode("latin-1").encode().decode("latin-1").translate(LETTERS)
            pieces[piece] = array(code, [t.id for t in model.tokenize(letters)]).tobytes()
        return pieces[piece]

    def of_word(word: bytes) -> bytes:
        return b"".join(map(of_piece, _PIECES(word)))

    def encode(text: str | None) -> bytes:
        if not text:
            return b""
        try:
            latin = text.encode("latin-1")
        except UnicodeEncodeError:
            latin = b"\xa0"
        if latin.translate(None, _LATIN_OK) or b"<|" in latin:
            return array(code, tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        words = latin.translate(_LATIN_LOWER).split()
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(words)
            if len(pieces) > REMEMBERED:
                pieces.clear()
            known.update((w, of_word(w)) for w in new)
        return b"".join(map(known.__getitem__, words))

    _encoders[path] = encode
    return encode


def encoded(docs: DataFrame, path: str, end_id: int, kind: str) -> DataFrame:
    """doc_id, ids (bytes of type ``kind``, with the end id) of every row; a null text is empty."""
    end = np.array([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encode(t.as_py()) + end for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def frequency_ranks(ids: DataFrame, kind: str) -> np.ndarray:
    """Token ids by falling frequency; as many as the vocabulary has at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                n = np.bincount(np.frombuffer(x.as_buffer(), kind))
                if len(n) > len(total):
                    n[: len(total)] += total
                    total = n
                else:
                    total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    counts = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))
    return np.array([r["id"] for r in rows], "<u4")


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of an array of ranks."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    parts = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.sum(axis=1, dtype=np.uint8).tobytes(), parts[np.arange(4) < size[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Ranks from control and data bytes."""
    size = LENGTHS[control].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = data
    return out.view("<u4").reshape(-1)


def file_bytes(doc_ids: list[int | None], ids: list[bytes], rank_of: np.ndarray, kind: str) -> bytes:
    width = np.dtype(kind).itemsize
    lengths = np.array([len(x) // width for x in ids], "<u4")
    control, data = pack(rank_of[np.frombuffer(b"".join(ids), kind)])
    head = MAGIC + np.array([len(ids), lengths.sum()], "<i8").tobytes()
    names = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    nulls = np.array([x is None for x in doc_ids], np.uint8).tobytes()
    return b"".join([head, names, nulls, lengths.tobytes(), control, data])


def file_documents(content: bytes, id_of: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, numbers of ids and all ids of a file."""
    if content[:8] != MAGIC:
        raise ValueError("not a file of ranked token ids")
    docs, n = np.frombuffer(content, "<i8", 2, 8).tolist()
    at = 24
    names = np.frombuffer(content, "<i8", docs, at).tolist()
    nulls = np.frombuffer(content, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(content, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    control = np.frombuffer(content, np.uint8, -(-n // 4), at)
    data = np.frombuffer(content, np.uint8, -1, at + len(control))
    ids = id_of[unpack(control, data, n)] if n else np.zeros(0, "<u4")
    return [None if z else x for x, z in zip(names, nulls)], lengths, ids


def write_files(ids: DataFrame, folder: str, id_of: np.ndarray, kind: str) -> DataFrame:
    """Write ``ids`` (doc_id, ids) in ascending doc_id order, null first; one row per file.

    Partitions are ranges of doc_id, and names sort as their contents do. Files are written under a
    name of the attempt and then moved, so a task that runs again leaves the same files.
    """
    rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 1, "<u4")
    rank_of[id_of] = np.arange(len(id_of))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, path = FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        width = np.dtype(kind).itemsize
        names: list[int | None] = []
        held: list[bytes] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, number
            name, draft = f"{path}/{part:08d}-{number:06d}.ids", f"{path}/_{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(file_bytes(names, held, rank_of, kind))
            store.move(draft, name)
            row = pa.RecordBatch.from_pylist([{"file": name, "n_docs": len(names), "n_ids": size}])
            names.clear(), held.clear()
            size, number = 0, number + 1
            return row

        store.create_dir(path, recursive=True)
        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = x.as_py()
                if held and size + len(body) // width > FILE_IDS:
                    yield flush()
                names.append(name)
                held.append(body)
                size += len(body) // width
        if held:
            yield flush()

    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    return ordered.mapInArrow(write, "file string, n_docs long, n_ids long")


def read_files(spark: SparkSession, folder: str, id_of: np.ndarray) -> DataFrame:
    """part, file, place (in the file), doc_id, before (ids of the file before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                names, lengths, ids = file_documents(content.as_py(), id_of)
                ends = np.cumsum(lengths, dtype=np.int64)
                body = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(body[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                label = file.rsplit("/", 1)[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([label[:8]] * len(names)),
                        pa.array([label] * len(names)),
                        pa.array(names, pa.int64()),
                        pa.array(ends - lengths),
                        pa.array(lengths.astype(np.int64)),
                        pa.array(crc, pa.int64()),
                    ],
                    ["part", "file", "doc_id", "before", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "content")
    schema = "part string, file string, doc_id long, before long, n_tokens long, ids_crc32 long"
    return files.mapInArrow(read, schema)


def token_files(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every row, from files written and read again.

    ``path`` names a tokenizer whose vocabulary drops white space. Null and empty texts have the end
    id alone. A null doc_id comes first; rows of one doc_id follow each other by their ids. An empty
    table writes no file and gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = id_type(path)
    ids = settle(encoded(docs, path, end_id, kind), "ids")
    id_of = frequency_ranks(ids, kind)
    folder = new_path(spark, "token-files")
    written = settle(write_files(ids, folder, id_of, kind), "written")
    if not written.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    documents = read_files(spark, folder, id_of)
    label = F.element_at(F.split("file", "/"), -1)
    files = written.select(label.alias("file"), F.substring(label, 1, 8).alias("part"), "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "file", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("file_start"))
    starts = settle(starts.join(parts, "part").select("file", (F.col("part_start") + F.col("file_start")).alias("at")), "starts")
    return documents.join(starts, "file").select(
        "doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
