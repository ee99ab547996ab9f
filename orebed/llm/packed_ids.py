"""Token-id files: fixed-width bit packing with block offsets.

Ids are stored in the fewest bits that hold the vocabulary, in blocks of
``BLOCK`` ids that begin at whole bytes; the offsets of the blocks and of the
documents stand in the file, so any document is read by fetching its blocks
only, and a block is unpacked by numpy at once.

A file is: the header (``HEADER``), the documents' ids (int64), their first id's
place (uint64, one more than documents), the blocks' byte offsets in the payload
(uint64, one more than blocks), which documents have no id (a byte each), the
payload.  Widths of 8, 16 and 32 bits (50,257 ids take 16) are whole bytes as
they are; other widths go through the same blocks, packed bit by bit.

Documents are range-partitioned and sorted by id (null first, equal ids by
text), encoded and written by the task that holds them; the files in the order
of their names hold the corpus in ascending order.  A task writes under a name
of its own and renames, so a repeated attempt replaces its files by equal ones.

Defined results: a null or empty text is the end id alone; repeated rows are
documents of their own; an empty table writes no file; further columns are not
read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stored import shards, shared_folder, written
from . import textarrays as T
from . import tokens

MAGIC = b"OREBITS2"
HEADER = struct.Struct("<8sIIQQQ")  # magic, bits, ids a block, documents, ids, blocks
BLOCK = 1 << 16
FILE_IDS = 1 << 24
#: Units of text that a worker remembers; it does little else that takes memory.
TABLE_UNITS = 600_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The n ids of a packed block, from the five bytes at most that each lies in."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    bit = np.arange(n, dtype=np.int64) * bits
    at, out = bit >> 3, np.zeros(n, np.uint64)
    for k in range((bits + 7) // 8 + 1):
        out |= raw[at + k].astype(np.uint64) << np.uint64(8 * k)
    return ((out >> (bit & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def file_bytes(doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """A file of documents: their ids, all their tokens behind each other and how many each has."""
    starts = np.zeros(len(sizes) + 1, "<u8")
    np.cumsum(sizes, out=starts[1:])
    packed = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.zeros(len(packed) + 1, "<u8")
    np.cumsum([len(p) for p in packed], out=offsets[1:])
    names = np.array([d or 0 for d in doc_ids], "<i8")
    none = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([HEADER.pack(MAGIC, bits, block, len(sizes), len(ids), len(packed)), names.tobytes(), starts.tobytes(), offsets.tobytes(), none.tobytes(), *packed])


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        where, path = fs.FileSystem.from_uri(uri)
        self.file = where.open_input_file(path)
        magic, self.bits, self.block, self.n_docs, self.n_ids, n_blocks = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token-id file")
        at, index = HEADER.size, []
        for kind, n in (("<i8", self.n_docs), ("<u8", self.n_docs + 1), ("<u8", n_blocks + 1)):
            index.append(np.frombuffer(self.file.read_at(8 * n, at), kind).astype(np.int64))
            at += 8 * n
        self.doc_ids, self.starts, self.offsets = index
        self.nameless = np.frombuffer(self.file.read_at(self.n_docs, at), np.uint8) > 0
        self.payload = at + self.n_docs

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start:end of the file; only the blocks that hold them are read."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        data = memoryview(self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), self.payload + int(self.offsets[first])))
        parts = []
        for b in range(first, last + 1):
            piece = data[self.offsets[b] - self.offsets[first] : self.offsets[b + 1] - self.offsets[first]]
            parts.append(unpack(piece, min(self.block, self.n_ids - b * self.block), self.bits))
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 0, file_ids: int = FILE_IDS, partitions: int | None = None) -> DataFrame:
    """Write the files under ``folder`` (a path or URI that all executors share); returns their manifest: file, uri, n_docs, n_ids."""
    spark = documents.sparkSession

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer, end_id, TABLE_UNITS)
        bits, (where, path) = bits_for(encoder.vocabulary), fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        part, k, held = TaskContext.get().partitionId(), 0, ([], [], [])

        def flush() -> pa.RecordBatch:
            ids, sizes = np.concatenate(held[1]), np.concatenate(held[2])
            name = f"ids-{part:06d}-{k:05d}.bits"
            own = f"{path}/.{name}.{uuid.uuid4().hex}"
            with where.open_output_stream(own) as out:
                out.write(file_bytes(held[0], ids, sizes, bits))
            where.move(own, f"{path}/{name}")
            return pa.RecordBatch.from_pylist([{"file": name, "uri": f"{folder}/{name}", "n_docs": len(sizes), "n_ids": len(ids)}])

        for rows, _, _ in T.chunks(batches, limit=min(1 << 19, 4 * file_ids)):
            ids, starts = encoder.encode(rows.column("text").to_pylist())
            held[0].extend(rows.column("doc_id").to_pylist())
            held[1].append(ids)
            held[2].append(np.diff(starts))
            if sum(map(len, held[1])) >= file_ids:
                yield flush()
                k, held = k + 1, ([], [], [])
        if held[0]:
            yield flush()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(partitions or shards(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(save, "file string, uri string, n_docs long, n_ids long"), "id-files")


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    The window that places the files behind each other runs over a row a file.
    """
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist()):
                reader = Reader(uri)
                ids = reader.ids(0, reader.n_ids).astype("<u4")
                data, at = memoryview(ids).cast("B"), (reader.starts * 4).tolist()
                sums = [zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.doc_ids, mask=reader.nameless), pa.array(reader.starts[:-1] + base), pa.array(np.diff(reader.starts)), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = placed.select("uri", "base").repartition(shards(manifest.sparkSession))
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_ids(documents: DataFrame, tokenizer: str, folder: str | None = None, **settings) -> DataFrame:
    """Write every document's ids and the end id, read the files back: doc_id, start, n_tokens, ids_crc32."""
    folder = folder or f"{shared_folder(documents.sparkSession)}/packed-ids-{uuid.uuid4().hex}"
    return read(write(documents, folder, tokenizer, **settings))
