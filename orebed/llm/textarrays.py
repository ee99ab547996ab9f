"""Whole texts of an Arrow batch as flat numpy arrays.

Every text operator reads its documents through :func:`chunks`, which cuts an
Arrow batch into runs of whole documents of a bounded number of bytes, so that
the work arrays of a task do not grow with the batch or the partition (one
document longer than the bound makes a chunk of its own).  Positions are byte
positions in the chunk's buffer; ``offsets[i]:offsets[i + 1]`` is document i.
A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

#: The separators of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if where and len(column) else np.zeros(1, np.int64)
    buffer = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return buffer, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, buffer, offsets) of runs of whole documents of about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buffer, offsets = flat(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), buffer[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
        del batch, buffer, offsets
        pa.default_memory_pool().release_unused()  # workers live on; what a batch took goes back


def document_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The document each position lies in (empty documents hold none)."""
    return np.searchsorted(offsets, starts, side="right") - 1


def per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a value per byte over each document."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def words(buffer: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word, in order; a table says which bytes separate words."""
    n = len(buffer)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separators[buffer]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut)) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut)) if n else np.zeros(0, np.int64)
    return starts, ends, document_of(starts, offsets)


def lines(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Start, end and document of every \n-split line that is not empty."""
    breaks = np.flatnonzero(buffer == 10)
    starts = np.union1d(offsets[:-1], breaks + 1)
    starts = starts[starts < len(buffer)]
    doc = document_of(starts, offsets)
    stop = np.append(breaks, len(buffer))[np.searchsorted(breaks, starts)] if len(starts) else starts
    ends = np.minimum(stop, offsets[1:][doc])
    full = ends > starts
    return starts[full], ends[full], doc[full]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(max(n, CHUNK_BYTES + 4096), base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(buffer: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2**64; the empty one first."""
    out = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(len(buffer))[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of the byte strings starts:ends, wherever they lie."""
    down = powers(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hashes."""
    return mix(a * np.uint64(0xE7037ED1A0B428DB) + mix(b + np.uint64(0x8EBC6AF09C88C6E3)))
