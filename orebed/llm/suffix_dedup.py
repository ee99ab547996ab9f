"""Suffix-array deduplication of passages across documents.

A byte of a document is removed if a string of ``length`` bytes covers it that
also starts in a document of a smaller id.  Sorting every suffix of the corpus
would move several times the corpus; so only suffixes that can matter are:

1. A string of ``length`` bytes holds ``length - GRAM + 1`` grams, of which the
   one of least hash (its minimiser) is the same wherever the string occurs.
   The minimisers of all texts are counted; one that only equal texts hold
   (equal texts are settled by their digest) cannot lie in a shared string.
2. Around each shared minimiser the suffixes that reach over it, cut to what a
   shared string can hold, go to the task of its hash.  There they are sorted by
   a merge sort that compares two suffixes by binary search over prefix
   polynomial hashes for their common extension.  Runs of a sufficient common
   extension, told apart by the bytes before, are the equal strings; each match
   is verified byte by byte against the document of least id.
3. The matched spans of a document are removed together.

A minimiser that very many documents hold, for the load of its task
(:func:`_hot_from`), is split: each string around it is keyed by its own hash; a
mark on the minimiser tells its documents so.  Equal suffixes of the chunks that a
task holds at once are settled there, and only the one of least id moves on.  So a
whole copy is settled by its digest, a passage repeated in those chunks by its hash
and bytes, and everything else by the suffix sort.  Hashes only propose: where the
bytes differ, the other candidates are compared.

A task sends its chunks together, so that the rows of a shuffle follow tasks times
buckets and not chunks times buckets, and what is sent stays worth compressing.

Defined results: a null or empty text has nothing removed; documents of equal
id do not remove from each other, and rows that are equal in id and text get the
same result; a null id is neither smaller nor larger than another, so such a
row is left whole; an empty table gives an empty one; further columns are not
read by :func:`repeats` and are kept by :func:`without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stored import removed, shards, written
from . import textarrays as T

LENGTH, GRAM = 50, 25
#: Documents from which on a minimiser is split, in a bucket of up to HOT_OF minimisers; more in a larger one.
HOT_LEAST, HOT_OF = 1000, 1 << 16
UNITS, SALTS = 1 << 15, 8
#: Bytes of text of a chunk.
CHUNK_BYTES = 2 << 20
#: What a task holds before it sends: bytes of text (the more, the more copies are settled before the shuffle), minimisers or suffixes.
HELD_BYTES, HELD = 16 << 20, 1 << 19
_LOW = np.uint64((1 << 40) - 1)
#: Marks a minimiser that very many documents hold.
_HOT = np.uint64(1 << 63)


# --- minimisers ---------------------------------------------------------------


def gram_hashes(buffer: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hashes of all grams, from differences of prefix hashes."""
    up, down = T.powers(len(buffer))
    prefix = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up, out=prefix[1:])
    out = prefix[gram:] - prefix[:-gram]
    out *= down[: len(out)]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def minimisers(buffer: np.ndarray, offsets: np.ndarray, length: int, gram: int, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, hash, first and last string of every minimiser: the strings of ``length`` bytes inside one document whose leftmost gram of least hash it is.

    Works block by block (with the bytes that the last strings reach into), so
    that the arrays stay in a core's cache.
    """
    n, window, out = len(buffer), length - gram + 1, []
    inside = np.zeros(n + 1, np.int32)  # starts of strings that lie in one document
    np.add.at(inside, offsets[:-1], 1)
    np.add.at(inside, np.maximum(offsets[1:] - length + 1, offsets[:-1]), -1)
    inside = np.cumsum(inside) > 0
    for begin in range(0, n - length + 1, block):
        end = min(begin + block, n - length + 1)  # strings begin:end
        hashes = gram_hashes(buffer[begin : end + length - 1], gram)
        least, reach = hashes, 1
        while 2 * reach <= window:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < window:
            least = np.minimum(least[: len(least) - (window - reach)], least[window - reach :])
        starts = np.flatnonzero(inside[begin:end])
        if not len(starts):
            continue
        wanted = least[starts]
        # Runs of strings of equal least hash share a minimiser as long as it lies in them.
        at, open_ = starts.copy(), np.arange(len(starts))
        new = np.ones(len(starts), bool)
        new[1:] = (wanted[1:] != wanted[:-1]) | (starts[1:] != starts[:-1] + 1)
        open_ = np.flatnonzero(new)
        head = open_
        while len(open_):
            missed = hashes[at[open_]] != wanted[open_]
            open_ = open_[missed]
            at[open_] += 1
        at = at[head][np.cumsum(new) - 1]
        while True:  # a string that begins after it takes the next gram of the same hash
            late = np.flatnonzero(at < starts)
            if not len(late):
                break
            at[late] = starts[late]
            while True:
                late = late[hashes[at[late]] != wanted[late]]
                if not len(late):
                    break
                at[late] += 1
        cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        last = np.append(cut[1:], len(at)) - 1
        out.append((at[cut] + begin, hashes[at[cut]], starts[cut] + begin, starts[last] + begin))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _short(hashes: np.ndarray) -> np.ndarray:
    """The low 40 bits as five bytes each."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _planes(values: np.ndarray) -> bytes:
    """Eight-byte integers, all their lowest bytes first: the high bytes, mostly alike, are worth compressing."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view("<i8")


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) of each key of an integer array."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(keys[part[0]]), part


# A bit of ``new`` says that a hash is the first of the next document of doc_ids and texts.
_CANDIDATES = "bucket int, direct boolean, hashes binary, new binary, counts binary, doc_ids binary, texts binary"


def _candidates(documents: DataFrame, n_buckets: int, length: int, gram: int) -> DataFrame:
    """Minimisers by bucket, packed: those of a chunk that stand alone in it, and of the others one each with its count; the others themselves pass (direct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, documents = [], 0, 0
        for rows, buffer, offsets in T.chunks(batches, limit=CHUNK_BYTES):
            ids, texts = (np.asarray(rows.column(rows.schema.get_field_index(c))) for c in ("doc_id", "th"))
            position, hashes, _, _ = minimisers(buffer, offsets, length, gram)
            doc = T.document_of(position, offsets)
            order = np.argsort(hashes, kind="stable")  # positions, so documents too, ascend
            hashes, doc = hashes[order], doc[order]
            kept = np.ones(len(hashes), bool)
            kept[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
            hashes, doc = hashes[kept], doc[kept]
            first = np.ones(len(hashes), bool)
            first[1:] = hashes[1:] != hashes[:-1]
            group = np.cumsum(first) - 1
            texts_of = texts[doc]
            apart = np.zeros(group[-1] + 1 if len(group) else 0, bool)  # several texts hold it
            apart[group[texts_of != texts_of[np.flatnonzero(first)][group]]] = True
            count = np.bincount(group, minlength=len(apart))
            sent, passed = np.flatnonzero(first | ~apart[group]), np.flatnonzero(apart[group])
            some = np.concatenate([sent, passed])
            direct = np.arange(len(some)) >= len(sent)
            counts = np.where(apart[group[some]] & ~direct, count[group[some]], 0).astype("<u4")
            held.append((hashes[some], doc[some] + documents, counts, direct, ids, texts.astype("<i8")))
            size, documents = size + len(some), documents + len(ids)
            if size >= HELD:
                yield _packed(held, n_buckets)
                held, size, documents = [], 0, 0
        if size:
            yield _packed(held, n_buckets)

    return documents.mapInArrow(run, _CANDIDATES)


def _packed(held: list[tuple], n_buckets: int) -> pa.RecordBatch:
    """A row a bucket, and one of those that pass: what the chunks hold of it."""
    hashes, doc, counts, direct, ids, texts = map(np.concatenate, zip(*held))
    out = []
    for key, part in _groups(2 * _bucket(hashes, n_buckets) + direct):
        part = part[np.argsort(doc[part], kind="stable")]
        new = np.ones(len(part), bool)
        new[1:] = doc[part][1:] != doc[part][:-1]
        names = doc[part][new]
        out.append({"bucket": key // 2, "direct": bool(key % 2), "hashes": _short(hashes[part]).tobytes(), "new": np.packbits(new).tobytes(), "counts": b"" if key % 2 else counts[part].tobytes(), "doc_ids": _planes(ids[names]), "texts": texts[names].tobytes()})
    return pa.RecordBatch.from_pylist(out, _schema(_CANDIDATES))


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in text.split(", "))])


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows of one bucket each, of batches sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = np.asarray(batch.column(batch.schema.get_field_index("bucket")))
        at = 0
        for cut in [*(np.flatnonzero(np.diff(key)) + 1), len(key)] if len(key) else []:
            if held and held[-1].column(held[-1].schema.get_field_index("bucket"))[0].as_py() != key[at]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, cut - at))
            at = cut
    if held:
        yield pa.Table.from_batches(held)


_SHARED = "bucket int, data binary"
# th, a hash of the text, tells rows of one id and equal texts apart.


def _by_bucket(records: np.ndarray, n_buckets: int) -> list[dict]:
    """Records (id, th, ...) packed by the bucket of their document."""
    return [{"bucket": b, "data": records[part].astype("<i8").tobytes()} for b, part in _groups(records[:, 0] % n_buckets)] if len(records) else []


def _by_document(packed: DataFrame, width: int, name: str) -> DataFrame:
    """A row a document: doc_id, th and its records' other columns, packed and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches):
            records = _joined(table.column("data"), "<i8").reshape(-1, width)
            records = records[np.lexsort((records[:, 2], records[:, 1], records[:, 0]))]
            cuts = np.concatenate([[0], np.flatnonzero((records[1:, :2] != records[:-1, :2]).any(1)) + 1, [len(records)]])
            first = cuts[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(records[first, 0]), pa.array(records[first, 1]), pa.array([records[a:b, 2:].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["doc_id", "th", name])

    rows = packed.repartition(shards(packed.sparkSession), "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, f"doc_id long, th long, {name} binary")


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _hot_from(minimisers: int, least: int, of: int) -> float:
    """Documents from which on a minimiser is too many for the task of a bucket of so many minimisers: a small part of it, and never more than are sorted at once."""
    return min(least * max(1, minimisers / of), UNITS)


def _shared(candidates: DataFrame, n_buckets: int) -> DataFrame:
    """Records (id, th, bucket and low bits) of documents' shared minimisers, packed by document; those that many documents hold are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches):
            bucket = np.uint64(table.column("bucket")[0].as_py()) << np.uint64(40)
            direct = table.column("direct").to_numpy()
            ids, texts, keys, counts, straight = [], [], [], [], []
            for row, passes in zip(table.to_pylist(), direct):
                keys.append(_long(row["hashes"]) | bucket)
                of = np.cumsum(np.unpackbits(np.frombuffer(row["new"], np.uint8), count=len(keys[-1]))) - 1
                ids.append(_unplaned(row["doc_ids"])[of])
                texts.append(np.frombuffer(row["texts"], "<i8")[of])
                counts.append(np.zeros(len(of), np.int64) if passes else np.frombuffer(row["counts"], "<u4").astype(np.int64))
                straight.append(np.full(len(of), passes))
            keys, ids, texts, counts, straight = map(np.concatenate, (keys, ids, texts, counts, straight))
            open_ = np.flatnonzero(~straight)
            order = open_[np.argsort(keys[open_], kind="stable")]
            first = np.ones(len(order), bool)
            first[1:] = keys[order][1:] != keys[order][:-1]
            group, begin = np.cumsum(first) - 1, np.flatnonzero(first)
            shared = np.zeros(len(begin), bool)
            shared[group[(counts[order] > 0) | (texts[order] != texts[order][begin][group])]] = True
            held = np.bincount(group, np.maximum(counts[order], 1), len(begin)).astype(np.int64) if len(order) else np.zeros(0, np.int64)
            report = np.concatenate([order[shared[group] & (counts[order] == 0)], np.flatnonzero(straight)]) if len(order) else np.flatnonzero(straight)
            often = np.isin(keys[report], keys[order[begin[held >= _hot_from(len(order), HOT_LEAST, HOT_OF)]]])
            marked = np.where(often, keys[report] | _HOT, keys[report])
            out = _by_bucket(np.column_stack([ids[report], texts[report], marked.view(np.int64)]), n_buckets)
            if out:
                yield pa.RecordBatch.from_pylist(out, _schema(_SHARED))

    dealt = candidates.repartition(shards(candidates.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, _SHARED)


# --- suffixes -----------------------------------------------------------------


class Suffixes:
    """Suffixes cut to ``length`` bytes and up to ``before`` bytes in front of each, as rows of prefix hashes."""

    def __init__(self, buffer: np.ndarray, begin: np.ndarray, at: np.ndarray, end: np.ndarray, length: int, before: int):
        self.buffer, self.at = buffer, at
        self.right, self.left = np.minimum(end - at, length), np.minimum(at - begin, before)
        up = T.powers(max(length, before) + 1)[0]
        reach = np.minimum(at[:, None] + np.arange(length), len(buffer) - 1)
        self.forward = self._sums(buffer[reach], up[:length])
        reach = np.maximum(at[:, None] - 1 - np.arange(before), 0)
        self.backward = self._sums(buffer[reach], up[:before])

    @staticmethod
    def _sums(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
        out = np.zeros((len(data), data.shape[1] + 1), np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, axis=1, out=out[:, 1:])
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of suffixes i and j, by binary search over their prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.right[i], self.right[j])
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            same = self.forward[i, middle] == self.forward[j, middle]
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)

    def above(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts after suffix j."""
        reach = self.common(i, j)
        i_ends, j_ends = reach >= self.right[i], reach >= self.right[j]
        last = len(self.buffer) - 1
        greater = self.buffer[np.minimum(self.at[i] + reach, last)] > self.buffer[np.minimum(self.at[j] + reach, last)]
        return np.where(i_ends | j_ends, j_ends & ~i_ends, greater)

    def sorted(self, cuts: np.ndarray) -> np.ndarray:
        """The suffixes of each group (cuts bound them) in order: a merge sort, all groups' merges of a width at once; each suffix finds its place in the sibling run by binary search."""
        size = np.diff(cuts)
        base, n = np.repeat(cuts[:-1], size), np.repeat(size, size)
        order, place, width = np.arange(cuts[-1]), np.arange(cuts[-1]), 1
        while (n > width).any():
            some = np.flatnonzero(n > width)
            inside = some - base[some]
            run = inside // width
            sibling = (run ^ 1) * width
            low = np.minimum(sibling, n[some])
            first, high = low.copy(), np.minimum(sibling + width, n[some])
            later = (run & 1) == 1  # its equals of the left run go first
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                own, other = order[some[open_]], order[base[some[open_]] + middle]
                passed = np.where(later[open_], ~self.above(other, own), self.above(own, other))
                low[open_] = np.where(passed, middle + 1, low[open_])
                high[open_] = np.where(passed, high[open_], middle)
            place[some] = base[some] + np.minimum(run, run ^ 1) * width + (inside - run * width) + (low - first)
            merged = order.copy()
            merged[place[some]] = order[some]
            order, width = merged, 2 * width
        return order


def matches(buffer: np.ndarray, begin: np.ndarray, at: np.ndarray, end: np.ndarray, keys: np.ndarray, docs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes (their indices) around which strings of ``length`` bytes also start in a document of smaller id and the same key: index, from, to (relative to ``at``)."""
    out = []
    order = np.argsort(keys, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys[order].view(np.int64))) + 1, [len(order)]])
    shared = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
    order = order[shared]
    cuts = np.concatenate([[0], np.cumsum(np.diff(cuts)[np.diff(cuts) > 1])])
    a = 0
    while a < len(cuts) - 1:  # runs of whole groups of about UNITS suffixes
        b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + UNITS, side="right")) - 1)
        out.append(_matches(buffer, begin, at, end, docs, order[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a], length, gram))
        a = b
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), (), ())))


def _matches(buffer, begin, at, end, docs, some, cuts, length, gram):
    before = length - gram
    s = Suffixes(buffer, begin[some], at[some], end[some], length, before)
    docs, order = docs[some], s.sorted(cuts)
    common = s.common(order[:-1], order[1:]) if len(order) > 1 else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    joined = group[1:] == group[:-1]
    most, least = np.full(len(some), -1), np.full(len(some), length)
    for a in range(before + 1):  # strings that start a bytes before the minimiser
        run = np.concatenate([[0], np.cumsum(~(joined & (common >= length - a)))]) if len(order) else order
        fits = (s.left[order] >= a) & (s.right[order] >= length - a)
        held, run = order[fits], run[fits]
        if len(held) < 2:
            continue
        name = T.pair_hashes(run.astype(np.uint64), s.backward[held, a])
        by = np.argsort(name)
        held, name = held[by], name[by]
        first = np.ones(len(held), bool)
        first[1:] = name[1:] != name[:-1]
        begins, group_of = np.flatnonzero(first), np.cumsum(first) - 1
        smallest = np.minimum.reduceat(docs[held], begins)[group_of]
        owners = np.empty(len(begins), np.int64)
        smallest_at = np.flatnonzero(docs[held] == smallest)
        owners[group_of[smallest_at]] = held[smallest_at]
        repeated = np.flatnonzero(docs[held] > smallest)
        one, two = held[repeated], owners[group_of[repeated]]
        span = np.arange(length) - a
        for k in range(0, len(one), UNITS):  # verify the bytes
            x, y = one[k : k + UNITS], two[k : k + UNITS]
            same = (buffer[s.at[x][:, None] + span] == buffer[s.at[y][:, None] + span]).all(1)
            if not same.all():
                group = group_of[repeated[k : k + UNITS]]
                for n in np.flatnonzero(~same):  # equal hashes, other bytes: the others of that hash
                    others = held[(group_of == group[n]) & (docs[held] < docs[x[n]])]
                    same[n] = (buffer[s.at[others][:, None] + span] == buffer[s.at[x[n]] + span]).all(1).any()
                x = x[same]
            most[x], least[x] = np.maximum(most[x], a), np.minimum(least[x], a)
    found = np.flatnonzero(most >= 0)
    return some[found], -most[found], length - least[found]


_UNITS = "bucket int, direct boolean, key binary, doc_id binary, th binary, place binary, left binary, size binary, data binary"
_SPANS = "bucket int, data binary"


def _packed_spans(docs: np.ndarray, texts: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.lexsort((start, texts, docs))
    if len(order):
        for part in np.split(order, np.flatnonzero((np.diff(docs[order]) != 0) | (np.diff(texts[order]) != 0)) + 1):
            yield int(docs[part[0]]), int(texts[part[0]]), np.column_stack(_merged(start[part], stop[part])).astype("<i8").tobytes()


def _merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans that cover the same; start is sorted."""
    reach = np.maximum.accumulate(stop)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return start[new], reach[last]


def _units(rows: DataFrame, n_buckets: int, length: int, gram: int) -> DataFrame:
    """The suffixes around shared minimisers, by bucket of their key; equal ones of the chunks held are settled here but for that of least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count = [], 0, 0
        for part, buffer, offsets in T.chunks(_with_text(batches), limit=CHUNK_BYTES):
            ids, texts = (np.asarray(part.column(part.schema.get_field_index(c))) for c in ("id", "th"))
            prefix = T.prefix_hashes(buffer)
            position, hashes, begin, end = minimisers(buffer, offsets, length, gram)
            end += length
            doc = T.document_of(position, offsets)
            short = _bucket(hashes, n_buckets).astype(np.uint64) << np.uint64(40) | hashes & _LOW
            replies = [np.frombuffer(keys, "<u8") for keys in part.column(part.schema.get_field_index("keys")).to_pylist()]
            answer = np.concatenate(replies)
            hot = np.unique(answer[answer >= _HOT]) ^ _HOT
            wanted = T.pair_hashes(answer & ~_HOT, np.repeat(np.arange(len(replies)), list(map(len, replies))).astype(np.uint64))
            some = np.flatnonzero(np.isin(T.pair_hashes(short, doc.astype(np.uint64)), wanted))
            position, hashes, begin, end, doc, short = (x[some] for x in (position, hashes, begin, end, doc, short))
            often = np.isin(short, hot)
            if often.any():  # each string around it for itself
                first, strings_of = begin[often], end[often] - length - begin[often] + 1
                start = np.repeat(first, strings_of) + np.arange(strings_of.sum()) - np.repeat(np.cumsum(strings_of) - strings_of, strings_of)
                of = np.repeat(doc[often], strings_of)
                strings = T.mix(T.span_hashes(prefix, start, start + length) + np.uint64(1))
                position, begin, end = (np.concatenate([x[~often], y]) for x, y in ((position, start), (begin, start), (end, start + length)))
                hashes, doc = np.concatenate([hashes[~often], strings]), np.concatenate([doc[~often], of])
            whole = T.pair_hashes(T.span_hashes(prefix, begin, end), T.pair_hashes(hashes, (position - begin).astype(np.uint64)))
            held.append((buffer.copy(), begin + size, end + size, hashes, whole, ids[doc], texts[doc], position - offsets[doc], position - begin))
            size, count = size + len(buffer), count + len(begin)
            if size >= HELD_BYTES or count >= HELD:
                yield from _settled(held, n_buckets, length, gram)
                held, size, count = [], 0, 0
        if held:
            yield from _settled(held, n_buckets, length, gram)

    return rows.select("id", "th", "row", "keys").mapInArrow(run, _UNITS)


def _settled(held: list[tuple], n_buckets: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The suffixes of the chunks held: a row of spans for each document of which some are settled, and a row a bucket of those that move on."""
    buffer, begin, end, hashes, whole, ids, texts, place, left = map(np.concatenate, zip(*held))
    order = np.lexsort((ids, whole))
    first = np.ones(len(order), bool)
    first[1:] = whole[order][1:] != whole[order][:-1]
    owner = order[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(order) else order
    settled = np.zeros(len(order), bool)
    settled[order] = ids[order] > ids[owner]
    owners = np.zeros(len(order), np.int64)
    owners[order] = owner
    size, reach, last = end - begin, np.arange(2 * length - gram), len(buffer) - 1
    at = np.flatnonzero(settled)
    for k in range(0, len(at), UNITS):  # verify the bytes
        x = at[k : k + UNITS]
        y = owners[x]
        same = (buffer[np.minimum(begin[x][:, None] + reach, last)] == buffer[np.minimum(begin[y][:, None] + reach, last)]) | (reach >= size[x][:, None])
        settled[x[~same.all(1) | (size[x] != size[y])]] = False  # equal hashes, other bytes: it moves on
    at, rest, out = np.flatnonzero(settled), np.flatnonzero(~settled), []
    empty = {c: b"" for c in ("key", "place", "left", "size", "data")}
    from_ = place - left
    for d, t, spans in _packed_spans(ids[at], texts[at], from_[at], (from_ + size)[at]):
        out.append({"bucket": int(d % n_buckets), "direct": True, **empty, "doc_id": np.int64(d).tobytes(), "th": np.int64(t).tobytes(), "data": spans})
    squeeze = zstandard.ZstdCompressor(level=1)
    for b, some in _groups(_bucket(hashes[rest], n_buckets)):
        some = rest[some]
        where = np.repeat(begin[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(size[some].sum())
        out.append({"bucket": b, "direct": False, "key": _short(hashes[some]).tobytes(), "doc_id": _planes(ids[some]), "th": texts[some].astype("<i8").tobytes(), "place": _planes(place[some]), "left": left[some].astype(np.uint8).tobytes(), "size": size[some].astype(np.uint8).tobytes(), "data": squeeze.compress(buffer[where].tobytes())})
    if out:
        yield pa.RecordBatch.from_pylist(out, _schema(_UNITS))


def _spans(units: DataFrame, n_buckets: int, length: int, gram: int) -> DataFrame:
    """Records (id, th, from, to) of spans that also start in a document of smaller id, packed by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches):
            direct = table.column("direct").to_numpy()
            out = []
            passed, rest = table.filter(pa.array(direct)), table.filter(pa.array(~direct))
            if len(passed):
                own = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in passed.column("data").to_pylist()]
                who = np.column_stack([_joined(passed.column("doc_id"), "<i8"), _joined(passed.column("th"), "<i8")])
                out.append(np.column_stack([np.repeat(who, list(map(len, own)), axis=0), np.concatenate(own)]))
            if len(rest):
                texts, left, size = (_joined(rest.column(c), k) for c, k in (("th", "<i8"), ("left", "u1"), ("size", "u1")))
                docs, place = (np.concatenate(list(map(_unplaned, rest.column(c).to_pylist()))) for c in ("doc_id", "place"))
                keys = _long(b"".join(rest.column("key").to_pylist()))  # grams that only share these bits are told apart by the sort
                data = np.frombuffer(b"".join(map(zstandard.ZstdDecompressor().decompress, rest.column("data").to_pylist())), np.uint8)
                end = np.cumsum(size.astype(np.int64))
                begin = end - size
                which, low, high = matches(data, begin, begin + left, end, keys, docs, length, gram)
                spans = list(_packed_spans(docs[which], texts[which].astype(np.int64), place[which] + low, place[which] + high))
                for d, t, x in spans:
                    pairs = np.frombuffer(x, "<i8").reshape(-1, 2)
                    out.append(np.column_stack([np.full(len(pairs), d), np.full(len(pairs), t), pairs]))
            if out:
                yield pa.RecordBatch.from_pylist(_by_bucket(np.concatenate(out), n_buckets), _schema(_SPANS))

    dealt = units.repartition(shards(units.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, _SPANS)


# --- documents ----------------------------------------------------------------


def marked(documents: DataFrame, columns: tuple[str, ...] = (), length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Of every document: row (a struct of doc_id, text and ``columns``), copy (its whole text stands in a document of smaller id) and spans (packed, of what is repeated)."""
    spark = documents.sparkSession
    n = shards(spark)
    keep = tuple(dict.fromkeys(("doc_id", "text", *columns)))
    rows = documents.select(F.struct(*keep).alias("row"), F.xxhash64("text").alias("th"), F.col("doc_id").cast("long").alias("id"))
    named = rows.where("id is not null")
    slim = named.select(F.col("id").alias("doc_id"), "th", F.col("row.text").alias("text"))

    digests = slim.select("doc_id", "th", F.sha2(F.col("text"), 256).alias("digest")).where(F.octet_length("text") >= length)
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Copies of one text are dealt to several tasks; its least id goes to each.
    salted = digests.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = written(salted.join(firsts, ["digest", "salt"]).where("doc_id > least").select("doc_id", "th").distinct(), "copies", tidy=True)

    # Each step is written, and what it shuffled goes before the texts are shuffled.
    shared = written(_shared(_candidates(slim, n, length, gram), n), "shared", tidy=True)
    replies = written(_by_document(shared, 3, "keys").join(copies, ["doc_id", "th"], "left_anti"), "replies", tidy=True)
    removed(shared)

    # Both joins read the same columns of the same partitioning, so that the texts are shuffled once.
    whole = named.select("id", "th", "row").repartition(n, "id", "th")
    asked = whole.join(replies.withColumnRenamed("doc_id", "id"), ["id", "th"])
    spans = _by_document(_spans(_units(asked, n, length, gram), n, length, gram), 4, "spans")
    marked_copies = copies.select(F.col("doc_id").alias("id"), "th", F.lit(True).alias("copy"))
    named = whole.join(spans.withColumnRenamed("doc_id", "id"), ["id", "th"], "left").join(marked_copies, ["id", "th"], "left")
    alone = rows.where("id is null").withColumns({"spans": F.lit(None).cast("binary"), "copy": F.lit(False)})
    return named.select("row", "spans", F.coalesce("copy", F.lit(False)).alias("copy")).unionByName(alone.select("row", "spans", "copy"))


def _with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with row.text as a column of its own."""
    for batch in batches:
        yield batch.append_column("text", batch.column(batch.schema.get_field_index("row")).field("text"))


def _kept(data: bytes, copy: bool, spans: bytes | None) -> tuple[np.ndarray, int]:
    """Which bytes stay, and the number of removed runs."""
    if copy:
        return np.zeros(len(data), bool), int(len(data) > 0)
    if not spans:
        return np.ones(len(data), bool), 0
    at = np.frombuffer(spans, "<i8").reshape(-1, 2)
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, at[:, 0], 1)
    np.add.at(change, at[:, 1], -1)
    gone = np.cumsum(change)[:-1] > 0
    return ~gone, int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def repeats(documents: DataFrame, **settings) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buffer, offsets in T.chunks(_with_text(batches)):
            out = []
            copies, spans = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("copy", "spans"))
            for a, b, copy, some in zip(offsets[:-1], offsets[1:], copies, spans):
                kept, n_spans = _kept(buffer[a:b], copy, some)
                left = buffer[a:b][kept]
                out.append((int(b - a), int(b - a - len(left)), n_spans, hashlib.sha256(left.tobytes()).hexdigest()))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("row")).field("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return marked(documents, **settings).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(documents: DataFrame, **settings) -> DataFrame:
    """The documents without what is repeated, and without those of which nothing is left; characters cut at their edge go whole, n_chars follows."""
    columns = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buffer, offsets in T.chunks(_with_text(batches)):
            row = rows.column(rows.schema.get_field_index("row"))
            out = {c: row.field(c) for c in columns}
            copies, spans, texts = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("copy", "spans", "text"))
            stays = np.ones(rows.num_rows, bool)
            for i, (copy, some) in enumerate(zip(copies, spans)):
                if copy or some:
                    data = buffer[offsets[i] : offsets[i + 1]]
                    texts[i] = data[_kept(data, copy, some)[0]].tobytes().decode(errors="ignore")
                    stays[i] = bool(texts[i].strip())
            lengths = out["n_chars"].to_pylist() if "n_chars" in out else []
            out["text"] = pa.array(texts, out["text"].type)
            if lengths:
                out["n_chars"] = pa.array([len(t) if c or s else n for n, t, c, s in zip(lengths, texts, copies, spans)], out["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out)).filter(pa.array(stays))

    schema = ", ".join(f"`{c}` {t}" for c, t in documents.dtypes)
    return marked(documents, tuple(columns), **settings).mapInArrow(run, schema)


SQL = """
WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS bytes FROM documents),
starts AS (
  SELECT doc_id, k, min(doc_id) OVER (PARTITION BY string) AS least
  FROM (SELECT doc_id, k, array_slice(bytes, k + 1, k + 50) AS string
        FROM (SELECT doc_id, bytes, unnest(range(octet_length(bytes) - 49)) AS k FROM texts WHERE octet_length(bytes) >= 50))),
opened AS (
  SELECT doc_id, k, coalesce(k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50, true) AS opens
  FROM starts WHERE least < doc_id),
runs AS (
  SELECT doc_id, min(k) AS a, max(k) + 50 AS b
  FROM (SELECT doc_id, k, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM opened)
  GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b, b - a AS removed, 1 AS run FROM runs
  UNION ALL
  SELECT doc_id, coalesce(max(b), 0), octet_length(any_value(bytes)), 0, 0 FROM texts LEFT JOIN runs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(any_value(bytes))::BIGINT AS n_bytes, sum(removed)::BIGINT AS n_removed, sum(run)::BIGINT AS n_spans,
       sha256(unhex(coalesce(string_agg(substr(hex(bytes), 2 * p.a + 1, 2 * (p.b - p.a)), '' ORDER BY p.a), ''))) AS kept_sha256
FROM pieces p JOIN texts USING (doc_id) GROUP BY doc_id
"""
