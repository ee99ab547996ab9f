"""Language-model scoring with a log-frequency Bloom filter.

Counting: a chunk of documents sends each bucket its distinct words, and the word
pairs of its training texts, with how often those hold them; there the exact
totals are taken.  A filter then holds, for each n-gram of total c, the entries
(n-gram, 1) to (n-gram, level(c)) with level(c) = 1 + floor(log_STEP c); a count is
found again, but for the step, by probing levels until one is missing.  The filter
is made where its n-grams meet, a segment a bucket, of ``BITS_PER_ENTRY`` bits for
each entry, and written as a table: it grows with the training texts.  The chunks
are written too; the exact counts of their words serve the add-one score alone.

Probing: the levels that make the model's score come from the filter alone; besides
them it reads the number of distinct words and the sum of their levels' counts.  The
filter's size is measured; up to ``broadcast_bytes`` it is broadcast and each chunk
probes it in place.  A greater one stays in its segments: each chunk sends a segment the n-grams that may be in it
and gets their levels back.  Both ways give the same levels.

The model mixes pair, word and uniform probabilities with weights fitted by
leave-one-out expectation maximisation over all whole training texts, copies
among them, as texts to be scored have copies there too: a token's
three probabilities depend on three levels only, so the steps run on the number
of tokens of each such triple, a table bounded by the levels and not by the
texts.  Word shares are of the sum of what the levels of all words stand for, so
they add up to 1 but for false positives; pair shares are of what the level of
the word before stands for, so their sum over the words after it is near 1 only.

Besides the model's score there is the exact add-one score of single words.

Words are told apart by 64-bit hashes (48 bits and the bucket).  Defined
results: a null or empty text is the end token alone; equal rows get equal rows;
a null id is scored and learnt from; an empty table gives an empty one; further
columns are not read.  With nothing to train on all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stored import removed, shards, written
from . import textarrays as T
from .common import crc32_sql
from .suffix_dedup import _groups, whole_buckets

END = np.uint64(0x5851F42D4C957F2D)
STEP, BITS_PER_ENTRY, PROBES = 1.5, 12, 6
_KEY = np.uint64((1 << 48) - 1)
#: Bytes of a key: words are counted exactly; pairs of equal bucket and 40 bits are far rarer than the filter's false positives.
WIDTH = {"word": 6, "pair": 5}
#: Bytes of text of a chunk: the more, the fewer n-grams are sent twice.
CHUNK_BYTES = 4 << 20
#: A filter of so many bytes at most is broadcast.
BROADCAST_BYTES = 128 << 20


def tokens_of(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every token: each document's lower-cased words, then one end."""
    buffer = T.LOWER[buffer]
    starts, ends, doc = T.words(buffer, offsets)
    n = len(offsets) - 1
    hashes = np.full(len(starts) + n, END)
    docs = np.empty(len(hashes), np.int64)
    at = np.arange(len(starts)) + doc
    hashes[at] = T.span_hashes(T.prefix_hashes(buffer), starts, ends)
    docs[at] = doc
    docs[np.cumsum(np.bincount(doc, minlength=n)) + np.arange(n)] = np.arange(n)
    return hashes, docs


def pairs_of(hashes: np.ndarray) -> np.ndarray:
    """Each token with the one before it; a document's first follows an end."""
    return T.pair_hashes(np.concatenate([[END], hashes[:-1]]), hashes)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


# --- the filter ---------------------------------------------------------------


def level(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(n) / np.log(STEP) + 1e-9).astype(np.int64)


def count_at(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of those it holds; 1 is exact."""
    low = STEP ** np.maximum(levels - 1.0, 0)
    return np.where(levels <= 1, np.minimum(levels, 1), (np.ceil(low - 1e-9) + np.maximum(np.ceil(low), np.ceil(low * STEP - 1e-9) - 1)) / 2)


def _bits(keys: np.ndarray, j: int, probe: int, size: int | np.ndarray) -> np.ndarray:
    """The place in its segment of probe ``probe`` for entry (key, j)."""
    entry = T.mix(keys * np.uint64(0x9FB21C651E98DF25) + np.uint64(j))
    return ((entry + np.uint64(probe) * (T.mix(entry) | np.uint64(1))) % np.asarray(size, np.uint64)).astype(np.int64)


class Filter:
    """Segments, one a bucket, end to end; ``size`` is the bits of each, or one number if they are alike."""

    def __init__(self, data: np.ndarray, size: int | np.ndarray, n_buckets: int):
        self.data, self.size, self.n_buckets = data, size, n_buckets
        self.sizes = np.broadcast_to(np.asarray(size, np.uint64), n_buckets)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int64) // 8

    def levels(self, hashes: np.ndarray, buckets: np.ndarray | None = None) -> np.ndarray:
        """The highest level each n-gram is found up to, by repeated membership probes; ``buckets`` are given where the hashes are narrowed."""
        out = np.zeros(len(hashes), np.int64)
        buckets = bucket_of(hashes, self.n_buckets) if buckets is None else buckets
        keys, active, j = hashes & _KEY, np.arange(len(hashes)), 0
        while len(active):
            j += 1
            for probe in range(PROBES):
                of = buckets[active]
                at = _bits(keys[active], j, probe, self.sizes[of])
                active = active[(self.data[self.starts[of] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0]
            out[active] = j
        return out


def size_for(entries: int) -> int:
    """Bits of a segment: at most half of them get set, as an entry sets PROBES."""
    return max(64, -(-entries * BITS_PER_ENTRY // 8) * 8)


def segment(words: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], size: int) -> bytes:
    bits = np.zeros(size, bool)
    for keys, n in (words, pairs):
        high, j = level(n) if len(n) else n, 1
        while (high >= j).any():
            for probe in range(PROBES):
                bits[_bits(keys[high >= j], j, probe, size)] = True
            j += 1
    return np.packbits(bits, bitorder="little").tobytes()


# --- scores -------------------------------------------------------------------

_CHUNK = "chunk long, docs binary, state binary"
_REQUEST = "bucket int, chunk long, n_words int, n_pairs int, words binary, pairs binary, counts binary"
_REPLY = "bucket long, source int, part binary, counts binary"
_COUNTED = "bucket int, chunk long, docs binary, segment binary, tokens long, kinds long, mass double"
_LEVELS = "chunk long, docs binary, own binary, pair binary"
_DOC = np.dtype([("id", "<i8"), ("none", "?"), ("scored", "?"), ("learnt", "?"), ("tokens", "<i8"), ("known", "<i8"), ("base", "<f8")])
_ROW = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Small integers packed: byte planes, of which the upper ones are zeros."""
    wide = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize)
    return pa.compress(wide.T.tobytes(), "zstd", asbytes=True)


def _from_planes(data: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = pa.decompress(data, n * width, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(width, -1).T).view(kind)[:, 0].astype(np.int64) if n else np.zeros(0, np.int64)


def _narrow(hashes: np.ndarray, kind: str) -> np.ndarray:
    return hashes & np.uint64((1 << 8 * WIDTH[kind]) - 1)


def _pairs(names: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's distinct pairs and the pair of each token."""
    tokens = tokens.astype(np.int64)
    end = tokens[-1:]  # every document ends with an end token
    codes, pair = np.unique(np.concatenate([end, tokens[:-1]]) * len(names) + tokens, return_inverse=True)
    return T.pair_hashes(names[codes // len(names)], names[codes % len(names)]), pair


def _asked(words: np.ndarray, pairs: np.ndarray, n_buckets: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """By bucket the places of its words and of its pairs, each in the order of their keys."""
    groups = []
    for b, at in _groups(bucket_of(np.concatenate([words, pairs]), n_buckets)):
        w, p = np.split(at, [np.searchsorted(at, len(words))])
        groups.append((b, w[np.argsort(_narrow(words[w], "word"))], (p := p - len(words))[np.argsort(_narrow(pairs[p], "pair"))]))
    return groups


def _message(bucket: int, chunk: int, words: np.ndarray, pairs: np.ndarray) -> dict:
    """Hashes of one bucket, each kind in the order of its keys, as packed differences."""
    steps = {f"{kind}s": _planes(np.diff(_narrow(hashes, kind), prepend=np.uint64(0)), "<u8") for kind, hashes in (("word", words), ("pair", pairs))}
    return {"bucket": bucket, "chunk": chunk, "n_words": len(words), "n_pairs": len(pairs), **steps}


def _keys(steps: bytes, n: int) -> np.ndarray:
    return np.cumsum(_from_planes(steps, n, "<u8")).astype(np.uint64)


def _packed_tokens(names: np.ndarray, tokens: np.ndarray) -> bytes:
    """A chunk's words and the word of each token."""
    state = b"".join((np.array([len(names), len(tokens)], "<i8").tobytes(), names.astype("<u8").tobytes(), tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()))
    return len(state).to_bytes(8, "little") + pa.compress(state, "zstd", asbytes=True)


def _tokens(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    state = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    n_names, n_tokens = np.frombuffer(state, "<i8", 2).tolist()
    names = np.frombuffer(state, "<u8", n_names, 16)
    return names, np.ascontiguousarray(np.frombuffer(state, np.uint8, 4 * n_tokens, 16 + names.nbytes).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


def totals(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often they occur in all, and the place of each given key among them."""
    distinct, back = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(back, n, len(distinct)).astype(np.int64), back


def made_filter(words: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray]) -> Filter:
    """The segment of words and pairs with their totals, sized by its entries; what never occurs is not held."""
    held = [(keys[n > 0], n[n > 0]) for keys, n in (words, pairs)]
    size = size_for(sum(int(level(n).sum()) for _, n in held if len(n)))
    return Filter(np.frombuffer(segment(*held, size), np.uint8), size, 1)


def _by_bucket(rows: DataFrame, n_buckets: int) -> DataFrame:
    return rows.repartition(n_buckets, "bucket").sortWithinPartitions("bucket")


def _batch(rows: list[dict], like: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(c, kinds[t]) for c, t in (x.split() for x in like.split(", "))]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: each holds a chunk, so no more than one is copied at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _token_levels(chunk: int, docs: bytes, own: np.ndarray, pair: np.ndarray) -> pa.RecordBatch:
    return _batch([{"chunk": chunk, "docs": docs, "own": pa.compress(own.tobytes(), "zstd", asbytes=True), "pair": pa.compress(pair.tobytes(), "zstd", asbytes=True)}], _LEVELS)


def counted(rows: DataFrame, n_buckets: int, words_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two written tables: chunks of documents and their tokens; the chunks' documents with the exact counts of their words, and the filter's segments with their training tokens, distinct words and mass.  Rows are doc_id, text, scored, learnt.  With ``words_only`` no pair is counted and the segments are empty.

    The chunks are written before they ask, so that a task that runs again, with its rows
    in another order perhaps, changes no chunk that others have seen.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for part, buffer, offsets in T.chunks(batches, limit=CHUNK_BYTES):
            column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: E731, B023
            hashes, doc = tokens_of(buffer, offsets)
            names, tokens, n = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # places of frequent words are small and pack well
            names, tokens = names[order], np.argsort(order)[tokens]
            docs = np.zeros(len(offsets) - 1, _DOC)
            docs["id"], docs["none"] = column("doc_id").fill_null(0).to_numpy(), column("doc_id").is_null().to_numpy(zero_copy_only=False)
            docs["scored"], docs["learnt"] = (column(c).to_numpy(zero_copy_only=False) for c in ("scored", "learnt"))
            docs["tokens"] = np.bincount(doc, minlength=len(docs))
            yield _batch([{"chunk": chunk, "docs": docs.tobytes(), "state": _packed_tokens(names, tokens)}], _CHUNK)
            chunk += 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            names, tokens = _tokens(row["state"])
            docs = np.frombuffer(row["docs"], _DOC)
            learnt = np.repeat(docs["learnt"], docs["tokens"])
            pairs, pair = (np.zeros(0, np.uint64), np.zeros(0, np.int64)) if words_only else _pairs(names, tokens)
            word_n, pair_n = np.bincount(tokens[learnt], minlength=len(names)), np.zeros(0, np.int64) if words_only else np.bincount(pair[learnt], minlength=len(pairs))
            pairs, pair_n = pairs[pair_n > 0], pair_n[pair_n > 0]
            yield _batch([_message(b, row["chunk"], names[w], pairs[p]) | {"counts": _planes(np.concatenate([word_n[w], pair_n[p]]), "<u4")} for b, w, p in _asked(names, pairs, n_buckets)], _REQUEST)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked in whole_buckets(batches):
            bucket, column = asked.column("bucket")[0].as_py(), lambda c: asked.column(c).to_pylist()  # noqa: B023, E731
            chunks, n_words, n_pairs, word_steps, pair_steps, counts = map(column, ("chunk", "n_words", "n_pairs", "words", "pairs", "counts"))
            words, pairs, word_n, pair_n = [], [], [], []
            for i in range(len(chunks)):
                words.append(_keys(word_steps[i], n_words[i]))
                pairs.append(_keys(pair_steps[i], n_pairs[i]))
                n = _from_planes(counts[i], n_words[i] + n_pairs[i], "<u4")
                word_n.append(n[: n_words[i]])
                pair_n.append(n[n_words[i] :])
            del word_steps, pair_steps, counts
            word_key, word_total, word_at = totals(np.concatenate(words), np.concatenate(word_n))
            pair_key, pair_total, _ = totals(np.concatenate(pairs), np.concatenate(pair_n))
            some = word_total > 0
            stats = np.array([word_total.sum(), some.sum(), count_at(level(word_total[some])).sum() if some.any() else 0.0], "<f8")
            held = b"" if words_only else made_filter((word_key, word_total), (pair_key, pair_total)).data.tobytes()
            yield _batch([{"bucket": -1 - bucket, "source": bucket, "part": held, "counts": stats.tobytes()}], _REPLY)
            a = 0
            for chunk, w in zip(chunks, words):
                if len(w):
                    yield _batch([{"bucket": chunk, "source": bucket, "counts": _planes(word_total[word_at[a : a + len(w)]], "<u8")}], _REPLY)
                a += len(w)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table_ in whole_buckets(batches):
            chunk, replies = table_.column("bucket")[0].as_py(), {r["source"]: r for r in table_.to_pylist()}
            if chunk < 0:
                (bucket, r), = replies.items()
                tokens, kinds, mass = np.frombuffer(r["counts"], "<f8")
                yield _batch([{"bucket": bucket, "segment": r["part"], "tokens": int(tokens), "kinds": int(kinds), "mass": mass}], _COUNTED)
                continue
            names, tokens = _tokens(replies[-1]["part"])
            docs = np.frombuffer(replies[-1]["counts"], _DOC).copy()
            known = np.zeros(len(names), np.int64)
            for b, words, _ in _asked(names, np.zeros(0, np.uint64), n_buckets):
                known[words] = _from_planes(replies[b]["counts"], len(words), "<u8")
            doc = np.repeat(np.arange(len(docs)), docs["tokens"])
            docs["known"] = np.bincount(doc[known[tokens] > 0], minlength=len(docs))
            docs["base"] = np.bincount(doc, np.log10(known + 1.0)[tokens], len(docs))
            yield _batch([{"chunk": chunk, "docs": docs.tobytes()}], _COUNTED)

    chunks = written(rows.mapInArrow(cut, _CHUNK), "chunks")
    replies = _by_bucket(chunks.mapInArrow(ask, _REQUEST), n_buckets).mapInArrow(answer, _REPLY)
    states = chunks.select(F.col("chunk").alias("bucket"), F.lit(-1).alias("source"), F.col("state").alias("part"), F.col("docs").alias("counts"))
    return chunks, written(_by_bucket(replies.unionByName(states), n_buckets).mapInArrow(gather, _COUNTED), "counted")


def _probed(chunks: DataFrame, segments: DataFrame, n_buckets: int) -> DataFrame:
    """The levels of every token's word and pair by chunk, from a broadcast filter; its size is to be checked before."""
    sizes = np.full(n_buckets, 8, np.int64)
    for bucket, n in segments.select("bucket", F.length("segment")).collect():
        sizes[bucket] = n
    starts, data = np.cumsum(sizes) - sizes, np.zeros(sizes.sum(), np.uint8)
    for bucket, part in segments.select("bucket", "segment").toLocalIterator():
        data[starts[bucket] : starts[bucket] + sizes[bucket]] = np.frombuffer(part, np.uint8)
    shared = chunks.sparkSession.sparkContext.broadcast((data, 8 * sizes.astype(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Filter(*shared.value, n_buckets)
        for row in _rows(batches):
            names, tokens = _tokens(row["state"])
            pairs, pair = _pairs(names, tokens)
            own, two = (filter_.levels(_narrow(h, kind), bucket_of(h, n_buckets)).astype(np.uint8) for h, kind in ((names, "word"), (pairs, "pair")))
            yield _token_levels(row["chunk"], row["docs"], own[tokens], two[pair])

    return chunks.mapInArrow(run, _LEVELS)


def _probed_by_segment(chunks: DataFrame, segments: DataFrame, n_buckets: int) -> DataFrame:
    """As :func:`_probed`, the n-grams sent to the segments of the filter that may hold them."""
    question = "bucket int, chunk long, n_words int, n_pairs int, words binary, pairs binary, segment binary"
    reply = "bucket long, source int, levels binary, docs binary, state binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            names, tokens = _tokens(row["state"])
            pairs, _ = _pairs(names, tokens)
            yield _batch([_message(b, row["chunk"], names[w], pairs[p]) for b, w, p in _asked(names, pairs, n_buckets)], question)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked in whole_buckets(batches):
            rows = asked.to_pylist()
            data = np.frombuffer(next((r["segment"] for r in rows if r["segment"] is not None), bytes(8)), np.uint8)
            filter_ = Filter(data, 8 * len(data), 1)
            for r in rows:
                if r["segment"] is None:
                    levels = filter_.levels(np.concatenate([_keys(r["words"], r["n_words"]), _keys(r["pairs"], r["n_pairs"])]))
                    yield _batch([{"bucket": r["chunk"], "source": r["bucket"], "levels": pa.compress(levels.astype(np.uint8).tobytes(), "zstd", asbytes=True)}], reply)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table_ in whole_buckets(batches):
            replies = {r["source"]: r for r in table_.to_pylist()}
            names, tokens = _tokens(replies[-1]["state"])
            pairs, pair = _pairs(names, tokens)
            own, two = np.zeros(len(names), np.uint8), np.zeros(len(pairs), np.uint8)
            for b, w, p in _asked(names, pairs, n_buckets):
                found = np.frombuffer(pa.decompress(replies[b]["levels"], len(w) + len(p), "zstd", asbytes=True), np.uint8)
                own[w], two[p] = np.split(found, [len(w)])
            yield _token_levels(table_.column("bucket")[0].as_py(), replies[-1]["docs"], own[tokens], two[pair])

    held = segments.select("bucket", "segment").mapInArrow(lambda batches: (_batch([row], question) for row in _rows(batches)), question)
    replies = _by_bucket(chunks.mapInArrow(ask, question).unionByName(held), n_buckets).mapInArrow(answer, reply)
    states = chunks.select(F.col("chunk").alias("bucket"), F.lit(-1).alias("source"), F.lit(None).cast("binary").alias("levels"), "docs", "state")
    return _by_bucket(replies.unionByName(states), n_buckets).mapInArrow(gather, _LEVELS)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's documents, the document of each token, and its code: the levels of its pair, of the word before and of its own, a byte each."""
    docs = np.frombuffer(row["docs"], _DOC)
    own, pair = (np.frombuffer(pa.decompress(row[c], int(docs["tokens"].sum()), "zstd", asbytes=True), np.uint8).astype(np.int64) for c in ("own", "pair"))
    return docs, np.repeat(np.arange(len(docs)), docs["tokens"]), pair << 16 | np.concatenate([own[-1:], own[:-1]]) << 8 | own


def _shares(codes: np.ndarray, mass: float, kinds: int, out_of: int = 0) -> np.ndarray:
    """Pair, word and uniform probability of tokens of a code; ``out_of`` 1 leaves its own occurrence out."""
    pair, context, own = (count_at(codes >> k & 255) for k in (16, 8, 0))
    pair_share = np.where(context > out_of, np.minimum(np.maximum(pair - out_of, 0) / np.maximum(context - out_of, 1), 1.0), 0.0)
    word_share = np.maximum(own - out_of, 0) / max(mass - out_of, 1)
    return np.column_stack([pair_share, word_share, np.full(len(codes), 1 / (kinds + 1))])


def mixture(shares: np.ndarray, n: np.ndarray, steps: int = 30) -> list[float]:
    """Weights of the three probabilities, by expectation maximisation; ``n`` tokens have each row's shares."""
    weights = np.array([0.3, 0.6, 0.1])
    for _ in range(steps if len(shares) else 0):
        part = shares * weights
        weights = np.maximum(n @ (part / part.sum(1, keepdims=True)) / n.sum(), 1e-6)
        weights /= weights.sum()
    return weights.tolist()


def fit(levels: DataFrame, mass: float, kinds: int) -> list[float]:
    """The mixture's weights from all tokens of the texts that are learnt from; the number of tokens of each code reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            docs, doc, codes = _unpacked(row)
            distinct, n = np.unique(codes[docs["learnt"][doc]], return_counts=True)
            yield pa.RecordBatch.from_pydict({"code": pa.array(distinct, pa.int64()), "n": pa.array(n, pa.int64())})

    found = levels.select("docs", "own", "pair").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")
    return mixture(_shares(found["code"].to_numpy(np.int64), mass, kinds, 1), found["n"].to_numpy(float))


_BASE = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score")


def _sums(segments: DataFrame):
    """Training tokens, distinct words, bytes of the filter and mass."""
    sums = (F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "kinds", F.length("segment")))
    return segments.agg(*sums, F.coalesce(F.sum(F.col("mass").cast("decimal(38,1)")).cast("double"), F.lit(0.0))).first()


def _base_columns(docs: np.ndarray, total: int, kinds: int) -> list[pa.Array]:
    base = docs["base"] - docs["tokens"] * np.log10(float(total + kinds + 1))
    return [pa.array(docs["id"], mask=docs["none"]), pa.array(docs["tokens"]), pa.array(docs["known"]), pa.array(np.full(len(docs), total, np.int64)), pa.array(base)]


def scored(rows: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row that is scored: doc_id, n_tokens, n_known, train_tokens, base_score, score; rows are doc_id, text, scored, learnt."""
    n_buckets = shards(rows.sparkSession)
    chunks, table = counted(rows.withColumn("doc_id", F.col("doc_id").cast("long")), n_buckets)
    segments = table.where("segment is not null")
    total, kinds, held, mass = _sums(segments)
    levels = written((_probed if held <= broadcast_bytes else _probed_by_segment)(chunks, segments, n_buckets), "levels")
    removed(chunks)
    weights = fit(levels, mass, kinds)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            docs, doc, codes = _unpacked(row)
            distinct, back = np.unique(codes, return_inverse=True)
            found = np.bincount(doc, np.log10(_shares(distinct, mass, kinds) @ np.array(weights))[back], len(docs))
            yield _batch([{"chunk": row["chunk"], "likely": found.tobytes()}], "chunk long, likely binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            docs = np.frombuffer(row["docs"], _DOC)
            out = docs["scored"]
            found, docs = np.frombuffer(row["likely"], "<f8")[out], docs[out]
            yield pa.RecordBatch.from_arrays([*_base_columns(docs, total, kinds), pa.array(found)], [*_BASE, "score"])

    return table.where("docs is not null").select("chunk", "docs").join(levels.mapInArrow(likely, "chunk long, likely binary"), "chunk").select("docs", "likely").mapInArrow(run, _ROW)


def score(documents: DataFrame, training: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score, score; learnt from ``training``."""
    given, learnt = (df.select("doc_id", "text", F.lit(x).alias("scored"), F.lit(not x).alias("learnt")) for df, x in ((documents, True), (training, False)))
    return scored(given.unionByName(learnt), broadcast_bytes)


def lm_scoring(documents: DataFrame, parts: int = 7, held: int = 2, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learnt from the rows that are not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == held, F.lit(False))
    rows = scored(documents.select("doc_id", "text", F.lit(True).alias("scored"), (~held_out).alias("learnt")), broadcast_bytes)
    return rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def base_scoring(documents: DataFrame, parts: int = 7, held: int = 2) -> DataFrame:
    """As :func:`lm_scoring` without the model's score: words are counted there in the same way, but no pairs, and no filter is made or probed."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == held, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(True).alias("scored"), (~held_out).alias("learnt"))
    chunks, table = counted(rows, shards(rows.sparkSession), words_only=True)
    removed(chunks)
    total, kinds, _, _ = _sums(table.where("segment is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield pa.RecordBatch.from_arrays(_base_columns(np.frombuffer(row["docs"], _DOC), total, kinds), list(_BASE))

    found = table.where("docs is not null").select("docs").mapInArrow(run, _ROW.removesuffix(", score double"))
    return found.select("doc_id", held_out.alias("held_out"), *_BASE[1:])


#: The exact columns: tokens, known ones and the add-one score of single words.
SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce({crc32_sql("doc_id::VARCHAR")} % 7 = 2, false) AS held_out,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words
  FROM documents),
tokens AS (
  SELECT rid, held_out, unnest(list_append(list_transform(words, lambda w: 'w' || w), 'end')) AS token FROM docs),
counts AS (SELECT token, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY token),
whole AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM counts),
per AS (
  SELECT rid, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / (any_n + any_v + 1)::DOUBLE)) AS base
  FROM (SELECT t.rid, c, n AS any_n, v AS any_v FROM tokens t LEFT JOIN counts USING (token), whole) GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base, 4) AS base_score FROM docs JOIN per USING (rid), whole
"""
