"""Operators against plain versions of their definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from orebed.llm import crosspolytope, lm_scoring, mixing, packed_ids, packing, quality_compression, quality_rules, simhash, suffix_dedup, textarrays, tokens, toxicity
from orebed.operators.components import components

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def _repeats(rows, length=50):
    owner, out = {}, {}
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - length + 1):
            owner[b[k : k + length]] = min(owner.get(b[k : k + length], i), i)
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if owner[b[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def _check_repeats(spark, rows, monkeypatch=None):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeats(frame).collect()}
    assert found == _repeats(rows)


def test_repeats_of_random_texts(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randint(40, 300))) for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), 60):
        parts = [b[rng.randint(0, len(b)) :] if rng.random() < 0.6 else "".join(rng.choice("abc") for _ in range(60)) for b in rng.sample(base, 3)]
        rows.append((i, "".join(parts)))
    _check_repeats(spark, rows + [(5000, "a" * 300), (5001, "a" * 70), (5002, rows[0][1]), (5003, rows[0][1])])


def test_repeats_with_every_minimiser_hot(spark, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 2)
    _check_repeats(spark, sorted(texts.items())[:80])


def test_repeats_sql(spark, docs):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        expected = {r[0]: r[1:] for r in c.execute(suffix_dedup.SQL).fetchall()}
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeats(docs).collect()} == expected


def test_suffixes_are_sorted():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    at = rng.choice(3900, 300, replace=False)
    cuts = np.array([0, 1, 130, 131, 300])
    order = suffix_dedup.Suffixes(data, np.maximum(at - 25, 0), at, np.minimum(at + 50, 4000), 50, 25).sorted(cuts)
    for a, b in zip(cuts, cuts[1:]):
        found = [data[at[i] : at[i] + 50].tobytes() for i in order[a:b]]
        assert found == sorted(found) and sorted(order[a:b]) == list(range(a, b))


def test_language_model_counts(spark, docs, texts):
    found = {r["doc_id"]: r for r in lm_scoring.lm_scoring(docs).collect()}
    lower = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None]
    count = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in lower(t))
    total, kinds = sum(count.values()), len(count)
    for i, t in texts.items():
        words, r = lower(t), found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(count[w] > 0 for w in words), total)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in words), abs_tol=1e-6)
        assert r["score"] < 0
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_a_filter_too_large_to_broadcast_gives_the_same(spark, docs):
    """The levels come from the broadcast filter or from its segments; the exact counts are not read."""
    rows = {way: sorted(map(tuple, lm_scoring.lm_scoring(docs, broadcast_bytes=bound).collect())) for way, bound in (("broadcast", 1 << 30), ("segments", 0))}
    assert rows["broadcast"] == rows["segments"] and len({r[-1] for r in rows["segments"]}) > 10
    chunks, table = lm_scoring.counted(docs.selectExpr("doc_id", "text", "true scored", "doc_id % 2 = 0 learnt"), 7)
    segments = table.where("segment is not null")
    levels = {way.__name__: sorted(map(tuple, way(chunks, segments, 7).collect())) for way in (lm_scoring._probed, lm_scoring._probed_by_segment)}
    assert levels["_probed"] == levels["_probed_by_segment"]
    empty = segments.withColumn("segment", F.lit(bytes(8)))
    assert not any(lm_scoring._unpacked(r.asDict())[2].any() for r in lm_scoring._probed(chunks, empty, 7).collect())  # an empty filter knows nothing



def test_filter_gives_counts_back():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    n = rng.geometric(0.05, 3000)
    size = 1 << 18
    data = b"".join(lm_scoring.segment((keys[lm_scoring.bucket_of(keys, 4) == b] & lm_scoring._KEY, n[lm_scoring.bucket_of(keys, 4) == b]), (np.zeros(0, np.uint64), np.zeros(0, np.int64)), size) for b in range(4))
    found = lm_scoring.Filter(np.frombuffer(data, np.uint8), size, 4).levels(keys)
    assert (found >= lm_scoring.level(n)).all() and (found == lm_scoring.level(n)).mean() > 0.98
    assert (lm_scoring.Filter(np.frombuffer(data, np.uint8), size, 4).levels(rng.integers(0, 1 << 63, 3000).astype(np.uint64)) == 0).mean() > 0.98


def test_filter_holds_what_it_is_sized_for():
    texts = [" ".join(f"w{i}x{j}" for j in range(40) for _ in range(70 + j)) + f" o{i} e{i}" for i in range(20)]
    data = "".join(texts).encode()
    words, _ = lm_scoring.tokens_of(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts)]))
    narrow = lambda keys, kind: keys & np.uint64((1 << 8 * lm_scoring.WIDTH[kind]) - 1)
    words, pairs = narrow(words, "word"), narrow(lm_scoring.pairs_of(words), "pair")
    one = lambda keys: lm_scoring.totals(keys, np.ones(len(keys)))[:2]
    found = lm_scoring.made_filter(one(words), one(pairs))
    assert found.size > 20 * 40 * 2 * 11 * lm_scoring.BITS_PER_ENTRY  # each of these words and pairs has a count of 69 or more
    assert np.unpackbits(found.data).mean() < 0.5
    keys, n = one(pairs)
    assert (found.levels(keys) >= lm_scoring.level(n)).all() and (n == 1).sum() >= 20  # pairs seen once are held too


def test_word_shares_add_up():
    """Over a vocabulary and the unknown word, the probabilities of a word after no known word sum to 1."""
    n = np.random.default_rng(3).geometric(0.02, 200)
    levels = lm_scoring.level(n)
    mass = lm_scoring.count_at(levels).sum()
    shares = lm_scoring._shares(np.append(levels, 0), mass, len(n))
    assert np.isclose(shares[:, 1].sum(), 1.0) and np.isclose(shares[:, 2].sum(), 1.0) and (shares[:, 0] == 0).all()
    for weights in ([0.3, 0.6, 0.1], [0.0, 0.5, 0.5]):
        assert (shares @ np.array(weights)).sum() <= 1 + 1e-9


def test_mixture_learns_from_whole_texts(spark):
    rng = np.random.default_rng(4)
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    common = lambda: " ".join(f"common{k}" for k in rng.integers(0, 30, 3000))
    rows = [(i, common() + " " + " ".join(f"rare{i}x{k}" for k in range(3000))) for i in range(200, 240) if zlib.crc32(str(i).encode()) % 7 != 2]
    kinds = 30 + 3000 * len(rows) + 1
    docs = spark.createDataFrame([*rows, (held[0], "nowhere"), (held[1], "nowhere " * 101)], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scoring(docs).collect()}
    uniform = 10 ** ((found[held[1]] - found[held[0]]) / 100) * (kinds + 1)
    assert 0.4 < uniform < 0.6  # half of all training words are seen once


def test_fingerprints_and_components(spark, docs, texts):
    def plain(t):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))

    prints = {i: plain(t) for i, t in texts.items()}
    ids = sorted(prints)
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and least[b] < least[a]:
                    least[a], changed = least[b], True
    for tile in (2048, 2):
        found = {r["doc_id"]: r for r in simhash.simhash(docs, tile=tile).collect()}
        assert {i: r["fingerprint"] for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
        assert {i: r["component_id"] for i, r in found.items()} == least


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_vector_links(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    rows = [(c + s * rng.normal(size=24)).tolist() for c in centres for s in (0.0, 0.05, 0.15, 0.3)] + [centres[0].tolist()] * 5
    x = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    for tile in (2048, 8):
        found = crosspolytope.near_duplicates(frame, tile=tile).toPandas().sort_values("vec_id")
        links = found["n_links"].to_numpy()
        assert (links <= near.sum(1)).all() and links.sum() >= 0.99 * near.sum()
        assert (found["kept"] == (found["vec_id"] == found["component_id"])).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(2000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + math.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = (crosspolytope.buckets(a)[:, :, :, None] == crosspolytope.buckets(b)[:, :, None, :]).any((1, 2, 3))
    assert met.mean() > 0.97


def test_id_files(spark, docs, texts, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    folder = f"file://{tmp_path}/ids"
    manifest = packed_ids.write(docs, folder, path, file_ids=5000)
    found = {r["doc_id"]: r for r in packed_ids.read(manifest).collect()}
    start = 0
    expected = {i: np.array([*whole.encode(texts[i], add_special_tokens=False).ids, 0], "<u4") for i in sorted(texts)}
    for i, ids in expected.items():
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert manifest.count() > 4
    for row in manifest.limit(3).collect():
        reader = packed_ids.Reader(row["uri"])
        for k in range(reader.n_docs):
            assert (reader.document(k) == expected[int(reader.doc_ids[k])]).all()


def test_bit_packing():
    for bits in (1, 3, 7, 8, 13, 16, 17, 24, 31, 32):
        ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
        data = packed_ids.pack(ids, bits)
        assert len(data) == -(-1003 * bits // 8) and (packed_ids.unpack(data, 1003, bits) == ids).all()


def test_pieces_get_the_librarys_ids(texts):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "\r\n", "\xa0", "\u2003", "a", "B", "é", "İ", "Σ", "ſ", "the", " the", "'s", "'S", "12", "½", "日本", "،", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\x00", "\x85", "\x1c", "...", "e\u0301", "\u0301", "😀", "_", "|"]
    odd = ["", None, "don't I'LL 'S a  b\t\n c  ", "\x1c a\x85b  \n\n"] + ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(4000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "as_it_is"):
        whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json" if name == "as_it_is" else name))
        own = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json" if name == "as_it_is" else name), end_id=7, table_units=500)
        assert own.keeps or own.drops
        if name == "as_it_is":  # a tokenizer of another pattern
            own.keeps = own.drops = False
        every = odd + list(texts.values())
        expected = [[*e.ids, 7] for e in whole.encode_batch([t or "" for t in every], add_special_tokens=False)]
        for at in range(0, len(every), 150):
            ids, starts = own.encode(every[at : at + 150])
            assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == expected[at : at + 150]
    assert 50256 in tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(["a <|endoftext|> b"])[0]


def test_mix(spark, docs):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        expected = c.execute(mixing.SQL).df().sort_values("doc_id", ignore_index=True)
    found = mixing.mixing(docs).toPandas().sort_values("doc_id", ignore_index=True)
    pd.testing.assert_frame_equal(found, expected[found.columns], check_dtype=False)
    assert (found["taken"] <= 2 * found["size"]).all()
    mix = mixing.mixed_documents(docs).toPandas()
    sizes = mix["text"].map(lambda t: len(WORD.findall(t))).groupby(mix["doc_id"]).sum()
    assert sizes.to_dict() == found[found["taken"] > 0].set_index("doc_id")["taken"].to_dict()


def test_rule_counts(spark, docs, texts):
    found = {r["doc_id"]: r for r in quality_rules.judge(docs, None).collect()}
    for i, t in texts.items():
        words = WORD.findall(t)
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert tuple(found[i][c] for c in quality_rules.COUNTS) == expected
        assert found[i]["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def test_isolation_forest_finds_outliers():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(2000, 4))
    forest = quality_rules.IsolationForest(rows, 100, 256, 1)
    assert forest.score(np.full((1, 4), 6.0))[0] > forest.score(rows).max() - 0.05 and forest.score(np.zeros((1, 4)))[0] < 0.5


@pytest.mark.parametrize("operator, label", [(quality_compression.quality_classifier, "quality"), (toxicity.toxicity, "toxic")])
def test_held_out_accuracy(spark, operator, label):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = operator(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    y, score = rows[label].to_numpy(), rows["score"].to_numpy()
    rank = np.argsort(np.argsort(score))
    area = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / y.sum() / (len(y) - y.sum())
    assert area > 0.85
    assert (rows["predicted"] == y).mean() > 0.85


def test_packings(spark, docs, texts):
    rows = packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"), shard_documents=60).toPandas()
    own = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for i, part in rows.sort_values(["doc_id", "piece"]).groupby("doc_id"):
        ids = own.encode([texts[i]])[0].astype("<u4")
        cut = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in part.itertuples()] == [(k, 2048 * k, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(cut)]
    placed = rows.sort_values(["sequence_id", "offset"])
    filled = placed.groupby("sequence_id")["length"].cumsum()
    assert (filled - placed["length"] == placed["offset"]).all() and filled.max() <= 2048
    assert rows["sequence_id"].nunique() <= 1 + -(-rows["length"].sum() // 2048)


def test_search_beats_best_fit():
    """Best fit decreasing joins 51 with 27; 51 + 26 + 23 fills a bin."""
    lengths, rng = sorted([51, 27, 26, 23] * 10, reverse=True), np.random.default_rng(1)
    first = packing.first_packing(lengths, 100, rng, 0.0)
    best = packing.evolve([first] + [packing.first_packing(lengths, 100, rng, 0.3) for _ in range(5)], lengths, 100, 40, 6, rng)[0]
    assert sorted(i for b in best for i in b) == list(range(40)) and all(sum(lengths[i] for i in b) <= 100 for b in best)
    assert len(best) < len(first)


def test_waste_of_shards_is_packed_again(spark):
    """120 shards of 5 pieces of 1000 tokens leave a half empty bin each; a further level joins them."""
    rows = spark.range(600).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "1000L AS length", "id AS ids_crc32", "id AS place")
    done = packing.pack(rows, 600, shard_documents=5).toPandas()
    assert sorted(done["doc_id"]) == list(range(600)) and done["sequence_id"].nunique() == 300
    assert (done.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_genetic_operators_keep_every_item():
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 1500, 120).tolist()
    first = [packing.first_packing(lengths, 2048, rng, s) for s in (0.0, 0.4)]
    child = packing.crossover(*first, lengths, 2048, rng)
    other = packing.mutated(child, lengths, 2048, rng)
    for bins in (*first, child, other):
        assert sorted(i for b in bins for i in b) == list(range(120)) and all(sum(lengths[i] for i in b) <= 2048 for b in bins)
    best = packing.evolve([*first], lengths, 2048, 10, 4, rng)[0]
    assert len(best) <= min(map(len, first))


def test_equal_hashes_of_other_bytes(monkeypatch):
    """All names of strings collide; what is found must still be what the bytes say."""
    rng = random.Random(8)
    word = lambda n: bytes(rng.choice(b"abcdef ") for _ in range(n))
    passage = word(70)
    texts = [word(40) + passage + word(30), word(90), word(10) + passage + word(55), passage[:55] + word(80)]
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    at, hashes, begin, last = suffix_dedup.minimisers(buffer, offsets, 50, 25)
    docs = textarrays.document_of(at, offsets)
    runs = []
    for forced in (False, True):
        if forced:
            monkeypatch.setattr(suffix_dedup.T, "pair_hashes", lambda a, b: np.zeros(len(a), np.uint64))
        which, low, high = suffix_dedup.matches(buffer, begin, at, last + 50, hashes, docs, 50, 25)
        gone = np.zeros(len(buffer), bool)
        for w, a, b in zip(which, low, high):
            gone[at[w] + a : at[w] + b] = True
        runs.append([int(gone[a:b].sum()) for a, b in zip(offsets, offsets[1:])])
    assert runs[0] == runs[1] == [r[1] for r in _repeats([(i, t.decode()) for i, t in enumerate(texts)]).values()]
    assert runs[0][2] >= 70 and runs[0][3] >= 55
