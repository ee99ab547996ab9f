"""Elkan clustering, virtual slots and spelling variants against plain versions of their definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from orebed.llm import elkan, spelling, virtual_slots
from orebed.operators.stored import written

DATA = "/root/testdata/sf0.001"


def _plain_kmeans(rows, k, rounds, seed="2"):
    v = np.array([x for _, x in rows], object)
    starts = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"{seed}:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), list(v[i])))[:k]
    centroids = [list(v[i]) for i in starts]
    for turn in range(rounds + 1):
        found = []
        for x in v:
            d = [sum((int(a) - int(b)) ** 2 for a, b in zip(x, c)) for c in centroids]
            j = d.index(min(d))
            found.append((j, d[j]))
        if turn < rounds:
            for j in range(len(centroids)):
                own = [x for x, (c, _) in zip(v, found) if c == j]
                if own:
                    centroids[j] = [sum(int(x[i]) for x in own) // len(own) for i in range(len(centroids[j]))]
    return found, centroids


def _floors(vector):
    return [int(np.floor(256 * float(x))) for x in vector]


def test_clusters_equal_the_plain_algorithm(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 64) / 256.0) for i in range(90)]  # few values: many ties
    rows += [(100 + i, rows[i % 7][1]) for i in range(30)]  # copies
    rows += [(100, rows[3][1]), (None, rows[5][1])]
    df = spark.createDataFrame([Row(vec_id=i, embedding=[float(x) for x in v], label=None) for i, v in rows], "vec_id long, embedding array<double>, label int")
    plain, centroids = _plain_kmeans([(i, _floors(v)) for i, v in rows], 40, 5)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    per = Counter()
    for j, d in plain:
        per[j] += d
    expected = sorted((str(i), j, d, per[j], sum(per.values()), digest[j]) for (i, _), (j, d) in zip(rows, plain))
    assert sorted((str(r[0]), *r[1:]) for r in elkan.elkan_clusters(df).collect()) == expected


def test_bounds_save_work_and_change_nothing(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows, seen = elkan.clustered(elkan.integers(df))
    found = rows.collect()
    assert sum(r["looked"] for r in found) < 0.5 * len(found) * 40
    last = seen[-1]
    for r in found:
        d = elkan.squared(np.array(r["v"], np.int64), last)
        assert (r["cluster"], r["distance"]) == (int(d.argmin()), int(d.min()))
        true = np.sqrt(d.astype(float))
        assert (np.array(r["lower"], float) <= true).all() and r["upper"] >= true[r["cluster"]]


def test_vectors_that_are_left_out(spark):
    good, nan, inf = [0.1] * 64, [0.1] * 63 + [float("nan")], [float("inf")] + [0.1] * 63
    rows = [(1, good), (2, nan), (3, inf), (4, None), (5, []), (6, good + [1.0]), (7, [0.1] * 63 + [None]), (8, [1e30] * 64), (9, [0.2] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).withColumn("v", F.lit(1))
    found = {r["vec_id"]: r for r in elkan.elkan_clusters(df).collect()}
    assert sorted(found) == [1, 9] and all(r["distance"] == 0 for r in found.values())
    assert elkan.elkan_clusters(df.limit(0)).collect() == []
    assert elkan.elkan_clusters(df.where("vec_id = 4")).collect() == []


def _placed(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by.values())
    return {s: sum(r["size"] for r in own) for s, own in by.items()}


def test_every_row_has_a_place_and_shards_are_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = virtual_slots.placed(docs).collect()
    sizes = _placed(rows)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in texts.items()}
    assert len(rows) == len(texts) and set(sizes) == set(range(40))
    share = sum(sizes.values()) / 40
    assert max(sizes.values()) < 1.05 * share and min(sizes.values()) > 0.95 * share


def test_equal_rows_are_spread(spark):
    """A third of the table is one row: it must not end in one shard."""
    rows = [(i, f"text {i} " * 8) for i in range(2000)] + [(7, "a copy " * 10)] * 1000 + [(None, None)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash")).withColumn("size", F.lit(0))
    found = virtual_slots.placed(df, shards=8).collect()
    sizes = _placed(found)
    assert len(found) == len(rows) and Counter((r["doc_id"], r["text_crc32"]) for r in found) == Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)
    assert max(sizes.values()) < 1.1 * sum(sizes.values()) / 8
    assert virtual_slots.placed(df.limit(0)).collect() == []


def test_a_giant_text_keeps_its_shard_apart(spark):
    df = spark.createDataFrame([(0, "x" * 3_000_000)] + [(i, "y" * 1000) for i in range(1, 1000)], "doc_id long, text string")
    sizes = _placed(virtual_slots.placed(df, shards=4).collect())
    assert 3_000_016 <= max(sizes.values()) < 3_010_000
    others = sorted(sizes.values())[:-1]
    assert others[-1] - others[0] < 3000


def test_the_map_is_edited_not_redrawn(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = written(virtual_slots.records(docs), "records")
    sizes = written(virtual_slots.loads(rows), "loads")
    path = f"file://{tmp_path}/map"
    virtual_slots.store_map(virtual_slots.first_map(spark), path)
    for shards in (40, 40, 41):
        virtual_slots.store_map(virtual_slots.rebalanced(virtual_slots.stored_map(spark, path), sizes, shards), path)
    maps = {v: {r["virtual_slot"]: r["shard"] for r in virtual_slots.stored_map(spark, path, v).collect()} for v in (1, 2, 3, 4)}
    assert all(sorted(m) == list(range(virtual_slots.SLOTS)) for m in maps.values())
    bytes_ = {r["virtual_slot"]: r["bytes"] for r in sizes.collect()}
    total = sum(bytes_.values())
    moved = lambda a, b: sum(n for s, n in bytes_.items() if maps[a][s] != maps[b][s])
    assert moved(2, 3) < 0.03 * total  # balanced already: next to nothing moves
    assert moved(3, 4) < 0.15 * total  # a new shard takes about its share
    new = sum(n for s, n in bytes_.items() if maps[4][s] == 40)
    assert 0.9 * total / 41 < new < 1.1 * total / 41
    assert virtual_slots.stored_map(spark, path).first()["version"] == 4


def test_shards_are_written_with_all_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i if i % 5 else None, f"text {i}", i) for i in range(200)], "doc_id long, text string, shard int")
    mapping = virtual_slots.first_map(spark, shards=6)
    virtual_slots.write_shards(docs, mapping, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(str, back.select("doc_id", "text", "shard").collect())) == sorted(map(str, docs.collect()))
    assert {r[0] for r in back.select("_shard").distinct().collect()} == set(range(6))


def _plain_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return _plain_forms({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain_forms(counts):
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and x != w and _near(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def _found(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@pytest.mark.parametrize("tile", [spelling.TILE, 5])
def test_near_words_equal_brute_force(spark, tile):
    """Few letters, so that words have many near ones, by several positions and over both halves; small tiles split the groups."""
    rng = random.Random(5)
    words = {"".join(rng.choice("aabé") for _ in range(rng.randint(6, 9))) for _ in range(500)} | {"a" * n for n in range(6, 30)}
    counts = {w: rng.choice([5, 5, 6, 30, 200, 1500, 9000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert _found(spelling.variants(df, tile=tile)) == _plain_forms(counts)


def test_variants_of_documents(spark):
    rng = random.Random(8)
    words = ["Mining", "mining", "minning", "geology", "gÉology", "géology", "estimate", "estimates", "estimatés", "short", "ore", "×÷abcde", "ABCDEF"]
    rows = [(i if i % 9 else None, " ".join(rng.choice(words) for _ in range(60))) for i in range(400)]
    rows += [(1, None), (2, ""), (2, ""), (3, "1234 -- ..."), (4, " ".join(["x" * 3000, "x" * 3001] * 6)), (5, "word" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    assert _found(spelling.spelling_variants(df)) == _plain_variants(rows)
    assert spelling.spelling_variants(df.limit(0)).collect() == []
    assert spelling.spelling_variants(df.where("text like '1234%'")).collect() == []


def test_chains_are_followed_to_the_last(spark):
    chain = ["a" * (6 + k) for k in range(20)]
    counts = {w: 5 * 5**k for k, w in enumerate(chain)}
    found = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {r["root"] for r in found.collect()} == {chain[-1]}


def test_a_range_report_equals_a_scan():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 64, 257):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        low, least = rng.integers(0, n + 1, 60), rng.integers(0, n + 1, 60)
        high, beyond = low + rng.integers(0, n + 1, 60), least + rng.integers(0, n + 1, 60)
        high, beyond = np.minimum(high, n), np.minimum(beyond, n)
        q, at = tree.report(low, high, least, beyond)
        expected = [(k, i) for k in range(60) for i in range(low[k], high[k]) if least[k] <= values[i] < beyond[k]]
        assert sorted(zip(q.tolist(), at.tolist())) == expected
