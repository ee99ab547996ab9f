"""The classifiers against plain versions of their definitions, and what they do with few labels."""

import math

import numpy as np
import pytest
import zstandard

from orebed.llm import crosspolytope, quality_compression, toxicity


def test_ftrl_is_its_definition():
    rng = np.random.default_rng(2)
    rates = {"alpha": 0.3, "beta": 1.0, "l1": 0.8, "l2": 0.1}
    model, z, n = toxicity.FTRL(50, **rates), [0.0] * 51, [0.0] * 51

    def weight(i):
        l1 = 0.0 if i == 50 else rates["l1"]
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((rates["beta"] + math.sqrt(n[i])) / rates["alpha"] + rates["l2"])

    for _ in range(300):
        at = np.unique(rng.integers(0, 50, 6))
        y = int(at.min() < 5)
        model.learn(at, y)
        p = 1 / (1 + math.exp(-sum(weight(i) for i in [*at.tolist(), 50])))
        old = {i: weight(i) for i in [*at.tolist(), 50]}
        for i, w in old.items():
            g = p - y
            rate = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / rates["alpha"]
            z[i] += g - rate * w
            n[i] += g * g
    assert np.allclose(model.weights(np.arange(51)), [weight(i) for i in range(51)], atol=1e-12)
    assert (model.weights(np.arange(50)) == 0).sum() > 5


def test_features_are_words_pairs_and_skips():
    text = b"One two, THREE two"
    doc, at = toxicity.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    single = lambda w: set(toxicity.features(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[1].tolist())
    assert len(at) == 4 + 3 + 2 and (doc == 0).all()
    assert single(b"one") | single(b"two") | single(b"three") <= set(at.tolist())
    assert set(at.tolist()) == set(toxicity.features(np.frombuffer(b"one TWO three... two!", np.uint8), np.array([0, 21]))[1].tolist())


def test_measure_is_the_difference_of_sizes():
    good, bad = b"the mill recovers gold " * 200, b"xq zz 00 ## " * 400
    texts = [b"", b"the mill recovers gold", b"xq zz ## " * 500, b"gold " * 1000]
    dictionaries = [quality_compression.dictionary([t]) for t in (good, bad)]
    buffer, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    found = quality_compression.measures(buffer, offsets, *map(quality_compression.compressor, dictionaries))
    for text, value in zip(texts, found):
        size = []
        for d in dictionaries:
            c = zstandard.ZstdCompressor(level=quality_compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False)
            size.append(sum(len(c.compress(text[k : k + 1024])) for k in range(0, len(text), 1024)))
        assert value == pytest.approx((size[1] - size[0]) / max(1, sum(size)))
    assert found[1] > 0 > found[2] and found[0] == 0


@pytest.mark.parametrize("given, share", [([], 1.0), ([1] * 6, 1.0), ([0] * 6, 0.0)])
def test_few_labels(spark, given, share):
    docs = spark.createDataFrame([(i, f"a text of number {i} with some words") for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, y) for i, y in enumerate(given)], "doc_id long, quality int, toxic int")
    scores = {r["score"] for r in quality_compression.quality_classifier(docs, labels).collect()}
    assert len(scores) == 1 and abs(scores.pop() - share) < 1e-3
    toxic = {r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert len(toxic) == 1
    score = toxic.pop()
    assert score == 0.5 if not given else (score > 0.5) == bool(given[0])


def test_vectors_with_other_columns(spark):
    """Columns whose names the operator uses within, long vectors, and the greatest id."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=40_000)
    rows = [(1, base.tolist(), 7, 9, "g"), (2, (base + 0.01 * rng.normal(size=40_000)).tolist(), 7, 9, "g"), ((1 << 63) - 1, rng.normal(size=40_000).tolist(), 7, 9, "g")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, n long, g string")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in crosspolytope.near_duplicates(frame, tables=2).collect()}
    assert found == {1: (1, 1, True), 2: (1, 1, False), (1 << 63) - 1: (0, (1 << 63) - 1, True)}
