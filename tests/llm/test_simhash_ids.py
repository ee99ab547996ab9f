import numpy as np

from orebed.llm import simhash


def _text(seed):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 10**6, 80))


def test_null_and_repeated_ids_lose_no_text(spark):
    texts = [_text(k) for k in range(7)]
    rows = [(5, texts[0]), (9, texts[1]), (None, texts[0]), (None, texts[2]), (None, texts[3]), (7, texts[4]), (7, texts[5]), (8, texts[4]), (None, texts[6]), (None, texts[6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.one_of_each(docs).collect()), key=str)
    assert kept == sorted([(5, texts[0]), (9, texts[1]), (None, texts[2]), (None, texts[3]), (7, texts[4]), (7, texts[5]), (None, texts[6])], key=str)


def test_null_ids_do_not_join_components(spark):
    base, swap = _text(11), lambda t, k: " ".join([*t.split()[:-1], f"end{k}"])
    near = lambda t: next(x for x in (swap(t, k) for k in range(2000)) if x != t and 0 < bin(_print(x) ^ _print(t)).count("1") <= 3)
    other = _text(12)
    docs = spark.createDataFrame([(5, base), (9, other), (None, near(base)), (None, near(other))], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.simhash(docs).where("doc_id is not null").collect()}
    assert found == {5: 5, 9: 9}
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [5, 9]


def _print(text):
    return simhash.fingerprint(simhash.shingle_hashes(text.encode()))
