"""Every operator over awkward tables: nulls, empty and long texts, repeated rows, clashing columns, no rows."""

import zlib

import public_tokenizers
import pytest
from pyspark.sql import Row

from orebed.llm import common, crosspolytope, lm_scoring, mixing, packed_ids, packing, quality_compression, quality_rules, simhash, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, bucket int, n_words string"
LONG = " ".join(f"word{i % 997}" for i in range(20000))
TEXTS = [(1, "A plain text of a few words."), (2, None), (3, ""), (4, LONG), (4, LONG), (None, "no id here"), (None, None), (5, "  \n \t"), (6, "A plain text of a few words."), (7, "é" * 40 + "ß" * 40), (8, "a" * 500)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([Row(i, t, "en", "src0" if k % 3 else None, len(t or ""), 0.5, "x", 1, "y") for k, (i, t) in enumerate(TEXTS)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def _byte():
    return public_tokenizers.path("byte_bpe_50k.json")


RUNS = {
    "quality_compression": lambda d, x: quality_compression.quality_classifier(d, x),
    "toxicity": lambda d, x: toxicity.toxicity(d, x),
    "quality_rules": lambda d, x: quality_rules.quality_rules(d, x),
    "suffix_dedup": lambda d, x: suffix_dedup.repeats(d),
    "lm_scoring": lambda d, x: lm_scoring.lm_scoring(d),
    "mixing": lambda d, x: mixing.mixing(d),
    "simhash": lambda d, x: simhash.simhash(d),
    "packed_ids": lambda d, x: packed_ids.packed_ids(d, _byte()),
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_has_a_result(tables, name):
    rows = RUNS[name](*tables).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    same = [r for r in rows if r["doc_id"] == 4]
    drop = {"start", "source_size", "target", "taken", "first_position"}  # of the place or source of a row
    assert {k: v for k, v in same[0].asDict().items() if k not in drop} == {k: v for k, v in same[1].asDict().items() if k not in drop}


@pytest.mark.parametrize("name", RUNS)
def test_no_rows(spark, tables, name):
    empty = spark.createDataFrame([], SCHEMA)
    assert RUNS[name](empty, tables[1].limit(0)).collect() == []


def test_packing_of_awkward_rows(spark, tables):
    rows = packing.best_fit_packing(tables[0], public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(TEXTS)
    assert all(0 < r["length"] <= 2048 for r in rows)
    assert packing.best_fit_packing(spark.createDataFrame([], SCHEMA), public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_vectors_that_link_with_nothing(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (9, [0.0, 1.0]), (None, [5.0, 0.1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    done = crosspolytope.near_duplicates(frame).collect()
    found = {(r["vec_id"], r["n_links"]): r["component_id"] for r in done}
    assert len(done) == len(rows)
    assert found[(1, 3)] == found[(2, 3)] == found[(8, 3)] == found[(None, 3)] == 1
    assert all((i, 0) in found for i in (3, 4, 5, 6, 7, 9))
    assert crosspolytope.near_duplicates(frame.limit(0)).collect() == []


def test_defined_values(tables):
    docs, labels = tables
    removed = {r["doc_id"]: r for r in suffix_dedup.repeats(docs).collect()}
    assert removed[2]["n_bytes"] == removed[3]["n_removed"] == 0
    assert removed[4]["n_removed"] == 0 and removed[8]["n_removed"] == 0  # equal ids do not remove from each other, nor does a text from itself
    prints = {r["doc_id"]: r for r in simhash.simhash(docs).collect()}
    assert prints[3]["fingerprint"] == "0" * 16 and prints[3]["component_id"] == prints[2]["component_id"] == 2
    assert prints[6]["component_id"] == 1
    mixed = {r["doc_id"]: r for r in mixing.mixing(docs).collect()}
    assert mixed[2]["size"] == 0 and mixed[2]["taken"] == 0 and mixed[2]["first_position"] is None
    rules = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert rules[2]["base_failed"] and not rules[2]["kept"] and rules[7]["word_chars"] == 80


def test_stages_keep_the_columns(tables):
    docs, _ = tables
    for out in (simhash.one_of_each(docs), suffix_dedup.without_repeats(docs), mixing.mixed_documents(docs), quality_rules.kept_documents(docs, None)):
        assert out.dtypes == docs.dtypes
        out.collect()


def test_results_do_not_depend_on_partitions(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    for name in ("quality_compression", "toxicity", "quality_rules", "lm_scoring"):
        one, two = (RUNS[name](d, labels).toPandas().sort_values("doc_id", ignore_index=True) for d in (docs.coalesce(1), docs.repartition(7, "text")))
        for c in one.columns:
            if one[c].dtype == float:
                assert abs(one[c] - two[c]).max() <= 1e-9 * abs(one[c]).max(), (name, c)
            else:
                assert (one[c] == two[c]).all(), (name, c)


def test_a_repeated_id_is_one_row_of_a_label_sample(spark):
    docs = spark.range(10_000).selectExpr("3L as doc_id", "case when id % 2 = 0 then concat('text ', id) end as text").unionByName(spark.createDataFrame([(4, None), (6, "six")], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    rows = common.labelled(docs, labels, "quality", 100).collect()
    assert sorted(r["doc_id"] for r in rows) == [i for i in (3, 4, 6) if zlib.crc32(str(i).encode()) % 5]
    assert all((r["text"] is None) == (r["doc_id"] == 4) for r in rows)
    again = common.labelled(docs.repartition(7), labels, "quality", 100).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
