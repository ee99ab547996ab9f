"""The pipeline's stages against plain versions of what each one decides, on its own input."""

import re

import corpus_pipeline
import pytest

from orebed.llm import quality_rules, simhash
from orebed.operators.stored import written
from tests.llm.test_brute_force import _repeats

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, written(stage(spark, docs, FOLDER), name)
        out[name] = (given, docs)
    return out


def _texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages(stages):
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == COLUMNS

    given, kept = stages["quality_rules"]
    labels = given.sparkSession.read.parquet(f"{FOLDER}/labels.parquet")
    expected = {r["doc_id"] for r in quality_rules.quality_rules(given, labels).where("kept").collect()}
    assert set(_texts(kept)) == expected

    given, kept = stages["simhash"]
    assert set(_texts(kept)) == {r["component_id"] for r in simhash.simhash(given).collect()}

    given, kept = stages["suffix_dedup"]
    removed, left = _repeats(sorted(_texts(given).items())), _texts(kept)
    for i, text in left.items():
        size, gone, _, _ = removed[i]
        assert size - gone - 8 * removed[i][2] <= len(text.encode()) <= size - gone
    assert all(removed[i][0] - removed[i][1] < 60 for i in set(removed) - set(left))

    given, mixed = stages["mixing"]
    count = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for (t,) in rows.select("text").collect())
    assert abs(count(mixed) - 1.5 * count(given)) <= 20

    given, packed = stages["packing"]
    assert packed.where("piece = 0").count() == given.count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, bucket int, spans string"


def _written(spark, folder, rows):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    spark.createDataFrame(rows, AWKWARD).write.parquet(f"{folder}/documents.parquet")
    labels.where("doc_id < 100").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """Null and repeated ids, empty and null texts and clashing columns: what is no copy and no junk comes through."""
    text = lambda k: " ".join(f"word{(k * 7919 + i * i * 31) % 9973}" for i in range(120)) + "."
    rows = [(i, text(i), "en", "a" if i % 2 else None, 0, 1, "x") for i in range(12)]
    rows += [(None, text(20), "en", "a", 0, 1, "x"), (None, text(21), None, "a", 0, 1, "x"), (3, text(22), "en", "b", 0, 1, "x"), (5, text(5), "en", "a", 0, 1, "x"), (30, None, "en", "a", 0, 1, "x"), (31, "", "en", "a", 0, 1, "x"), (None, None, None, None, None, None, None)]
    folder = _written(spark, tmp_path / "awkward", rows)
    packed = corpus_pipeline.run(spark, folder).toPandas()
    names = set(packed["doc_id"].dropna().astype(int))
    assert names and names <= set(range(12))
    assert (packed.groupby("sequence_id")["length"].sum() <= 2048).all()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    once = simhash.one_of_each(docs.where("length(text) > 0")).collect()
    assert len(once) == 15 and sum(r["doc_id"] is None for r in once) == 2


def test_pipeline_of_no_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, _written(spark, tmp_path / "empty", [])).collect() == []
