"""What op2 leaves on disk: the rows and bytes of its shuffles, and the files of steps that are over."""

import random
import time

import pytest
from pyspark.sql import functions as F

from orebed.llm import suffix_dedup
from orebed.operators import stored

from .test_brute_force import _repeats


def _rows(n=120):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(5)]
    return [(i, " ".join([*(word() for _ in range(40)), rng.choice(passages), *(word() for _ in range(40))])) for i in range(n)]


def _slim(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.select("doc_id", F.xxhash64("text").alias("th"), "text").coalesce(1)


def test_messages_do_not_grow_with_the_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 2000)  # some thirty chunks
    rows, n = _rows(), 8
    slim = _slim(spark, rows)
    candidates = suffix_dedup._candidates(slim, n, 50, 25)
    assert candidates.count() <= 2 * n
    keys = suffix_dedup._by_document(suffix_dedup._shared(candidates, n), 3, "keys")
    asked = slim.select(F.col("doc_id").alias("id"), "th", F.struct("doc_id", "text").alias("row")).join(keys.withColumnRenamed("doc_id", "id"), ["id", "th"]).coalesce(1)
    units = suffix_dedup._units(asked, n, 50, 25)
    assert 0 < units.where("not direct").count() <= n
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeats(frame).collect()} == _repeats(rows)


@pytest.mark.parametrize("held", [1, 60])
def test_what_is_held_does_not_change_the_result(spark, monkeypatch, held):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    monkeypatch.setattr(suffix_dedup, "HELD_BYTES", 3000)
    rows = [*_rows(60), (3, _rows(60)[9][1]), (70, _rows(60)[9][1]), (71, ""), (72, None), (-4, "short")]
    frame = spark.createDataFrame([r for r in rows if r[0] != 3], "doc_id long, text string")
    expected = _repeats([(i, t or "") for i, t in rows if i != 3])
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeats(frame).collect()} == expected


def test_a_minimiser_is_hot_for_the_size_of_its_bucket(spark, monkeypatch):
    rows = _rows()
    marks = {}
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 3)
    for of in (1 << 16, 16):
        monkeypatch.setattr(suffix_dedup, "HOT_OF", of)
        keys = suffix_dedup._by_document(suffix_dedup._shared(suffix_dedup._candidates(_slim(spark, rows), 2, 50, 25), 2), 3, "keys")
        marks[of] = sum(int.from_bytes(r["keys"][i : i + 8], "little") >> 63 for r in keys.collect() for i in range(0, len(r["keys"]), 8))
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeats(frame).collect()} == _repeats(rows)
    assert marks[1 << 16] > 0 == marks[16]


def test_a_written_step_leaves_no_shuffle_files(spark):
    def files():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f for f in found if "shuffle_" in f}

    before, setting = files(), spark.conf.get(stored._CLEANUP, None)
    table = stored.written(spark.range(1000).repartition(3, "id"), "tidy", tidy=True)
    for _ in range(50):  # they go in the background
        left = files() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(stored._CLEANUP, None) == setting
    assert table.count() == 1000
