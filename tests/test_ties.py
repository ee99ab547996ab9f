"""Ties and columns without a scale, where sums in another form or order give other last digits."""

from orebed.operators import intervals, timeseries


def test_index_of_a_constant_column_is_unknown(spark):
    rows = spark.createDataFrame([(2, 5.0, 1.0), (1, 5.0, 3.0)], "hole int, a double, b double")
    assert [tuple(r) for r in timeseries.deformation_index(rows, "hole", {"a": 0.7, "b": 0.3}).orderBy("rank").collect()] == [(1, None, 1), (2, None, 2)]


def test_indexes_equal_to_ten_places_rank_by_point(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 1.0 + 1e-13), (3, 0.0), (4, 2.0)], "hole int, a double")
    assert [r["hole"] for r in timeseries.deformation_index(rows, "hole", {"a": 1.0}).orderBy("rank").collect()] == [4, 1, 2, 3]


def test_waste_that_leaves_the_cutoff_is_bridged(spark):
    """The joined grade is 5 exactly; the first run's mean times its length is less than its metal."""
    ends, grades = [0, 4, 37, 46, 47], [8, 6, 0, 5]
    frame = spark.createDataFrame([(1, float(a), float(b), float(g)) for a, b, g in zip(ends, ends[1:], grades)], "hole_id int, depth_from double, depth_to double, grade double")
    assert [(r["grade"], r["waste_length"]) for r in intervals.economic(frame, "grade", 5.0, 0.0, 20.0).collect()] == [(5.0, 9.0)]
