"""Joins that look at what they broadcast."""

from fleetlens.llm.common import join_checked


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_elements_of_arrays_count(spark):
    left = spark.range(10).withColumnRenamed("id", "k")
    right = spark.createDataFrame([(1, [1] * 7), (2, []), (3, None)], "k long, a array<int>")
    assert "strategy=broadcast" in plan(join_checked(left, right, ["k"], "left", 3))
    wide, narrow = (join_checked(left, right, ["k"], "left", n, "a") for n in (9, 10))
    assert "strategy=broadcast" not in plan(wide)
    assert "strategy=broadcast" in plan(narrow)
    rows = sorted(wide.collect())
    assert rows == sorted(narrow.collect()) and len(rows) == 10 and rows[1]["a"] == [1] * 7


def test_an_empty_table_is_small(spark):
    none = spark.createDataFrame([], "k long, a array<int>")
    assert join_checked(spark.range(2).withColumnRenamed("id", "k"), none, ["k"], "left", 0, "a").count() == 2
