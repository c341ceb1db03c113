"""Filters and joins that the corpus operators share."""

import pytest
from pyspark.sql import functions as F

from eventloom.llm import _common


@pytest.mark.parametrize("most", [_common.MOST_BITS, 64])
def test_filter_lets_every_key_through(spark, monkeypatch, most):
    monkeypatch.setattr(_common, "MOST_BITS", most)
    rows = spark.range(5000).withColumn("v", F.when(F.col("id") % 7 != 0, F.concat(F.lit("k"), F.col("id"))))
    keys = _common.cut(rows.where("id % 10 = 0").select(F.col("v").alias("k")).distinct(), "keys")
    inside = {r["id"] for r in _common.passing(rows, F.col("v"), keys, "k").collect()}
    outside = {r["id"] for r in _common.passing(rows, F.col("v"), keys, "k", how="left_anti").collect()}
    assert inside | outside == set(range(5000)) and not inside & outside
    # Null is a key here, as 0, 70, ... have no value.
    assert {i for i in range(5000) if i % 10 == 0 or i % 7 == 0} <= inside
    assert most == 64 or len(inside) < 1500


def test_size_of_filters():
    assert [_common.bloom_words(n) for n in (0, 1, 4, 5, 1000)] == [1, 1, 1, 2, 256]
    assert 64 * _common.bloom_words(10**9, _common.MOST_BITS) == _common.MOST_BITS


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_is_a_join(spark, how):
    left = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 3 else f"k{i}") for i in range(60)], "id long, k string")
    right = spark.createDataFrame([("hot", 1), (None, 2), ("k6", 3), ("other", 4)], "key string, v int")
    got = sorted(map(str, _common.salted_join(left, right, "k", "key", F.col("id"), how).collect()))
    assert got == sorted(map(str, left.join(right, left["k"].eqNullSafe(right["key"]), how).drop("key").collect()))


def test_bound_computes_once(spark):
    df = spark.createDataFrame([("a,b,c",), (None,)], "s string")
    out = df.select(_common.bound(F.split("s", ","), lambda p: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.get(p, i))).alias("o"))
    assert [r["o"] for r in out.collect()] == [["a", "b", "c"], [None, None, None]]


def test_no_temporary_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="checkpoint"):
        _common.shared_dir(Session())
