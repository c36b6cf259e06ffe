import pytest
from pyspark.sql import functions as F

from quarrymint.session import hot_values, skew_join


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id")).cast("long").alias("k"))


def test_hot_values(many):
    assert hot_values(many, F.col("k")) == [7]
    assert hot_values(many.where("false"), F.col("k")) == []
    assert hot_values(many.where("k is null"), F.col("k")) == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_is_the_plain_join(many, spark, how):
    one = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 5).alias("v")).unionByName(spark.createDataFrame([(7, 1), (7, 2), (None, 3)], "k long, v long"))
    got, want = skew_join(many, one, ["k"], F.col("id"), how), many.join(one, "k", how)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "SortMergeJoin" in got._jdf.queryExecution().toString()
