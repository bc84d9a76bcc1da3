import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.skew import Measure, salted
from millrace.session import shared_dir, written

def measures():
    return [Measure("n", F.count(F.lit(1)), "sum"), Measure("total", F.sum("v"), "sum"), Measure("low", F.min("v"), "min"), Measure("high", F.max("v"), "max")]


def plain(df, keys):
    return sorted(map(tuple, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high")).collect()), key=str)


@pytest.mark.parametrize("salts, share", [(1, 1.0), (7, 0.05), (64, 0.0001)])
def test_like_a_plain_aggregation(spark, salts, share):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 20 + ["a", "b", None]), rng.choice(["x", None]), rng.choice([1, 2, None, -3]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, k2 string, v long, id long")
    got = salted(df, ["k", "k2"], F.col("id"), measures(), salts=salts, heavy_share=share)
    assert sorted(map(tuple, got.collect()), key=str) == plain(df, ["k", "k2"])


def test_edges(spark):
    df = spark.createDataFrame([], "k string, v long, id long, count long, _mr_salt int")
    assert salted(df, ["k"], F.col("id"), measures()).count() == 0
    one = spark.createDataFrame([("a", 1, 1, 5, 2)] * 3, "k string, v long, id long, n long, total int")
    assert salted(one, ["k"], F.col("id"), measures()).first() == ("a", 3, 3, 1, 1)  # clashing columns, repeated rows
    for bad in ({"salts": 0}, {"heavy_share": 0}):
        with pytest.raises(ValueError):
            salted(df, ["k"], F.col("id"), measures(), **bad)


def test_written(spark):
    df = spark.createDataFrame([(1, "a"), (None, None)], "x int, y string")
    again = written(df)
    assert sorted(map(tuple, again.collect()), key=str) == [(1, "a"), (None, None)] and again.schema == df.schema
    assert shared_dir(spark)
