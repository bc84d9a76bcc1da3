from pyspark.sql import functions as F

from millrace.config import Orchestration
from millrace.operators.keysets import capture, distribute, key_name, tag
from millrace.schema import ORDER, SOURCE


def test_key_sets_keep_order(spark):
    """Producers write in turn; each key set gets its records in their order, under its tag."""
    rows = [(f"p{p}", i, level, app) for p in range(5) for i, (level, app) in enumerate([("error", "sshd"), ("info", "sshd"), ("info", "lptd"), ("info", "sshd")])]
    df = spark.createDataFrame(rows, f"{SOURCE} string, {ORDER} long, level string, app string").repartition(6)
    o = Orchestration("byKeySet", ("level", "app"), "$level-$app")
    out = distribute(capture(df, o.keys), o, 3, (SOURCE, ORDER)).withColumn("tag", tag(o)).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    got = out.orderBy("at").collect()
    assert {t: sum(r["tag"] == t for r in got) for t in {r["tag"] for r in got}} == {"error-sshd": 5, "info-sshd": 10, "info-lptd": 5}
    for t in {r["tag"] for r in got}:
        own = [r for r in got if r["tag"] == t]
        assert len({r["part"] for r in own}) == 1
        assert [(r[SOURCE], r[ORDER]) for r in own] == sorted((r[SOURCE], r[ORDER]) for r in own)


def test_true_tuples(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("", "abc")], "x string, y string")
    o = Orchestration("byKeySet", ("x", "y"), "t.$x.$y")
    assert capture(df, o.keys).groupBy(key_name("x"), key_name("y")).count().count() == 3


def test_single_pipeline(spark):
    df = spark.createDataFrame([("s", i) for i in range(5)], f"{SOURCE} string, {ORDER} long").repartition(3)
    o = Orchestration("singleton", (), "all")
    assert [r[ORDER] for r in distribute(df, o, order=(SOURCE, ORDER)).collect()] == list(range(5))
    assert distribute(df, o).count() == 5
