import pytest
from pyspark.sql import functions as F

from quarrylens import runtime


def test_salted_join_equals_a_plain_join(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"k{i % 900}", i) for i in range(1800)] + [("lonely", 1), (None, 2)]
    left = spark.createDataFrame(rows, "k string, i int")
    right = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(900)], ("unused", 0)], "k string, v int")
    sizes = left.groupBy("k").agg(F.count(F.lit(1)).alias("__rows")).crossJoin(left.agg(F.count(F.lit(1)).alias("total")))
    got = runtime.salted_join(left, right, ["k"], sizes, F.col("total"), ["i"])
    plain = left.join(right, "k")
    assert sorted(tuple(r) for r in got.select("k", "i", "v").collect()) == sorted(tuple(r) for r in plain.select("k", "i", "v").collect())
    assert set(got.columns) == {"k", "i", "v"}
    assert runtime.salted_join(left.where("false"), right, ["k"], sizes.where("false"), F.col("total"), ["i"]).count() == 0


def test_columns_are_picked_by_exact_name_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("A", "a", "a.b")
    assert tuple(runtime.pick(df, "a", upper="A", dotted="a.b").first()) == (2, 1, 3)
    assert runtime.pick(df.toDF("A", "x", "y"), "a").first().a == 1
    with pytest.raises(ValueError):
        runtime.pick(df, "missing")
    assert runtime.unclash(df, ("A.B",)).columns == ["A", "a__2", "a.b__2"]


def test_checkpoints_lie_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert runtime.shared_dir(spark) == root and runtime.scratch_path(spark, "x").startswith(root)
    cut = runtime.cut(spark.range(5).where("id > 1"))
    assert cut.count() == 3 and root.removeprefix("file://") in spark.sparkContext.getCheckpointDir()


def test_scans_are_spread_over_the_cores(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "x"))
    assert runtime.parallel(spark.read.parquet(str(tmp_path / "x"))).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
