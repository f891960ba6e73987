"""Planning helpers: generator filter, salted join, checked broadcast, row numbers."""

from pyspark.sql import functions as F

from rxframe.operators.common import bounded_broadcast, keep_rows, salted_equi_join
from rxframe.operators.search import global_row_number


def test_keep_rows_equals_where(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("m"), F.lit(None).cast("string").alias("s"))
    a = sorted(tuple(r) for r in keep_rows(df, (F.col("m") > 3) & F.col("s").isNull()).collect())
    b = sorted(tuple(r) for r in df.where((F.col("m") > 3) & F.col("s").isNull()).collect())
    assert a == b and keep_rows(df, F.col("m") > 3).columns == df.columns


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3)], "k string, v long")
    right = spark.createDataFrame([("hot" if i % 3 else "cold", i) for i in range(300)], "k string, w long")
    for how in ("inner", "right"):
        a = sorted(tuple(r) for r in salted_equi_join(left, right, "k", 8, right_salt_from="w", how=how).collect())
        b = sorted(tuple(r) for r in left.join(right, "k", how).collect())
        assert a == b, how
    try:
        salted_equi_join(left, right, "k", 8, right_salt_from="w", how="left")
        raise AssertionError("left outer join must be refused")
    except ValueError:
        pass


def test_bounded_broadcast(spark):
    df = spark.range(10)
    assert bounded_broadcast(df, 10)[1] is True
    assert bounded_broadcast(df, 9)[1] is False
    assert bounded_broadcast(df, 0)[1] is False


def test_global_row_number_dense_and_ordered(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "o").repartition(5)
    rows = sorted((r["o"], r["rn"]) for r in global_row_number(df, "o", partitions=4).collect())
    assert [rn for _, rn in rows] == list(range(1, len(rows) + 1))
