"""Versioned tables: failed writes, lost races, several tables at once, expiry."""

import os

import pytest
from pyspark.sql import functions as F

from rxframe.sources import versions as vs


def ids(df):
    return sorted(r["id"] for r in df.collect())


def folders(base):
    return sorted(f for f in os.listdir(base) if f != vs.RECORDS)


def test_failed_write_is_never_seen(spark, tmp_path):
    base = str(tmp_path / "t")
    assert vs.current(spark, base) is None and vs.latest_version(spark, base) is None
    broken = spark.range(10).withColumn("x", F.when(F.col("id") == 9, F.raise_error(F.lit("broken"))).otherwise(F.lit("a")))
    with pytest.raises(Exception):
        vs.write_new_version(broken, base)
    assert vs.latest_version(spark, base) is None
    vs.write_new_version(spark.range(3), base)
    with pytest.raises(Exception):
        vs.write_new_version(broken, base)
    assert ids(vs.current(spark, base).read(spark)) == [0, 1, 2]
    assert vs.version_numbers(spark, base) == [1] and len(folders(base)) == 1
    assert spark.read.parquet(vs.latest_version(spark, base)).count() == 3


def test_two_tables_change_together_or_not_at_all(spark, tmp_path):
    base = str(tmp_path / "t")
    good, broken = spark.range(2), spark.range(2).select(F.raise_error(F.lit("no")).alias("id"))
    vs.write_version(spark, base, {"a": good, "b": good}, notes={"by": "first"})
    with pytest.raises(Exception):
        vs.write_version(spark, base, {"a": spark.range(9), "b": broken})
    v = vs.current(spark, base)
    assert (v.number, v.notes, ids(v.read(spark, "a"))) == (1, {"by": "first"}, [0, 1])
    assert len(folders(base)) == 2


def test_lost_race(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "t")
    vs.write_new_version(spark.range(1), base)
    vs.write_new_version(spark.range(2), base, expected=1)
    with pytest.raises(vs.VersionConflict):
        vs.write_new_version(spark.range(3), base, expected=1)
    assert ids(vs.current(spark, base).read(spark)) == [0, 1] and len(folders(base)) == 2
    # the other writer publishes between this one's look and its rename
    publish, raced = vs._publish, []

    def slow(spark_, v):
        if not raced:
            raced.append(v.number)
            vs.write_new_version(spark.range(5), base)
        return publish(spark_, v)

    monkeypatch.setattr(vs, "_publish", slow)
    vs.write_new_version(spark.range(7), base)      # takes the next number
    assert raced == [3] and vs.version_numbers(spark, base) == [1, 2, 3, 4]
    assert ids(vs.version(spark, base, 3).read(spark)) == list(range(5))
    assert ids(vs.current(spark, base).read(spark)) == list(range(7))
    raced.clear()
    with pytest.raises(vs.VersionConflict):          # and is told if it relied on the version before
        vs.write_new_version(spark.range(9), base, expected=4)
    assert vs.version_numbers(spark, base) == [1, 2, 3, 4, 5]


def test_append_compact_and_expire(spark, tmp_path):
    base = str(tmp_path / "t")
    for k in range(4):
        vs.write_version(spark, base, {"rows": spark.range(k, k + 1), "last": spark.range(k)}, append=True)
    v = vs.current(spark, base)
    assert ids(v.read(spark, "rows")) == [0, 1, 2, 3] and len(v.tables["rows"]) == 4
    assert ids(vs.version(spark, base, 2).read(spark, "rows")) == [0, 1]
    vs.compact(spark, base, "rows", files=1)
    vs.expire(spark, base, keep=1)
    v = vs.current(spark, base)
    assert v.number == 5 and vs.version_numbers(spark, base) == [5]
    assert ids(v.read(spark, "rows")) == [0, 1, 2, 3] and len(v.tables["rows"]) == 1
    assert len(folders(base)) == len(v.tables["rows"]) + len(v.tables["last"])
    assert ids(v.read(spark, "last")) == [0, 0, 0, 1, 1, 2]


def test_empty_table_keeps_its_schema(spark, tmp_path):
    base = str(tmp_path / "t")
    vs.write_new_version(spark.createDataFrame([], "a int, b array<string>"), base)
    assert vs.current(spark, base).read(spark).schema.simpleString() == "struct<a:int,b:array<string>>"
