"""The scratch folder keeps its depth, is deleted on request, and is never guessed on a cluster."""

import pytest

from rxframe import session


def test_scratch_depth_is_constant(spark):
    depths = {session.scratch_path(spark, "t").count("/") for _ in range(500)}
    assert len(depths) == 1


def test_materialize_and_release(spark):
    df = session.materialize(spark.range(5), "t")
    assert df.count() == 5
    root = session.scratch_root(spark)
    session.release_scratch(spark)
    assert session.scratch_root(spark) != root


def test_unset_folder_raises_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        applicationId = "app-none"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_scratch_tables_are_dropped(spark):
    from rxframe.session import release_scratch, scratch_path, scratch_table
    name = scratch_table(spark, "rows")
    spark.range(4).write.option("path", scratch_path(spark, "rows")).saveAsTable(name)
    assert spark.catalog.tableExists(name)
    release_scratch(spark)
    assert not spark.catalog.tableExists(name)
