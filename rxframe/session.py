"""Session construction, the shared scratch folder and the few settings the jobs rely on."""

from __future__ import annotations

import contextvars
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "rxframe", checkpoint_folder: str | None = None) -> SparkSession:
    """A session with AQE, skew-join handling and the UI off.

    On a cluster ``master`` is left to spark-submit; locally it defaults to
    ``local[*]``.  Shuffle partitions default to the core count locally; on a
    cluster size them so one partition stays around 128-256 MB.
    ``checkpoint_folder`` becomes ``spark.checkpoint.dir``; leave it out where
    the cluster's own configuration names one.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    cpus = os.cpu_count() or 8
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "16g",
    }
    if checkpoint_folder:
        conf["spark.checkpoint.dir"] = checkpoint_folder
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# one scratch root per Spark application, decided at the first use
_ROOTS: dict[str, str] = {}
_TABLES: dict[str, list[str]] = {}
_GROUPS: contextvars.ContextVar[tuple[ScratchGroup, ...]] = contextvars.ContextVar("scratch groups", default=())


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, read from the session, never changed here.

    ``spark.checkpoint.dir`` as the cluster sets it, else the folder somebody
    gave the context with ``setCheckpointDir``.  Where neither is set, a plain
    ``local[...]`` session (tests, smoke runs: one machine, one JVM) gets a
    temporary folder once; any other master raises, because a folder of the
    driver's machine is not seen by the executors.
    """
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    set_dir = set_dir or sc.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="rxframe-local-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The one folder of this application under the checkpoint folder."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{checkpoint_dir(spark)}/rxframe-{uuid.uuid4().hex}"
    return _ROOTS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one write, always at the same depth."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if groups := _GROUPS.get():
        groups[-1].paths.append(path)
    return path


class ScratchGroup:
    """The scratch folders taken inside ``with`` (but in no group within), to be deleted together
    before the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> ScratchGroup:
        self._before = _GROUPS.set((*_GROUPS.get(), self))
        return self

    def __exit__(self, kind, *_) -> None:
        _GROUPS.reset(self._before)
        if kind is not None:
            self.release()

    def release(self) -> None:
        while self.paths:
            delete_path(self.spark, self.paths.pop())


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as a parquet table under the shared checkpoint folder
    and read it back.

    Used where one intermediate feeds several branches or a size check: it is
    computed by one job, later stages read files (with pruning), and its
    lineage is cut, so a lost executor does not recompute the upstream plan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh name for a bucketed scratch table; ``release_scratch`` drops it."""
    table = f"rxframe_{name}_{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(table)
    return table


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete one folder through Hadoop's file system API (any store)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table of this application.  Results that were
    not written or consumed yet read from these tables: call it after them."""
    for table in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    root = _ROOTS.pop(spark.sparkContext.applicationId, None)
    if root:
        delete_path(spark, root)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``rxframe`` importable in Python workers (for ``mapInPandas``
    functions), once per application: the package is zipped on the driver and
    distributed with ``addPyFile``, as ``--py-files`` would do.  A no-op when
    the package was already shipped in this application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="rxframe-pkg-"), "rxframe.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
