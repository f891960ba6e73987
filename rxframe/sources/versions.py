"""Versioned tables (S7): "overwrite in place" as staged writes and one published record.

``base`` holds data folders and ``_versions/<number>``, one small JSON record per version
that names the folders of each of its tables.  A write goes to folders of its own first;
the version exists from the moment its complete record is renamed to the next number.  So
a failed or slow write is never seen, several tables change together, and of two writers
that want the same number one is told (``VersionConflict``) or goes on to the next.

The rename must fail where its target exists: HDFS and local folders do that, as Spark's own
streaming logs ask for; for an object store use a committer or file system layer that does.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rxframe.session import delete_path

RECORDS = "_versions"
TABLE = "table"


class VersionConflict(RuntimeError):
    """Another writer published a version in between."""


@dataclass(frozen=True)
class Version:
    base: str
    number: int
    tables: dict[str, list[str]]  # folders below ``base``, oldest first
    schemas: dict[str, str] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)

    def paths(self, table: str = TABLE) -> list[str]:
        return [f"{self.base}/{folder}" for folder in self.tables[table]]

    def read(self, spark: SparkSession, table: str = TABLE) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self.schemas[table]))
        return spark.read.schema(schema).parquet(*self.paths(table))


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version_numbers(spark: SparkSession, base: str) -> list[int]:
    """Published versions, ascending."""
    folder, fs = _path(spark, f"{base.rstrip('/')}/{RECORDS}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def version(spark: SparkSession, base: str, number: int) -> Version:
    base = base.rstrip("/")
    record, fs = _path(spark, f"{base}/{RECORDS}/{number:012d}")
    stream = fs.open(record)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    r = json.loads(text)
    return Version(base, number, r["tables"], r["schemas"], r["notes"])


def current(spark: SparkSession, base: str) -> Version | None:
    """The newest published version."""
    numbers = version_numbers(spark, base)
    return version(spark, base, numbers[-1]) if numbers else None


def _publish(spark: SparkSession, v: Version) -> bool:
    """Rename a complete record to its number; false if that number is taken."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    text = json.dumps({"tables": v.tables, "schemas": v.schemas, "notes": v.notes})
    made, fs = _path(spark, f"{v.base}/{RECORDS}/.{uuid.uuid4().hex}")
    out = fs.create(made, False)
    out.write(text.encode())
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(made, _path(spark, f"{v.base}/{RECORDS}/{v.number:012d}")[0], how)
        return True
    except Py4JJavaError as e:
        fs.delete(made, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise


def write_version(spark: SparkSession, base: str, tables: dict[str, DataFrame], *, append: bool = False,
                  notes: dict | None = None, expected: int | None = None) -> Version:
    """Write ``tables`` and publish them as one version.

    Tables that are not given stay as they are in the version before; given ones replace it,
    or with ``append`` are added to it.  ``expected`` is the version that the new tables were
    made from (0: none yet): if another one is current by then, ``VersionConflict`` is raised and the
    staged data is deleted.  Without it, a writer that loses a race publishes the next number.
    """
    base = base.rstrip("/")
    staged: dict[str, str] = {}
    planned = (version_numbers(spark, base) or [0])[-1] + 1
    try:
        for name, df in tables.items():
            staged[name] = f"{name}-{uuid.uuid4().hex}/v={planned}"
            df.write.mode("errorifexists").parquet(f"{base}/{staged[name]}")
        while True:
            before = current(spark, base) or Version(base, 0, {})
            if expected is not None and before.number != expected:
                raise VersionConflict(f"{base}: version {before.number} is current, not {expected}")
            earlier = before.tables if append else {}
            v = Version(base, before.number + 1,
                        {**before.tables, **{n: [*earlier.get(n, []), folder] for n, folder in staged.items()}},
                        {**before.schemas, **{n: df.schema.json() for n, df in tables.items()}}, notes or {})
            if _publish(spark, v):
                return v
    except (Py4JJavaError, PySparkException, VersionConflict):
        for folder in staged.values():
            _drop(spark, base, folder)
        raise


def _drop(spark: SparkSession, base: str, folder: str) -> None:
    delete_path(spark, f"{base}/{folder.partition('/')[0]}")


def compact(spark: SparkSession, base: str, table: str = TABLE, files: int | None = None) -> Version:
    """The current version with ``table`` rewritten into one folder."""
    v = current(spark, base)
    df = v.read(spark, table)
    return write_version(spark, base, {table: df.coalesce(files) if files else df}, notes=v.notes, expected=v.number)


def expire(spark: SparkSession, base: str, keep: int = 1) -> None:
    """Delete all but the newest ``keep`` versions, records first, then the folders that
    no kept version names.  Readers of an older version must have ended."""
    numbers = version_numbers(spark, base)
    old = [version(spark, base, n) for n in numbers[:-keep]]
    kept = {f for n in numbers[-keep:] for fs in version(spark, base, n).tables.values() for f in fs}
    for v in old:
        delete_path(spark, f"{v.base}/{RECORDS}/{v.number:012d}")
    for folder in {f for v in old for fs in v.tables.values() for f in fs} - kept:
        _drop(spark, base.rstrip("/"), folder)


def write_new_version(df: DataFrame, base: str, expected: int | None = None) -> str:
    """One table as the next version; returns its folder."""
    return write_version(df.sparkSession, base, {TABLE: df}, expected=expected).paths()[0]


def latest_version(spark: SparkSession, base: str) -> str | None:
    """Folder of the newest version written by ``write_new_version``."""
    v = current(spark, base)
    return v.paths()[-1] if v else None
