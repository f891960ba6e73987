"""File sources and sinks of the registry pipeline (S1-S6; versions are in ``versions.py``).

Registry harvests are JSON: either one array per file (``multiLine``, one task
per file) or JSON lines (splittable; what ``write_registry_json`` produces and
what large harvests should use).  CSV sheets are read with an explicit schema
and pandas' NA words turned into nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxframe.functions.text import na_to_null


def read_registry_json(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """Registry records with a fixed schema (keys absent in a record read as null)."""
    return spark.read.schema(schema).option("multiLine", multiline).option("encoding", "UTF-8").json(path)


def write_registry_json(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8, non-ASCII kept as is; a key with a null value is written
    (it counts as present when the file is profiled)."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def envelope_schema(record: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("pageCount", T.IntegerType()),
                         T.StructField("results", T.ArrayType(record))])


def flatten_envelopes(pages: DataFrame, json_col: str, record: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """The ``results`` of every page envelope, one row each; a page without
    results (missing or empty) gives no rows."""
    parsed = pages.select(*keep, F.from_json(F.col(json_col), envelope_schema(record)).alias("_env"))
    return parsed.select(*keep, F.explode("_env.results").alias("_r")).select(*keep, "_r.*")


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True) -> DataFrame:
    """S3: header CSV with quoted multi-line fields; NA words become null in
    string columns (numbers are typed by the schema).  ``multiline=False`` reads
    sheets without line breaks in fields, whose files Spark can split."""
    df = (spark.read.schema(schema).option("header", True).option("multiLine", multiline)
          .option("escape", '"').csv(path))
    return df.select(*[na_to_null(f.name).alias(f.name) if isinstance(f.dataType, T.StringType)
                       else F.col(f.name) for f in schema.fields])


# The words and number forms that a column's type is inferred from.
BOOL_WORDS = ["True", "TRUE", "true", "False", "FALSE", "false"]
INT_FORM = r"^[ \t]*[+-]?[0-9]+[ \t]*$"
FLOAT_FORM = r"^[ \t]*[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))[ \t]*$"


def infer_csv_schema(raw: DataFrame) -> T.StructType:
    """S3: the type of every column of a sheet read as text, in one aggregate over all rows.

    NA words are missing.  Whole numbers without a missing value: long; numbers, whole ones with a
    missing value included: double; nothing but missing values: double; true and false words without
    a missing value: boolean; all else, whole numbers beyond 64 bits too: string."""
    facts = []
    for c in raw.columns:
        x = na_to_null(f"`{c}`")
        whole = x.rlike(INT_FORM)
        facts.append(F.struct(
            F.coalesce(F.bool_or(x.isNull()), F.lit(False)).alias("missing"), F.bool_and(whole).alias("whole"),
            F.bool_and(~whole | F.trim(x).try_cast("long").isNotNull()).alias("fits"),
            F.bool_and(x.rlike(FLOAT_FORM)).alias("number"), F.bool_and(x.isin(BOOL_WORDS)).alias("truth")).alias(c))
    row = raw.agg(*facts).first()

    def kind(f) -> T.DataType:
        if f["number"] is None:  # no value at all
            return T.DoubleType()
        if f["number"] and f["fits"]:
            return T.LongType() if f["whole"] and not f["missing"] else T.DoubleType()
        return T.BooleanType() if f["truth"] and not f["missing"] else T.StringType()

    return T.StructType([T.StructField(c, kind(f)) for c, f in zip(raw.columns, row)])


def read_csv_inferred(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """S3 without a given schema: header CSV, the types inferred from all rows by one pass, then
    a typed read.  Only the header is read to name the columns."""
    raw = (spark.read.option("header", True).option("inferSchema", False).option("multiLine", multiline)
           .option("escape", '"').csv(path))
    out = []
    for f in infer_csv_schema(raw).fields:
        x = na_to_null(f"`{f.name}`")
        spelt = F.regexp_replace(F.trim(x), r"(?i)^([+-]?)inf(inity)?$", "$1Infinity") if isinstance(f.dataType, T.DoubleType) else F.trim(x)
        out.append((x if isinstance(f.dataType, T.StringType) else spelt.cast(f.dataType)).alias(f.name))
    return raw.select(*out)


def write_csv_table(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Header CSV in a fixed column order (no BOM, no index), blanks around values kept."""
    (df.select(*columns).write.mode("errorifexists").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def dictionary_entries(df: DataFrame, json_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Each JSON object text as ``(key, value)`` rows (values as text); of a key
    that an object repeats the last value holds."""
    parsed = df.select(*keep, F.map_entries(F.from_json(F.col(json_col), "map<string,string>")).alias("_e"))
    backwards = parsed.select(*keep, F.reverse(F.transform("_e", lambda x: x["key"])).alias("_k"),
                              F.reverse(F.transform("_e", lambda x: x["value"])).alias("_v"))
    last = F.transform(F.array_distinct("_k"), lambda k: F.struct(
        k.alias("key"), F.get(F.col("_v"), (F.array_position("_k", k) - 1).cast("int")).alias("value")))
    return backwards.select(*keep, F.explode_outer(last).alias("_r")).where("_r is not null").select(*keep, "_r.*")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """S4 from files: one JSON object per file; a missing path gives an empty table."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return spark.createDataFrame([], "key string, value string")
    raw = spark.read.option("wholetext", True).text(path)
    return dictionary_entries(raw, "value")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """S3 path fallback: the first of ``paths`` that exists (a driver-side
    metadata check, no data read); ``None`` when none does."""
    for p in paths:
        hpath, fs = _fs(spark, p)
        if fs.exists(hpath):
            return p
    return None
