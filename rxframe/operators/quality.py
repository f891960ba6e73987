"""Data-quality profiling (A1-A5, A13) as single-pass aggregates.

Totals that a per-group result needs are scalar subqueries (``DataFrame.scalar``),
so no result row ever pairs with a whole table and nothing is collected to the
driver; "first n" reports are ordered limits (the limit is the report).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_ids(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """A1: every id value (a missing id counts as a value) seen more than once."""
    return (df.groupBy(*id_cols).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def duplicate_keys(df: DataFrame, key: str, ord_col: str, examples: int = 5) -> DataFrame:
    """A2: keys (empty or missing ones ignored) seen more than once: how many such
    keys there are, and the first ``examples`` of them in first-seen order."""
    dup = (df.where(F.col(key).isNotNull() & (F.col(key) != ""))
           .groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(ord_col).alias("first_ord"))
           .where(F.col("n") > 1))
    n_dup = dup.select(F.count(F.lit(1))).scalar()
    return (dup.orderBy("first_ord").limit(examples)
            .withColumn("duplicate_keys", n_dup))


def field_presence(df: DataFrame, raw_json: str) -> DataFrame:
    """A3: per top-level JSON key, the number of records that lack it (a key with
    a null value is present); only keys missing somewhere."""
    total = df.select(F.count(F.lit(1))).scalar()
    keys = df.select(F.explode(F.array_distinct(F.json_object_keys(F.col(raw_json)))).alias("field"))
    return (keys.groupBy("field").agg(F.count(F.lit(1)).alias("present"))
            .select("field", (total - F.col("present")).alias("missing"))
            .where(F.col("missing") > 0))


def critical_empty(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A4: per field, records where it is missing or empty; only counts > 0."""
    counts = df.agg(*[F.count_if(F.col(f).isNull() | (F.col(f).cast("string") == "")).alias(f) for f in fields])
    return (counts.unpivot([], list(fields), "field", "empty")
            .where(F.col("empty") > 0))


def filter_report(df: DataFrame, keep) -> DataFrame:
    """A5: rows before and after a filter and the removed count, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("before"), F.count_if(keep).alias("after")).withColumn(
        "removed", F.col("before") - F.col("after"))


def dataset_status(table: DataFrame, dictionary: DataFrame, key: str, ord_col: str,
                   samples: int = 3) -> DataFrame:
    """Table rows, dictionary size and the dictionary's first keys."""
    rows = table.select(F.count(F.lit(1))).scalar()
    first = dictionary.orderBy(ord_col).limit(samples)
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ord_col, key))),
                                              lambda x: x[key]), ", ").alias("sample_keys")).select(
        rows.alias("rows"), dictionary.select(F.count(F.lit(1))).scalar().alias("map_size"), "sample_keys")
