"""Deterministic lookups into the master table.

Every first/last rule uses an explicit order column (unique within the lookup):
the smallest or greatest order per key is a hash aggregate over two narrow columns
(a hot key costs one row per map task) of the rows that are ``usable``, a predicate that is
evaluated in this one pass; the texts of these winners alone are then fetched by (key,
order), cleaned, and joined to the master.  The reduced side holds one row per distinct key; Spark
and AQE broadcast it when its measured size is small and shuffle otherwise.
Keys are compared null-safely: a missing key of the master finds a missing key
of the lookup, as dictionary lookups of pandas cells do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _winners(df: DataFrame, key: str, ord_col: str, cols: Sequence[str], best, usable: Column | None) -> DataFrame:
    rows = df if usable is None else df.where(usable)
    won = rows.groupBy(F.col(key).alias("_wk")).agg(best.alias("_wo"))
    return df.join(won, (F.col(ord_col) == F.col("_wo")) & F.col(key).eqNullSafe(F.col("_wk"))).select(key, *cols)


def first_per_key(df: DataFrame, key: str, ord_col: str, cols: Sequence[str], usable: Column | None = None) -> DataFrame:
    """For each ``key`` the ``cols`` of the (usable) row with the smallest ``ord_col``."""
    return _winners(df, key, ord_col, cols, F.min(ord_col), usable)


def last_per_key(df: DataFrame, key: str, ord_col: str, cols: Sequence[str], usable: Column | None = None) -> DataFrame:
    """For each ``key`` the ``cols`` of the (usable) row with the greatest ``ord_col``."""
    return _winners(df, key, ord_col, cols, F.max(ord_col), usable)


Finish = dict[str, Callable]


def _left_lookup(master: DataFrame, master_key: str, reduced: DataFrame, lookup_key: str,
                 cols: Sequence[str], prefix: str, finish: Finish | None = None) -> DataFrame:
    """Left join of the one-row-per-key lookup.  ``finish`` maps a lookup column
    to a row-wise function applied after the reduction, so expensive cleaning
    runs once per key instead of once per lookup row (valid for functions that
    keep null-ness, since the winner is chosen on null-ness and order only)."""
    finish = finish or {}
    r = reduced.select(F.col(lookup_key).alias("_lk"),
                       *[(finish[c](F.col(c)) if c in finish else F.col(c)).alias(prefix + c) for c in cols])
    return master.join(r, master[master_key].eqNullSafe(r["_lk"]), "left").drop("_lk")


def with_text(lookup: DataFrame, col: str, finish: Finish | None = None) -> DataFrame:
    """F3-F5 before a lookup: rows whose ``col``, cleaned, is missing or empty go, so
    that they neither win nor replace another row's text."""
    clean = (finish or {}).get(col)
    return lookup.where((clean(F.col(col)) if clean else F.col(col)) != "")


def _present(require: str, usable: Column | None) -> Column:
    present = F.col(require).isNotNull()
    return present if usable is None else present & usable


def lookup_first_wins(master: DataFrame, lookup: DataFrame, *, master_key: str, lookup_key: str,
                      ord_col: str, require: str, take: dict[str, str], finish: Finish | None = None,
                      usable: Column | None = None) -> DataFrame:
    """Among usable lookup rows whose ``require`` column is present, the first row per
    key supplies all ``take`` columns together (``{lookup_col: master_col}``);
    the master columns are (re)set from it, missing when the key has no row."""
    cols = list(take)
    reduced = first_per_key(lookup, lookup_key, ord_col, cols, _present(require, usable))
    out = _left_lookup(master.drop(*take.values()), master_key, reduced, lookup_key, cols, "_n_", finish)
    for src, dst in take.items():
        out = out.withColumnRenamed("_n_" + src, dst)
    return out


def lookup_gap_fill(master: DataFrame, lookup: DataFrame, *, master_key: str, lookup_key: str,
                    ord_col: str, require: str, take: dict[str, str], finish: Finish | None = None,
                    usable: Column | None = None) -> DataFrame:
    """First-wins rows as in J2, but every master column is only filled
    where it is missing, each column on its own."""
    cols = list(take)
    reduced = first_per_key(lookup, lookup_key, ord_col, cols, _present(require, usable))
    out = _left_lookup(master, master_key, reduced, lookup_key, cols, "_n_", finish)
    for src, dst in take.items():
        out = out.withColumn(dst, F.coalesce(F.col(dst), F.col("_n_" + src))).drop("_n_" + src)
    return out


def lookup_last_wins(master: DataFrame, lookup: DataFrame, *, master_key: str, lookup_key: str,
                     ord_col: str, value: str, target: str, default: str = "",
                     finish: Finish | None = None, usable: Column | None = None) -> DataFrame:
    """Replace ``target`` by the value of the last (usable) lookup row with the key
    (a missing value included), ``default`` where there is none.  Idempotent."""
    reduced = last_per_key(lookup, lookup_key, ord_col, [value], usable)
    out = _left_lookup(master.drop(target), master_key, reduced, lookup_key, [value], "_n_", finish)
    return out.withColumn(target, F.coalesce(F.col("_n_" + value), F.lit(default))).drop("_n_" + value)


def nest_details(parent: DataFrame, detail: DataFrame, *, key: str, fields: Sequence[str],
                 ord_col: str, as_col: str = "details") -> DataFrame:
    """Attach to each parent row the list of its detail rows (ordered by
    ``ord_col``) as ``array<struct>``; no detail gives ``[]``.  The detail side is
    grouped once per key (one shuffle) and then joined."""
    nested = detail.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("_o"), *fields))),
                    lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(as_col))
    empty = F.array().cast(nested.schema[as_col].dataType)
    return (parent.join(nested, key, "left")
            .withColumn(as_col, F.coalesce(F.col(as_col), empty)))


def resume_todo(todo: DataFrame, done: DataFrame, key: str, done_key: str | None = None) -> DataFrame:
    """A11 + J5: distinct non-missing names of ``todo`` not yet in ``done``."""
    names = todo.select(key).dropna().distinct()
    d = done.select(F.col(done_key or key).alias(key))
    return names.join(d, key, "left_anti")


def first_seen_by_derived_key(df: DataFrame, *, key_expr, value: str, ord_col: str,
                              key_name: str = "key") -> DataFrame:
    """One row per derived key, keeping the original value first seen."""
    return (df.select(key_expr.alias(key_name), F.col(value), F.col(ord_col))
            .groupBy(key_name).agg(F.min_by(value, ord_col).alias(value), F.min(ord_col).alias(ord_col)))


def union_by_name(earlier: DataFrame, new: DataFrame) -> DataFrame:
    """Stack results by column name; a column only one side has is null on
    the other; duplicates kept."""
    return earlier.unionByName(new, allowMissingColumns=True)
