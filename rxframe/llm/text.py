"""Column expressions shared by the operators: words, hashes, look-ups in bounded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# white space between words: the space and the control characters 9 to 13
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text in order, repeats included; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    """Number of words, without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the
    body (or a lambda in it) mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keep_columns(docs: DataFrame, **renamed: str) -> DataFrame:
    """Only the named columns, under internal names: columns of the input that
    happen to carry an output's name cannot clash."""
    return docs.select(*[F.col(f"`{c}`").alias(n) for n, c in renamed.items()])


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null equals null; the left side's keys stay."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"_right_{k}" for k in keys])
