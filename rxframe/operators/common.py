"""Small planning helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a side that may be broadcast after an explicit size check.
DEFAULT_BROADCAST_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only when it provably holds at most ``max_rows`` rows.

    The check is a ``limit(max_rows + 1).count()``, which stops reading as soon
    as the bound is exceeded.  Returns the (possibly hinted) frame and whether
    the hint was applied; callers keep a shuffle plan for the other case.
    """
    if max_rows <= 0:
        return df, False
    n = df.limit(max_rows + 1).count()
    if n <= max_rows:
        return F.broadcast(df), True
    return df, False


def salted_equi_join(left: DataFrame, right: DataFrame, key: str, buckets: int,
                     right_salt_from: str, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` with a hot-key salt.

    The (smaller) ``left`` side is replicated ``buckets`` times; each ``right``
    row lands in one bucket chosen from a hash of ``right_salt_from``.  A key
    that holds a third of ``right`` is spread over ``buckets`` tasks instead of
    one.  The salt column is dropped from the result.

    Only ``inner`` and ``right`` joins keep their meaning: the replicated
    ``left`` side must not be the preserved side of an outer join (an
    unmatched left row would come out once per bucket).
    """
    if how not in ("inner", "right"):
        raise ValueError(f"salted join supports inner and right joins, not {how!r}")
    if buckets <= 1:
        return left.join(right, key, how)
    l = left.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    r = right.withColumn("_salt", F.pmod(F.xxhash64(F.col(right_salt_from)), F.lit(buckets)).cast("int"))
    return l.join(r, [key, "_salt"], how).drop("_salt")


def keep_rows(df: DataFrame, cond) -> DataFrame:
    """``df.where(cond)`` for a condition on *computed* columns, without
    recomputing them.

    Catalyst pushes a ``Filter`` below the ``Project`` that computed the columns
    by inlining their expressions, so expensive text expressions would run
    twice (once in the pushed filter, once in the projection).  Expressing the
    filter as a generator that emits the row or nothing keeps one evaluation:
    the projection computes each column once and the generator only reads them.
    """
    return df.select(F.inline(F.when(cond, F.array(F.struct(*df.columns))).otherwise(F.array())))
