"""Texts in blocks of bounded bytes, and packed exchange of sorted 64-bit keys.

Some operators ask a global question about very many small things in a text (which
n-grams occur elsewhere, how often).  Texts are stored once in blocks; a block sends
its distinct keys, sorted and cut by their leading bits, as a few packed rows; each
range of keys is merged in one task; and only the answers that a block cannot know
by itself go back.  Keys travel as byte planes of their differences, which Spark's
shuffle compression shortens to the few bytes that differ.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxframe.session import materialize, scratch_path, scratch_table, ship_package

BLOCK_BYTES = 4 << 20
MAX_BUCKETS = 100_000  # what Spark takes by default


def store_blocks(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES,
                 bucket_bytes: int = 4 * BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``_block`` and ``_row``, written once as a table bucketed by block.

    A block is a run of rows of one input split, closed when it reaches ``block_bytes``;
    null texts become empty.  Later grouping by ``_block`` reads the buckets as they are:
    texts are never shuffled, however often they meet what was found out about them.
    """
    spark = docs.sparkSession
    ship_package(spark)
    at = docs.columns.index(text_col)

    def run(batches):
        part, seq, size, row = TaskContext.get().partitionId(), 0, 0, 0
        for b in batches:
            texts = b.column(at)
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1])
            block, rows = np.empty(len(texts), np.int64), np.empty(len(texts), np.int32)
            for i, n in enumerate(sizes.tolist()):
                if size and size + n > block_bytes:
                    seq, size, row = seq + 1, 0, 0
                block[i], rows[i] = (part << 32) + seq, row
                size, row = size + n, row + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block), pa.array(rows)],
                                             names=[*b.schema.names, "_block", "_row"])

    d = docs.withColumn(text_col, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    total = d.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]
    name = scratch_table(spark, "blocks")
    d.mapInArrow(run, f"{schema}, _block bigint, _row int").write.format("parquet") \
        .bucketBy(min(MAX_BUCKETS, max(1, math.ceil(total / bucket_bytes))), "_block") \
        .option("path", scratch_path(spark, "blocks")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


ROWS_PER_BLOCK_BITS = 12


def store_rows(docs: DataFrame, size_col: str, bucket_bytes: int = 4 * BLOCK_BYTES) -> DataFrame:
    """``docs`` as ``_row`` structs with ``_at`` (a row's number) and ``_block`` (some thousand
    consecutive ones of one input split), written once as a table bucketed by block.

    ``with_rows_at`` then picks rows by number: only the numbers travel to the blocks.
    Nothing of the rows is changed, whatever their columns are called.
    """
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length(f"`{size_col}`")), F.lit(0)).alias("n")).first()["n"]
    at = F.monotonically_increasing_id()
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), at.alias("_at"))
    name = scratch_table(spark, "rows")
    d.withColumn("_block", F.shiftright("_at", ROWS_PER_BLOCK_BITS)).write.format("parquet") \
        .bucketBy(min(MAX_BUCKETS, max(1, math.ceil(total / bucket_bytes))), "_block") \
        .option("path", scratch_path(spark, "rows")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _lists_by_block(numbers: DataFrame) -> DataFrame:
    """``numbers`` (distinct) as one list ``_kept`` per ``_block``, some thousand numbers at most.

    The lists are written first: a side with a partitioning of its own, of more partitions than
    there are buckets, would make Spark deal the stored rows anew."""
    return materialize(numbers.groupBy(F.shiftright("_at", ROWS_PER_BLOCK_BITS).alias("_block"))
                       .agg(F.collect_list("_at").alias("_kept")), "picked-rows")


def with_rows_at(stored: DataFrame, numbers: DataFrame) -> DataFrame:
    """The ``stored`` rows whose ``_at`` is in ``numbers`` (distinct), by a join on the blocks alone:
    the stored side is read as it is bucketed."""
    return stored.join(_lists_by_block(numbers), "_block").where(F.array_contains("_kept", F.col("_at"))).drop("_kept")


def marked_rows(stored: DataFrame, numbers: DataFrame, out: str) -> DataFrame:
    """All ``stored`` rows with the boolean ``out``: whether ``_at`` is in ``numbers`` (distinct).
    The lists of a bucket are hashed, so that its rows are not sorted."""
    d = stored.join(_lists_by_block(numbers).hint("shuffle_hash"), "_block", "left")
    return d.withColumn(out, F.coalesce(F.array_contains("_kept", F.col("_at")), F.lit(False))).drop("_kept")


def key_ranges(blocks: DataFrame, text_col: str, range_bytes: int) -> int:
    """Number of key ranges, a power of two: one for about ``range_bytes`` of text."""
    total = blocks.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]
    return 1 << max(0, math.ceil(math.log2(max(1, total / range_bytes))))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, a space after each, and where each starts."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return data, np.cumsum(sizes) - sizes


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as byte planes of their differences."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return np.ascontiguousarray(counts, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()


def split_ranges(keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted keys by their leading bits; empty ranges are left out."""
    if not len(keys):
        return []
    shift = 64 - (ranges.bit_length() - 1)
    of = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    cut = np.flatnonzero(np.diff(of)) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
    return [(int(of[s]), int(s), int(e)) for s, e in zip(starts, ends)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over scrambled byte values, by prefix sums."""
    power = np.cumprod(np.full(len(data) + 1, _BASE, np.uint64), dtype=np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * power[:-1], out=sums[1:], dtype=np.uint64)
    value = sums[ends] - sums[starts]
    del power, sums
    back = np.cumprod(np.full(len(data) + 1, _INVERSE, np.uint64), dtype=np.uint64)[starts]
    return mix(value * back + (ends - starts).astype(np.uint64))
