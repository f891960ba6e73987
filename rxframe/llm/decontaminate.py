"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming
look-up, exact weighted-shingle similarity.

1. Every text becomes hashes of its word shingles (five words; an item with fewer
   words is one shingle of its own length, looked for at that length).
2. A fixed-size Bloom filter of the benchmark's shingles keeps the stretches of
   text that can matter: a window without any shingle of an item has similarity 0
   to it, so nothing is lost and false hits only cost time.
3. In these stretches every window of the size of an item that shares a shingle
   gets a 64-bit SimHash (each occurrence of a shingle votes).
4. Items are indexed by eight 8-bit blocks with all values up to 2 bits away:
   fingerprints within ``RADIUS`` = 23 bits agree within 2 bits in some block, so
   the look-up misses none of them.  At similarity 0.8 about 10 of 64 bits differ
   (spread 3), which leaves more than four spreads.
5. Candidates within the radius are verified by exact weighted Jaccard similarity
   of the shingle multisets (weight: number of occurrences).

All steps are DataFrame operations.  The text is read once; what is shuffled is
the stretches around hits.  Only the filter (at most ``MAX_BITS``) and a few
numbers reach the driver.

Defined results: words are split at white space, A-Z counts as a-z.  Null and
blank texts and items never match.  A text with fewer words than an item is one
window as it is.  Rows with equal id and text are one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxframe.llm.text import ascii_lower, join_same, let, words
from rxframe.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BLOCK_BITS, BLOCKS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
MIN_BITS, MAX_BITS = 1 << 18, 1 << 23
PROBES = 4
# rows of the benchmark's own tables that may be sent to every task
BROADCAST_ROWS = 1_000_000
_PAIR = 0x100000001  # the lowest bit of each half of a long


def _shingles(word_hashes: str, size: Column | int) -> Column:
    """Hashes of the shingles of ``size`` words over an array of word hashes."""
    w = F.col(word_hashes)
    if isinstance(size, int):
        at = [lambda i, k=k: F.get(w, i + k) for k in range(1, size)]
        return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(0))),
                           lambda x, i: F.xxhash64(x, *[f(i) for f in at]))
    return reduce(lambda other, s: F.when(size == s, _shingles(word_hashes, s)).otherwise(other),
                  range(1, SHINGLE + 1), F.array().cast("array<bigint>"))


def simhash(shingles: Column, n: Column) -> Column:
    """64-bit SimHash of an array of hashes: a bit is set if set in over half of them.

    Counts of bit ``k`` and bit ``k + 32`` share one long, one in each half.
    """
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(32)])
    counts = F.aggregate(shingles, zero, lambda a, h: F.struct(
        *[(a[f"c{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_PAIR))).alias(f"c{k}") for k in range(32)]))
    # adding this to a count sets bit 30 of its half exactly if 2 * count > n
    lift = (F.lit(0x3FFFFFFF) - F.floor(n / 2)).cast("long") * F.lit(_PAIR)

    def bits(c: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(32):
            top = F.shiftrightunsigned(c[f"c{k}"] + c["lift"], 30).bitwiseAND(F.lit(_PAIR))
            out = out.bitwiseOR(F.shiftleft(top, k))
        return out

    return let(let(counts, lambda c: c.withField("lift", lift)), bits)


def benchmark_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item``, ``size`` (words a shingle), ``n`` (shingles), ``hs``, ``fp``."""
    d = items.select(F.col(f"`{id_col}`").alias("item"),
                     F.transform(words(ascii_lower(F.col(f"`{text_col}`"))), lambda w: F.xxhash64(w)).alias("_w"))
    d = d.where("size(_w) > 0").withColumn("size", F.least(F.size("_w"), F.lit(SHINGLE)))
    d = d.withColumn("hs", _shingles("_w", F.col("size"))).withColumn("n", F.size("hs"))
    return materialize(d.select("item", "size", "n", "hs", simhash(F.col("hs"), F.col("n")).alias("fp")), "leak-items")


def _filter_words(items: DataFrame, size: int, bits: int) -> list[int]:
    """A Bloom filter of the items' shingles, as ``bits / 64`` longs."""
    h = items.where(F.col("size") == size).select(F.explode("hs").alias("h")).distinct()
    bit = h.select(F.explode(F.array(*_probes(F.col("h"), bits))).alias("b"))
    rows = bit.groupBy((F.col("b") / 64).cast("int").alias("at")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("w")).collect()
    out = [0] * (bits // 64)
    for r in rows:
        out[r["at"]] = r["w"]
    return out


def _probes(h: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(h, 13 * k).bitwiseAND(F.lit(bits - 1)) for k in range(PROBES - 1)] + \
        [F.xxhash64(h).bitwiseAND(F.lit(bits - 1))]


def _maybe(h: Column, filter_words: list[int]) -> Column:
    """Whether the filter may hold ``h``: false is certain."""
    bits = len(filter_words) * 64
    table = F.split(F.lit(",".join(map(str, filter_words))), ",").cast("array<bigint>")
    tests = [F.getbit(F.get(table, F.shiftrightunsigned(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1
             for b in _probes(h, bits)]
    return reduce(lambda a, b: a & b, tests)


def _stretches(docs: DataFrame, items: DataFrame, size: int, grid: int, bits: int) -> DataFrame:
    """Stretches of documents with a possible hit: ``_id``, ``_x``, ``c`` (number of
    the stretch), ``hs`` (shingles of it and of the next one)."""
    maybe = _filter_words(items, size, bits)
    d = docs.withColumn("_hs", _shingles("_w", size))
    # no conditional expression around the filter's table: it must fold to one constant
    at = F.transform("_hs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    hit = F.transform(F.filter(at, lambda x: _maybe(x["h"], maybe)), lambda x: F.floor(x["i"] / grid).cast("int"))
    d = d.withColumn("_c", F.array_distinct(hit))
    # a window that covers a hit starts in the hit's stretch or the one before; no hit, no row
    starts = F.filter(F.array_distinct(F.concat("_c", F.transform("_c", lambda c: c - 1))), lambda c: c >= 0)
    d = d.withColumn("_s", F.transform(starts, lambda c: F.struct(
        c.alias("c"), F.slice(F.col("_hs"), c * grid + 1, F.lit(2 * grid)).alias("hs"))))
    # the outer form: Spark infers no filter from it, which would be pushed below and
    # repeat the work on the whole text, for each element
    return d.select("_id", "_x", F.size("_hs").alias("total"), F.explode_outer("_s").alias("s")) \
        .where("s is not null").select("_id", "_x", "total", "s.c", "s.hs")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and item with a window of similarity ``similarity`` or
    more: ``_id``, ``_x`` (hash of the text), ``item``, ``word`` (where the best window
    starts, the first of equals), ``similarity``, ``distance`` (bits)."""
    items = benchmark_items(benchmark, item_id, item_text)
    facts = items.groupBy("size").agg(F.max("n").alias("grid"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("count")).collect()
    text = F.col(f"`{text_col}`")
    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_x"),
                    F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w)).alias("_w"))
    found = [_leaks_of_size(d, items, r["size"], r["grid"], r["n"], r["count"], similarity) for r in facts]
    if not found:
        empty = d.select("_id", "_x").where(F.lit(False))
        item_type = benchmark.schema[item_id].dataType
        return empty.select("_id", "_x", F.lit(None).cast(item_type).alias("item"), F.lit(0).alias("word"),
                            F.lit(0.0).alias("similarity"), F.lit(0).alias("distance"))
    return reduce(DataFrame.unionByName, found)


def _block_mask(b: int) -> int:
    mask = ((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * b)
    return mask - (1 << 64) if mask >> 63 else mask


def _probe(windows: DataFrame, blocks: list[Column]) -> DataFrame:
    return windows.withColumn("k", F.explode(F.array(*blocks))).select("*", "k.b", "k.v").drop("k")


def _numbered(hs: Column) -> Column:
    """Shingles told apart by their number among equal ones: multisets as sets."""
    return let(F.sort_array(hs), lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i - F.array_position(s, x))))


def _leaks_of_size(d: DataFrame, items: DataFrame, size: int, grid: int, shingles: int, count: int, similarity: float) -> DataFrame:
    bits = MIN_BITS
    while bits < min(MAX_BITS, 32 * shingles):
        bits *= 2
    mine = items.where(F.col("size") == size)
    stretch = materialize(_stretches(d, items, size, grid, bits).distinct(), "leak-stretches")
    key = ["_id", "_x", "c"]

    # which window sizes a stretch needs: those of the items that it shares a shingle with
    index = mine.select("n", F.explode("hs").alias("h")).distinct()
    index = F.broadcast(index) if shingles <= BROADCAST_ROWS else index
    sizes = stretch.select(*key, F.explode(F.array_distinct("hs")).alias("h")).join(index, "h") \
        .select(*key, "n").distinct()
    w = join_same(stretch, sizes, key)
    last = F.least(F.lit(grid), F.size("hs") - F.col("n") + 1) - 1
    whole = (F.col("total") < F.col("n")) & (F.col("c") == 0)
    starts = F.when(whole, F.array(F.lit(0))).when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    w = w.withColumn("s", F.explode(starts))
    w = w.select("_id", "_x", (F.col("c") * grid + F.col("s")).alias("word"), "n",
                 F.slice("hs", F.col("s") + 1, F.col("n")).alias("hs"))
    w = materialize(w.withColumn("fp", simhash(F.col("hs"), F.size("hs"))), "leak-windows")

    blocks = [F.struct(F.lit(b).alias("b"), F.shiftrightunsigned("fp", BLOCK_BITS * b).bitwiseAND(F.lit(255)).alias("v"))
              for b in range(BLOCKS)]
    flips = [x for x in range(1 << BLOCK_BITS) if bin(x).count("1") <= BLOCK_RADIUS]
    near = mine.select("item", "n", F.col("fp").alias("fi"), F.explode(F.array(*blocks)).alias("k")) \
        .select("item", "n", "fi", "k.b", F.explode(F.transform(
            F.array(*map(F.lit, flips)), lambda x: F.col("k.v").bitwiseXOR(x.cast("long")))).alias("v"))
    small = count * BLOCKS * len(flips) <= BROADCAST_ROWS and shingles <= BROADCAST_ROWS
    xor = F.col("fp").bitwiseXOR(F.col("fi"))
    first = F.coalesce(*[F.when(F.bit_count(xor.bitwiseAND(F.lit(_block_mask(b)))) <= BLOCK_RADIUS, F.lit(b)) for b in range(BLOCKS)])
    at = ["_id", "_x", "word", "n"]
    found = ((F.bit_count(xor) <= RADIUS) & (F.col("b") == first))  # once, at the first block that agrees
    tagged = mine.select("item", _numbered(F.col("hs")).alias("hi"))
    if small:  # the windows stay where they are and meet the index, then the items, there
        cand = _probe(w.select(*at, "fp", "hs"), blocks).join(F.broadcast(near), ["n", "b", "v"]).where(found) \
            .select(*at, "item", F.bit_count(xor).alias("distance"), "hs").join(F.broadcast(tagged), "item")
    else:  # fingerprints alone are shuffled to the index, matches back to their windows
        cand = _probe(w.select(*at, "fp"), blocks).join(near, ["n", "b", "v"]).where(found) \
            .select(*at, "item", F.bit_count(xor).alias("distance"))
        cand = join_same(cand, w.select(*at, "hs"), at).join(tagged, "item")
    both = F.size(F.array_intersect(_numbered(F.col("hs")), F.col("hi")))
    sim = let(both, lambda x: x / (F.size("hs") + F.size("hi") - x))
    best = cand.select("_id", "_x", "item", "word", "distance", sim.alias("sim")).where(F.col("sim") >= similarity) \
        .groupBy("_id", "_x", "item").agg(F.max(F.struct("sim", (-F.col("word")).alias("back"), "distance")).alias("m"))
    return best.select("_id", "_x", "item", (-F.col("m.back")).alias("word"), F.col("m.sim").alias("similarity"),
                       F.col("m.distance").alias("distance"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    found = materialize(leaks(docs, benchmark, id_col, text_col, item_id, item_text).select("_id", "_x").distinct(), "leaks")
    # columns by number, so that none of the rows' own names can clash
    d = docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))])
    mine, text = (f"_in{docs.columns.index(c)}" for c in (id_col, text_col))
    ids = found.withColumnsRenamed({"_id": "_leak_id", "_x": "_leak_x"})
    here = (F.xxhash64(F.col(text)) == F.col("_leak_x")) & F.col(mine).eqNullSafe(F.col("_leak_id"))
    return d.join(ids, here, "left_anti").toDF(*docs.columns)
