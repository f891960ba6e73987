"""Removal of repeated byte strings with suffix arrays sorted in two stages.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier (in an
earlier document, or earlier in the same one); strings are judged on the input.

1. Anchors.  In every string of ``length`` bytes the 32-byte gram of smallest hash (the
   leftmost of equals) is its anchor, so equal strings have equal anchors at equal
   places.  Texts are stored in blocks; a block sends its distinct anchor hashes, packed,
   and learns which occur elsewhere too.  A string with an anchor that occurs once is
   unique; all others are candidates.
2. Contexts.  A run of strings with one anchor is one context, at most 168 bytes.  Equal
   contexts (by hashes of anchor and context) are reduced with map-side combine to their
   first place.  A string holds either the 34 bytes before its anchor or the 35 bytes
   after it: a context has two sides, and strings of a side that occurs in one context
   only are unique (short lines that very many texts share are of this kind).  Only the
   pieces of contexts with a side in common are fetched as bytes.
3. Suffix arrays.  Pieces with one side meet in one task.  Their suffixes are sorted in
   two stages: those smaller than their successors directly, all others by scanning the
   buckets in order, each taking its place from its successor's.  Adjacent common
   prefixes of ``length`` or more make a class of equal strings, whose first place stays;
   every other candidate goes.
4. Each block gets back the places that stay, marks the rest and digests what is left.

Whole copies of a text are found by digest before step 2: all their strings start
earlier.  A side with over ``big_side`` different pieces (a passage in very many
surroundings) is not gathered: its strings are grouped by value with map-side combine.
No task holds more than a block, a range of hashes or about ``range_bytes`` of contexts.

Defined results: a null text is empty.  Null ids come after all others; equal ids go by
their place in the input.  Texts shorter than ``length`` stay whole.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rxframe.llm import blocks as B
from rxframe.session import materialize

LENGTH = 100
GRAM = 32
BIG_SIDE = 20_000
RANGE_BYTES = 64 << 20
CONTEXT_BYTES = 2 << 20
_STEP = 1 << 20
_MULTIPLIER = 0xD1342543DE82EF95


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM`` bytes from each place on, by doubling."""
    h, m = B.BYTE_VALUES[data], 1
    while m < GRAM:
        h = h[:-m] * np.uint64(pow(_MULTIPLIER, m, 1 << 64)) + h[m:]
        m *= 2
    return B.mix(h)


def _leftmost_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` values in a row, the leftmost of equals."""
    value, place, m = h, np.arange(len(h), dtype=np.int32), 1
    while m < width:
        step = min(m, width - m)
        left = value[:-step] <= value[step:]
        value, place = np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:])
        m += step
    return place


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: (text number, first start, last start, anchor
    hash, anchor's place in the first string)."""
    out, group, first, size = [], [], 0, 0
    for i, t in enumerate(texts):
        group.append(t)
        size += len(t)
        if size < _STEP and i < len(texts) - 1:
            continue
        if size >= length:
            data = np.frombuffer(b"".join(group), np.uint8)
            sizes = np.fromiter(map(len, group), np.int64, len(group))
            starts = np.cumsum(sizes) - sizes
            h = gram_hashes(data)
            place = _leftmost_minimum(h, length - GRAM + 1)
            doc = np.repeat(np.arange(len(group)), sizes)[:len(place)]
            valid = np.flatnonzero(np.arange(len(place)) - starts[doc] + length <= sizes[doc])
            if len(valid):
                d, p = doc[valid], place[valid]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 0) | (np.diff(d) != 0)]))
                last = np.concatenate([new[1:], [len(valid)]]) - 1
                out.append((d[new] + first, valid[new] - starts[d[new]], valid[last] - starts[d[new]], h[p[new]],
                            p[new] - valid[new]))
        group, first, size = [], i + 1, 0
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _words(symbols: np.ndarray) -> np.ndarray:
    """Seven 9-bit symbols from each place on in one number, zeros from a separator on."""
    n = len(symbols)
    wide = np.concatenate([symbols, np.zeros(7, symbols.dtype)]).astype(np.int64)
    out, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(7):
        s = wide[j:j + n]
        alive &= s != 0
        out = (out << 9) | np.where(alive, s, 0)
    return out


def sort_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of strings of symbols 1..256, a 0 after each; equal suffixes go by place.

    A suffix reaches to its separator.  Stage 1 sorts the suffixes smaller than their
    successors (and the separators) by their symbols; stage 2 takes the others bucket by
    bucket in the order of their successors, which are smaller and so placed already.
    """
    n = len(symbols)
    s = symbols.astype(np.int64)
    change = np.append(np.flatnonzero(np.diff(s) != 0), n - 1)
    run_end = change[np.searchsorted(change, np.arange(n))]  # last place of the run of equal symbols
    after = s[np.minimum(run_end + 1, n - 1)]
    smaller = (s == 0) | (s < after)
    start = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=257))])
    larger_in = np.bincount(s[~smaller], minlength=257)
    rank = np.empty(n, np.int64)

    # stage 1: refine by seven symbols at a time, ties only
    words = np.concatenate([_words(symbols), np.zeros(1, np.int64)])
    end = np.flatnonzero(s == 0)
    end = end[np.searchsorted(end, np.arange(n))]
    order = np.flatnonzero(smaller)
    group = np.zeros(len(order), np.int64)
    active, depth = np.arange(len(order)), 0
    while len(active):
        at = order[active]
        key = words[np.where(at + depth <= end[at], at + depth, n)]
        by = np.lexsort((key, group[active]))  # stable: equal keys stay in the order of their places
        order[active], key, g = at[by], key[by], group[active][by]
        new = np.concatenate([[True], (np.diff(g) != 0) | (np.diff(key) != 0)])
        group[active] = active[np.flatnonzero(new)][np.cumsum(new) - 1]
        single = new & np.append(new[1:], True)
        done = single | ((key & 511) == 0)  # ended at a separator: equal strings go by place
        active, depth = active[~done], depth + 7
    first = s[order]
    within = np.arange(len(order)) - np.searchsorted(first, first)
    rank[order] = start[first] + larger_in[first] + within

    # stage 2: by first symbol, then by the length of its run, in the order of the successors
    rest = np.flatnonzero(~smaller)
    level = run_end[rest] - rest
    by = np.lexsort((level, s[rest]))
    rest, level = rest[by], level[by]
    cut = np.flatnonzero((np.diff(s[rest]) != 0) | (np.diff(level) != 0)) + 1
    free = start[:-1].copy()
    for part in np.split(rest, cut) if len(rest) else []:
        c = s[part[0]]
        placed = part[np.argsort(rank[part + 1], kind="stable")]
        rank[placed] = free[c] + np.arange(len(placed))
        free[c] += len(placed)
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def common_prefixes(symbols: np.ndarray, suffixes: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to ``limit``."""
    words = np.concatenate([_words(symbols), np.zeros(limit + 8, np.int64)])
    out = np.zeros(len(suffixes), np.int64)
    at = np.arange(1, len(suffixes))
    for depth in range(0, limit, 7):
        a, b = words[suffixes[at - 1] + depth], words[suffixes[at] + depth]
        equal = (a == b) & ((a & 511) != 0)  # a word without separators ends in a symbol
        out[at[equal]] += 7
        a, differ, end = a[~equal], (a ^ b)[~equal], at[~equal]
        same = np.zeros(len(end), np.int64)
        for j in range(6, -1, -1):  # the first of the seven symbols that differs or is a separator
            shift = 9 * (6 - j)
            same = np.where(((differ >> shift) & 511 != 0) | ((a >> shift) & 511 == 0), j, same)
        out[end] += same
        at = at[equal]
    return np.minimum(out, limit)


def first_places(contexts: list[bytes], documents: np.ndarray, starts: np.ndarray, length: int = LENGTH):
    """Strings of ``length`` bytes in distinct contexts -> the first place of each.

    ``documents`` are the order of the contexts' documents, ``starts`` their places in
    them.  Returns (context, offset) of the strings that come first.
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    symbols = np.zeros(int(sizes.sum()) + len(contexts), np.uint16)
    at = np.cumsum(sizes + 1) - sizes - 1
    context = np.repeat(np.arange(len(contexts)), sizes + 1)
    offset = np.arange(len(symbols)) - at[context]
    symbols[offset < sizes[context]] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.uint16) + 1
    order = sort_suffixes(symbols)
    prefix = common_prefixes(symbols, order, length)
    string = offset[order] + length <= sizes[context[order]]
    group = np.cumsum(prefix < length)[string]
    place = order[string]
    c, o = context[place], offset[place]
    by = np.lexsort((starts[c] + o, documents[c], group))
    head = by[np.concatenate([[True], np.diff(group[by]) != 0])] if len(by) else by
    return c[head], o[head]


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted whole numbers as runs: first and last of each."""
    cut = np.flatnonzero(np.diff(places) != 1)
    return places[np.concatenate([[0], cut + 1])], places[np.append(cut, len(places) - 1)]


def _hash(data: bytes) -> int:
    """64 bits, signed; never alone a key, always beside the anchor's hash."""
    h = xxhash.xxh64_intdigest(data, 7)
    return h - (1 << 64) if h >> 63 else h


def _bytes(column) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _repeated_anchors(stored: DataFrame, length: int, range_bytes: int) -> DataFrame:
    """Per block the anchor hashes that it has once and other blocks have too."""
    ranges = B.key_ranges(stored, "_text", range_bytes)

    def send(batches):
        for b in batches:
            ids, texts = np.asarray(b.column(0)), _bytes(b.column(1))
            for block in np.unique(ids).tolist():  # a block in several batches counts as several
                h = anchors([t for t, i in zip(texts, ids) if i == block], length)[3]
                keys, n = np.unique(h, return_counts=True)
                parts = B.split_ranges(keys, ranges)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r for r, _, _ in parts], pa.int64()), pa.array([block] * len(parts), pa.int64()),
                    pa.array([B.pack(keys[s:e]) for _, s, e in parts], pa.binary()),
                    pa.array([np.minimum(n[s:e], 2).astype(np.uint8).tobytes() for _, s, e in parts], pa.binary())],
                    names=["range", "_block", "keys", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        keys = [B.unpack(k.as_py()) for k in table.column("keys")]
        counts = [np.frombuffer(c.as_py(), np.uint8) for c in table.column("counts")]
        unique, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(counts), minlength=len(unique))
        out, at = {"_block": [], "keys": []}, 0
        for block, k in zip(table.column("_block").to_pylist(), keys):
            more = total[where[at:at + len(k)]] > 1
            at += len(k)
            if more.any():
                out["_block"].append(block)
                out["keys"].append(B.pack(k[more]))
        return pa.table({"_block": pa.array(out["_block"], pa.int64()), "keys": pa.array(out["keys"], pa.binary())})

    sent = stored.select("_block", "_text").mapInArrow(send, "range bigint, _block bigint, keys binary, counts binary")
    return sent.groupBy("range").applyInArrow(merge, "_block bigint, keys binary")


def _copies(stored: DataFrame, length: int) -> DataFrame:
    """(``_block``, ``rows``): texts of ``length`` bytes or more that an earlier row has, too."""
    light = stored.where(F.octet_length("_text") >= length) \
        .select(F.md5("_text").alias("d"), F.octet_length("_text").alias("n"), F.col("_id").isNull().alias("none"),
                "_id", "_block", "_row")
    firsts = light.groupBy("d", "n").agg(F.min(F.struct("none", "_id", "_block", "_row")).alias("f"), F.count(F.lit(1)).alias("c"))
    firsts = firsts.where("c > 1").select("d", "n", F.col("f._block").alias("fb"), F.col("f._row").alias("fr"))
    return light.join(firsts, ["d", "n"]).where("not (_block = fb and _row = fr)") \
        .groupBy("_block").agg(F.collect_list("_row").alias("rows"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 big_side: int = BIG_SIDE, block_bytes: int = B.BLOCK_BYTES, range_bytes: int = RANGE_BYTES,
                 context_bytes: int = CONTEXT_BYTES, with_bytes: bool = False) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``
    and, if asked for, the bytes that are left (``kept``)."""
    id_type = docs.schema[id_col].dataType
    id_sql, id_arrow = id_type.simpleString(), to_arrow_type(id_type)
    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    stored = B.store_blocks(d, "_text", block_bytes)
    copies = materialize(_copies(stored, length), "repeat-copies")
    known = _repeated_anchors(stored, length, range_bytes)
    known = known.select("_block", "keys", F.lit(None).cast("array<int>").alias("rows")).unionByName(
        copies.select("_block", F.lit(None).cast("binary").alias("keys"), "rows"))

    half = (length - GRAM) // 2
    place = ["none", "_id", "_block", "_row", "lo"]

    def find(texts: pa.Table, known: pa.Table) -> pa.Table:
        names = ("h", "context", "left", "right", "off", "none", "_id", "_block", "_row", "lo", "hi")
        out = {c: [] for c in names}
        if texts.num_rows:
            rows, ids, data = texts.column("_row").to_pylist(), texts.column("_id").to_pylist(), _bytes(texts.column("_text"))
            block = texts.column("_block")[0].as_py()
            skip = {r for x in known.column("rows").to_pylist() if x for r in x}
            doc, lo, hi, h, off = anchors(data, length)
            keys = np.concatenate([B.unpack(k) for k in known.column("keys").to_pylist() if k is not None]
                                  or [np.zeros(0, np.uint64)])
            own, n = np.unique(h, return_counts=True)
            repeated = np.isin(h, np.concatenate([keys, own[n > 1]]))
            for i, a, z, key, at in zip(doc[repeated].tolist(), lo[repeated].tolist(), hi[repeated].tolist(),
                                        h[repeated].view(np.int64).tolist(), off[repeated].tolist()):
                if rows[i] in skip:
                    continue
                t, g = data[i], a + at
                left = _hash(t[g - half:g + GRAM]) if at >= half else None
                right = _hash(t[g:g + length - half + 1]) if z - a > at - half else None
                for c, v in zip(names, (key, _hash(t[a:z + length]), left, right, at, ids[i] is None, ids[i], block, rows[i], a, z)):
                    out[c].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), id_arrow, pa.int64(), pa.int32(),
                 pa.int32(), pa.int32())
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})

    found = materialize(stored.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(
        find, f"h bigint, context bigint, left bigint, right bigint, off int, none boolean, _id {id_sql}, _block bigint, "
              "_row int, lo int, hi int"), "repeat-contexts")
    firsts = found.groupBy("h", "context").agg(F.min(F.struct(*place, "hi", "off", "left", "right")).alias("f")).select("h", "f.*")
    cut = F.col("lo") + F.col("off") - half  # the last start with ``half`` bytes before the anchor
    sides = firsts.select("h", *place, F.posexplode(F.array(
        F.when(F.col("left").isNotNull(), F.struct(F.col("left").alias("side"), F.col("lo").alias("a"), F.least(cut, "hi").alias("z"))),
        F.when(F.col("right").isNotNull(), F.struct(F.col("right").alias("side"), F.greatest(cut + 1, "lo").alias("a"), F.col("hi").alias("z")))
    )).alias("k", "s")).where("s is not null").select("h", "k", "s.side", "none", "_id", "_block", "_row", "s.a", "s.z")
    sides = materialize(sides, "repeat-sides")
    counts = sides.groupBy("h", "k", "side").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sides = materialize(sides.join(counts, ["h", "k", "side"], "left"), "repeat-counted")
    once = sides.where("n is null").select("_block", "_row", F.col("a").alias("lo"), F.col("z").alias("hi"))

    def fetch(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        data = dict(zip(texts.column("_row").to_pylist(), _bytes(texts.column("_text"))))
        piece = [data[r][a:z + length] for r, a, z in zip(*[wanted.column(c).to_pylist() for c in ("_row", "a", "z")])]
        return wanted.select(["h", "k", "side", "n", "none", "_id", "_block", "_row", "a"]) \
            .append_column("piece", pa.array(piece, pa.binary()))

    pieces = materialize(stored.select("_block", "_row", "_text").groupBy("_block").cogroup(
        sides.where("n is not null").groupBy("_block")).applyInArrow(
        fetch, f"h bigint, k int, side bigint, n bigint, none boolean, _id {id_sql}, _block bigint, _row int, a int, piece binary"),
        "repeat-pieces")
    size = pieces.agg(F.coalesce(F.sum(F.length("piece")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, math.ceil(size / context_bytes))

    def first(table: pa.Table) -> pa.Table:
        ids = table.column("_id").to_pylist()
        codes = {v: i for i, v in enumerate(sorted({v for v in ids if v is not None}))}
        code = np.array([codes.get(v, len(codes)) for v in ids])
        block, row, lo = (np.asarray(table.column(c)).astype(np.int64) for c in ("_block", "_row", "a"))
        by = np.lexsort((row, block, code))
        new = np.concatenate([[0], np.cumsum((np.diff(code[by]) != 0) | (np.diff(block[by]) != 0) | (np.diff(row[by]) != 0))])
        document = np.empty(len(by), np.int64)
        document[by] = new
        c, o = first_places(table.column("piece").to_pylist(), document, lo, length)
        by = np.lexsort((o, c))
        c, o = c[by], o[by]
        a, z = _runs(c * (1 << 32) + o)
        c = a >> 32
        return pa.table({"_block": pa.array(block[c]), "_row": pa.array(row[c].astype(np.int32)),
                         "lo": pa.array((lo[c] + a - (c << 32)).astype(np.int32)),
                         "hi": pa.array((lo[c] + z - (c << 32)).astype(np.int32))})

    stays = pieces.where(F.col("n") <= big_side) \
        .withColumn("bucket", F.pmod(F.xxhash64("h", "k", "side"), F.lit(buckets))) \
        .groupBy("bucket").applyInArrow(first, "_block bigint, _row int, lo int, hi int")
    # crowded sides: strings by value
    strings = pieces.where(F.col("n") > big_side).select("h", "piece", "none", "_id", "_block", "_row", "a", F.explode(
        F.sequence(F.lit(0), F.length("piece") - length)).alias("o"))
    strings = strings.groupBy("h", F.substring("piece", F.col("o") + 1, F.lit(length)).alias("string")) \
        .agg(F.min(F.struct("none", "_id", "_block", "_row", (F.col("a") + F.col("o")).alias("lo"))).alias("f"))
    stays = stays.unionByName(once).unionByName(
        strings.select("f._block", "f._row", F.col("f.lo").alias("lo"), F.col("f.lo").alias("hi")))

    marks = found.select("_block", "_row", F.lit(1).alias("add"), "lo", "hi") \
        .unionByName(stays.select("_block", "_row", F.lit(-1).alias("add"), "lo", "hi")) \
        .unionByName(copies.select("_block", F.explode("rows").alias("_row"), F.lit(0).alias("add"),
                                   F.lit(0).alias("lo"), F.lit(0).alias("hi")))

    def digest(texts: pa.Table, marks: pa.Table) -> pa.Table:
        out = {c: [] for c in ("_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        if texts.num_rows:
            row, add, lo, hi = (np.asarray(marks.column(c)) for c in ("_row", "add", "lo", "hi"))
            by = np.argsort(row, kind="stable")
            row, add, lo, hi = row[by], add[by], lo[by], hi[by]
            for i, r, t in zip(texts.column("_id").to_pylist(), texts.column("_row").to_pylist(), _bytes(texts.column("_text"))):
                s, e = np.searchsorted(row, [r, r + 1])
                gone = np.zeros(len(t) + 1, np.int64)
                if e > s and (add[s:e] == 0).any():
                    gone[:len(t)] = 1
                elif e > s:
                    start = np.zeros(len(t) + 1, np.int64)
                    np.add.at(start, lo[s:e], add[s:e])
                    np.add.at(start, hi[s:e] + 1, -add[s:e])
                    start = np.cumsum(start) > 0
                    cover = np.zeros(len(t) + 1, np.int64)
                    p = np.flatnonzero(start)
                    np.add.at(cover, p, 1)
                    np.add.at(cover, p + length, -1)
                    gone = (np.cumsum(cover) > 0).astype(np.int64)
                spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
                kept = np.frombuffer(t, np.uint8)[gone[:len(t)] == 0].tobytes() if spans else t
                for c, v in zip(out, (i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest(),
                                      kept if with_bytes else None)):
                    out[c].append(v)
        kinds = (id_arrow, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})

    out = stored.groupBy("_block").cogroup(marks.groupBy("_block")).applyInArrow(
        digest, f"_id {id_sql}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    out = out.withColumnRenamed("_id", id_col)
    return out if with_bytes else out.drop("kept")
