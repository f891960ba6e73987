"""SimHash near-duplicates with the generalised pigeonhole principle.

1. Each text becomes a 64-bit fingerprint: a bit is set if it is set in more than
   half of the XXH64 values (seed 42) of its word shingles.
2. Equal fingerprints are one node.  Bits that go together (correlation over all
   nodes) are grouped into ``distance + 1`` partitions.
3. Each node allocates a threshold to each partition, -1 (not probed) or more,
   adding up to ``distance - partitions + 1``: whatever lies within ``distance``
   then agrees within the threshold in some partition.  Dynamic programming picks
   the allocation of least estimated cost: exact counts of the node's own bucket,
   plus, for wider thresholds, the share of all nodes expected by bit frequencies.
4. Nodes probe an index of the partitions' values and every candidate is verified
   on all 64 bits.  A bucket above ``big_bucket`` nodes is indexed once more by
   parts of the other bits (again one of ``distance + 1`` parts must agree), which
   loses nothing and keeps a crowded value from pairing all its nodes.
5. Connected components over the links give the classes.

Defined results: a null, empty or blank text has fingerprint zero and links like
any other.  Null ids are never a class's name unless the class has no other id.
Equal rows each give a row.  Spark moves ids and fingerprints only, never texts.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxframe.llm.blocks import store_rows, with_rows_at
from rxframe.llm.components import components
from rxframe.session import materialize, ship_package

BITS = 64
SEED = 42
_CHUNK = 1 << 16
# a probe is a row to shuffle and sort, a candidate one comparison: their costs, in candidates
PROBE_COST = 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of one text (unsigned)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:len(words) - shingle + 1], ends[shingle - 1:]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _CHUNK):
        spans = zip(starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(``_id`` or any other columns, text) -> the same columns without the text, and ``fp`` (signed)."""
    ship_package(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(text_col)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(fps)], names=[*rest, "fp"])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest], "fp bigint"])
    return docs.mapInArrow(run, schema)


def _bit_moments(nodes: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of nodes, share of ones per bit, correlation of bits; over all nodes."""
    def run(batches):
        n, gram = 0, np.zeros((BITS, BITS), np.int64)
        for b in batches:
            v = np.asarray(b.column(0)).view(np.uint64)
            for at in range(0, len(v), _CHUNK):
                x = np.unpackbits(v[at:at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                x = x.astype(np.float64)
                gram += (x.T @ x).astype(np.int64)
                n += len(x)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(gram.ravel(), n))],
            names=["i", "j", "n"])

    rows = nodes.select("fp").mapInArrow(run, "i bigint, j bigint, n bigint") \
        .groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    gram, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r["i"] < 0:
            n = r["n"]
        else:
            gram[r["i"], r["j"]] = r["n"]
    p = np.diag(gram) / max(n, 1)
    cov = gram / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return n, p, np.abs(cov / np.outer(sd, sd))


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near equal size; each group starts with the
    free bit most correlated to all free bits and takes the one closest to it next."""
    free, out = list(range(len(corr))), []
    for k in range(parts):
        size = math.ceil(len(free) / (parts - k))
        first = max(free, key=lambda b: (corr[b, free].sum(), -b))
        group = [first]
        free.remove(first)
        while len(group) < size:
            nearest = max(free, key=lambda b: (corr[b, group].mean(), -b))
            group.append(nearest)
            free.remove(nearest)
        out.append(sorted(group))
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def expected_share(p: np.ndarray, bits: list[int], limit: int) -> np.ndarray:
    """Chance that two nodes differ in exactly 0..limit of these bits, bits taken as independent."""
    dist = np.zeros(limit + 1)
    dist[0] = 1.0
    for b in bits:
        q = 2 * p[b] * (1 - p[b])
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return dist


def allocate(cost: np.ndarray, total: int) -> np.ndarray:
    """Least-cost thresholds per row.  ``cost[row, part, t + 1]`` is the cost of
    threshold t = -1, 0, ...; the thresholds of a row add up to ``total``."""
    rows, parts, options = cost.shape
    best = np.full((rows, parts * options + 1), np.inf)
    # sums are kept shifted: after k partitions, index = sum of (t + 1)
    best[:, 0] = 0.0
    choice = np.zeros((rows, parts, best.shape[1]), np.int8)
    for k in range(parts):
        nxt = np.full_like(best, np.inf)
        for t in range(options):
            moved = np.full_like(best, np.inf)
            moved[:, t:] = best[:, :best.shape[1] - t] + cost[:, k, t:t + 1]
            better = moved < nxt
            nxt = np.where(better, moved, nxt)
            choice[:, k][better] = t
        best = nxt
    at = np.full(rows, total + parts)
    out = np.zeros((rows, parts), np.int64)
    for k in range(parts - 1, -1, -1):
        t = choice[np.arange(rows), k, at].astype(np.int64)
        out[:, k] = t - 1
        at -= t
    return out


def _flips(bits: list[int], upto: int) -> list[np.ndarray]:
    """For t = 0..upto, the masks that flip exactly t of the bits."""
    return [np.array([_mask(list(c)) for c in itertools.combinations(bits, t)], np.uint64) for t in range(upto + 1)]


def links(nodes: DataFrame, distance: int = 2, big_bucket: int = 2000) -> DataFrame:
    """(``fp``) distinct fingerprints -> pairs (``u``, ``v``) at 1..``distance`` bits, u < v."""
    ship_package(nodes.sparkSession)
    n, p, corr = _bit_moments(nodes)
    groups = group_bits(corr, distance + 1)
    total = distance - len(groups) + 1
    masks = [_signed(_mask(g)) for g in groups]
    others = [[b for b in range(BITS) if b not in g] for g in groups]
    subs = [[o[s::distance + 1] for s in range(distance + 1)] for o in others]
    sub_masks = [[_signed(_mask(s)) for s in row] for row in subs]
    shares = [expected_share(p, g, distance) for g in groups]
    flips = [_flips(g, distance) for g in groups]

    keys = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("part", "key"))
    counts = keys.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))
    keys = materialize(keys.join(counts, ["part", "key"]), "gph-keys")

    def probes(batches):
        for b in batches:
            fp = np.asarray(b.column(0)).view(np.uint64)
            own = np.array(b.column(1).to_pylist(), dtype=np.float64).reshape(len(fp), len(groups))
            cost = np.zeros((len(fp), len(groups), distance + 2))
            for k in range(len(groups)):
                for t in range(distance + 1):
                    # values nearby are looked up in the plain and in the finer index
                    rows = 1 + (distance + 2) * sum(len(f) for f in flips[k][1:t + 1])
                    cost[:, k, t + 1] = PROBE_COST * rows + own[:, k] + n * shares[k][1:t + 1].sum()
            chosen = allocate(cost, total)
            out = {c: [] for c in ("fp", "part", "key", "sub", "rest")}

            def emit(q, part, key, sub, rest):
                for c, v in zip(out, (q, np.full(len(q), part, np.int32), key, np.full(len(q), sub, np.int32), rest)):
                    out[c].append(v)

            for k in range(len(groups)):
                mask = np.uint64(_mask(groups[k]))
                for t in range(distance + 1):
                    q = fp[chosen[:, k] >= t]
                    big = own[chosen[:, k] >= t, k] > big_bucket
                    for f in flips[k][t]:
                        key = (q & mask) ^ f
                        # own bucket: its size is known; other buckets may be indexed either way
                        plain = ~big if t == 0 else np.ones(len(q), bool)
                        emit(q[plain], k, key[plain], -1, np.zeros(plain.sum(), np.uint64))
                        deep = big if t == 0 else np.ones(len(q), bool)
                        for s, bits in enumerate(subs[k]):
                            emit(q[deep], k, key[deep], s, q[deep] & np.uint64(_mask(bits)))
            cols = [np.concatenate(v) for v in out.values()]
            cols = [c.view(np.int64) if c.dtype == np.uint64 else c for c in cols]
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=list(out))

    by_node = keys.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("c"))
    probe = by_node.select("fp", F.transform("c", lambda x: x["n"]).alias("c")) \
        .mapInArrow(probes, "fp bigint, part int, key bigint, sub int, rest bigint")

    fp = F.col("fp")
    plain = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("rest")))
    deep = F.coalesce(*[F.when(F.col("part") == k, F.array(*[
        F.struct(F.lit(s).alias("sub"), fp.bitwiseAND(F.lit(m)).alias("rest")) for s, m in enumerate(row)]))
        for k, row in enumerate(sub_masks)])
    index = keys.select(fp.alias("v"), "part", "key", F.explode(
        F.when(F.col("n") > big_bucket, deep).otherwise(plain)).alias("x")).select("v", "part", "key", "x.*")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    on = ["part", "key", "sub", "rest"]
    p_, i_ = probe.withColumnRenamed("fp", "u").alias("p"), index.alias("i")
    pairs = p_.join(i_, [F.col(f"p.{c}") == F.col(f"i.{c}") for c in on] + [F.col("u") < F.col("v"), near])
    return pairs.select("u", "v").distinct()


def classes(rows: DataFrame, distance: int = 2, big_bucket: int = 2000) -> DataFrame:
    """(``_id``, ``fp``) rows -> one row per fingerprint: ``fp``, ``component`` (smallest
    id that it reaches), ``root`` (the class's smallest fingerprint)."""
    nodes = materialize(rows.groupBy("fp").agg(F.min("_id").alias("low")), "simhash-nodes")
    roots = components(links(nodes, distance, big_bucket), "simhash-links")
    d = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "low", F.coalesce("root", "fp").alias("root"))
    names = d.groupBy("root").agg(F.min("low").alias("component"))
    return d.join(names, "root").select("fp", "component", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    distance: int = 2, big_bucket: int = 2000) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id``."""
    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    rows = materialize(with_fingerprint(d, "_text", shingle), "simhash-rows")
    d = rows.join(classes(rows, distance, big_bucket), "fp")
    return d.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.col("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         distance: int = 2, big_bucket: int = 2000) -> DataFrame:
    """``docs`` with one row of each class: the smallest id (of equal ids, the first row as stored).

    The rows are stored once in blocks; what is kept is decided on row numbers, and only those
    travel, however many there are."""
    columns = docs.columns
    stored = store_rows(docs, text_col)
    d = stored.select("_at", F.col(f"_row.`{id_col}`").alias("_id"), F.col(f"_row.`{text_col}`").alias("_text"))
    rows = materialize(with_fingerprint(d, "_text", shingle), "simhash-rows")
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_at"))
    # equal fingerprints are reduced before the join with their classes
    firsts = rows.groupBy("fp").agg(best.alias("first"))
    kept = firsts.join(classes(rows, distance, big_bucket), "fp").groupBy("root") \
        .agg(F.min("first").alias("first")).select(F.col("first._at").alias("_at"))
    return with_rows_at(stored, kept).select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])
