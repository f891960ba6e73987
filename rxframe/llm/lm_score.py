"""Language-model scores by a weighted backoff automaton over smoothed n-grams.

The model: a state is a context (up to ``order - 1`` tokens, the start mark included)
seen in training, with count C.  A token seen n times after it has an arc of weight
``log10((n + m * p) / (C + m))``, where p is the token's probability in the next
shorter state; any other token takes the failure arc ``log10(m / (C + m))`` to that
state.  The root's probability is the add-half unigram.  Each state's arcs sum to 1.
A text is read once, left to right: the state after a token is its longest context
that is a state, and the arc weights add up.

Spark shape: texts are stored in blocks; a block sends its distinct n-gram keys with
its training counts, ranges of keys are summed, and a block gets back only totals
that differ from its own count, i.e. the part of the automaton that it can reach and
does not know.  From them it builds the states, arcs and failure arcs of its n-grams
and walks its texts.  No task holds more than one block or one range of keys, nothing is
pruned, and the driver sees two numbers (tokens and types).

Defined results: a null or empty text is the end token alone.  A null id is hashed
as the empty string.  Without training texts every token has the unseen probability.
Equal rows are counted and scored each.
"""

from __future__ import annotations

from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxframe.llm import blocks as B
from rxframe.session import materialize

ORDER = 2
PRIOR = 4.0
RANGE_BYTES = 8 << 20
_HASH_BYTES = 1 << 20
END, START = B.mix(np.array([11, 13], np.uint64))
_ONE = np.uint64(1)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts (each text: its words, A-Z as a-z, then the end), and
    the number of tokens per text."""
    out, sizes, group, size = [], [], [], 0
    for i, t in enumerate(texts):
        group.append(t)
        size += len(t) + 1
        if size >= _HASH_BYTES or i == len(texts) - 1:
            data, starts = B.joined(group)
            upper = (data >= 65) & (data <= 90)
            data = data + (upper * np.uint8(32))
            word = ~((data == 32) | ((data >= 9) & (data <= 13)))
            edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
            s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            of = np.searchsorted(starts, s, side="right") - 1
            n = np.bincount(of, minlength=len(group))
            tok = np.empty(len(s) + len(group), np.uint64)
            tok[np.arange(len(s)) + of] = B.span_hashes(data, s, e)
            tok[np.cumsum(n + 1) - 1] = END
            out.append(tok)
            sizes.append(n + 1)
            group, size = [], 0
    none = np.zeros(0, np.uint64)
    return np.concatenate(out or [none]), np.concatenate(sizes or [np.zeros(0, np.int64)])


def grams(tok: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """Per n = 1..order, the key of the n-gram that ends at each token; 0 where the
    text has fewer tokens before (the start mark counts as one).  Keys of single
    tokens are odd, all others even."""
    first = np.cumsum(sizes) - sizes
    where = np.arange(len(tok)) - np.repeat(first, sizes)
    out = [B.mix(tok) | _ONE]
    chain = tok
    for n in range(2, order + 1):
        before = np.concatenate([[np.uint64(0)], chain[:-1]]) if len(chain) else chain
        if n == 2:
            before = np.where(where == 0, START, before)
        chain = B.mix(before * np.uint64(0xD6E8FEB86659FD93) + tok + np.uint64(n))
        out.append(np.where(where >= n - 2, B.mix(chain + np.uint64(n)) & ~_ONE, np.uint64(0)))
    return out


START_KEY = int(B.mix(np.array([START], np.uint64))[0] & ~_ONE)


def _counts(texts: list[bytes], train: np.ndarray, order: int):
    """Tokens per text, the number of each token's n-grams among the sorted keys (-1:
    none) by n, the keys, their training counts."""
    tok, sizes = tokens(texts)
    g = grams(tok, sizes, order)
    weight = np.repeat(train.astype(np.int64), sizes)
    keys = np.concatenate([*g, np.full(1, START_KEY, np.uint64)])
    add = np.concatenate([*[weight] * order, [int(train.sum())]])
    unique, where = np.unique(keys, return_inverse=True)
    total = np.bincount(where, weights=add, minlength=len(unique)).astype(np.int64)
    number = where[:-1].reshape(order, -1)
    if unique[0] == 0:
        unique, total, number = unique[1:], total[1:], number - 1
    return sizes, number, unique, total


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def train(blocks: DataFrame, order: int = ORDER, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, int, int]:
    """Totals that blocks do not know by themselves; training tokens; training types."""
    ranges = B.key_ranges(blocks, "_text", range_bytes)

    def send(table: pa.Table) -> pa.Table:
        _, _, keys, total = _counts(_texts(table.column("_text")), np.asarray(table.column("_train")), order)
        parts = B.split_ranges(keys, ranges)
        return pa.table({
            "range": pa.array([r for r, _, _ in parts], pa.int64()),
            "_block": pa.array([table.column("_block")[0].as_py()] * len(parts), pa.int64()),
            "keys": pa.array([B.pack(keys[s:e]) for _, s, e in parts], pa.binary()),
            "counts": pa.array([B.pack_counts(total[s:e]) for _, s, e in parts], pa.binary())})

    def send_all(batches):
        """Blocks lie together in a file; one cut by a file split is sent in two parts."""
        held: list[pa.RecordBatch] = []

        def flush():
            yield from send(pa.Table.from_batches(held)).to_batches()

        for b in batches:
            ids = np.asarray(b.column(0))
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if held and held[0].column(0)[0].as_py() != int(ids[s]):
                    yield from flush()
                    held = []
                held.append(b.slice(s, e - s))
        if held:
            yield from flush()

    def merge(table: pa.Table) -> pa.Table:
        keys = [B.unpack(k.as_py()) for k in table.column("keys")]
        counts = [B.unpack_counts(c.as_py()) for c in table.column("counts")]
        unique, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64)
        single = (unique & _ONE).astype(bool) & (total > 0)
        rows = {"_block": [-1], "keys": [None], "counts": [None], "n": [int(total[single].sum())], "v": [int(single.sum())]}
        at = 0
        for block, k, c in zip(table.column("_block").to_pylist(), keys, counts):
            t = total[where[at:at + len(k)]]
            at += len(k)
            other = t != c
            if other.any():
                for name, v in zip(rows, (block, B.pack(k[other]), B.pack_counts(t[other]), 0, 0)):
                    rows[name].append(v)
        return pa.table({"range": pa.array([table.column("range")[0].as_py()] * len(rows["n"]), pa.int64()),
                         "_block": pa.array(rows["_block"], pa.int64()), "keys": pa.array(rows["keys"], pa.binary()),
                         "counts": pa.array(rows["counts"], pa.binary()), "n": pa.array(rows["n"], pa.int64()),
                         "v": pa.array(rows["v"], pa.int64())})

    sent = blocks.select("_block", "_text", "_train").mapInArrow(
        send_all, "range bigint, _block bigint, keys binary, counts binary")
    model = materialize(sent.groupBy("range").applyInArrow(
        merge, "range bigint, _block bigint, keys binary, counts binary, n bigint, v bigint"), "lm-model")
    r = model.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    return model.where("_block >= 0").select("range", "_block", "keys", "counts"), r["n"], r["v"]


class Automaton(NamedTuple):
    """The part of the model that some texts can reach.

    State 0 is the root, state ``k + 1`` the context with the ``k``-th key; a token has the
    number of its own key.  ``arcs`` finds the arc of a state other than the root by
    ``state * width + token``; arcs are numbered like the keys of their n-grams, so the
    root's arc of a token is the token's number.  The root has an arc for every token of
    the texts: a chain of failure arcs always ends.  ``start``, ``target`` and ``failure``
    hold states times ``width``.
    """

    start: int
    width: int
    arcs: dict[int, int]
    weight: array
    target: array
    failure: array
    failure_weight: array
    tokens: array

    def score(self, sizes: np.ndarray) -> np.ndarray:
        """Log10 probability of each text, one traversal of its tokens."""
        arc, width, weight, target = self.arcs.get, self.width, self.weight, self.target
        failure, failure_weight, tokens = self.failure, self.failure_weight, self.tokens
        out, at = [], 0
        for size in sizes.tolist():
            state, total = self.start, 0.0
            for token in tokens[at:at + size]:
                a = arc(state + token) if state else token
                while a is None:
                    s = state // width
                    total += failure_weight[s]
                    state = failure[s]
                    a = arc(state + token) if state else token
                total += weight[a]
                state = target[a]
            out.append(total)
            at += size
        return np.array(out, np.float64)


def automaton(number: np.ndarray, sizes: np.ndarray, keys: np.ndarray, total: np.ndarray, z: float, prior: float) -> Automaton:
    """States, arcs and failure arcs from the n-grams of some texts (``number``: their keys'
    numbers by n and token), their sorted ``keys`` and the keys' training counts ``total``."""
    order, width = len(number), len(keys)
    first = np.zeros(number.shape[1], bool)
    first[np.cumsum(sizes) - sizes] = True
    start = int(np.searchsorted(keys, np.uint64(START_KEY)))
    p, target, failure = (total + 0.5) / z, np.zeros(width, np.int64), np.zeros(width + 1, np.int64)
    if order > 1:
        seen = np.zeros(width, bool)
        seen[number[0]] = True
        target = np.where(seen & (total > 0), np.arange(1, width + 1), 0)
    arcs, found = [], []
    for n in range(2, order + 1):
        here = np.flatnonzero(number[n - 1] >= 0)
        place = np.full(width, -1, np.int64)
        place[number[n - 1][here]] = here
        gram = np.flatnonzero((place >= 0) & (total > 0))
        place = place[gram]
        before = np.where(first[place], start, number[n - 2][place - 1])
        shorter = number[n - 2][place]
        p[gram] = (total[gram] + prior * p[shorter]) / (total[before] + prior)
        target[gram] = (gram if n < order else shorter) + 1
        if n < order:
            failure[gram + 1] = shorter + 1
        arcs += ((before + 1) * width + number[0][place]).tolist()
        found += gram.tolist()
    with np.errstate(divide="ignore"):
        handed = np.concatenate([[0.0], np.log10(prior / (total + prior))])
    return Automaton((start + 1) * width if order > 1 and total[start] else 0, width, dict(zip(arcs, found)),
                     *(array(x.dtype.char, x.tobytes()) for x in (np.log10(p), target * width, failure * width, handed, number[0])))


def score(docs: DataFrame, train_when, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
          prior: float = PRIOR, block_bytes: int = B.BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per document: id, ``held_out`` (not ``train_when``), ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (add-half unigram) and ``score`` (the automaton), log10."""
    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), train_when.alias("_train"))
    stored = B.store_blocks(d, "_text", block_bytes)
    model, n_train, n_types = train(stored, order, range_bytes)
    z = n_train + 0.5 * (n_types + 1)

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({f: pa.array([], t) for f, t in types.items()})
        flags = np.asarray(texts.column("_train"))
        sizes, number, keys, total = _counts(_texts(texts.column("_text")), flags, order)
        parts = sorted(zip(known.column("range").to_pylist(), known.column("keys").to_pylist(),
                           known.column("counts").to_pylist()), key=lambda r: r[0])
        for _, k, c in parts:
            total[np.searchsorted(keys, B.unpack(k))] = B.unpack_counts(c)

        first = np.cumsum(sizes) - sizes
        c = total[number[0]]
        base = np.log10((c + 0.5) / z)
        walked = automaton(number, sizes, keys, total, z, prior).score(sizes)
        out = [texts.column("_id").combine_chunks(), pa.array(~flags), pa.array(sizes.astype(np.int64)),
               pa.array(np.add.reduceat((c > 0).astype(np.int64), first)), pa.array(np.full(len(sizes), n_train, np.int64)),
               pa.array(np.add.reduceat(base, first)), pa.array(walked)]
        return pa.table(dict(zip(types, out)))

    id_type = docs.schema[id_col].dataType
    schema = f"_id {id_type.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, " \
             "base_score double, score double"
    from pyspark.sql.pandas.types import to_arrow_type
    types = {"_id": to_arrow_type(id_type), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(),
             "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    out = stored.select("_block", "_id", "_text", "_train").groupBy("_block") \
        .cogroup(model.groupBy("_block")).applyInArrow(run, schema)
    return out.withColumnRenamed("_id", id_col)
