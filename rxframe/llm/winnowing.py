"""Document fingerprints by winnowing.

Every run of ``k`` code points is hashed by a rolling polynomial; of each window of ``w``
consecutive hashes the smallest is kept, the rightmost of equal ones, with its position.
Two texts that share a run of ``k + w - 1`` code points therefore keep at least one equal
hash inside it, and what is shorter than ``k`` code points is never matched.  The likeness
of two fingerprints is the Jaccard coefficient of their sets of hashes; the positions tell
where in the texts the equal hashes lie.

A fingerprint is written as text: per kept hash eight hexadecimal digits and two more for
the distance from the previous position (from the start for the first), at most ``w``.

A text is cut into pieces of ``PIECE`` windows that overlap by what a window needs, and the
pieces of a batch are hashed together in numpy: a task holds its Arrow batch, some
``THEN_BYTES`` of it as strings (one text at least) and about 100 bytes for each of ``GROUP``
code points.

Defined results: a null or empty text has the empty fingerprint; two empty fingerprints have
likeness 1, an empty and another one 0.  A text shorter than ``k`` is one run, a text with
fewer than ``w`` runs one window.  Equal texts have equal fingerprints.  Repeated rows are
fingerprinted once each.  Only the id and the text are read: other columns can't clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxframe.llm.blocks import mix
from rxframe.session import ship_package

PIECE = 1 << 18
GROUP = 1 << 18
RANGE_BYTES = 32 << 20
THEN_BYTES = 4 << 20
NO_CHAR = 0x110000  # no code point: fills up texts that are shorter than one run
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Winnowing:
    """Length of a hashed run of code points, and of a window of hashes (255 at most)."""
    k: int = 16
    w: int = 32

    def __post_init__(self):
        if self.k < 1 or not 1 <= self.w <= 255:
            raise ValueError("k is at least 1, w from 1 to 255")

    def fingerprints(self, texts: list[str]) -> Fingerprints:
        """Kept hashes of all texts, in the order of the texts and positions."""
        pieces: list[tuple[int, int, str]] = []  # text, offset, characters
        for i, t in enumerate(texts):
            last = max(1, len(t) - self.k - self.w + 2)  # windows of the text
            pieces += [(i, at, t[at:at + PIECE + self.k + self.w - 2]) for at in range(0, last, PIECE) if t]
        parts, group, size = [], [], 0
        for p in pieces:
            group.append(p)
            size += len(p[2])
            if size >= GROUP:
                parts.append(self._kept(group))
                group, size = [], 0
        if group:
            parts.append(self._kept(group))
        if not parts:
            return Fingerprints(*(np.empty(0, d) for d in (np.int64, np.int64, np.uint32)), len(texts))
        doc, pos, value = (np.concatenate(c) for c in zip(*parts))
        # the first window of a piece may keep what the last of the piece before kept
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
        return Fingerprints(doc[new], pos[new], value[new], len(texts))

    def _kept(self, pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position, hash) that the windows of the pieces keep."""
        k, w = self.k, self.w
        n = np.fromiter((len(p[2]) for p in pieces), np.int64, len(pieces))
        room = np.maximum(n, k)
        first = np.cumsum(room) - room
        chars = np.frombuffer("".join(p[2].ljust(k) for p in pieces).encode("utf-32-le"), np.uint32).astype(np.uint64)
        for i in np.flatnonzero(n < k):
            chars[first[i] + n[i]:first[i] + k] = NO_CHAR
        hashes = mix(self._rolling(mix(chars))) >> np.uint64(32)

        # the runs of each piece side by side, filled up to one window with the greatest key;
        # a key is hash, then position from behind: the least one is the rightmost of equals
        runs = room - k + 1
        slots = np.maximum(runs, w)
        at = np.cumsum(slots) - slots
        source = _spread(first, runs)
        target = _spread(at, runs)
        keys = np.full(int(slots.sum()), ~np.uint64(0))
        keys[target] = (hashes[source] << np.uint64(32)) | (_LOW - target.astype(np.uint64))
        least, have = keys, 1
        while have < w:
            step = min(have, w - have)
            least = np.minimum(least[:len(least) - step], least[step:])
            have += step
        kept = (_LOW - (least[_spread(at, slots - w + 1)] & _LOW)).astype(np.int64)
        new = np.ones(len(kept), bool)
        new[1:] = kept[1:] != kept[:-1]
        kept = kept[new]
        piece = np.searchsorted(at, kept, "right") - 1
        text = np.fromiter((p[0] for p in pieces), np.int64, len(pieces))
        offset = np.fromiter((p[1] for p in pieces), np.int64, len(pieces))
        return text[piece], kept - at[piece] + offset[piece], (keys[kept] >> np.uint64(32)).astype(np.uint32)

    def _rolling(self, values: np.ndarray) -> np.ndarray:
        """Polynomial hashes of all runs of ``k`` values, from those of half the length."""
        def doubled(k: int) -> np.ndarray:
            if k == 1:
                return values
            half = doubled(k // 2)
            out = half[:-(k // 2)] * np.uint64(pow(_BASE, k // 2, 1 << 64)) + half[k // 2:]
            return out if k % 2 == 0 else out[:-1] * np.uint64(_BASE) + values[k - 1:]
        return doubled(self.k)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts[i]`` consecutive numbers from ``starts[i]`` on, one after another."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


@dataclass
class Fingerprints:
    """Kept hashes of a list of texts: number of the text, position, hash."""
    doc: np.ndarray
    pos: np.ndarray
    value: np.ndarray
    n: int

    def _cuts(self) -> np.ndarray:
        return np.searchsorted(self.doc, np.arange(self.n + 1))

    def texts(self) -> list[str]:
        """Each fingerprint as hexadecimal text."""
        gap = np.diff(self.pos, prepend=0)
        cuts = self._cuts()
        starts = cuts[:-1][cuts[:-1] < cuts[1:]]
        gap[starts] = self.pos[starts]
        rows = np.empty((len(self.doc), 5), np.uint8)
        rows[:, :4] = self.value.astype(">u4").view(np.uint8).reshape(-1, 4)
        rows[:, 4] = gap
        data = rows.tobytes().hex()
        return [data[10 * a:10 * b] for a, b in zip(cuts[:-1], cuts[1:])]

    def sets(self) -> np.ndarray:
        """Distinct (text, hash), packed and sorted."""
        return np.unique((self.doc.astype(np.uint64) << np.uint64(32)) | self.value)


def likeness(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Jaccard coefficients of the sets with equal numbers; two empty sets are alike."""
    def count(x):
        return np.bincount((x >> np.uint64(32)).astype(np.int64), minlength=n)
    both = count(np.intersect1d(a, b, assume_unique=True))
    either = count(a) + count(b) - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0)


def parse(fingerprint: str) -> list[tuple[int, int]]:
    """(hash, position) of a fingerprint's text."""
    out, at = [], 0
    for i in range(0, len(fingerprint), 10):
        at += int(fingerprint[i + 8:i + 10], 16)
        out.append((int(fingerprint[i:i + 8], 16), at))
    return out


def fingerprint(docs: DataFrame, how: Winnowing = Winnowing(), id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per document: id, ``hashes`` and ``positions`` kept.  Nothing is shuffled."""
    ship_package(docs.sparkSession)

    def run(batches):
        for b in batches:
            found = how.fingerprints([t or "" for t in b.column(1).to_pylist()])
            cuts = pa.array(found._cuts(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(cuts, pa.array(found.value.astype(np.int64))),
                 pa.ListArray.from_arrays(cuts, pa.array(found.pos))], names=[id_col, "hashes", "positions"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(
        run, f"`{id_col}` {kind}, hashes array<bigint>, positions array<bigint>")


def with_next(docs: DataFrame, then, columns: str, id_col: str = "doc_id", text_col: str = "text",
              range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All documents in descending order of the id (nulls last, equal ids by a hash of the
    text; after the last comes the first), given to ``then(ids, texts, at)`` in batches:
    ``ids`` are those of the texts at ``at``, and the next text of ``at[j]`` is at ``at[j] + 1``.

    The narrow (id, hash) rows are sorted alone first and give the last key of each of some
    ranges, one per ``range_bytes`` of text: these few keys are all that the driver sees.  Then
    the texts are dealt by range in one shuffle, the last row of a range also to the range
    above as a guest, so that every row meets its next one in its own task.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    keyed = d.select("id", F.xxhash64("text").alias("h"), "text")
    total = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]

    def last_key(batches):
        row = None
        for b in batches:
            row = b.slice(b.num_rows - 1, 1) if b.num_rows else row
        if row is not None:
            yield row

    found = keyed.select("id", "h").repartitionByRange(max(1, -(-total // range_bytes)), F.asc_nulls_first("id"), "h") \
        .sortWithinPartitions(F.asc_nulls_first("id"), "h").mapInArrow(last_key, f"id {kind}, h bigint").collect()

    def key(i, h):
        return (False, 0, h) if i is None else (True, i, h)

    order = sorted(key(r["id"], r["h"]) for r in found)

    def deal(batches):
        for b in batches:
            keys = [*map(key, b.column(0).to_pylist(), b.column(1).to_pylist())]
            to = [bisect_left(order, k) for k in keys]
            guests = [j for j, (k, r) in enumerate(zip(keys, to)) if order[r] == k]
            names = ["id", "h", "text", "range", "guest"]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.int32()), pa.array([False] * len(to))], names=names)
            if guests:
                above = [(to[j] + 1) % len(order) for j in guests]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(guests)) for c in b.columns), pa.array(above, pa.int32()),
                                                  pa.array([True] * len(guests))], names=names)

    def pairs(batches):
        held = None  # the last row of a batch waits for the next one
        for b in batches:
            n, ids, texts = b.num_rows, b.column(0), b.column(2)
            if not n:
                continue
            own = ~b.column(4).to_numpy(zero_copy_only=False)
            if held is not None:
                yield then(held[0], [held[1], texts[0].as_py()], np.zeros(1, np.int64))
            held = (ids.slice(n - 1, 1), texts[n - 1].as_py()) if own[n - 1] else None
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            start = 0
            while start < n - 1:  # some megabytes of text at a time, and the row after them
                end = min(n - 1, max(start + 1, int(np.searchsorted(ends, ends[start] + THEN_BYTES))))
                at = np.flatnonzero(own[start:end])
                if len(at):
                    yield then(ids.take(pa.array(at + start)), texts.slice(start, end - start + 1).to_pylist(), at)
                start = end

    dealt = keyed.mapInArrow(deal, f"id {kind}, h bigint, text string, range int, guest boolean")
    return dealt.repartitionById(max(1, len(order)), F.col("range")) \
        .sortWithinPartitions("range", "guest", F.desc_nulls_last("id"), F.desc("h")).mapInArrow(pairs, columns)


def edit(text: str, other: str) -> str:
    """``text`` with its last third replaced by as many characters of ``other``'s beginning."""
    third = len(text) // 3
    return text[:len(text) - third] + other[:third]


def edited_table(docs: DataFrame, how: Winnowing = Winnowing()) -> DataFrame:
    """Per document its fingerprint, that of its edited text (last third replaced by the
    beginning of the next document) and the likeness to the edited text and the next document."""
    one = np.uint64(1 << 32)

    def then(ids, texts, at):
        edited = [edit(t, o) for t, o in zip(texts, texts[1:])]
        a, b = how.fingerprints(texts), how.fingerprints(edited)
        mine, n = a.sets(), len(texts)
        near_edited, near_next = likeness(mine, b.sets(), n), likeness(mine, mine[mine >= one] - one, n)
        prints, edited_prints = a.texts(), b.texts()
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(texts[j]) for j in at], pa.int64()),
             pa.array([hashlib.sha256(edited[j].encode()).hexdigest() for j in at], pa.string()),
             pa.array([prints[j] for j in at], pa.string()), pa.array([edited_prints[j] for j in at], pa.string()),
             pa.array(near_edited[at]), pa.array(near_next[at])],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_next(docs, then, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")
