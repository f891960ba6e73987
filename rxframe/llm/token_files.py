"""Token-ID files: Parquet list columns in document order, read back selectively.

Texts are range-partitioned and sorted by id, encoded in batches of bounded bytes
by the tokenizer's own library, and written by Spark's Parquet writer: token ids
dictionary-encoded, ids and counts delta-encoded (writer version 2), row groups
and pages of set size, column and offset indexes on (the writer's default).  A
reader of counts or of a few documents touches only those columns and pages.

Files: ``part`` (order of the file), ``row`` (order in it), the id, ``n_tokens``,
``ids`` array<int>.  The place of a document in the whole stream is a prefix sum:
tokens per part, then tokens before it within its part.

Defined results: a null or empty text is the end id alone.  Null ids come first;
equal ids go by a hash of the text, then the text.  Special tokens' strings in a
text are encoded as the tokenizer file says.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxframe.session import ship_package

END_ID = 2
BATCH_CHARS = 1 << 21
# parts and words after which a worker begins to drop what it was not asked for since, and the longest that it remembers
KNOWN_WORDS, KNOWN_CHARS = 250_000, 64
_LOADED: dict[str, _Encoder] = {}

# The parts of a tokenizer file that say that words stand for themselves.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_SPLITTERS = [{"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True},
                  {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
# what these make of single bytes; Latin letters are two bytes, the first of them 0xC3
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[33:127] = SIGN
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _cut(raw: np.ndarray, at: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of texts that lie one after another in ``raw``, beginning at ``at``: the bytes with
    letters lower-cased, where parts begin (and the end), and whether each part is a word left whole.

    Runs of white space are parts as well.  Words of printable ASCII and Latin letters with one code
    point each are cut as ``WORD_PATTERN`` says; others, and words that hold one of the ``special``
    texts, are left whole and as they are.
    """
    n, kind, low = len(raw), KIND[raw], LOWER[raw]
    latin = np.flatnonzero(raw == 0xC3)
    second = raw[latin + 1]
    is_letter = (second != 0x97) & (second != 0xB7)  # these are signs: left to the library
    latin, second = latin[is_letter], second[is_letter]
    kind[latin] = kind[latin + 1] = LETTER
    low[latin[second < 0x9F] + 1] |= 0x20
    if special:
        text = raw.tobytes()
        for s in special:
            i = text.find(s)
            while i >= 0:
                kind[i] = OTHER
                i = text.find(s, i + 1)

    begin, cut = np.zeros(n + 1, bool), np.ones(n + 1, bool)
    begin[at] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
    cut[:-1] |= kind == DIGIT
    cut[at] = True
    quote = np.flatnonzero(raw[:-1] == ord("'"))
    quote = quote[cut[quote] & ~begin[quote + 1]]
    one, two = low[quote + 1], np.where(begin[quote + 2], 0, low[np.minimum(quote + 2, n - 1)])
    short = np.isin(one, list(b"stmd"))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    cut[quote[short | long] + 1] = False
    cut[quote[short] + 2] = True
    cut[quote[long] + 3] = True

    whole = np.zeros(n, bool)
    other = np.flatnonzero(kind == OTHER)
    if len(other):
        first, last = kind != SPACE, kind != SPACE
        last[:-1] &= (kind[1:] == SPACE) | begin[1:-1]
        first[1:] &= (kind[:-1] == SPACE) | begin[1:-1]
        first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
        hit = np.unique(np.searchsorted(first, other, "right") - 1)
        first, last = first[hit], last[hit]
        step = np.zeros(n + 1, np.int8)
        step[first] += 1
        step[last] -= 1
        whole = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        cut[:-1][whole] = False
        cut[first] = True
        np.copyto(low, raw, where=whole)
    ends = np.flatnonzero(cut)
    return low, ends, whole[ends[:-1]]


class _Encoder:
    """Token ids by the tokenizer's library, remembered by part within a Python worker.

    With the normaliser and splitter named above, white space never lies within a token
    and nothing is normalised across ASCII white space, so a text's ids are its words'
    ids in a row.  A batch of texts is cut into parts over its bytes, as the file says, and
    the parts are numbered by Arrow; Python sees each distinct part of the batch once, and each
    new one goes to the library's model.  Words of other than ASCII and Latin letters are
    encoded whole, many at a time with a special token between them, which marks the ends;
    a word that holds a special token's text is encoded alone.  With any other tokenizer
    file, whole texts are encoded.

    Parts and words are remembered together, each with its ids as bytes, in two generations:
    when ``KNOWN_WORDS`` are in the newer one, the older one is dropped, so that a worker's
    memory does not grow with the texts it has seen.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        self.by_words = (spec.get("normalizer") == {"type": "Sequence", "normalizers": WORD_NORMALIZERS}
                         and spec.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": WORD_SPLITTERS}
                         and not spec.get("truncation") and not spec.get("padding") and not spec["model"].get("dropout")
                         and all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])
                                 and re.fullmatch(r"\S+", t["content"]) for t in added))
        self.special = [t["content"] for t in added]
        self.special_bytes = [s.encode() for s in self.special]
        self.mark = (added[0]["id"], added[0]["content"]) if added else None
        self.model = self.tokenizer.model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _learn_parts(self, parts: list[str]) -> list[bytes]:
        tokenize, shown = self.model.tokenize, parts
        if latin := [p for p in parts if not p.isascii()]:
            # each byte as the character that stands for it; a space's stands for nothing else
            latin = dict(zip(latin, self.bytes.pre_tokenize_str(" ".join(latin))[0][0].split("\u0120")))
            shown = [latin.get(p, p) for p in parts]
        return [b"" if p.isspace() else array("i", [t.id for t in tokenize(p)]).tobytes() for p in shown]

    def _learn_words(self, words: list[str], many: int = 512) -> list[bytes]:
        found = {}
        rest = [w for w in words if self.mark and len(w) <= KNOWN_CHARS]
        between = f" {self.mark[1]} " if self.mark else " "
        for i in range(0, len(rest), many * 16):
            groups = [rest[j:j + many] for j in range(i, min(i + many * 16, len(rest)), many)]
            for group, e in zip(groups, self.batch([between.join(g) for g in groups], add_special_tokens=False)):
                at, ids = 0, array("i", e.ids)
                for word in group[:-1]:
                    end = ids.index(self.mark[0], at)
                    found[word] = ids[at:end].tobytes()
                    at = end + 1
                found[group[-1]] = ids[at:].tobytes()
        return [found[w] if w in found else self._alone(w) for w in words]

    def _alone(self, word: str) -> bytes:
        return array("i", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _remembered(self, texts: list[str], learn) -> list[bytes]:
        """The ids of each of these distinct parts or words, 4 bytes each."""
        if len(self.known) >= KNOWN_WORDS:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        found = list(map(known.get, texts))
        missing = [i for i, ids in enumerate(found) if ids is None]
        older = [before.get(texts[i]) for i in missing]
        learned = iter(learn([texts[i] for i, ids in zip(missing, older) if ids is None]))
        for i, ids in zip(missing, older):
            found[i] = ids = next(learned) if ids is None else ids
            if len(texts[i]) <= KNOWN_CHARS:
                known[texts[i]] = ids
        return found

    def part_ids(self, parts: list[str]) -> list[bytes]:
        return self._remembered(parts, self._learn_parts)

    def word_ids(self, words: list[str]) -> list[bytes]:
        text = " ".join(words)
        held = [s for s in self.special if s in text]
        if not held:
            return self._remembered(words, self._learn_words)
        plain = [w for w in words if not any(s in w for s in held)]  # as a part, a special token's text has other ids
        found = dict(zip(plain, self._remembered(plain, self._learn_words)))
        return [found[w] if w in found else self._alone(w) for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            found = [np.array(e.ids, np.int32) for e in self.batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.int32), *found]), np.array([len(x) for x in found], np.int64)
        texts = texts.cast(pa.large_string())
        if not pc.sum(pc.binary_length(texts)).as_py():
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw, at = np.frombuffer(texts.buffers()[2], np.uint8)[at[0]:at[-1]], at - at[0]
        edges = [0, len(raw)]
        if len(raw) > 2 * BATCH_CHARS:  # a long text goes piece by piece, which end after white space or with a text
            stop = np.concatenate([[False], KIND[raw] == SPACE])
            stop[at] = True
            stops = np.flatnonzero(stop)
            edges = np.union1d(edges, stops[np.searchsorted(stops, np.arange(2 * BATCH_CHARS, len(raw), 2 * BATCH_CHARS))])
        pieces = [self._piece(raw[i:j], np.clip(at, i, j) - i) for i, j in zip(edges[:-1], edges[1:])]
        return np.concatenate([ids for ids, _ in pieces]), np.sum([sizes for _, sizes in pieces], axis=0)

    def _piece(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for the texts in ``raw``, which begin at ``at``."""
        low, ends, whole = _cut(raw, at, self.special_bytes)
        parts = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(low)])
        place, found = np.empty(len(parts), np.int64), []
        for of, is_it, between in ((self.part_ids, ~whole, "\0"), (self.word_ids, whole, " ")):
            if is_it.any():
                some = (parts if is_it.all() else parts.filter(pa.array(is_it))).dictionary_encode()
                place[is_it] = np.asarray(some.indices) + len(found)
                found += of(_strings(some.dictionary, between))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start, size = (np.cumsum(sizes) - sizes)[place], sizes[place]
        counts = np.concatenate([[0], np.cumsum(size)])
        ids = np.frombuffer(b"".join(found), np.int32)[np.arange(counts[-1]) + np.repeat(start - counts[:-1], size)]
        return ids, np.diff(counts[np.searchsorted(ends, at)])


def _strings(texts: pa.Array, between: str) -> list[str]:
    """As ``to_pylist``, by one string; ``between`` is in none of the texts."""
    row = pa.LargeListArray.from_arrays(pa.array([0, len(texts)], pa.int64()), texts)
    return pc.binary_join(row, pa.scalar(between, texts.type))[0].as_py().split(between)


def encode(texts: pa.Array, path: str, end_id: int | None = END_ID) -> pa.ListArray:
    """Token ids of each text, the end id appended."""
    if path not in _LOADED:
        _LOADED[path] = _Encoder(path)
    ids, sizes = _LOADED[path].encode(texts)
    ends = np.cumsum(sizes)
    if end_id is not None:
        ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int | None = END_ID, row_group_bytes: int = 32 << 20, page_bytes: int = 1 << 18,
                 page_rows: int = 2000) -> None:
    """Encode every document and write the files, in ascending id order."""
    ship_package(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    d = d.withColumn("_h", F.xxhash64("_text"))
    d = d.repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h", "_text").select("_id", "_text")

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            texts, at = b.column(1), 0
            chars = np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))])
            while at < len(texts):  # a few documents at a time: token lists are much larger than texts
                end = max(at + 1, int(np.searchsorted(chars, chars[at] + BATCH_CHARS)))
                ids = encode(texts.slice(at, end - at), tokenizer_path, end_id)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ids), part, np.int64)), pa.array(np.arange(row, row + len(ids), dtype=np.int64)),
                    b.column(0).slice(at, end - at), pc.list_value_length(ids).cast(pa.int64()), ids],
                    names=["part", "row", "_id", "n_tokens", "ids"])
                row += len(ids)
                at = end

    kind = docs.schema[id_col].dataType.simpleString()
    out = d.mapInArrow(run, f"part bigint, row bigint, _id {kind}, n_tokens bigint, ids array<int>")
    plain = {c: "false" for c in ("part", "row", id_col, "n_tokens")}
    writer = out.withColumnRenamed("_id", id_col).write.mode("errorifexists").option("compression", "zstd") \
        .option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", row_group_bytes) \
        .option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows) \
        .option("parquet.enable.dictionary", "true")
    for c, flag in plain.items():
        writer = writer.option(f"parquet.enable.dictionary#{c}", flag)
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def token_table(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, ``start``, ``n_tokens``, ``ids_crc32``."""
    ship_package(spark)
    files = read_tokens(spark, path)

    def run(batches):
        for b in batches:
            ids = b.column(3)
            offsets = np.asarray(ids.offsets)
            values = np.asarray(ids.values).astype("<u4")
            crc = [zlib.crc32(values[s:e].tobytes()) for s, e in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(np.diff(offsets).astype(np.int64)),
                 pa.array(crc, pa.int64())], names=["part", "row", "_id", "n_tokens", "ids_crc32"])

    kind = files.schema[id_col].dataType.simpleString()
    d = files.select("part", "row", F.col(f"`{id_col}`").alias("_id"), "ids") \
        .mapInArrow(run, f"part bigint, row bigint, _id {kind}, n_tokens bigint, ids_crc32 bigint")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_off"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    d = d.withColumn("_in", within).join(parts, "part")
    return d.select(F.col("_id").alias(id_col), (F.col("_off") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")
