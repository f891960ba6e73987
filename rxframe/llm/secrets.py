"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns at the hits, checksums.

One automaton finds all keywords in one pass over a text; a kind's pattern is only
tried, anchored, where one of its keywords starts.  Hexadecimal runs have no keyword
and are searched directly.  Token formats that embed a checksum (the last six
characters are the base-62 CRC-32 of the thirty before) are kept only if it holds.

Matches of a kind are leftmost and do not overlap; a match that is too short or has
a wrong checksum is dropped but still takes its characters.  Offsets are code points,
end exclusive.  The scan is a row-local ``mapInArrow``: no shuffle, any text length.

Defined results: a null or empty text has no spans.  Equal rows give equal rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from rxframe.session import ship_package

# fixed values: keywords, patterns and least lengths of the base kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# formats of public services
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])", re.A)
CHAT = re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}", re.A)
CLOUD = re.compile(r"AIza[A-Za-z0-9_-]{35}", re.A)
PAYMENT = re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}", re.A)
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "checked", "chat", "cloud", "payment", "pem")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "checked": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "chat": ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"),
    "cloud": ("aiza",),
    "payment": ("sk_live_", "rk_live_"),
    "pem": ("-----begin",),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: str) -> str:
    """CRC-32 of the characters in base 62, six digits."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0")


_VALID = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 8),
    "access": (ACCESS, lambda m: len(m[0]) >= 16),
    "checked": (CHECKED, lambda m: checksum62(m[1][:30]) == m[1][30:]),
    "chat": (CHAT, None), "cloud": (CLOUD, None), "payment": (PAYMENT, None), "pem": (PEM, None),
}
_AUTOMATON = []
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _automaton():
    if not _AUTOMATON:
        import ahocorasick
        a = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for w in words:
                a.add_word(w, (kind, len(w)))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, in the order of start, then kind."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer would shift what follows
        low = text.translate(_ASCII_LOWER)
    hits: dict[str, list[int]] = {}
    for end, (kind, size) in _automaton().iter(low):
        hits.setdefault(kind, []).append(end - size + 1)
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for kind, starts in hits.items():
        pattern, valid = _VALID[kind]
        free = 0
        for at in sorted(starts):
            m = pattern.match(text, at) if at >= free else None
            if m:
                free = m.end()
                if valid is None or valid(m):
                    out.append((at, free, kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(found) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts of the base kinds, ``base_sha256`` of the base
    spans and ``spans`` (all of them)."""
    ship_package(docs.sparkSession)

    def run(batches):
        for b in batches:
            n = {k: [] for k in BASE}
            digest, all_spans = [], []
            for t in b.column(1):
                found = spans(t.as_py())
                for k in BASE:
                    n[k].append(sum(s[2] == k for s in found))
                base = _joined([s for s in found if s[2] in BASE])
                digest.append(hashlib.sha256(base.encode()).hexdigest())
                all_spans.append(_joined(found))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(n[k], pa.int64()) for k in BASE], pa.array(digest, pa.string()),
                 pa.array(all_spans, pa.string())],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    d = docs.select(f"`{id_col}`", f"`{text_col}`")
    kind = docs.schema[id_col].dataType.simpleString()
    return d.mapInArrow(run, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, "
                             "base_sha256 string, spans string")
