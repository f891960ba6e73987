import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edge_rows import EDGE
from rxframe.llm import winnowing as wn
from rxframe.llm.blocks import _BASE

M = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def plain(text, k, w):
    """(hash, position) kept, window by window, with Python's integers."""
    if not text:
        return []
    chars = [ord(c) for c in text] + [wn.NO_CHAR] * (k - len(text))
    hashes = []
    for i in range(len(chars) - k + 1):
        h = 0
        for c in chars[i:i + k]:
            h = (h * int(_BASE) + mix(c)) & M
        hashes.append(mix(h) >> 32)
    kept = set()
    for i in range(max(1, len(hashes) - w + 1)):
        window = hashes[i:i + w]
        kept.add(max(i + j for j, h in enumerate(window) if h == min(window)))
    return [(hashes[p], p) for p in sorted(kept)]


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


texts = st.lists(st.text(st.sampled_from("abé\U0001F600 \x00"), max_size=40), max_size=8)


@given(texts, st.integers(1, 9), st.integers(1, 12))
@settings(max_examples=300, deadline=None)
def test_batches_match_plain_winnowing(batch, k, w):
    how = wn.Winnowing(k, w)
    found = how.fingerprints(batch)
    want = [plain(t, k, w) for t in batch]
    assert [wn.parse(f) for f in found.texts()] == want
    near = wn.likeness(found.sets(), how.fingerprints(batch[::-1]).sets(), len(batch))
    assert list(near) == [alike(a, b) for a, b in zip(want, want[::-1])]


@pytest.mark.parametrize("piece, group", [(1, 1), (7, 50), (64, 10_000)])
def test_pieces_change_nothing(monkeypatch, piece, group):
    long = ["abc " * 300 + "xyz" * 40, "", "a", "a" * 500, "".join(chr(97 + i * i % 23) for i in range(900))]
    monkeypatch.setattr(wn, "PIECE", piece)
    monkeypatch.setattr(wn, "GROUP", group)
    how = wn.Winnowing(6, 10)
    assert [wn.parse(f) for f in how.fingerprints(long).texts()] == [plain(t, 6, 10) for t in long]


@given(st.text(max_size=60), st.text(max_size=60), st.text(min_size=13, max_size=40), st.text(max_size=60), st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_shared_runs_are_matched(a, b, shared, c, d):
    how = wn.Winnowing(5, 9)  # 13 code points are enough
    one, two = how.fingerprints([a + shared + b, c + shared + d]).texts()
    inside = [{(h, p - len(x)) for h, p in wn.parse(f) if 0 <= p - len(x) <= len(shared) - 5} for f, x in ((one, a), (two, c))]
    assert inside[0] & inside[1]


def test_least_hash_is_the_rightmost():
    assert [p for _, p in wn.parse(wn.Winnowing(1, 4).fingerprints(["aaaaaaa"]).texts()[0])] == [3, 4, 5, 6]


def test_parameters():
    for k, w in ((0, 4), (4, 0), (4, 256)):
        with pytest.raises(ValueError):
            wn.Winnowing(k, w)


def expected(rows, how=wn.Winnowing()):
    """The table by hand; equal ids only with equal texts."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        third = len(t) // 3
        e = t[:len(t) - third] + after[:third]
        f, g, h = (plain(x, how.k, how.w) for x in (t, e, after))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, alike(f, g), alike(f, h)))
    return out


def got(table):
    return [(r["doc_id"], r["n_chars"], r["edited_sha256"], wn.parse(r["fingerprint"]), wn.parse(r["edited_fingerprint"]),
             r["near_edited"], r["near_next"]) for r in table.collect()]


ROWS = [r for r in EDGE if r[0] is not None] + [(None, "no id here at all"), (50, "a line of words\n" * 700), (51, "é" * 20_000)]


@pytest.mark.parametrize("range_bytes", [64, 5000, wn.RANGE_BYTES])
def test_table(make_docs, monkeypatch, range_bytes):
    monkeypatch.setattr(wn.with_next, "__defaults__", ("doc_id", "text", range_bytes))
    monkeypatch.setattr(wn, "THEN_BYTES", range_bytes)
    docs = make_docs(ROWS)
    for c in ("id", "h", "range", "guest", "fingerprint"):
        docs = docs.withColumn(c, docs["source"])
    assert sorted(got(wn.edited_table(docs)), key=str) == sorted(expected(ROWS), key=str)


def test_equal_ids_and_small_tables(make_docs, spark):
    assert wn.edited_table(make_docs([])).count() == 0
    one = wn.edited_table(make_docs([(3, "abcdef")])).collect()[0]
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    rows = [(1, "some text of one"), (1, "another text"), (None, "x" * 50), (None, "y" * 50), (1, "some text of one")]
    first = sorted(map(tuple, wn.edited_table(make_docs(rows)).collect()), key=str)
    assert len(first) == 5
    assert first == sorted(map(tuple, wn.edited_table(make_docs(rows, 1)).collect()), key=str)
    named = spark.createDataFrame([("b", "text of b " * 9), ("a", "text of a " * 9), ("c", None)], "key string, body string")
    prints = {r["key"]: (r["hashes"], r["positions"]) for r in wn.fingerprint(named, id_col="key", text_col="body").collect()}
    assert prints["c"] == ([], [])
    assert [*zip(*prints["a"])] == plain("text of a " * 9, 16, 32)


def test_whole_table(sf_docs):
    rows = [(r["doc_id"], r["text"]) for r in sf_docs.select("doc_id", "text").collect()]
    want = {r[0]: r for r in expected(rows, wn.Winnowing())}
    found = got(wn.edited_table(sf_docs))
    assert len(found) == len(want) and all(want[r[0]] == r for r in found)
