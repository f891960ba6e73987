import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edge_rows import EDGE
from rxframe.llm import suffixes


def brute(rows, length):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, out = set(), []
    for k in order:
        t = (rows[k][1] or "").encode()
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            s = t[p:p + length]
            if s in seen:
                gone[p:p + length] = [True] * length
            seen.add(s)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((rows[k][0], len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_suffix_array_and_prefixes(strings):
    symbols = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.uint16) + 1, 0) for s in strings]).astype(np.uint16)
    whole = b"".join(bytes([*(x + 1 for x in s), 0]) for s in strings)
    suffix = lambda i: (whole[i:whole.index(0, i)], i)
    want = sorted(range(len(whole)), key=suffix)
    order = suffixes.sort_suffixes(symbols)
    assert order.tolist() == want
    prefix = suffixes.common_prefixes(symbols, order, 20)
    for j in range(1, len(want)):
        a, b = suffix(want[j - 1])[0], suffix(want[j])[0]
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert prefix[j] == min(n, 20)


def passages(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    common = [text(40) for _ in range(3)]
    rows = []
    for i in range(60):
        t = " ".join(rnd.choice([text(rnd.randint(1, 30)), rnd.choice(common), rnd.choice(common)[rnd.randint(0, 60):]])
                     for _ in range(rnd.randint(1, 4)))
        rows.append((rnd.randint(0, 10 ** 6) * 100 + i, t))
    rows += [(10 ** 9 + k, rows[k][1]) for k in range(10)]
    rows += [(5, "ab" * 300), (6, "aaaa" * 100), (7, "ab" * 250 + "c"), (8, "z" * 99), (9, "z" * 100), (10, "z" * 101)]
    return rows


@pytest.mark.parametrize("big", [20_000, 2])
def test_repeated_passages(make_docs, big):
    rows = passages(big)
    df = suffixes.drop_repeats(make_docs(rows), big_side=big, block_bytes=3000, range_bytes=5000, context_bytes=4000)
    assert got(df) == brute(rows, 100)


def test_small_table(sf_docs):
    rows = [(r["doc_id"], r["text"]) for r in sf_docs.collect()]
    assert got(suffixes.drop_repeats(sf_docs)) == brute(rows, 100)


def test_edge_rows(make_docs):
    docs = [*EDGE, (40, None), (41, "é" * 200), (42, "é" * 200), (None, "é" * 200)]
    assert got(suffixes.drop_repeats(make_docs(docs))) == brute(docs, 100)
    assert suffixes.drop_repeats(make_docs([])).count() == 0
    kept = suffixes.drop_repeats(make_docs([(1, "x" * 150), (2, "y")]), with_bytes=True).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in kept} == {1: b"x", 2: b"y"}
