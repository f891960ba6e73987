import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from rxframe.llm import sharding
from edge_rows import EDGE


@given(st.lists(st.integers(0, 1000), max_size=40), st.integers(2, 6))
@settings(max_examples=60, deadline=None)
def test_difference_keeps_every_item_once(sizes, k):
    sums, places = sharding.difference([(i, [s]) for i, s in enumerate(sizes)], k)
    again = [0] * k
    for i, s in enumerate(sizes):
        again[places[i][0]] += s
    assert again == sums and sums == sorted(sums, reverse=True)
    if sizes:
        assert sums[0] - sums[-1] <= max(sizes)


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def check(rows, k=8):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(0 <= s < k for s in slots)


def test_balanced_gapless_and_repeatable(sf_docs):
    rows = sharding.shard_table(sf_docs, 8, bucket_items=16, slot_rows=10).collect()
    check(rows)
    text = {r["doc_id"]: r["text"] for r in sf_docs.collect()}
    where, total = {}, [0] * 8
    for r in rows:
        t = text[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
        assert where.setdefault(t, r["shard"]) == r["shard"]
        total[r["shard"]] += r["size"]
    assert max(total) - min(total) <= 0.02 * sum(total) / 8 + 50
    assert table(sharding.shard_table(sf_docs.repartition(5), 8, bucket_items=16, slot_rows=10)) == sorted(map(tuple, rows), key=str)


def test_edge_rows(make_docs):
    rows = sharding.shard_table(make_docs(EDGE), 8).collect()
    assert len(rows) == len(EDGE)
    check(rows)
    assert len({r["shard"] for r in rows if r["size"] == 1}) == 1
    assert sharding.shard_table(make_docs([]), 8).count() == 0
