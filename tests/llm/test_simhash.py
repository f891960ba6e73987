import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from edge_rows import EDGE
from rxframe.llm import simhash


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 2:
            parent[root(i)] = root(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    return sorted(((i, f"{fps[k]:016x}", low[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_small_table(sf_docs):
    rows = [(r["doc_id"], r["text"]) for r in sf_docs.collect()]
    assert got(simhash.near_duplicates(sf_docs)) == brute(rows)


def test_spark_hash_is_the_same(spark):
    text = "Grüße an ALLE"
    h = spark.range(1).select(F.xxhash64(F.lit("grüße an alle"))).first()[0]
    assert h % (1 << 64) == simhash.fingerprint(text)


def test_edge_rows(make_docs):
    rows = [*EDGE, (20, "one two three four"), (21, "ONE two\tthree\nfour")]
    assert got(simhash.near_duplicates(make_docs(rows))) == brute(rows)
    kept = simhash.drop_near_duplicates(make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    assert kept.count() == len({c for _, _, c in brute(rows)})
    assert simhash.near_duplicates(make_docs([])).count() == 0
    assert simhash.drop_near_duplicates(make_docs([])).count() == 0


@pytest.mark.parametrize("big", [2000, 3])
def test_links_lose_nothing(spark, big):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 4))) for b in base for _ in range(60)}
    fps |= {rnd.getrandbits(64) for _ in range(100)} | {0, 1, 3, 7, 2 ** 64 - 1}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    want = {(a, b) for a, b in itertools.permutations(signed, 2) if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 2}
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    assert {tuple(r) for r in simhash.links(nodes, 2, big).collect()} == want


def test_allocation_is_least_cost():
    rng = np.random.default_rng(1)
    cost = rng.random((50, 3, 4))
    cost[:, :, 0] = 0
    for row, t in zip(cost, simhash.allocate(cost, 0)):
        assert t.sum() == 0
        options = [c for c in itertools.product(range(-1, 3), repeat=3) if sum(c) == 0]
        best = min(sum(row[k, x + 1] for k, x in enumerate(c)) for c in options)
        assert abs(sum(row[k, x + 1] for k, x in enumerate(t)) - best) < 1e-12
