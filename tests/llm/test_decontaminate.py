import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from edge_rows import EDGE
from rxframe.llm import decontaminate as dc


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    """Best weighted Jaccard of any item-sized window, all windows tried."""
    out = set()
    for i, text in docs:
        w = tokens(text)
        for j, t in items:
            x = tokens(t)
            if not x:
                continue
            size = min(5, len(x))
            want = Counter(tuple(x[k:k + size]) for k in range(len(x) - size + 1))
            sh = [tuple(w[k:k + size]) for k in range(len(w) - size + 1)]
            n = sum(want.values())
            for s in range(max(1, len(sh) - n + 1)):
                c = Counter(sh[s:s + n])
                if c and sum((c & want).values()) / sum((c | want).values()) >= 0.8:
                    out.add((i, j))
                    break
    return sorted(out, key=str)


def got(df):
    return sorted({(r["_id"], r["item"]) for r in df.select("_id", "item").collect()}, key=str)


def test_small_table(spark, sf_docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [(r["doc_id"], r["text"]) for r in sf_docs.collect()]
    assert got(dc.leaks(sf_docs, bench)) == brute(docs, [(r["item_id"], r["text"]) for r in bench.collect()])


def test_edited_moved_and_short_items(spark, make_docs):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(n)] for n in (60, 45, 30, 7, 5, 3, 1)] + [["again"] * 12, ["x", "y"] * 10]
    items = [(i, " ".join(w)) for i, w in enumerate(base)] + [(90, None), (91, " "), (92, " ".join(base[0]))]
    docs, at = [], 100
    for w in base:
        for edit in ("whole", "first gone", "last gone", "one changed", "inserted", "halves swapped", "upper"):
            x, k = list(w), rnd.randrange(len(w))
            if edit == "first gone":
                x = x[1:]
            elif edit == "last gone":
                x = x[:-1]
            elif edit == "one changed":
                x[0] = "zz"
            elif edit == "inserted":
                x.insert(k, "zz")
            elif edit == "halves swapped":
                x = x[len(x) // 2:] + x[:len(x) // 2]
            elif edit == "upper":
                x = [v.upper() for v in x]
            for pad in (0, 150):
                before, after = ([word() for _ in range(rnd.randint(0, pad))] for _ in range(2))
                docs.append((at, " ".join(before + x + after)))
                at += 1
    docs += EDGE
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(dc.leaks(make_docs(docs), bench)) == brute(docs, items)


def test_simhash_votes(spark):
    hs = [random.Random(i).getrandbits(64) - (1 << 63) for i in range(7)]
    df = spark.createDataFrame([(hs,)], "h array<long>").select(dc.simhash(F.col("h"), F.size("h")).alias("fp"))
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert df.first()["fp"] % (1 << 64) == want


@pytest.mark.parametrize("bench", [[], [(1, None)], [(1, "one two three four five six")]])
def test_empty_sides_and_drop(spark, make_docs, bench):
    b = spark.createDataFrame(bench, "item_id long, text string")
    docs = make_docs([*EDGE, (50, "and one two three four five six")])
    kept = dc.drop_leaks(docs, b)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - (bool(bench) and bench[0][1] is not None)
    assert dc.leaks(make_docs([]), b).count() == 0
