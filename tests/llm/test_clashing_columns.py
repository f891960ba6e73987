from edge_rows import EDGE
from pyspark.sql import functions as F

from rxframe.llm import decontaminate, quality

NAMES = ["_ws", "_w1", "_at", "_quality", "_leak_id", "_leak_x", "_in0", "_id", "_x", "kept"]


def clashing(docs):
    return docs.withColumns({n: F.lit(f"own {n}") for n in NAMES})


def test_quality_keeps_rows_as_they_are(make_docs):
    long = [(100, "word " * 3 + " ".join(f"w{i}" for i in range(40))), (101, " ".join(f"v{i}" for i in range(30)))]
    docs = make_docs([*EDGE, *long])
    trusted = docs.where("doc_id >= 100").select("doc_id")
    want = sorted(map(tuple, quality.keep_good(docs, trusted).collect()), key=str)
    got = quality.keep_good(clashing(docs), trusted)
    assert got.schema == clashing(docs).schema and want
    assert sorted(map(tuple, got.select(*docs.columns).collect()), key=str) == want
    assert all(r[n] == f"own {n}" for r in got.collect() for n in NAMES)


def test_decontamination_keeps_rows_as_they_are(spark, make_docs):
    item = " ".join(f"q{i}" for i in range(30))
    docs = make_docs([*EDGE, (200, "before it " + item + " after it")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    want = sorted(map(tuple, decontaminate.drop_leaks(docs, bench).collect()), key=str)
    got = decontaminate.drop_leaks(clashing(docs), bench)
    assert got.schema == clashing(docs).schema
    rows = got.collect()
    assert sorted((tuple(r[c] for c in docs.columns) for r in rows), key=str) == want
    assert 200 not in {r["doc_id"] for r in rows} and len(rows) == len(EDGE)
    assert all(r[n] == f"own {n}" for r in rows for n in NAMES)
