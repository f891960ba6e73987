import collections
import math
import re
import struct

import pytest
import xxhash
from edge_rows import EDGE
from pyspark.sql import functions as F

from rxframe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def check(df, texts):
    got = sorted(tuple(r["_quality"])[:6] for r in df.collect())
    assert got == sorted(brute(t) for t in texts)


def test_base_counts_match_brute_force(sf_docs):
    check(quality.base_counts(sf_docs), [r["text"] for r in sf_docs.collect()])


def test_edge_texts(make_docs):
    texts = [t for _, t in EDGE] + ["a b c d e f a b c d e g\nx\nx\n\n\nx y", "r " * 4]
    d = make_docs([(i, t) for i, t in enumerate(texts)])
    check(quality.base_counts(d), texts)


def test_junk_goes_and_clean_stays(spark, sf_docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    d = quality.assess(docs, quality.trusted_labels(labels)).join(labels, "doc_id")
    rows = [r for r in d.select("quality", "_quality").collect() if not r["_quality"]["base_failed"]]
    assert all(r["_quality"]["kept"] for r in rows if r["quality"] == 1)
    bad = [r["_quality"]["kept"] for r in rows if r["quality"] == 0]
    assert sum(bad) <= 0.1 * len(bad)


def test_no_trusted_documents_and_no_documents(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = quality.assess(make_docs([(1, "one two three four five six seven eight nine ten")]), quality.trusted_labels(none))
    assert d.first()["_quality"]["kept"] is True
    assert quality.assess(make_docs([]), quality.trusted_labels(none)).count() == 0


def test_clashing_columns_pass_through(make_docs):
    d = make_docs([(1, "a b")]).withColumn("n_words", F.lit("mine")).withColumn("h", F.lit(1))
    r = quality.base_counts(d).first()
    assert r["n_words"] == "mine" and r["_quality"]["n_words"] == 2


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def gram_hashes(text):
    """Hashes of words, of word pairs and of the last three characters of words."""
    w = WORD.findall(text or "")
    one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    two = [xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)) for a, b in zip(one, one[1:])]
    ends = [xxhash.xxh64_intdigest(struct.pack("<i", 3), xxhash.xxh64_intdigest(x[-3:].encode(), 42)) for x in w]
    return [signed(h) for h in one + two + ends]


def verdicts(rows, trusted, buckets):
    """(id, ratio, kept) of every (id, text), from plain counts."""
    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        here = collections.Counter(h % buckets for h in gram_hashes(t))
        raw += here
        if i in trusted:
            target += here
    n, m = raw.total(), target.total()
    log = [math.log((target[k] + 1) / (m + buckets)) - math.log((raw[k] + 1) / (n + buckets)) if m else 0.0 for k in range(buckets)]
    out = []
    for i, t in rows:
        hs = gram_hashes(t)
        ratio = sum(log[h % buckets] for h in hs) / len(hs) if hs else 0.0
        out.append((i, ratio, not brute(t)[-1] and ratio >= quality.MIN_MEAN_RATIO))
    return out


def check_verdicts(docs, trusted, buckets):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    ids = {r[0] for r in trusted.collect()} - {None}
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(verdicts(rows, ids, buckets), key=key)
    got = quality.assess(docs, trusted, buckets=buckets).select("doc_id", "_quality.ratio", "_quality.kept").collect()
    got = sorted(map(tuple, got), key=key)
    assert [(g[0], g[2]) for g in got] == [(w[0], w[2]) for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)
    return want


def test_ratio_and_verdict_match_plain_counts(spark, sf_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    want = check_verdicts(sf_docs, quality.trusted_labels(labels), quality.BUCKETS)
    assert {k for _, _, k in want} == {True, False}


def test_verdicts_of_repeated_and_null_ids(spark, make_docs):
    rows = [(i, t) for i, t in EDGE] + [(7, "seven of them " * 3), (7, "another seven"), (None, "no id " * 9), (8, "w " * 20_000)]
    trusted = spark.createDataFrame([(7,), (7,), (None,), (12345,), (8,)], "doc_id long")
    check_verdicts(make_docs(rows).repartition(3), trusted, 50)


def test_texts_do_not_meet_ids_by_a_shuffle(spark, sf_docs):
    """However many ids: with broadcasts off, the rows are read as they are bucketed."""
    from rxframe.llm.blocks import marked_rows, store_rows
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = store_rows(sf_docs, "text")
        d = marked_rows(stored, stored.where("_row.doc_id % 3 = 0").select("_at"), "hit")
        plan = d._jdf.queryExecution().executedPlan().toString()
        hits = d.groupBy((F.col("_row.doc_id") % 3 == 0).alias("want"), "hit").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanged) <= 1 and all("SelectedBucketsCount" in x for x in plan.splitlines() if "rows" in x and "FileScan" in x)
    assert "Sort [" not in plan and {(r["want"], r["hit"]) for r in hits} == {(True, True), (False, False)}
