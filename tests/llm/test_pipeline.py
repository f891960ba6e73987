"""Pipeline stages against their operators' brute-force versions, each on its own input."""

import corpus_pipeline as cp
from rxframe.llm import decontaminate, quality
from rxframe.session import materialize
from test_decontaminate import brute as brute_leaks
from test_quality import brute as brute_counts
from test_simhash import brute as brute_groups
from test_token_files import expected as expected_tokens

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "source_mix", "token_output"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")

    good = materialize(cp.quality_rules(spark, docs, SF))
    assert good.columns == docs.columns
    ratio = {r["doc_id"]: r["_quality"]["ratio"] for r in
             quality.assess(docs, quality.trusted_labels(labels)).select("doc_id", "_quality").collect()}
    want = [r for r in rows(docs) if not brute_counts(r[1])[5] and ratio[r[0]] >= quality.MIN_MEAN_RATIO]
    assert rows(good) == want and 0 < len(want) < docs.count()

    one = materialize(cp.near_duplicates(spark, good, SF))
    first = {c for _, _, c in brute_groups([(r[0], r[1]) for r in rows(good)])}
    assert rows(one) == [r for r in rows(good) if r[0] in first]

    clean = materialize(cp.decontamination(spark, one, SF))
    found = {i for i, _ in brute_leaks([(r[0], r[1]) for r in rows(one)], [tuple(r) for r in bench.collect()])}
    assert rows(clean) == [r for r in rows(one) if r[0] not in found] and found

    mixed = materialize(cp.source_mix(spark, clean, SF))
    assert mixed.columns == docs.columns and mixed.dtypes == docs.dtypes
    size = {}
    for r in rows(clean):
        size[r[3]] = size.get(r[3], 0) + len(r[1].split())
    taken = {}
    for r in rows(mixed):
        taken[r[3]] = taken.get(r[3], 0) + len(r[1].split())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(size)
    assert all(n <= 2 * size[s] for s, n in taken.items())

    out = cp.token_output(spark, mixed, SF)
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out.collect())
    assert got == sorted((i, n, c) for i, _, n, c in expected_tokens([(r[0], r[1]) for r in rows(mixed)]))


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, SF))
    assert rows(cp.run(spark, SF)) == rows(docs)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, SF))
        assert docs.count() == 0
    assert decontaminate.drop_leaks(docs.selectExpr("doc_id", "cast(null as string) as text"),
                                    spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
