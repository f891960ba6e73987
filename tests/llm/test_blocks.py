from pyspark.sql import functions as F

from edge_rows import EDGE
from rxframe.llm import blocks


def test_rows_are_picked_without_moving_them(spark, make_docs, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS_PER_BLOCK_BITS", 1)
    docs = make_docs(EDGE).withColumn("_at", F.lit("x")).withColumn("_row", F.lit(1)).withColumn("_block", F.lit(None).cast("int"))
    stored = blocks.store_rows(docs, "text", bucket_bytes=4000)
    numbers = stored.where("_row.doc_id % 2 = 1 or _row.doc_id is null").select("_at")
    picked = blocks.with_rows_at(stored, numbers)
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    assert "_kept" in plan
    got = picked.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    want = docs.where("doc_id % 2 = 1 or doc_id is null")
    assert got.dtypes == docs.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = blocks.with_rows_at(stored, numbers)._jdf.queryExecution().executedPlan().toString()
        left = [line for line in text.splitlines() if line.lstrip().startswith(":")]
        assert "SortMergeJoin" in text and any("Bucketed: true" in line for line in left)
        assert not any("Exchange" in line for line in left)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert blocks.store_rows(make_docs([]), "text").count() == 0
