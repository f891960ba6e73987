"""Context texts meet their requests last: nothing that holds a line is shuffled, and both paths agree."""

from rxframe.operators import context as cx
from rxframe.plans.consult import consult_contexts, consult_prompts, prepare_consult

COLS = cx.MasterColumns(trade="trade", sci="sci", form="form", strength="strength", price="price", route="route", leaflet="leaflet")


def _tables(spark):
    master = spark.createDataFrame(
        [(1, "Red Ring", "RING", "long text one"), (1, "Blue Ring", "OTHER", None), (2, "Old Bolt", "BOLT", "two"), (3, "Hot Ring", None, "three"),
         (None, "Lost Ring", "LOST", "four"), (5, "Cold Ring", "COLD", "five"), (6, "Grey Ring", "GREY", "six")],
        "ord long, trade string, sci string, leaflet string").selectExpr(
        "*", "'f' form", "'1 mg' strength", "2.5D price", "'r' route")
    requests = spark.createDataFrame(
        [(1, "ring", "none", "Brandol"), (1, "bolt", "none", "A!, A"), (None, "ring", "", ""), (2, "xyz", "xyz", "xyz"), (3, "dose", "", "")],
        "req_id long, symptoms string, history string, medications string").selectExpr("*", "'9' age_weight")
    symptoms = spark.createDataFrame([("dose", "bolt, ring", 1)], "key string, value string, ord long")
    links = spark.createDataFrame([("BRANDOL", "bolt"), ("A!", "x"), ("A", "y")], "key string, ingredient string")
    return requests, master, symptoms, links, COLS


def _rows(df):
    return sorted(map(str, df.collect()))


def test_broadcast_lines_equal_shuffled_ones(spark, monkeypatch):
    t = _tables(spark)
    few = [_rows(consult_contexts(*t)), _rows(consult_prompts(*t)), _rows(consult_prompts(*t, base=prepare_consult(t[1], COLS)))]
    monkeypatch.setattr(cx, "BROADCAST_BYTES", -1)
    many = [_rows(consult_contexts(*t)), _rows(consult_prompts(*t)), _rows(consult_prompts(*t, base=prepare_consult(t[1], COLS)))]
    assert few == many
    assert len(few[0]) == 5 and len(few[1]) == 6            # a repeated request meets each of its contexts, a missing one none
    assert "Red Ring" in few[0][1] and "Blue Ring" in few[0][1]       # two rows of one order are both shown
    monkeypatch.setattr(cx, "BROADCAST_ROWS", -1)
    assert _rows(consult_contexts(*t)) == few[0]


def test_no_line_is_grouped_or_sorted_by_request(spark):
    for found in (consult_contexts(*_tables(spark)), consult_prompts(*_tables(spark))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        moved = [x for x in plan.splitlines() if ("Exchange" in x and "Broadcast" not in x) or "Aggregate" in x or " Sort " in x]
        assert moved and not any("line#" in x or "_l0#" in x or "context#" in x for x in moved)


def test_streamed_prompts_are_written_small(spark, tmp_path):
    from rxframe.streaming.streams import consult_stream
    rows = spark.range(9)
    rows.write.parquet(f"{tmp_path}/in")
    consult_stream(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out", f"{tmp_path}/ckpt", lambda batch: batch, timeout_s=100)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 9
    assert [f for f in tmp_path.glob("out/*/*.parquet")] == [f for f in tmp_path.glob("out/*/*.zstd.parquet")]


def test_landed_pages_are_many_tasks_of_a_micro_batch(spark, tmp_path, monkeypatch):
    from rxframe.plans import catalog
    seen = {}
    real = catalog.page_extract_stream

    def watched(s, pages_dir, *args, **kw):
        seen["files"], seen["query"] = s.read.parquet(pages_dir).inputFiles(), real(s, pages_dir, *args, **kw)
    monkeypatch.setattr(catalog, "page_extract_stream", watched)
    spark.range(6000).selectExpr("id page_id", "'u' url", "'<h1>x</h1>' html").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert catalog.q_stream_page_extract(spark, str(tmp_path)).count() == 6000
    assert len(seen["files"]) == 3 and [p["numInputRows"] for p in seen["query"].recentProgress if p["numInputRows"]] == [6000]
