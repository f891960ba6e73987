"""Page extraction on literal HTML, paging, and stream = batch."""

import os
import tempfile

from rxframe.operators.pages import label_values, page_texts, result_links
from rxframe.operators.search import page_rows

HTML = ('<html><head><title>T</title><script>var t="</p>";</script></head><body>'
        '<a href="/1">view one</a><a href="/x">other</a><a href="/2">view two</a><a href="/3">view &amp; 3</a>'
        '<a href="/4">view four</a><a href="/5">other</a>'
        '<article><h1>Title &amp; more</h1><p>First  para<p> second <b>bold</b></p></article>'
        '<h2>Dose</h2></body></html>')


def test_links_fields_text(spark):
    p = spark.createDataFrame([(1, HTML), (2, "<html></html>")], "page_id long, html string")
    links = [(r["rank"], r["href"], r["text"]) for r in result_links(p, "page_id", "html", "view", 3)
             .orderBy("rank").collect()]
    assert links == [(1, "/1", "view one"), (2, "/2", "view two"), (3, "/3", "view & 3")]
    fields = {r["label"]: r["value"] for r in label_values(p, "page_id", "html").collect()}
    assert fields["other"] == "/5"           # a later duplicate label wins
    t = {r["page_id"]: r for r in page_texts(p, "page_id", "html").collect()}
    assert t[1]["body"] == "Title & more\nFirst  para\nsecond\nbold"
    assert t[1]["headings"] == "Dose"
    assert t[2]["body"] is None


def test_paging(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(23)], "ord long")
    rows = sorted((r["ord"], r["rn"], r["page"], r["page_count"], r["first_row_on_page"], r["last_row_on_page"])
                  for r in page_rows(df, "ord", 10).collect())
    assert [r[1] for r in rows] == list(range(1, 24))
    assert rows[-1][2:] == (3, 3, 21, 23)
    assert rows[0][2:] == (1, 3, 1, 10)


def test_page_stream_equals_batch_and_resumes(spark):
    from rxframe.streaming.streams import page_extract_stream
    base = tempfile.mkdtemp(prefix="rxframe-stream-", dir="/tmp")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    pages.repartition(3).write.parquet(os.path.join(base, "in"))
    out, ck = os.path.join(base, "out"), os.path.join(base, "ck")
    page_extract_stream(spark, os.path.join(base, "in"), pages.schema, out, ck, timeout_s=300)
    first = spark.read.parquet(out)
    batch = page_texts(pages, "page_id", "html", keep=("url",))
    assert first.count() == pages.count()
    assert first.exceptAll(batch).count() == 0 and batch.exceptAll(first).count() == 0
    q = page_extract_stream(spark, os.path.join(base, "in"), pages.schema, out, ck, timeout_s=300)
    assert q.lastProgress is None or q.lastProgress["numInputRows"] == 0   # nothing done twice
    assert spark.read.parquet(out).count() == pages.count()


def test_entry_and_all_keys_run(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for k, fn in entry.queries().items():
        if k.startswith("stream_"):
            continue
        res = fn(spark, "/root/testdata/sf0.001")
        res.limit(1).collect()
        assert res.columns, k
