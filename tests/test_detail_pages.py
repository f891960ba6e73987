"""Detail-page DOM rules (label -> next value div, sections by id)."""

from rxframe.operators.detail_pages import detail_fields, detail_sections, parse_detail_page

PAGE = ('<div id="D-div"><label class="form-label"> A &amp; B </label>'
        '<div class="x"><div class="form-line"> 1 <b> 2 </b></div></div>'
        '<label class="form-label">A &amp; B</label><p>unclosed<div class="form-line">later</div>'
        '<label class="form-label">Last</label></div>'
        '<div id="A-div"><p> one <p>two</p><br> </div>'
        '<div id="M-div">لم يتم إدخال بيانات</div>'
        '<div class="form-line">outside</div>')


def test_parse_rules():
    fields, sections = parse_detail_page(PAGE)
    assert list(fields) == ["A & B", "Last"]
    assert fields["A & B"] == "later"            # a later duplicate label wins, first position kept
    assert fields["Last"] == "outside"           # the next value div after the label, anywhere
    assert sections == {"leaflet": "one\ntwo"}   # placeholder section dropped


def test_detail_frames(spark):
    pages = spark.createDataFrame([(7, PAGE), (8, None), (9, "<p>no tabs</p>")], "page_id long, html string")
    f = sorted((r["page_id"], r["pos"], r["label"], r["value"]) for r in detail_fields(pages).collect())
    assert f == [(7, 0, "A & B", "later"), (7, 1, "Last", "outside")]
    s = [(r["page_id"], r["section"], r["text"]) for r in detail_sections(pages).collect()]
    assert s == [(7, "leaflet", "one\ntwo")]


def test_main_block_rules():
    from rxframe.operators.detail_pages import parse_main_block
    page = ('<div id="content"><p>by id</p></div>'
            '<div class="x contentBox"><h2> A </h2><p>one\n two</p><h3>B<b>!</b></h3></div>')
    assert parse_main_block(page) == (" A \none\n two\nB\n!", "A\nB!")    # class first, text unstripped
    assert parse_main_block('<section id="content"><p> x </p></section>') == (" x ", "")
    assert parse_main_block("<div><p>none</p></div>") == (None, None)


RESULTS = ('<a href="/o">other</a><a class="b" href="/1">view</a><a href="/2"><span>view it</span></a>'
           '<a href="/x">view <b>two texts</b></a><a name="n">view</a><a href="/4">view</a>'
           '<div class="search-results-product row"><a class="search-results-product-info-title-link"> A &middot; <b>x</b></a>'
           '<div id="q" class="search-results-product-info-type">one<style>p{}</style></div></div>'
           '<div class="search-results-product"><a class="search-results-product-info-title-link">no type</a></div>'
           '<div class="search-results-product"><a class="search-results-product-info-title-link">cut</a>'
           '<div class="search-results-product-info-type">off</div></div>')


def test_links_and_cards_cut_before_drop():
    from rxframe.operators.detail_pages import parse_result_cards, parse_result_links
    assert parse_result_links(RESULTS, "view", 3) == ["/1", "/2"]       # the third match has no target
    assert parse_result_links(RESULTS, "view", 9) == ["/1", "/2", "/4"]
    assert parse_result_cards(RESULTS, 2) == [(0, "A ·x", "one")]
    assert parse_result_links(None, "view", 3) == [] and parse_result_cards("", 5) == []


def test_script_and_style_are_not_text_and_short_sections_go():
    from rxframe.operators.detail_pages import parse_main_block
    assert parse_main_block('<div id="content">a<script>var x=1;</script><style>p{}</style>&#233;</div>') == ("a\né", "")
    assert parse_detail_page('<div id="A-div">0123456789</div>', min_len=10)[1] == {}
    assert parse_detail_page('<div id="A-div">0123456789a</div>', min_len=10)[1] == {"leaflet": "0123456789a"}


def test_plain_pages_give_the_parsers_events():
    import random

    from rxframe.operators import detail_pages as dp
    pieces = ['<div id="A-div" class="x  form-line">', "</div>", "<p>", "<br>", "<br/>", '<a HREF="/q" href="/r">', "</A >", "<script>",
              "var x", "</script>", "<title>", "</title>", "<template>", "</template>", "&amp;", "&eacute", " ", "<", ">", "<!-- c -->",
              '<img src="a>b">', "<i class='q'>", '<a href="/x&amp;y">', "<a b>", "text\n", "<plaintext>", "</ div>"]
    rng, plain = random.Random(1), 0
    for _ in range(20_000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        walker = dp._Walker()
        walker.feed(page)
        walker.close()
        plain += dp._plain_events(page) is not None
        assert dp._events(page) == walker.out.events, page
    assert plain > 1000


def test_pages_rendered_from_one_split_are_dealt(spark, tmp_path):
    from rxframe.plans import fixtures as fx
    parts = spark.range(400).selectExpr("id p_partkey", "concat('n ', id) p_name", "'T' p_type", "'B' p_brand", "1 p_size")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for pages in (fx.detail_pages(spark, str(tmp_path)), fx.search_pages(spark, str(tmp_path))):
        sizes = [n for n in pages.select("page_id").rdd.glom().map(len).collect() if n]
        assert sum(sizes) == 400 and len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) <= 200
