"""The driver's tables in the roles of the registry pipeline.

Every role is derived by Spark from whole tables (no id subsets or row caps):

* registry / master rows  <- ``part``   (``p_partkey`` is the file order)
* leaflet, brand and dosage lookups <- ``documents`` (``doc_id`` order,
  ``source`` is the search name)
* consult requests  <- ``part`` (one request per part)
* chat requests     <- ``conversations`` user turns
* mapping for brand links and the symptom dictionary <- ``part``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxframe.functions.text import dosage_context, dosage_normalise, has_dosage_text, has_leaflet_text, leaflet_normalise
from rxframe.operators.clean import leaflet_usable
from rxframe.sources.tables import dealt_rows, read_table


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned-registry stand-in with the lookup keys of the three enrichments."""
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size", "p_retailprice")
    return p.select(
        F.col("p_partkey").alias("ord"),
        F.col("p_name").alias("trade_name"),
        F.col("p_type").alias("scientific_name"),
        F.col("p_brand").alias("dosage_form"),
        F.concat(F.col("p_size").cast("string"), F.lit(" mg")).alias("strength"),
        F.col("p_retailprice").alias("price"),
        F.element_at(F.split("p_name", " "), -1).alias("route"),
        F.concat(F.lit("src"), (F.col("p_size") % 25).cast("string")).alias("sci_key"),
        F.concat(F.lit("src"), ((F.col("p_size") + 7) % 25).cast("string")).alias("brand_key"),
    )


def leaflets(spark: SparkSession, sf: str) -> DataFrame:
    """Leaflet lookup (raw sheet text): search name, patient leaflet (only some
    documents have one), practitioner leaflet, Arabic route; before each source's documents
    three rows that cleaning drops (blank, placeholder in either text).  Consumers apply
    ``LEAFLET_FINISH`` (T5) to the rows they keep."""
    d = read_table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    return _beside(d.select(
        F.col("doc_id").alias("ord"),
        F.col("source").alias("search_key"),
        F.when(F.col("lang") == "en", F.col("text")).alias("leaflet"),
        F.when(F.col("lang") != "de", F.col("text")).alias("practitioner"),
        F.col("lang").alias("route_ar"),
    ), [(-1, "_x000D_ \r", "x", "none"), (-2, "No \r_x000D_data", "x", "none"), (-3, "words", "No specific  match found", "none")])


def _beside(rows: DataFrame, more: list[tuple]) -> DataFrame:
    """``rows`` and, for each of their search keys, the ``more`` ones (order, then the columns after the key)."""
    cols = rows.columns[2:]
    added = F.array(*[F.struct(F.lit(m[0]).cast("long").alias("ord"), *[F.lit(v).cast("string").alias(c) for c, v in zip(cols, m[1:])])
                      for m in more])
    return rows.unionByName(rows.select("search_key").distinct().select("search_key", F.explode(added).alias("r"))
                            .select("r.ord", "search_key", *[f"r.{c}" for c in cols]))


def brand_leaflets(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    return d.select(
        F.col("doc_id").alias("ord"),
        F.col("source").alias("search_key"),
        F.when(F.col("lang") == "fr", F.col("text")).alias("leaflet"),
        F.concat(F.lit("ar-"), F.col("lang")).alias("route_ar"),
    )


def dosage(spark: SparkSession, sf: str) -> DataFrame:
    """Dosage lookup (raw page text as the adult section), after each source's documents
    two rows without text; consumers apply ``DOSAGE_FINISH`` (T6 + T7) to the rows they keep."""
    d = read_table(spark, sf, "documents", "doc_id", "text", "source")
    return _beside(d.select(
        F.col("doc_id").alias("ord"),
        F.col("source").alias("search_key"),
        F.col("text").alias("dosage_context"),
    ), [(10**15, "for: \n"), (10**15 + 1, "NaN")])


# row-wise cleaning of the lookup columns, applied after the one-row-per-key reduction
LEAFLET_FINISH = {"leaflet": leaflet_normalise, "practitioner": leaflet_normalise}
DOSAGE_FINISH = {"dosage_context": lambda c: dosage_context(dosage_normalise(c), F.lit(""), F.lit(""), F.lit(""))}


# rows that keep text once cleaned, told from the raw text in the pass that chooses the winners
def lookup_rules() -> dict:
    return {"leaflet_usable": leaflet_usable(), "brand_usable": has_leaflet_text("leaflet"),
            "dosage_usable": has_dosage_text("dosage_context")}


def brand_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Brand mapping rows: term = first word of the name, brand = name,
    ingredient = brand label; file order = ``p_partkey``."""
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_brand")
    return p.select(F.col("p_partkey").alias("ord"),
                    F.upper(F.element_at(F.split("p_name", " "), 1)).alias("search_term"),
                    F.col("p_name").alias("brand_name"),
                    F.col("p_brand").alias("ingredients"))


def symptom_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """``(key, value)``: each part type expands to itself and the smallest and
    largest part name of that type (a comma-joined value, as in the reference)."""
    p = read_table(spark, sf, "part", "p_partkey", "p_type", "p_name")
    return p.groupBy(F.col("p_type").alias("key")).agg(
        F.concat_ws(", ", F.lower(F.col("key")), F.min("p_name"), F.max("p_name")).alias("value"),
        F.min("p_partkey").alias("ord"))


def consult_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per part: the name's words as symptoms, the type as history
    (a dictionary key), the name as medication (a linked brand)."""
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_size")
    return p.select(
        F.col("p_partkey").alias("req_id"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit(", ")).alias("symptoms"),
        F.col("p_type").alias("history"),
        F.col("p_name").alias("medications"),
        F.concat(F.col("p_size").cast("string"), F.lit(" سنة, "), (F.col("p_size") + 40).cast("string"),
                 F.lit(" كجم")).alias("age_weight"),
    )


def chat_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per user turn: its whole text as the symptom list."""
    c = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    return c.where(F.col("role") == "user").select(
        F.concat_ws(".", "conv_id", "turn").alias("req_id"),
        F.col("text").alias("symptoms"), F.lit("").alias("history"), F.lit("").alias("medications"))


def raw_event_records(spark: SparkSession, sf: str) -> DataFrame:
    """One raw JSON record per event; some keys are absent by rule, one is
    present with a null value (counts as present)."""
    e = read_table(spark, sf, "events", "event_id", "user_id", "event_type", "props")
    raw = F.concat(
        F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "props": '), F.col("props"),
        F.when(F.col("event_type") == "click", F.lit(', "value": null')).otherwise(F.lit("")),
        F.when(F.col("user_id") > 50, F.concat(F.lit(', "user": '), F.col("user_id").cast("string")))
        .otherwise(F.lit("")),
        F.when(F.col("event_type") != "error", F.concat(F.lit(', "type": "'), F.col("event_type"), F.lit('"')))
        .otherwise(F.lit("")),
        F.lit("}"))
    return e.select("event_id", raw.alias("raw"))


def leaflet_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Leaflet sheet with the artefacts the cleaning removes: CR/Excel CR marks
    and blank-line runs, padded text, placeholders, rows missing all names."""
    d = read_table(spark, sf, "documents", "doc_id", "text", "lang", "source", "n_chars")
    lang = F.col("lang")
    return d.select(
        F.col("doc_id").alias("ord"),
        F.col("source").alias("search_key"),
        F.when(lang == "de", F.concat(F.lit("No data "), F.col("text")))
        .when(lang == "es", F.lit(None).cast("string"))
        .otherwise(F.concat(F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n \n\n")), F.lit("_x000D_")))
        .alias("leaflet"),
        F.when(lang == "fr", F.concat(F.lit("  "), F.col("text"), F.lit("  "))).alias("practitioner"),
        F.when((lang != "es") | (F.col("n_chars") > 1000), F.col("source")).alias("trade_ar"),
        F.when(lang != "es", F.concat(F.col("source"), F.lit("  x"))).alias("sci_ar"),
    )


def dosage_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Dosage pages: document text with the section markers inserted at line
    breaks and after commas, and a blank line before the renal marker."""
    d = read_table(spark, sf, "documents", "doc_id", "text", "source")
    t = F.replace(F.col("text"), F.lit(".\n"), F.lit(".\nUsual Adult Dose\n"))
    t = F.replace(t, F.lit(", "), F.lit(", Usual Pediatric Dose "))
    t = F.replace(t, F.lit("\nE"), F.lit("\n\nRenal Dose Adjustments E"))
    t = F.replace(t, F.lit("\nL"), F.lit("\n\nLiver Dose Adjustments\n\nL"))
    return d.select("doc_id", "source", t.alias("page"))


def raw_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Raw registry records as the JSON harvest gives them (all strings, nested
    agents), with the spacing, comma and empty-field cases cleaning handles."""
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    size = F.col("p_size")
    agents = F.array(F.struct(F.col("p_brand").alias("nameEn")),
                     F.struct(F.concat(F.lit(" "), F.lower("p_type"), F.lit("\t ")).alias("nameEn")),
                     F.struct(F.when(size > 25, F.col("p_brand")).alias("nameEn")),
                     F.struct(F.when(size > 45, F.lit("")).alias("nameEn")))
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.concat(F.lit("  "), F.col("p_name"), F.lit(" ,x ")).alias("tradeName"),
        F.concat(F.col("p_type"), F.lit(" ,  "), F.lower("p_type")).alias("scientificName"),
        F.col("p_brand").alias("registerNumber"),
        (size + 1990).cast("string").alias("registerYear"),
        F.concat(size.cast("string"), F.when(size > 25, F.lit(" ,,")).otherwise(F.lit(""))).alias("strength"),
        F.when(size > 40, F.lit("")).otherwise(F.lit("mg")).alias("strengthUnit"),
        F.concat(F.lower("p_type"), F.lit("\n\t form")).alias("doesageForm"),
        F.element_at(F.split("p_name", " "), -1).alias("administrationRoute"),
        F.col("p_retailprice").cast("string").alias("price"),
        F.col("p_brand").alias("manufacturerName"),
        F.lit(None).cast("string").alias("manufacturerCountry"),
        F.concat(F.col("p_brand"), F.lit(" Co")).alias("companyName"),
        F.lit("SA").alias("companyCountryEn"),
        F.lit("Marketed").alias("marketingStatus"),
        F.lit("Prescription").alias("legalStatus"),
        F.when(size > 10, F.lit(" OTC ")).when(size > 5, F.lit("")).alias("legalStatusEn"),
        F.lit("Store below 25C").alias("storageConditions"),
        F.lit(None).cast("string").alias("distributionArea"),
        agents.alias("agents"))


def order_envelopes(spark: SparkSession, sf: str, page_size: int = 100) -> DataFrame:
    """Registry pages as the paged API returns them: orders packed by key into
    pages of ``page_size`` numbers, ``{"pageCount": n, "results": [...]}``;
    orders of every fifth page are listed under another page number, so that page
    comes back empty."""
    o = read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    page = F.floor(F.col("o_orderkey") / page_size).cast("long")
    rec = F.struct("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    listed = F.when(page % 5 == 4, page - 1).otherwise(page)
    slots = F.array(F.struct(listed.alias("page"), rec.alias("rec")), F.struct(page.alias("page"), F.lit(None).alias("rec")))
    pages = o.select(F.inline(slots)).groupBy("page").agg(F.collect_list("rec").alias("results"))
    n_pages = pages.select(F.count(F.lit(1))).scalar()
    return pages.select("page", F.to_json(F.struct(n_pages.cast("int").alias("pageCount"), "results"))
                        .alias("envelope"))


def detail_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Registry detail pages rendered from ``part``: a data tab of label/value
    pairs (nested and padded values, a label repeated later), a patient leaflet
    tab and a practitioner tab that holds the empty-leaflet placeholder for
    large sizes.  The parts are dealt before they are rendered, since parsing a page costs much
    more than reading its part."""
    p = dealt_rows(read_table(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size"))
    html = F.concat(
        F.lit('<html><body><div id="D-div" class="tab">'),
        F.lit('<label class="form-label"> Trade Name </label><div class="form-line">  '), F.col("p_name"),
        F.lit(' </div>'),
        F.lit('<label class="form-label">Scientific Name</label><div class="form-line"><div><b>'), F.col("p_type"),
        F.lit('</b></div></div>'),
        F.lit('<label class="form-label">Brand</label><div class="row"><div class="form-line">'), F.col("p_brand"),
        F.lit('</div></div>'),
        F.lit('<label class="form-label">Trade Name</label><div class="form-line">'), F.upper("p_name"),
        F.lit('</div></div>'),
        F.lit('<div id="A-div"><div><p>'), F.col("p_name"), F.lit('</p><p> '), F.col("p_brand"),
        F.lit(' </p><p>  </p></div></div>'),
        F.lit('<div id="M-div"><p>'),
        F.when(F.col("p_size") > 40, F.lit("لم يتم إدخال بيانات"))
        .otherwise(F.concat(F.lit("Size "), F.col("p_size").cast("string"))),
        F.lit('</p></div></body></html>'))
    return p.select(F.col("p_partkey").alias("page_id"), F.col("p_type").alias("search_key"),
                    F.concat(F.lit("/drug/"), F.col("p_partkey").cast("string")).alias("url"), html.alias("html"))


def search_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Search pages rendered from ``part``: six product cards (classes in any order,
    nested markup, entities, one without an ingredient line, the sixth past the cut)
    and view links as bare, nested, target-less and mixed anchors.  The parts are dealt as in
    ``detail_pages``."""
    p = dealt_rows(read_table(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_brand"))

    def card(name, kind, extra=""):
        title = F.concat(F.lit('<a href="/p" title="x" class="big search-results-product-info-title-link">'), name, F.lit("</a>"))
        line = F.concat(F.lit(f'<div {extra} class="search-results-product-info-type">\n '), kind, F.lit(" </div>")) \
            if kind is not None else F.lit("")
        return F.concat(F.lit('<div data-n="1" class="row search-results-product"><div><h2>'), title, F.lit("</h2>"), line,
                        F.lit("</div></div>"))

    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    cards = [card(F.concat(F.lit(" <b>"), name, F.lit("</b> ")), kind), card(brand, None),
             card(F.concat(brand, F.lit(" &amp; Co&middot;&#233;")), F.concat(kind, F.lit("<script>var x=1;</script>")), 'id="t"'),
             card(name, F.lit("")), card(brand, brand), card(name, name)]
    key = F.col("p_partkey").cast("string")
    links = F.concat(
        F.lit('<a href="/o">other</a><a class="b" href="/1/'), key, F.lit('">view</a><a href="/2/'), key,
        F.lit('"><span>view it</span></a><a href="/x">view <b>not one text</b></a><a name="n">view</a><a href="/4">view</a>'))
    html = F.concat(F.lit("<html><head><style>p{}</style></head><body>"), *cards, links, F.lit("</body></html>"))
    return p.select(F.col("p_partkey").alias("page_id"), html.alias("html"))


def _escaped(c: str):
    return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def dosage_html_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Dosage pages rendered from ``documents`` as fetched HTML: the main text
    sits in a ``div.contentBox`` (English, French), in ``#content`` (Spanish) or
    nowhere (German), after a navigation block; text is HTML-escaped."""
    d = read_table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    esc = _escaped("text")
    body = F.concat(F.lit("<h2>Usual Adult Dose</h2><p>"), esc, F.lit("</p><h3> Renal Dose Adjustments </h3><p>"),
                    F.col("source"), F.lit("</p>"))
    main = (F.when(F.col("lang").isin("en", "fr"), F.concat(F.lit('<div class="contentBox wide">'), body,
                                                            F.lit("</div>")))
            .when(F.col("lang") == "es", F.concat(F.lit('<section id="content">'), body, F.lit("</section>")))
            .otherwise(F.concat(F.lit("<div>"), body, F.lit("</div>"))))
    html = F.concat(F.lit('<html><body><div id="nav"><a href="/x">Home</a></div>'), main, F.lit("</body></html>"))
    return d.select(F.col("doc_id").alias("page_id"), html.alias("html"))


def _harvested(spark: SparkSession, sf: str, shift: int) -> DataFrame:
    """Documents as what a harvest found for the names of the part ``shift`` rows on."""
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_type")
    d = read_table(spark, sf, "documents", "doc_id", "text", "lang")
    return d.join(p, F.col("p_partkey") == F.col("doc_id") + shift).select(
        F.col("doc_id").alias("ord"), "text", "lang", "p_type", F.concat("p_type", F.lit(", "), F.lower("p_type")).alias("sci"),
        F.concat("p_name", F.lit(", x")).alias("trade"))


def _tabs(leaflet, practitioner, route):
    return F.concat(
        F.lit('<div id="D-div"><label class="form-label">طريقة الإستعمال</label><div class="form-line"> '), route,
        F.lit(' </div></div><div id="A-div"><p>'), leaflet, F.lit('</p></div><div id="M-div"><p>'), practitioner, F.lit("</p></div>"))


def harvested_leaflet_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Detail pages by scientific name, rendered from ``documents`` (none found for some names); before
    each name's pages four that cleaning drops: placeholders in either tab, blank text, nothing entered."""
    h = _harvested(spark, sf, 1)
    real = h.where(~F.col("p_type").startswith("SMALL")).select(
        F.col("sci").alias("search_key"), "ord", _tabs(_escaped("text"), F.concat("lang", F.lit(" leaflet")), F.col("lang")).alias("html"))
    empty = F.array(*[F.struct(F.lit(n).cast("long").alias("ord"), _tabs(F.lit(a), F.lit(m), F.lit("none")).alias("html"))
                      for n, a, m in ((-1, "No \r_x000D_data", "m"), (-2, " _x000D_ ", "m"),
                                      (-3, "words", "No specific  match found"), (-4, "لم يتم إدخال بيانات", "m"))])
    more = h.select(F.col("sci").alias("search_key")).distinct().select("search_key", F.inline(empty))
    return real.unionByName(more).withColumn("url", F.concat(F.lit("/drug/"), F.col("ord").cast("string")))


def harvested_brand_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Detail pages by trade name; before each one a page whose leaflet is too short to be kept."""
    h = _harvested(spark, sf, 2).select(F.col("trade").alias("search_key"), "ord", "lang", _escaped("text").alias("t"))
    both = F.array(F.struct("ord", F.col("t").alias("a")), F.struct((-1 - F.col("ord")).alias("ord"), F.lit("too short").alias("a")))
    r = h.select("search_key", "lang", F.inline(both))
    return r.select("search_key", "ord", _tabs(F.col("a"), F.lit("m"), F.concat(F.lit("ar-"), F.col("lang"))).alias("html"),
                    F.concat(F.lit("/brand/"), F.col("ord").cast("string")).alias("url"))


def harvested_dosage_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Dosage pages by scientific name (``dosage_html_pages``); after each name's pages one without a
    dose and one whose dose is empty once cleaned."""
    h = _harvested(spark, sf, 1).select(F.col("sci").alias("search_key"), "ord")
    real = h.join(dosage_html_pages(spark, sf), F.col("ord") == F.col("page_id")).select("search_key", "ord", "html")
    empty = F.array(*[F.struct(F.lit(10**15 + n).alias("ord"), F.lit(f'<div class="contentBox"><p>{t}</p></div>').alias("html"))
                      for n, t in enumerate(("No dose is known.", "Usual Adult Dose for: \n"))])
    return real.unionByName(h.select("search_key").distinct().select("search_key", F.inline(empty)))
