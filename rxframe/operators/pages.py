"""HTML extraction over a table of landed pages.

Pages are parsed where they lie: anchors, sections and titles come out of
``regexp_extract_all``/``regexp_extract`` on the page text, exploded with their
position, so a page never leaves its task and only small long-form rows are
shuffled (for the per-page "first k" and "last label wins" rules).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page markers of the search sites.
NO_RESULTS_MARKER = "no-results-content"
INTERSTITIAL_MARKER = "Just a moment"
NOT_FOUND_TITLES = ["Page Not Found", "404"]
BLOCK_STATUSES = [403, 429]
LEAFLET_PLACEHOLDER = "لم يتم إدخال بيانات"

ANCHOR = r'<a href="[^"]*">[^<]*</a>'
TAG_MARK = "\u0001"


def html_unescape_basic(c) -> Column:
    """The five basic entities as an HTML parser decodes them (``&amp;`` last)."""
    x = c
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return x


def _marked_links(html_col: str, marker: str, k: int) -> Column:
    found = F.filter(F.regexp_extract_all(F.col(html_col), F.lit(ANCHOR), F.lit(0)), lambda x: html_unescape_basic(
        F.regexp_extract(x, r">([^<]*)</a>", 1)).contains(marker))
    return F.slice(found, 1, k)


def result_links(pages: DataFrame, page_col: str, html_col: str, marker: str, k: int) -> DataFrame:
    """H1 on pages of bare anchors: anchors whose text contains ``marker``, the first
    ``k`` of each page, ranked in the row (``dom_result_links`` takes any markup)."""
    a = pages.select(page_col, F.posexplode(_marked_links(html_col, marker, k)).alias("rank", "_a"))
    return a.select(page_col, (F.col("rank") + 1).cast("long").alias("rank"),
                    F.regexp_extract("_a", r'href="([^"]*)"', 1).alias("href"),
                    html_unescape_basic(F.regexp_extract("_a", r">([^<]*)</a>", 1)).alias("text"))


def n_result_links(html_col: str, marker: str, k: int) -> Column:
    """Number of ``result_links`` of a page, as a column."""
    return F.size(_marked_links(html_col, marker, k))


def label_values(pages: DataFrame, page_col: str, html_col: str) -> DataFrame:
    """H2: label/value pairs of a page (anchor text -> href here); a later
    duplicate label wins.  Decided in the row: no shuffle."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(ANCHOR), F.lit(0))
    a = pages.select(page_col, F.reverse(F.transform(found, lambda x: F.struct(
        html_unescape_basic(F.regexp_extract(x, r">([^<]*)</a>", 1)).alias("label"),
        F.regexp_extract(x, r'href="([^"]*)"', 1).alias("value")))).alias("_p"))
    a = a.withColumn("_l", F.transform("_p", lambda x: x["label"]))
    last = F.transform(F.array_distinct("_l"), lambda k: F.get(F.col("_p"), (F.array_position("_l", k) - 1).cast("int")))
    return a.select(page_col, F.explode_outer(last).alias("_r")).where("_r is not null") \
        .select(page_col, "_r.label", "_r.value")


def section_text(html: Column, tag: str) -> Column:
    """H3: text nodes of the first ``<tag>`` element, each stripped, empty ones
    dropped, joined by newlines (null when the element is absent)."""
    inner = F.regexp_extract(html, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    nodes = F.split(F.regexp_replace(inner, "<[^>]*>", TAG_MARK), TAG_MARK)
    from rxframe.functions.text import py_strip
    kept = F.filter(F.transform(nodes, lambda x: py_strip(html_unescape_basic(x))), lambda x: x != "")
    return F.when(inner != "", F.array_join(kept, "\n"))


def page_text_columns(html_col: str, min_len: int = 10) -> list[Column]:
    """H3/H6 columns: title (``h1``), main text (``article``; dropped when it
    holds the placeholder or is not longer than ``min_len``), ``h2``/``h3`` headings."""
    h = F.col(html_col)
    body = section_text(h, "article")
    heads = F.regexp_extract_all(h, F.lit(r"<h[23][^>]*>([^<]*)</h[23]>"), F.lit(1))
    return [html_unescape_basic(F.regexp_extract(h, r"<h1>([^<]*)</h1>", 1)).alias("title"),
            F.when(~body.contains(LEAFLET_PLACEHOLDER) & (F.length(body) > min_len), body).alias("body"),
            F.array_join(F.transform(heads, html_unescape_basic), "\n").alias("headings")]


def page_texts(pages: DataFrame, page_col: str, html_col: str, min_len: int = 10,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """Page texts as one projection (works on batch and streaming frames)."""
    return pages.select(page_col, *keep, *page_text_columns(html_col, min_len))


def page_outcome(html: Column, status: Column, title: Column, n_results: Column) -> Column:
    """H5 + A8 class of one fetched page: blocked, not_found, no_results, hit or miss."""
    return (F.when(html.contains(INTERSTITIAL_MARKER) | status.isin(BLOCK_STATUSES), F.lit("blocked"))
            .when((status != 200) | F.exists(F.array(*[F.lit(t) for t in NOT_FOUND_TITLES]),
                                             lambda t: title.contains(t)), F.lit("not_found"))
            .when(html.contains(NO_RESULTS_MARKER), F.lit("no_results"))
            .when(n_results > 0, F.lit("hit"))
            .otherwise(F.lit("miss")))


CARD = r"(?s)<li(?:\s[^>]*)?>(.*?)</li>"


def result_cards(pages: DataFrame, page_col: str, html_col: str, k: int,
                 name_expr, ingredients_expr) -> DataFrame:
    """H4: result cards of a search page in order; only the first ``k`` cards are
    looked at, and *then* cards lacking a name or an ingredient text are
    dropped (so fewer than ``k`` may remain).  ``name_expr`` and
    ``ingredients_expr`` map the card markup column ``card`` to text (empty
    means absent)."""
    first = F.slice(F.regexp_extract_all(F.col(html_col), F.lit(CARD), F.lit(1)), 1, k)
    cut = pages.select(page_col, F.posexplode(first).alias("pos", "card"))
    out = cut.select(page_col, F.col("pos").cast("long").alias("pos"),
                     F.nullif(py_strip_col(name_expr(F.col("card"))), F.lit("")).alias("name"),
                     F.nullif(py_strip_col(ingredients_expr(F.col("card"))), F.lit("")).alias("ingredients"))
    return out.where(F.col("name").isNotNull() & F.col("ingredients").isNotNull())


def py_strip_col(c: Column) -> Column:
    from rxframe.functions.text import py_strip
    return py_strip(html_unescape_basic(c))
