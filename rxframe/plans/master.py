"""The master build (first-wins leaflets, brand gap fill, last-wins dosage), from sheets or raw sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxframe.functions import text as tx
from rxframe.operators.clean import (DOSAGE_COLS, clean_dosage, clean_registry, dosage_usable, extract_sections,
                                     leaflet_usable)
from rxframe.operators.detail_pages import leaflet_records, main_blocks
from rxframe.operators.enrich import lookup_first_wins, lookup_gap_fill, lookup_last_wins
from rxframe.session import materialize


def build_master(registry: DataFrame, leaflets: DataFrame, brand_leaflets: DataFrame,
                 dosage: DataFrame, *, sci_key: str, brand_key: str, leaflet_finish=None, brand_finish=None,
                 dosage_finish=None, leaflet_usable: Column | None = None, brand_usable: Column | None = None,
                 dosage_usable: Column | None = None) -> DataFrame:
    """Registry enriched in a fixed order.  Of each lookup only ``usable`` rows can win (F3-F5, as
    predicates on the raw text), so an earlier or later row with text takes the place of an empty
    one; the winners alone are cleaned (``finish``).

    Adds ``leaflet``, ``practitioner``, ``route_ar`` (J2 by ``sci_key``), fills
    ``leaflet`` and ``route_ar`` gaps by ``brand_key`` (J3), replaces
    ``intl_dosage`` by the last dosage context per ``sci_key`` (J4).  The flag
    ``leaflet_before_gap`` keeps step 1's coverage for the report.
    """
    m = lookup_first_wins(registry, leaflets, master_key=sci_key, lookup_key="search_key", ord_col="ord",
                          require="leaflet",
                          take={"leaflet": "leaflet", "practitioner": "practitioner", "route_ar": "route_ar"},
                          finish=leaflet_finish, usable=leaflet_usable)
    m = m.withColumn("leaflet_before_gap", F.col("leaflet").isNotNull())
    m = lookup_gap_fill(m, brand_leaflets, master_key=brand_key, lookup_key="search_key", ord_col="ord",
                        require="leaflet", take={"leaflet": "leaflet", "route_ar": "route_ar"},
                        finish=brand_finish, usable=brand_usable)
    return lookup_last_wins(m, dosage, master_key=sci_key, lookup_key="search_key", ord_col="ord",
                            value="dosage_context", target="intl_dosage", finish=dosage_finish, usable=dosage_usable)


# The labels of a detail page's data tab that the master takes.
ROUTE_LABEL = "طريقة الإستعمال"


def _winning_pages(pages: DataFrame, facts: DataFrame, best) -> DataFrame:
    """The page of the best order of each key; ``facts`` are the (search_key, ord) of usable pages."""
    won = facts.groupBy(F.col("search_key").alias("_wk")).agg(best("ord").alias("_wo"))
    return pages.join(won, (F.col("ord") == F.col("_wo")) & F.col("search_key").eqNullSafe(F.col("_wk")), "left_semi")


def _page_records(pages: DataFrame, min_len: int) -> DataFrame:
    r = leaflet_records(pages, "search_key", "url", min_len=min_len, keep=("ord",))
    return r.select("search_key", "ord", "leaflet", "practitioner", F.element_at("fields", ROUTE_LABEL).alias("route_ar"))


def _dosage_sections(pages: DataFrame) -> DataFrame:
    main = main_blocks(pages, "ord", keep=("search_key",))
    return extract_sections(main.select(F.col("page_id").alias("ord"), "search_key", "main_text"), "main_text")


def build_master_from_sources(raw_registry: DataFrame, leaflet_pages: DataFrame, brand_pages: DataFrame,
                              dosage_pages: DataFrame, *, id_col: str = "id") -> DataFrame:
    """C2 as one chain: raw registry records, and landed pages ``(search_key, ord, url, html)`` of
    the three harvests, to the master.

    Texts are materialised late.  One pass over the pages of a harvest parses each where it lies
    and stores (key, order) of those that have text after F3-F5 (F4, F7 for dosage); the first or
    last order per key is chosen on this narrow table; only the winning pages, one per key, are
    fetched, parsed again and cleaned.  Lookup keys are the names the harvests searched for: the
    cleaned scientific name and trade name.
    """
    registry = clean_registry(raw_registry, keep={id_col: "record_id"})
    facts = {}
    for name, pages, rows, usable in (
            ("leaflets", leaflet_pages, lambda p: _page_records(p, -1), leaflet_usable()),
            ("brands", brand_pages, lambda p: _page_records(p, 10), tx.has_leaflet_text("leaflet")),
            ("dosage", dosage_pages, _dosage_sections, dosage_usable(DOSAGE_COLS))):
        facts[name] = materialize(rows(pages).where(usable).select("search_key", "ord"), f"{name}-facts")
    leaflets = _page_records(_winning_pages(leaflet_pages, facts["leaflets"], F.min), -1)
    brands = _page_records(_winning_pages(brand_pages, facts["brands"], F.min), 10)
    dosage = clean_dosage(_dosage_sections(_winning_pages(dosage_pages, facts["dosage"], F.max)))
    cleaned = {"leaflet": tx.leaflet_normalise, "practitioner": tx.leaflet_normalise}
    return build_master(registry, materialize(leaflets, "leaflets"), materialize(brands, "brands"),
                        materialize(dosage, "dosage"), sci_key="Scientific Name", brand_key="Trade Name",
                        leaflet_finish=cleaned)


def coverage_report(master: DataFrame) -> DataFrame:
    """A5-A7 in one pass: rows, leaflets after step 1, after the gap fill, new
    hits, coverage percent (2 decimals) and rows with dosage text."""
    return master.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("leaflet_before_gap")).alias("leaflets_first"),
        F.count("leaflet").alias("leaflets_after"),
        (F.count("leaflet") - F.count_if(F.col("leaflet_before_gap"))).alias("new_hits"),
        F.round(F.count("leaflet") * 100.0 / F.count(F.lit(1)), 2).cast("double").alias("coverage_pct"),
        F.count_if(F.col("intl_dosage") != "").alias("dosage_rows"),
    )
