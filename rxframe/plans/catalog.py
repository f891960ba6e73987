"""Registered keys: one ``(spark, sf_dir) -> DataFrame`` per operator row of the
inventory, each reading whole driver tables through ``fixtures``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxframe.functions.text import brand_simplify, query_string_form, url_slug
from rxframe.operators import quality
from rxframe.operators.clean import (clean_dosage, clean_leaflets, clean_registry_with_id, distinct_names_per_key,
                                     extract_sections, leaflet_keep_predicate)
from rxframe.operators.context import MasterColumns
from rxframe.operators.enrich import (first_seen_by_derived_key, lookup_first_wins, lookup_gap_fill,
                                      lookup_last_wins, nest_details, resume_todo, union_by_name)
from rxframe.operators.link import extract_entities, link_dictionary, search_terms
from rxframe.operators.context import format_request
from rxframe.operators.detail_pages import (detail_fields, detail_sections, dom_result_cards,
                                            dom_result_links, leaflet_records, main_blocks)
from rxframe.operators.pages import label_values, page_outcome, page_texts, result_cards, n_result_links, result_links
from rxframe.operators.retrieve import boundary_matches_per_term, retrieve_substring, retrieve_topk
from rxframe.operators.search import (HISTORY_OPTIONS, SYMPTOM_OPTIONS, agent_slots, display_defaults,
                                      option_labels, page_rows, search_filter)
from rxframe.operators.clean import RAW_REGISTRY_SCHEMA
from rxframe.session import materialize, scratch_path
from rxframe.streaming.streams import RECORDS, page_extract_stream, record_stream, versioned_consult_stream
from rxframe.sources.files import (dictionary_entries, first_existing, flatten_envelopes, read_csv_table,
                                   read_registry_json, write_csv_table, write_registry_json)
from rxframe.sources.versions import current, latest_version, write_new_version
from rxframe.plans import fixtures as fx
from rxframe.plans.consult import VersionedConsult, consult_contexts, consult_lines, consult_prompts
from rxframe.plans.master import build_master, build_master_from_sources, coverage_report
from rxframe.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

MASTER_COLS = MasterColumns(trade="trade_name", sci="scientific_name", form="dosage_form",
                            strength="strength", price="price", route="route", route_ar="route_ar",
                            leaflet="leaflet", intl_dosage="intl_dosage")


def _master(spark, sf):
    return build_master(fx.registry(spark, sf), fx.leaflets(spark, sf), fx.brand_leaflets(spark, sf),
                        fx.dosage(spark, sf), sci_key="sci_key", brand_key="brand_key",
                        leaflet_finish=fx.LEAFLET_FINISH, brand_finish=fx.LEAFLET_FINISH, dosage_finish=fx.DOSAGE_FINISH,
                        **fx.lookup_rules())


def _link_dict(spark, sf):
    return link_dictionary(fx.brand_mapping(spark, sf), ord_col="ord", term_col="search_term",
                           brand_col="brand_name", ingredient_col="ingredients")


def _entities(spark, sf):
    return extract_entities(fx.consult_requests(spark, sf), fx.symptom_dictionary(spark, sf),
                            _link_dict(spark, sf))


def q_master_build(spark, sf):
    return _master(spark, sf)


def q_link_dictionary(spark, sf):
    return _link_dict(spark, sf)


def q_request_terms(spark, sf):
    terms, links = _entities(spark, sf)
    return search_terms(terms, links)


def q_entity_link(spark, sf):
    _, links = _entities(spark, sf)
    w = F.row_number().over(Window.partitionBy("req_id").orderBy("link_rank"))
    return links.select("req_id", "brand", "ingredient", w.cast("long").alias("link_pos"))


def q_retrieve_topk(spark, sf):
    terms, links = _entities(spark, sf)
    st = search_terms(terms, links)
    return retrieve_topk(st, fx.registry(spark, sf), ord_col="ord", trade_col="trade_name",
                         sci_col="scientific_name", k=4).withColumn("rn", F.col("rn").cast("long"))


def q_context_lines(spark, sf):
    lines, _ = consult_lines(fx.consult_requests(spark, sf), _master(spark, sf), fx.symptom_dictionary(spark, sf),
                             _link_dict(spark, sf), MASTER_COLS)
    return lines.withColumn("rn", F.col("rn").cast("long"))


def q_consult_context(spark, sf):
    return consult_contexts(fx.consult_requests(spark, sf), _master(spark, sf), fx.symptom_dictionary(spark, sf),
                            _link_dict(spark, sf), MASTER_COLS)


def q_prompt_table(spark, sf):
    return consult_prompts(fx.consult_requests(spark, sf), _master(spark, sf), fx.symptom_dictionary(spark, sf),
                           _link_dict(spark, sf), MASTER_COLS)


# --- data quality -----------------------------------------------------------

def _raw_events(spark, sf):
    return fx.raw_event_records(spark, sf)


def q_dq_duplicate_ids(spark, sf):
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber")
    return quality.duplicate_ids(li, ["l_orderkey", "l_linenumber"])


def q_dq_duplicate_keys(spark, sf):
    return quality.duplicate_keys(fx.registry(spark, sf), "trade_name", "ord", 5)


def q_dq_field_presence(spark, sf):
    return quality.field_presence(_raw_events(spark, sf), "raw")


def q_dq_critical_empty(spark, sf):
    d = read_table(spark, sf, "documents", "text", "lang", "source").withColumn(
        "title", F.regexp_extract("text", "^([A-Z][a-z]+) ", 1))
    return quality.critical_empty(d, ["text", "lang", "source", "title"])


def q_dq_filter_report(spark, sf):
    lf = fx.leaflet_sheet(spark, sf)
    return quality.filter_report(lf, leaflet_keep_predicate(lf.columns))


def q_dataset_status(spark, sf):
    return quality.dataset_status(fx.registry(spark, sf), fx.symptom_dictionary(spark, sf), "key", "ord", 3)


# --- enrichment ---------------------------------------------------------------

def _first_leaflets(spark, sf, *cols):
    return lookup_first_wins(fx.registry(spark, sf), fx.leaflets(spark, sf), master_key="sci_key", lookup_key="search_key",
                             ord_col="ord", require="leaflet", take={c: c for c in cols}, finish=fx.LEAFLET_FINISH,
                             usable=fx.lookup_rules()["leaflet_usable"])


def q_lookup_first_wins(spark, sf):
    m = _first_leaflets(spark, sf, "leaflet", "practitioner", "route_ar")
    return m.select("ord", "sci_key", "leaflet", "practitioner", "route_ar")


def q_lookup_gap_fill(spark, sf):
    m = lookup_gap_fill(_first_leaflets(spark, sf, "leaflet", "route_ar"), fx.brand_leaflets(spark, sf), master_key="brand_key",
                        lookup_key="search_key", ord_col="ord", require="leaflet", take={"leaflet": "leaflet", "route_ar": "route_ar"},
                        finish=fx.LEAFLET_FINISH, usable=fx.lookup_rules()["brand_usable"])
    return m.select("ord", "brand_key", "leaflet", "route_ar")


def q_lookup_last_wins(spark, sf):
    m = lookup_last_wins(fx.registry(spark, sf), fx.dosage(spark, sf), master_key="sci_key", lookup_key="search_key",
                         ord_col="ord", value="dosage_context", target="intl_dosage", finish=fx.DOSAGE_FINISH,
                         usable=fx.lookup_rules()["dosage_usable"])
    return m.select("ord", "sci_key", "intl_dosage")


def q_master_chain(spark, sf):
    """C2 whole: raw registry records and the landed pages of three harvests to the master."""
    m = build_master_from_sources(fx.raw_registry(spark, sf), fx.harvested_leaflet_pages(spark, sf),
                                  fx.harvested_brand_pages(spark, sf), fx.harvested_dosage_pages(spark, sf))
    return m.select("record_id", F.col("Trade Name").alias("trade_name"), F.col("Scientific Name").alias("scientific_name"),
                    "leaflet", "practitioner", "route_ar", "leaflet_before_gap", "intl_dosage")


def q_coverage_report(spark, sf):
    return coverage_report(_master(spark, sf))


def q_resume_anti_join(spark, sf):
    todo = read_table(spark, sf, "documents", "doc_id")
    done = read_table(spark, sf, "labels", "doc_id")
    return resume_todo(todo, done, "doc_id")


def q_union_by_name(spark, sf):
    earlier = read_table(spark, sf, "documents", "doc_id", "text", "source")
    new = read_table(spark, sf, "conversations", "conv_id", "turn", "text")
    return union_by_name(earlier, new)


def q_nest_details(spark, sf):
    o = read_table(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    li = li.withColumnRenamed("l_orderkey", "o_orderkey").withColumn(
        "_ord", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    nested = nest_details(o, li, key="o_orderkey", fields=["l_linenumber", "l_partkey"], ord_col="_ord",
                          as_col="details")
    return nested.select("o_orderkey", "o_orderstatus", F.size("details").cast("long").alias("n_details"),
                         F.array_join(F.transform("details", lambda x: F.concat_ws(
                             ":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ";")
                         .alias("details"))


def q_nested_distinct_join(spark, sf):
    """A10 per order over its suppliers' names (long form; orders whose
    suppliers all lack a name get ``""``)."""
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_suppkey")
    s = read_table(spark, sf, "supplier", "s_suppkey", "s_name")
    long = li.join(s, li.l_suppkey == s.s_suppkey, "left").select(
        F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit(" "), F.col("s_name"), F.lit("  ")).alias("nameEn"))
    return distinct_names_per_key(long, "o_orderkey", "nameEn")


def q_search_terms(spark, sf):
    r = fx.registry(spark, sf).where(F.col("trade_name").isNotNull())
    keyed = first_seen_by_derived_key(r, key_expr=brand_simplify("trade_name"), value="trade_name",
                                      ord_col="ord", key_name="search_term")
    return keyed.where(F.length("search_term") > 2).select(
        "search_term", F.col("trade_name").alias("original_name"))


def q_slugify(spark, sf):
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_type")
    return p.select("p_partkey", url_slug(F.concat_ws(" + ", "p_name", "p_type")).alias("slug"),
                    query_string_form("p_name").alias("query_form"))


# --- cleaning -----------------------------------------------------------------

def q_registry_clean(spark, sf):
    return clean_registry_with_id(fx.raw_registry(spark, sf))


def q_leaflet_clean(spark, sf):
    return clean_leaflets(fx.leaflet_sheet(spark, sf), ["leaflet", "trade_ar", "sci_ar"])


def q_section_extract(spark, sf):
    return extract_sections(fx.dosage_pages(spark, sf), "page")


def q_dosage_clean(spark, sf):
    sec = extract_sections(fx.dosage_pages(spark, sf), "page")
    raw = sec.withColumn("adult", F.concat(F.lit("for:  "), "adult", F.lit("\n\nAdditional dosage information "),
                                           "source"))
    return clean_dosage(raw)


QUERIES: dict[str, Query] = {
    "master_build": q_master_build,
    "master_chain": q_master_chain,
    "link_dictionary": q_link_dictionary,
    "request_terms": q_request_terms,
    "entity_link": q_entity_link,
    "retrieve_topk": q_retrieve_topk,
    "context_lines": q_context_lines,
    "consult_context": q_consult_context,
    "prompt_table": q_prompt_table,
    "dq_duplicate_ids": q_dq_duplicate_ids,
    "dq_duplicate_keys": q_dq_duplicate_keys,
    "dq_field_presence": q_dq_field_presence,
    "dq_critical_empty": q_dq_critical_empty,
    "dq_filter_report": q_dq_filter_report,
    "dataset_status": q_dataset_status,
    "lookup_first_wins": q_lookup_first_wins,
    "lookup_gap_fill": q_lookup_gap_fill,
    "lookup_last_wins": q_lookup_last_wins,
    "coverage_report": q_coverage_report,
    "resume_anti_join": q_resume_anti_join,
    "union_by_name": q_union_by_name,
    "nest_details": q_nest_details,
    "nested_distinct_join": q_nested_distinct_join,
    "search_terms": q_search_terms,
    "slugify": q_slugify,
    "registry_clean": q_registry_clean,
    "leaflet_clean": q_leaflet_clean,
    "section_extract": q_section_extract,
    "dosage_clean": q_dosage_clean,
}


# --- sources, search, display, pages, retrieval variants ------------------------

def q_registry_json_scan(spark, sf):
    path = scratch_path(spark, "registry-json")
    write_registry_json(fx.raw_registry(spark, sf), path)
    r = read_registry_json(spark, path, RAW_REGISTRY_SCHEMA)
    scalar = [c for c in r.columns if c != "agents"]
    return r.select(*scalar, F.size("agents").cast("long").alias("n_agents"),
                    F.array_join(F.transform("agents", lambda x: F.coalesce(x["nameEn"], F.lit("<null>"))), "|")
                    .alias("agent_names"))


def q_page_envelope_flatten(spark, sf):
    env = fx.order_envelopes(spark, sf, page_size=100)
    rec = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
                        T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType())])
    return flatten_envelopes(env, "envelope", rec, keep=["page"])


def q_csv_roundtrip(spark, sf):
    c = read_table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    seg = F.col("c_mktsegment")
    c = c.withColumn("c_mktsegment", F.when(seg == "AUTOMOBILE", F.lit("NA"))
                     .when(seg == "BUILDING", F.concat(F.lit("  "), seg, F.lit(" "))).otherwise(seg))
    path = scratch_path(spark, "customer-csv")
    write_csv_table(c, path, c.columns)
    return read_csv_table(spark, path, c.schema)


def q_dictionary_scan(spark, sf):
    e = read_table(spark, sf, "events", "event_id", "props")
    return dictionary_entries(e, "props", keep=["event_id"])


def q_registry_search(spark, sf):
    raw = fx.raw_registry(spark, sf)
    hits = search_filter(raw, {"tradeName": "ring", "scientificName": "", "manufacturerName": "",
                               "registerNumber": ""}, agents_col="agents", agent="brand#1")
    hits = hits.select(F.col("id").cast("long").alias("ord"), "tradeName", "registerNumber")
    return page_rows(hits, "ord", page_size=10)


def q_null_display(spark, sf):
    raw = fx.raw_registry(spark, sf)
    fields = ["tradeName", "scientificName", "strengthUnit", "manufacturerCountry", "legalStatusEn",
              "distributionArea", "price"]
    shown = display_defaults(raw.select("id", *fields, "agents"), fields, "ar", empty_too=["legalStatusEn"])
    return shown.select("id", *fields, *agent_slots("agents", 3, "ar"))


def q_request_format(spark, sf):
    c = read_table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal")
    sym_ids = [i for i, _ in SYMPTOM_OPTIONS]
    his_ids = [i for i, _ in HISTORY_OPTIONS]
    sym_arr = F.array(*[F.lit(x) for x in sym_ids])
    his_arr = F.array(*[F.lit(x) for x in his_ids])
    nk = F.col("c_nationkey")
    sel = c.select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal",
        F.array(F.element_at(sym_arr, nk % 12 + 1), F.element_at(sym_arr, (nk + 5) % 12 + 1), F.lit("unknown"))
        .alias("symptom_ids"),
        F.when(F.col("c_acctbal") < 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.element_at(his_arr, nk % 6 + 1))).alias("history_ids"))
    f = format_request(age=(nk + 20).cast("string"), weight=F.round(F.col("c_acctbal") / 100).cast("long").cast("string"),
                       symptom_labels=option_labels("symptom_ids", SYMPTOM_OPTIONS),
                       history_labels=option_labels("history_ids", HISTORY_OPTIONS),
                       medications=F.col("c_name"), takes_meds=F.col("c_acctbal") > 5000)
    return sel.select("c_custkey", *[v.alias(k) for k, v in f.items()])


def q_page_links_topk(spark, sf):
    p = read_table(spark, sf, "pages", "page_id", "html")
    return result_links(p, "page_id", "html", marker="e", k=3)


def q_page_fields(spark, sf):
    p = read_table(spark, sf, "pages", "page_id", "html")
    return label_values(p, "page_id", "html")


def q_page_text(spark, sf):
    p = read_table(spark, sf, "pages", "page_id", "html")
    return page_texts(p, "page_id", "html", min_len=10)


def q_page_outcomes(spark, sf):
    p = read_table(spark, sf, "pages", "page_id", "url", "html")
    status = F.when(F.col("url").contains("#"), F.lit(404)).otherwise(F.lit(200))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    cls = page_outcome(F.col("html"), status, title, n_result_links("html", marker="e", k=3))
    return p.select(cls.alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("pages"))


def _chat_terms(spark, sf):
    req = fx.chat_requests(spark, sf)
    terms, links = extract_entities(req, fx.symptom_dictionary(spark, sf), _link_dict(spark, sf))
    return search_terms(terms, links)


def q_retrieve_substring(spark, sf):
    terms, links = _entities(spark, sf)
    st = search_terms(terms, links)
    return retrieve_substring(st, fx.registry(spark, sf), ord_col="ord", trade_col="trade_name",
                              sci_col="scientific_name", k=5).withColumn("rn", F.col("rn").cast("long"))


def q_retrieve_indexed(spark, sf):
    """Per distinct term of the chat and consult requests: its first 4 matching rows."""
    terms, links = _entities(spark, sf)
    both = _chat_terms(spark, sf).unionByName(search_terms(terms, links))
    per_term, _ = boundary_matches_per_term(both, fx.registry(spark, sf), term_col="term",
                                            ord_col="ord", trade_col="trade_name", sci_col="scientific_name", k=4)
    return per_term.select("term_l", "ord")


QUERIES.update({
    "registry_json_scan": q_registry_json_scan,
    "page_envelope_flatten": q_page_envelope_flatten,
    "csv_roundtrip": q_csv_roundtrip,
    "dictionary_scan": q_dictionary_scan,
    "registry_search": q_registry_search,
    "null_display": q_null_display,
    "request_format": q_request_format,
    "page_links_topk": q_page_links_topk,
    "page_fields": q_page_fields,
    "page_text": q_page_text,
    "page_outcomes": q_page_outcomes,
    "retrieve_substring": q_retrieve_substring,
    "retrieve_indexed": q_retrieve_indexed,
})


# --- streams ---------------------------------------------------------------------

def _land_as_files(df: DataFrame, path: str, rows_per_file: int) -> None:
    """Land a table as parquet files of bounded rows (the stream's arriving files)."""
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def q_stream_consult(spark, sf):
    """The consult requests arrive as files; prompts per micro-batch over the newest
    version of the master."""
    base = scratch_path(spark, "stream-consult")
    req = fx.consult_requests(spark, sf)
    _land_as_files(req, f"{base}/in", 15_000)
    write_new_version(_master(spark, sf), f"{base}/master")
    # dictionaries, stored once: every micro-batch reads them instead of deriving them again
    sd, ld = materialize(fx.symptom_dictionary(spark, sf), "sd"), materialize(_link_dict(spark, sf), "ld")
    versioned_consult_stream(
        spark, f"{base}/in", req.schema, f"{base}/out", f"{base}/ckpt", VersionedConsult(spark, f"{base}/master", MASTER_COLS),
        lambda batch, master, prepared: consult_prompts(batch, master, sd, ld, MASTER_COLS, base=prepared), files_per_trigger=2)
    return spark.read.parquet(f"{base}/out").drop("batch")


def q_stream_records(spark, sf):
    """R2 + J5: detail pages arrive per search name; half of the files, then all of them under
    other names and with a new checkpoint: every name's records come once."""
    base = scratch_path(spark, "stream-records")
    pages = fx.detail_pages(spark, sf).withColumn("search_key", F.concat("search_key", F.lit(" "), "url"))
    pages = materialize(pages, "landed")
    names = dict(name_col="search_key", url_col="url", min_len=10, files_per_trigger=4)
    early = pages.where(F.crc32("search_key") % 2 == 0)
    early.repartition(8, "search_key").write.parquet(f"{base}/first")
    record_stream(spark, f"{base}/first", pages.schema, f"{base}/out", f"{base}/ckpt-1", **names)
    pages.repartition(8, "search_key").write.parquet(f"{base}/second")
    record_stream(spark, f"{base}/second", pages.schema, f"{base}/out", f"{base}/ckpt-2", **names)
    r = current(spark, f"{base}/out").read(spark, RECORDS)
    return r.select("search_key", "url", F.element_at("fields", "Trade Name").alias("trade_name"),
                    F.element_at("fields", "Brand").alias("brand"), "leaflet", "practitioner")


def q_stream_page_extract(spark, sf):
    """R2: landed pages arrive as files; extraction runs once per page.  A file is one task's
    work, so files are small and a micro-batch takes several per core."""
    base = scratch_path(spark, "stream-pages")
    pages = read_table(spark, sf, "pages", "page_id", "url", "html")
    _land_as_files(pages, f"{base}/in", 2_500)
    page_extract_stream(spark, f"{base}/in", pages.schema, f"{base}/out", f"{base}/ckpt",
                        files_per_trigger=4 * spark.sparkContext.defaultParallelism)
    return spark.read.parquet(f"{base}/out")


QUERIES.update({
    "stream_consult": q_stream_consult,
    "stream_page_extract": q_stream_page_extract,
    "stream_records": q_stream_records,
})


def q_page_cards(spark, sf):
    """H4 on the landed pages: nav items as result cards (name = link text,
    ingredient = a plain-word link target), first 5 cards looked at."""
    p = read_table(spark, sf, "pages", "page_id", "html")
    return result_cards(p, "page_id", "html", 5,
                        name_expr=lambda c: F.regexp_extract(c, r">([^<]*)</a>", 1),
                        ingredients_expr=lambda c: F.regexp_extract(c, r'href="/([a-z]+)"', 1))


def q_master_versions(spark, sf):
    """The enriched master written as a new version next to the old one,
    read back from the newest version."""
    base = scratch_path(spark, "master-versions")
    write_new_version(fx.registry(spark, sf), base)                    # version 1: the cleaned registry
    write_new_version(_master(spark, sf), base)                        # version 2: enriched
    src = first_existing(spark, [f"{base}/missing", latest_version(spark, base)])
    return spark.read.parquet(src).select("ord", "sci_key", "leaflet", "intl_dosage")


QUERIES.update({
    "page_cards": q_page_cards,
    "master_versions": q_master_versions,
})


def q_detail_fields(spark, sf):
    """H2 on registry detail pages: label/value pairs, later duplicate label wins."""
    return detail_fields(fx.detail_pages(spark, sf))


def q_detail_sections(spark, sf):
    """H3 on registry detail pages: leaflet tabs by id, placeholder tabs dropped."""
    return detail_sections(fx.detail_pages(spark, sf))


QUERIES.update({
    "detail_fields": q_detail_fields,
    "detail_sections": q_detail_sections,
})


def q_page_main_block(spark, sf):
    """H6 on dosage pages: main block (class, else id, else skipped) and headings."""
    return main_blocks(fx.dosage_html_pages(spark, sf))


QUERIES["page_main_block"] = q_page_main_block


def q_dom_links(spark, sf):
    """H1 on result pages with mixed markup: first 3 view links, then those with a target."""
    return dom_result_links(fx.search_pages(spark, sf), "page_id", "html", "view", 3)


def q_dom_cards(spark, sf):
    """H4 on result pages: product cards, first 5 looked at."""
    return dom_result_cards(fx.search_pages(spark, sf), "page_id", "html", 5)


def q_leaflet_records(spark, sf):
    """H2 + H3 in one parse, keyed by search name and URL (texts over ten characters)."""
    r = leaflet_records(fx.detail_pages(spark, sf), "search_key", "url", min_len=10)
    return r.select("search_key", "url", F.element_at("fields", "Trade Name").alias("trade_name"),
                    F.element_at("fields", "Brand").alias("brand"), "leaflet", "practitioner")


QUERIES.update({
    "dom_links": q_dom_links,
    "dom_cards": q_dom_cards,
    "leaflet_records": q_leaflet_records,
})
