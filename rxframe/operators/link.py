"""Entity standardisation and brand linking.

Requests stay in long form ``(req, field, pos, sub, term)`` the whole way; the
dictionaries are dimension tables joined by equality, so Spark (or AQE at run
time, from measured sizes) picks a broadcast when they are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxframe.functions.text import comma_items, first_token, py_strip
from rxframe.session import materialize

# field ranks: insertion order of the reference's link map (medications first)
FIELD_MEDICATIONS, FIELD_SYMPTOMS, FIELD_HISTORY = 0, 1, 2


def _py_str(c):
    """``str(cell)`` of a pandas cell: missing prints as ``nan``."""
    return F.coalesce(c, F.lit("nan"))


def link_dictionary(mapping: DataFrame, *, ord_col: str, term_col: str, brand_col: str,
                    ingredient_col: str) -> DataFrame:
    """``(key, ingredient)`` with the mapping's last-wins rule.

    Each mapping row writes three keys in order: the upper-cased search term,
    the upper-cased brand and the brand's first word if longer than two
    characters.  A later write replaces an earlier one whatever its kind, so
    the winner per key is the one with the greatest ``(ord, kind)``.  A blank
    brand gets no first-word key.
    """
    term_key = F.upper(py_strip(_py_str(F.col(term_col))))
    brand_key = F.upper(py_strip(_py_str(F.col(brand_col))))
    first = first_token(brand_key)
    ing = py_strip(_py_str(F.col(ingredient_col)))
    entries = F.array(
        F.struct(F.lit(0).alias("kind"), term_key.alias("key")),
        F.struct(F.lit(1).alias("kind"), brand_key.alias("key")),
        F.struct(F.lit(2).alias("kind"),
                 F.when((brand_key != "") & (F.length(first) > 2), first).alias("key")))
    long = (mapping.select(F.col(ord_col).alias("ord"), ing.alias("ingredient"),
                           F.explode(entries).alias("e"))
            .select("ord", "ingredient", "e.kind", "e.key").where(F.col("key").isNotNull()))
    return long.groupBy("key").agg(
        F.max_by("ingredient", F.struct("ord", "kind")).alias("ingredient"))


def resolve_links(terms: DataFrame, dictionary: DataFrame, term_col: str = "term") -> DataFrame:
    """Adds ``ingredient`` (null when unlinked) by exact lookup of
    ``upper(strip(term))``; an empty term never links, and a blank ingredient is
    no link."""
    q = F.upper(py_strip(F.col(term_col)))
    d = dictionary.where(F.col("ingredient") != "").select(F.col("key").alias("_lk"), F.col("ingredient"))
    return (terms.withColumn("_lk", F.when(F.col(term_col) != "", q))
            .join(d, "_lk", "left").drop("_lk"))


def entity_rows(requests: DataFrame, symptom_dict: DataFrame, link_dict: DataFrame, *,
                req_col: str = "req_id", symptoms_col: str = "symptoms", history_col: str = "history",
                medications_col: str = "medications") -> DataFrame:
    """C3 as one long table ``(req, field, pos, sub, term, ingredient)``.

    All three request fields are exploded in one pass; symptom and history
    items that are dictionary keys expand to their terms (J6), medication items
    stay as they are and empty ones are skipped; every non-empty term is then
    looked up once in the brand dictionary (J7).  Terms, links and search terms
    all derive from this table, so callers can materialise it once.
    """
    fields = F.array(
        F.struct(F.lit(FIELD_SYMPTOMS).alias("field"), F.col(symptoms_col).alias("text")),
        F.struct(F.lit(FIELD_HISTORY).alias("field"), F.col(history_col).alias("text")),
        F.struct(F.lit(FIELD_MEDICATIONS).alias("field"), F.col(medications_col).alias("text")))
    per_field = requests.select(req_col, F.inline(fields))
    items = per_field.select(req_col, "field", F.posexplode(comma_items("text")).alias("pos", "item"))
    d = symptom_dict.select(F.col("key").alias("item"),
                            F.transform(F.split(F.col("value"), ","), lambda x: py_strip(x)).alias("exp"))
    expanded = items.join(d, "item", "left").select(
        req_col, "field", "pos",
        F.posexplode(F.when(F.col("field") == FIELD_MEDICATIONS,
                            F.when(F.col("item") != "", F.array("item")).otherwise(F.array().cast("array<string>")))
                     .otherwise(F.coalesce("exp", F.array("item")))).alias("sub", "term"))
    return resolve_links(expanded, link_dict)


def terms_and_links(rows: DataFrame, req_col: str = "req_id") -> tuple[DataFrame, DataFrame]:
    """From ``entity_rows``: ``terms`` ``(req, field, pos, sub, term)`` (each
    linked medication followed by its ingredient) and ``links``
    ``(req, brand, ingredient, link_rank)``, one row per linked name in the
    reference's insertion order (medications, then symptom/history terms)."""
    med_ings = rows.where((F.col("field") == FIELD_MEDICATIONS) & F.col("ingredient").isNotNull()).select(
        req_col, "field", "pos", F.lit(1).alias("sub"), F.col("ingredient").alias("term"))
    terms = rows.select(req_col, "field", "pos", "sub", "term").unionByName(med_ings)
    links = (rows.where(F.col("ingredient").isNotNull())
             .select(req_col, F.col("term").alias("brand"), "ingredient", F.struct("field", "pos", "sub").alias("rank"))
             .groupBy(req_col, "brand")
             .agg(F.min_by("ingredient", "rank").alias("ingredient"), F.min("rank").alias("link_rank")))
    return terms, links


def extract_entities(requests: DataFrame, symptom_dict: DataFrame, link_dict: DataFrame, *,
                     req_col: str = "req_id", symptoms_col: str = "symptoms",
                     history_col: str = "history", medications_col: str = "medications"
                     ) -> tuple[DataFrame, DataFrame]:
    """``(terms, links)`` of every request (see ``terms_and_links``); the rows that
    both derive from are stored once."""
    rows = materialize(entity_rows(requests, symptom_dict, link_dict, req_col=req_col, symptoms_col=symptoms_col,
                                   history_col=history_col, medications_col=medications_col), "entities")
    return terms_and_links(rows, req_col)


def search_terms(terms: DataFrame, links: DataFrame, req_col: str = "req_id") -> DataFrame:
    """Distinct ``(req, term)``: every standardised term plus every
    linked ingredient (case-sensitive)."""
    return (terms.select(req_col, "term")
            .unionByName(links.select(req_col, F.col("ingredient").alias("term")))
            .distinct())
