"""Cleaning of registry, leaflet and dosage tables.

All per-row work is one ``select`` of JVM-side expressions: no shuffle, and
every column function stays inside whole-stage codegen.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxframe.functions import text as tx
from rxframe.operators.common import keep_rows

# The cleaned registry's column order and the raw field each comes from.
REGISTRY_HEADERS = [
    "Trade Name", "Scientific Name", "Registration Number", "Registration Year",
    "Strength", "Dosage Form", "Administration Route", "Price (SAR)",
    "Manufacturer", "Manufacturer Country", "Selling Company", "Company Country",
    "Marketing Status", "Legal Status", "Storage Conditions", "Distribution Area", "Agents",
]
# Placeholder phrases that mark an empty leaflet.
LEAFLET_PLACEHOLDERS = ["لم يتم إدخال بيانات", "No data", "No specific match found"]

# The raw registry's field names.
RAW_FIELDS = ["id", "tradeName", "scientificName", "registerNumber", "registerYear", "strength",
              "strengthUnit", "doesageForm", "administrationRoute", "price", "manufacturerName",
              "manufacturerCountry", "companyName", "companyCountryEn", "marketingStatus", "legalStatus",
              "legalStatusEn", "storageConditions", "distributionArea"]

RAW_REGISTRY_SCHEMA = T.StructType(
    [T.StructField(f, T.StringType()) for f in RAW_FIELDS]
    + [T.StructField("agents", T.ArrayType(T.StructType([T.StructField("nameEn", T.StringType())])))])


def distinct_agent_names(agents) -> Column:
    """A10: names of agents that have one, cleaned, distinct, code-point sorted,
    joined by ``", "``; no agents gives ``""``."""
    a = F.col(agents) if isinstance(agents, str) else agents
    names = F.transform(F.filter(a, lambda x: x["nameEn"].isNotNull() & (x["nameEn"] != "")),
                        lambda x: tx.ws_collapse(x["nameEn"]))
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(names)), ", "), F.lit(""))


def distinct_names_per_key(df: DataFrame, key: str, name_col: str, out_col: str = "agents") -> DataFrame:
    """A10 over a long table ``(key, name)``: names that are present, cleaned,
    distinct, code-point sorted, joined by ``", "`` per key; a key without any gives
    ``""``.  One shuffle: sets are combined in the map tasks, so a key costs its
    distinct names, not its rows."""
    name = F.when(F.col(name_col) != "", tx.ws_collapse(name_col))
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(name)), ", ").alias(out_col))


def clean_registry(raw: DataFrame, keep: dict[str, str] | None = None) -> DataFrame:
    """Raw registry records (``RAW_REGISTRY_SCHEMA``) to the 17 cleaned
    string columns, ``""`` for missing; ``keep`` passes columns through renamed."""
    ws = tx.ws_collapse
    cols = [
        tx.comma_spacing("tradeName"), tx.comma_spacing("scientificName"), ws("registerNumber"),
        ws("registerYear"), tx.strength_with_unit("strength", "strengthUnit"), ws("doesageForm"),
        ws("administrationRoute"), ws("price"), ws("manufacturerName"), ws("manufacturerCountry"),
        ws("companyName"), ws("companyCountryEn"), ws("marketingStatus"),
        tx.first_nonempty("legalStatusEn", "legalStatus"), ws("storageConditions"), ws("distributionArea"),
        distinct_agent_names("agents"),
    ]
    passed = [F.col(k).alias(v) for k, v in (keep or {}).items()]
    return raw.select(*passed, *[c.alias(h) for c, h in zip(cols, REGISTRY_HEADERS)])


def leaflet_keep_predicate(columns: Sequence[str], leaflet_cols=("leaflet", "practitioner")) -> Column:
    """keep a row unless a present leaflet column contains a placeholder
    (case-sensitive; missing text counts as not containing)."""
    pattern = "|".join(LEAFLET_PLACEHOLDERS)
    keep = F.lit(True)
    for c in leaflet_cols:
        if c in columns:
            keep = keep & ~F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return keep


def leaflet_usable(leaflet: str = "leaflet", practitioner: str | None = "practitioner") -> Column:
    """F3-F5 for a lookup, on raw text: the leaflet is not empty once cleaned and neither text
    holds a placeholder.  (F3 drops rows without leaflet and names; without leaflet they are not usable.)"""
    bad = tx.has_phrase(leaflet, LEAFLET_PLACEHOLDERS)
    if practitioner:
        bad = bad | tx.has_phrase(practitioner, LEAFLET_PLACEHOLDERS)
    return tx.has_leaflet_text(leaflet) & ~bad


def dosage_usable(cols: Sequence[str]) -> Column:
    """F4 for a lookup, on raw text: one of the dosage texts is not empty once cleaned."""
    return functools.reduce(lambda a, b: a | b, [tx.has_dosage_text(c) for c in cols])


def clean_leaflets(df: DataFrame, required_any: Sequence[str],
                   leaflet_cols: Sequence[str] = ("leaflet", "practitioner")) -> DataFrame:
    """F3 -> T5 -> F5: drop rows missing all of ``required_any``, normalise every
    string column, drop rows whose leaflet holds a placeholder."""
    kept = df.dropna(how="all", subset=list(required_any))
    strings = {f.name for f in kept.schema.fields if isinstance(f.dataType, T.StringType)}
    normalised = kept.select(*[tx.leaflet_normalise(c).alias(c) if c in strings else F.col(c)
                               for c in kept.columns])
    return keep_rows(normalised, leaflet_keep_predicate(normalised.columns, leaflet_cols))


DOSAGE_COLS = ("adult", "pediatric", "renal", "liver")


def clean_dosage(df: DataFrame, cols: Sequence[str] = DOSAGE_COLS) -> DataFrame:
    """T6 on the four dosage texts, F4 (drop rows where all four are empty),
    T7 labelled ``dosage_context``."""
    out = df.select(*[tx.dosage_normalise(c).alias(c) if c in cols else F.col(c) for c in df.columns])
    out = keep_rows(out, ~functools.reduce(lambda a, b: a & b, [F.col(c) == "" for c in cols]))
    return out.withColumn("dosage_context", tx.dosage_context(*cols))


def extract_sections(df: DataFrame, text_col: str) -> DataFrame:
    """T11/T12 + F7: adult, pediatric (to the next ``Usual``, 1000 chars), renal
    and liver (to the next blank line, 500 chars) sections of a dosage page;
    rows with neither adult nor pediatric text are dropped."""
    t = F.col(text_col)
    out = df.select(
        *[F.col(c) for c in df.columns if c != text_col],
        tx.section_between(t, tx.ADULT_MARKER, "Usual", 1000).alias("adult"),
        tx.section_between(t, tx.PEDIATRIC_MARKER, "Usual", 1000).alias("pediatric"),
        tx.section_between(t, tx.RENAL_MARKER, "\n\n", 500).alias("renal"),
        tx.section_between(t, tx.LIVER_MARKER, "\n\n", 500).alias("liver"))
    return keep_rows(out, (F.col("adult") != "") | (F.col("pediatric") != ""))



def clean_registry_with_id(raw: DataFrame, id_col: str = "id") -> DataFrame:
    """C1 keeping the record id as ``record_id`` (to join back to raw records)."""
    return clean_registry(raw, keep={id_col: "record_id"})
