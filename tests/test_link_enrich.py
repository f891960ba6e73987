"""Linking, lookups and quality rules on literal cases."""

from pyspark.sql import functions as F

from rxframe.operators import quality
from rxframe.operators.enrich import lookup_first_wins, lookup_gap_fill, lookup_last_wins, resume_todo
from rxframe.operators.link import extract_entities, link_dictionary, resolve_links, search_terms


def _mapping(spark):
    rows = [  # ord, search term, brand, ingredients
        (0, "PANADOL", "Panadol Extra", "paracetamol, caffeine"),
        (1, "PANADOL", "Panadol", "paracetamol"),
        (2, "NICORETTE", "Nicorette Gum", "nicotine"),
        (3, "NICORETTE", "Nicorette Spray", "nicotine resinate"),
        (4, "OMNI", "Omnipaque 300", "iohexol"),
        (5, "OLMETEC", "Olmetec Plus", "hydrochlorothiazide, olmesartan medoxomil"),
        (6, "X", " ", "blank brand"),
    ]
    return spark.createDataFrame(rows, "ord long, term string, brand string, ing string")


def test_link_dictionary_rules(spark):
    d = link_dictionary(_mapping(spark), ord_col="ord", term_col="term", brand_col="brand", ingredient_col="ing")
    got = {r["key"]: r["ingredient"] for r in d.collect()}
    assert got["PANADOL"] == "paracetamol"                 # last write wins
    assert got["PANADOL EXTRA"] == "paracetamol, caffeine"
    assert got["NICORETTE"] == "nicotine resinate"         # first-word key of a later row wins
    assert got["OMNIPAQUE"] == "iohexol"                   # first word of the brand
    assert got["OLMETEC"] == "hydrochlorothiazide, olmesartan medoxomil"   # kept whole
    assert "" in got and got[""] == "blank brand"          # blank brand: no first-word key, brand key ''
    t = spark.createDataFrame([("panadol",), ("PANADOL",), ("Omnipaque",), ("solpadeine",), ("",)], "term string")
    res = {r["term"]: r["ingredient"] for r in resolve_links(t, d).collect()}
    assert res == {"panadol": "paracetamol", "PANADOL": "paracetamol", "Omnipaque": "iohexol",
                   "solpadeine": None, "": None}


def test_entities_expand_and_link(spark):
    sd = spark.createDataFrame([("صداع / آلام الرأس", "headache, migraine, pain relief, paracetamol, ibuprofen")],
                               "key string, value string")
    ld = link_dictionary(_mapping(spark), ord_col="ord", term_col="term", brand_col="brand", ingredient_col="ing")
    req = spark.createDataFrame([(1, "صداع / آلام الرأس, shjkdhfkjsd", "Panadol", "Omnipaque, , omnipaque")],
                                "req_id long, symptoms string, history string, medications string")
    terms, links = extract_entities(req, sd, ld)
    st = {r["term"] for r in search_terms(terms, links).collect()}
    assert {"headache", "migraine", "shjkdhfkjsd", "Panadol", "Omnipaque", "iohexol", "paracetamol"} <= st
    ls = sorted((r["link_rank"]["field"], r["brand"], r["ingredient"]) for r in links.collect())
    assert ls == [(0, "Omnipaque", "iohexol"), (0, "omnipaque", "iohexol"), (2, "Panadol", "paracetamol")]


def test_lookups(spark):
    master = spark.createDataFrame([(1, "a", "t1", None), (2, "b", "t2", None), (3, None, "t3", None)],
                                   "ord long, sci string, trade string, leaflet string")
    look = spark.createDataFrame([(10, "a", None, "r0"), (11, "a", "L1", None), (12, "a", "L2", "r2"),
                                  (13, None, "LN", "rn")], "ord long, key string, leaflet string, route string")
    j2 = {r["ord"]: (r["leaflet"], r["route"]) for r in lookup_first_wins(
        master, look, master_key="sci", lookup_key="key", ord_col="ord", require="leaflet",
        take={"leaflet": "leaflet", "route": "route"}).collect()}
    assert j2 == {1: ("L1", None), 2: (None, None), 3: ("LN", "rn")}   # one row supplies both; null keys meet
    filled = lookup_gap_fill(master.withColumn("route", F.lit("keep")), look.withColumnRenamed("key", "k2"),
                             master_key="sci", lookup_key="k2", ord_col="ord", require="leaflet",
                             take={"leaflet": "leaflet", "route": "route"})
    got = {r["ord"]: (r["leaflet"], r["route"]) for r in filled.collect()}
    assert got[1] == ("L1", "keep")          # each column filled on its own
    last = {r["ord"]: r["ctx"] for r in lookup_last_wins(
        master, look, master_key="sci", lookup_key="key", ord_col="ord", value="route", target="ctx").collect()}
    assert last == {1: "r2", 2: "", 3: "rn"}
    todo = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "n string")
    done = spark.createDataFrame([("b",)], "n string")
    assert [r["n"] for r in resume_todo(todo, done, "n").collect()] == ["a"]


def test_quality(spark):
    df = spark.createDataFrame([(1, "R1", 0), (1, "R1", 1), (None, "", 2), (None, "R2", 3), (2, "R2", 4)],
                               "id long, reg string, ord long")
    dups = {(r["id"], r["n"]) for r in quality.duplicate_ids(df, ["id"]).collect()}
    assert dups == {(1, 2), (None, 2)}       # a missing id counts as a value
    dk = quality.duplicate_keys(df, "reg", "ord").collect()
    assert [(r["reg"], r["n"], r["duplicate_keys"]) for r in dk] == [("R1", 2, 2), ("R2", 2, 2)]
    raw = spark.createDataFrame([('{"a": 1, "b": null}',), ('{"a": 2}',)], "raw string")
    assert {(r["field"], r["missing"]) for r in quality.field_presence(raw, "raw").collect()} == {("b", 1)}
    ce = quality.critical_empty(df.select(F.col("reg"), F.col("id").cast("string")), ["reg", "id"]).collect()
    assert {(r["field"], r["empty"]) for r in ce} == {("reg", 1), ("id", 2)}


def test_blank_ingredient_is_no_link(spark):
    from rxframe.operators.link import resolve_links
    d = spark.createDataFrame([("A", ""), ("B", "x")], "key string, ingredient string")
    terms = spark.createDataFrame([("a",), ("b",), ("",)], "term string")
    assert {r["term"]: r["ingredient"] for r in resolve_links(terms, d).collect()} == {"a": None, "b": "x", "": None}


def test_lookup_plans_sort_no_text(spark):
    from rxframe.operators.enrich import first_per_key, last_per_key, lookup_last_wins, with_text
    df = spark.createDataFrame([(1, "k", "one"), (2, "k", ""), (3, None, "n")], "ord int, key string, text string")
    for reduce in (first_per_key, last_per_key):
        out = reduce(df, "key", "ord", ["text"])
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
        assert len(out.collect()) == 2
    m = spark.createDataFrame([("k",)], "mk string")
    got = lookup_last_wins(m, with_text(df, "text"), master_key="mk", lookup_key="key", ord_col="ord", value="text", target="t")
    assert got.first()["t"] == "one"        # the empty last row does not replace the earlier text
