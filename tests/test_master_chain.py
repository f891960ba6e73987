"""The whole chain from raw sources, and the raw-text predicates it chooses winners by."""

import random

import pytest
from pyspark.sql import functions as F

from rxframe.functions import text as tx
from rxframe.operators.clean import LEAFLET_PLACEHOLDERS, RAW_REGISTRY_SCHEMA, clean_leaflets, leaflet_keep_predicate, leaflet_usable
from rxframe.operators.enrich import last_per_key
from rxframe.plans.master import ROUTE_LABEL, build_master_from_sources


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(3)
    pieces = [" ", "  ", "\n", "\r", "\t", "_x000D_", "_x000D", "x000D_", "_", "No", "data", "specific", "match", "found", "for:",
              "FOR:", "nan", "NaN", "|", "Additional dosage information", " ", "\x85", "لم يتم", "إدخال بيانات", "word"]
    rows = [("".join(r.choice(pieces) for _ in range(r.randint(0, 7))),) for _ in range(4000)]
    rows += [(None,), ("",), ("No" + " " * 20_000 + "data",), (" " * 50_000,), ("_x000D_" * 2_000,), ("\n" * 9,), ("for:" + " " * 9_000,)]
    return spark.createDataFrame(rows, "t string").repartition(4)


def test_predicates_on_raw_text_say_what_cleaning_would(texts):
    cleaned = tx.leaflet_normalise("t")
    phrase = cleaned.rlike("|".join(LEAFLET_PLACEHOLDERS))
    rules = [(tx.has_leaflet_text("t"), cleaned != ""), (tx.has_phrase("t", LEAFLET_PLACEHOLDERS), phrase),
             (tx.has_dosage_text("t"), tx.dosage_normalise("t") != "")]
    for raw, after in rules:
        after = F.coalesce(after, F.lit(False))
        assert texts.where(raw != after).collect() == []
        assert 0 < texts.where(raw).count() < texts.count()


def test_usable_rows_are_those_that_cleaning_keeps(spark, texts):
    both = texts.withColumn("leaflet", F.col("t")).withColumn("practitioner", F.reverse("t")).withColumn("n", F.monotonically_increasing_id())
    kept = clean_leaflets(both, ["leaflet"]).where("leaflet <> ''")
    usable = both.where(leaflet_usable())
    assert sorted(r["n"] for r in usable.select("n").collect()) == sorted(r["n"] for r in kept.select("n").collect())
    assert leaflet_keep_predicate(["leaflet"]) is not None


def test_winners_are_told_in_one_pass(spark):
    df = spark.createDataFrame([(1, "k", "real text"), (2, "k", " \r "), (3, None, "n"), (4, "e", "")], "ord int, key string, t string")
    out = last_per_key(df, "key", "ord", ["t"], tx.has_dosage_text("t"))
    assert sorted(out.collect(), key=str) == sorted([("k", "real text"), (None, "n")], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 2 and "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def tabs(leaflet, practitioner="p", route="oral"):
    return (f'<div id="D-div"><label class="form-label">{ROUTE_LABEL}</label><div class="form-line">{route}</div></div>'
            f'<div id="A-div"><p>{leaflet}</p></div><div id="M-div"><p>{practitioner}</p></div>')


def registry(spark, names):
    rows = [{"id": str(n), "tradeName": t, "scientificName": s, "agents": None} for n, (t, s) in enumerate(names)]
    return spark.createDataFrame([tuple(r.get(f.name) for f in RAW_REGISTRY_SCHEMA.fields) for r in rows], RAW_REGISTRY_SCHEMA)


PAGES = "search_key string, ord long, url string, html string"


def build(spark, names, leaflets, brands, dosage):
    m = build_master_from_sources(registry(spark, names), spark.createDataFrame(leaflets, PAGES),
                                  spark.createDataFrame(brands, PAGES),
                                  spark.createDataFrame(dosage, "search_key string, ord long, html string"))
    return {r["record_id"]: r for r in m.collect()}


def test_chain_by_hand(spark):
    names = [(" Brand  A", "sci a"), ("Brand B ", "sci b"), ("Brand C", "sci c"), ("Brand A", "sci a ,  x"), (None, None)]
    leaflets = [("sci a", 5, "u", tabs("later")), ("sci a", 4, "u", tabs("first\n \n text ")), ("sci a", 1, "u", tabs("No  data here")),
                ("sci a", 2, "u", tabs("fine", "No specific\rmatch found")), ("sci a", 3, "u", tabs("لم يتم إدخال بيانات")),
                ("sci b", 1, "u", tabs(" _x000D_ ")), ("sci a, x", 9, "u", tabs("for the pair", "لم يتم إدخال بيانات")),
                ("other", 1, "u", tabs("nobody asks")), (None, 7, "u", tabs("no name")), ("sci c", 2, "u", None)]
    brands = [("Brand B", 2, "u", tabs("brand  text as it is", route="rectal")), ("Brand B", 1, "u", tabs("short")),
              ("Brand A", 1, "u", tabs("not needed, a leaflet is there")), ("Brand C", 1, "u", "<p>no tabs</p>")]
    def main(body):
        return f'<div class="contentBox">{body}</div>'
    dosage = [("sci a", 1, main("<h2>Usual Adult Dose</h2><p>one\n\ntwo</p>")), ("sci a", 2, main("Usual Adult Dose for: 5 mg Usual Pediatric Dose 2 mg")),
              ("sci a", 3, main("Usual Adult Dose for: ")), ("sci a", 4, main("nothing")), ("sci a", 5, "<p>Usual Adult Dose 9</p>"),
              ("sci b", 1, '<section id="content">Usual Adult Dose x Renal Dose Adjustments y</section>'), ("sci c", 1, None)]
    got = build(spark, names, leaflets, brands, dosage)
    assert len(got) == 5
    a, b, c, pair, none = (got[str(n)] for n in range(5))
    assert (a["leaflet"], a["practitioner"], a["route_ar"], a["leaflet_before_gap"]) == ("first\n text", "p", "oral", True)
    assert a["intl_dosage"] == "[Adult] 5 mg // [Pediatric] 2 mg"
    assert (b["leaflet"], b["practitioner"], b["route_ar"], b["leaflet_before_gap"]) == ("brand  text as it is", None, "rectal", False)
    assert b["intl_dosage"] == "[Adult] x Renal Dose Adjustments y // [Renal] y"
    assert (c["leaflet"], c["route_ar"], c["intl_dosage"]) == (None, None, "")
    assert (pair["leaflet"], pair["practitioner"], pair["Scientific Name"]) == ("for the pair", None, "sci a, x")
    assert (none["Trade Name"], none["leaflet"], none["intl_dosage"]) == ("", None, "")


def test_chain_of_empty_tables(spark):
    assert build(spark, [], [], [], []) == {}
    got = build(spark, [("t", "s")], [], [], [])
    assert got["0"]["leaflet"] is None and got["0"]["intl_dosage"] == ""
