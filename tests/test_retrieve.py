"""Indexed retrieval against its definition on random small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from rxframe.operators.retrieve import (boundary_matches_per_term, build_substring_index, retrieve_substring,
                                        retrieve_topk, substring_candidates, substring_keys)

WORDS = ["flu", "cold", "influenza", "para", "paracetamol", "Cold + Flu", "tab", "é", "x-ray", "a_b", "+", ""]


def _fixture(seed):
    rnd = random.Random(seed)
    master = []
    for ordv in range(60):
        trade = None if rnd.random() < 0.1 else " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 3)))
        sci = None if rnd.random() < 0.2 else rnd.choice(["paracetamol", "ibuprofen", "Flu, Vaccine", "NaN"])
        master.append((ordv, trade, sci))
    reqs = []
    for req in range(25):
        for _ in range(rnd.randint(1, 3)):
            reqs.append((req, rnd.choice(WORDS + ["nan", "co", "ld + f", "FLU"])))
    return master, reqs


def edge(name, i):
    """Whether a word begins or ends at ``i``: just one of its neighbours is a letter, digit or underscore."""
    left, right = name[i - 1:i] if i else "", name[i:i + 1]
    return (left.isalnum() or left == "_") != (right.isalnum() or right == "_")


def as_word(term, name):
    """Whether ``term`` stands in ``name`` with a word edge at both ends."""
    return any(name.startswith(term, i) and edge(name, i) and edge(name, i + len(term)) for i in range(len(name) + 1))


def matching(master, terms, holds):
    """(order, ingredient) of the rows of which a lowered name holds a term; a missing name reads "nan"."""
    shown = [(o, sci, [("nan" if x is None else x).lower() for x in (trade, sci)]) for o, trade, sci in master]
    return sorted((o, sci) for o, sci, names in shown if any(holds(t, n) for t in terms for n in names))


def expected_topk(master, terms, k=4):
    """Of the matching rows the first of each ingredient (all without one), the ``k`` smallest orders."""
    rows = matching(master, [t.lower() for t in terms], as_word)
    first = {sci: min(o for o, s in rows if s == sci) for _, sci in rows}
    return [o for o, sci in rows if sci is None or o == first[sci]][:k]


def expected_substring(master, terms, k=5):
    """The older rule: terms are compared as they are written."""
    return [o for o, _ in matching(master, terms, lambda t, name: t in name)][:k]


def test_edges_of_words():
    cases = {("flu", "a flu b"): True, ("flu", "influenza"): False, ("flu", "flu_a"): False, ("+", "a+b"): True, ("+", "a + b"): False,
             ("", "a"): True, ("", "+"): False, ("", ""): False, ("é", "x é"): True, ("e", "é"): False, ("a b", "xa b"): False}
    assert {c: as_word(*c) for c in cases} == cases


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_topk_equals_definition(spark, seed, broadcast_rows):
    master, reqs = _fixture(seed)
    m = spark.createDataFrame(master, "ord long, trade string, sci string")
    r = spark.createDataFrame(reqs, "req_id long, term string")
    got = retrieve_topk(r, m, ord_col="ord", trade_col="trade", sci_col="sci", k=4, salt_buckets=3,
                        broadcast_rows=broadcast_rows)
    by_req = {}
    for row in got.collect():
        by_req.setdefault(row["req_id"], []).append((row["rn"], row["ord"]))
    for req in {q for q, _ in reqs}:
        terms = [t for q, t in reqs if q == req]
        expect = expected_topk(master, terms)
        assert [o for _, o in sorted(by_req.get(req, []))] == expect, (req, terms)


def check_substring(spark, master, reqs, **options):
    m = spark.createDataFrame(master, "ord long, trade string, sci string")
    r = spark.createDataFrame(reqs, "req_id long, term string")
    got = {}
    for row in retrieve_substring(r, m, ord_col="ord", trade_col="trade", sci_col="sci", **options).collect():
        got.setdefault(row["req_id"], []).append((row["rn"], row["ord"]))
    for req in {q for q, _ in reqs}:
        terms = [t for q, t in reqs if q == req and t is not None]
        assert [o for _, o in sorted(got.get(req, []))] == expected_substring(master, terms, options.get("k", 5)), (req, terms)


@pytest.mark.parametrize("seed, options", [(4, {}), (5, {"broadcast_bytes": 0, "salt_buckets": 2, "crowded": 0}),
                                           (6, {"crowded": 0, "k": 3}), (7, {"broadcast_bytes": 0, "gram": 2})])
def test_substring_equals_definition(spark, seed, options):
    check_substring(spark, *_fixture(seed), **options)


def test_substring_of_odd_names_and_terms(spark):
    """Repeated names, nulls, characters beyond 16 bits, line breaks, long names, terms that no name has."""
    long = "Ab" * 3000 + " zinc \U0001F600x end"
    master = [(i, "Same Name", "same") for i in range(30)] + [(40, "\U0001F600x", None), (41, "a\nb", "c"), (42, long, ""), (43, "", ""), (44, None, "q")]
    terms = ["same name", "Same", "\U0001F600x", "\U0001F600", "x", "a\nb", "\n", "zinc \U0001F600x", "zinc  ", "ab" * 50, "nan", "", None, "?x", "e na"]
    check_substring(spark, master, [*enumerate(terms), (99, "a\nb"), (99, "end")], crowded=1)
    check_substring(spark, [], [(1, "a"), (2, "")])


def test_a_stored_substring_index_serves_many_calls(spark):
    master, reqs = _fixture(8)
    m = spark.createDataFrame(master, "ord long, trade string, sci string")
    index = build_substring_index(m, "ord", "trade", "sci", k=5)
    r = spark.createDataFrame(reqs, "req_id long, term string")
    rows = lambda **x: sorted(map(tuple, retrieve_substring(r, m, ord_col="ord", trade_col="trade", sci_col="sci", **x).collect()))
    assert rows(k=2, index=index) == rows(k=2) and rows(index=index) == rows()
    with pytest.raises(ValueError, match="keeps 5 rows"):
        rows(k=6, index=index)


def test_terms_are_asked_for_by_their_rarest_grams(spark):
    """Names that share their beginning are not read for a term that ends rarely."""
    m = spark.createDataFrame([(i, f"paracetamol {'forte' if i % 10 else 'junior'} {i}", "x") for i in range(100)], "ord long, trade string, sci string")
    index = build_substring_index(m, "ord", "trade", "sci")
    terms = spark.createDataFrame([("paracetamol junior",), ("paracetamol 7",), ("tamol forte 1",), ("parazet",), ("ol",)], "term_l string")
    keys = {}
    for r in substring_keys(terms, index, crowded=20).collect():
        keys.setdefault(r["term_l"], []).append(r["key"])
    assert len(keys["paracetamol junior"]) == 1 and keys["paracetamol junior"][0] not in "paracetamol"
    assert "parazet" not in keys and "paracetamol 7" not in keys and keys["ol"] == ["ol"]
    found = {}
    for r in substring_candidates(substring_keys(terms, index, crowded=5), index).collect():
        found[r["term_l"]] = found.get(r["term_l"], 0) + 1
    assert found == {"paracetamol junior": 10, "tamol forte 1": 10, "ol": 100}


def test_literal_cases(spark):
    m = spark.createDataFrame([(0, "Influenza Tab", "x"), (1, "Cold + Flu Tab", "y"), (2, None, "z"),
                               (3, "A", None), (4, "B", None)], "ord long, trade string, sci string")
    r = spark.createDataFrame([(1, "flu"), (2, "cold + flu"), (3, "nan"), (4, "b"), (4, "a")],
                              "req_id long, term string")
    got = {}
    for row in retrieve_topk(r, m, ord_col="ord", trade_col="trade", sci_col="sci").collect():
        got.setdefault(row["req_id"], []).append(row["ord"])
    assert got[1] == [1]            # boundary: 'flu' does not match 'influenza'
    assert got[2] == [1]            # literal term with '+'
    assert sorted(got[3]) == [2, 3, 4]  # missing names print as 'nan'
    assert sorted(got[4]) == [3, 4]     # missing ingredients are never duplicates


def test_hot_term_salted(spark):
    """One key held by every row: the salted join still gives the exact first k."""
    m = spark.createDataFrame([(i, f"tab {i}", f"s{i % 7}") for i in range(300)], "ord long, trade string, sci string")
    r = spark.createDataFrame([(q, "tab") for q in range(20)], "req_id long, term string")
    per_term, small = boundary_matches_per_term(r, m, ord_col="ord", trade_col="trade", sci_col="sci",
                                                k=4, salt_buckets=8, broadcast_rows=0)
    assert not small
    assert sorted(x["ord"] for x in per_term.where(F.col("term_l") == "tab").collect()) == [0, 1, 2, 3]
