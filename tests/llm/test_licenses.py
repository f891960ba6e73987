import math
import re
from collections import Counter

from pyspark.sql import functions as F

from edge_rows import EDGE
from rxframe.llm import licenses

FILES = [
    (1, "LICENSE", "Released under the MIT License."),
    (2, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
    (3, "a/b/code.py", "nothing here\nbut code"),
    (4, "a/b/own.py", "# This work is licensed under the GNU General Public License, version 3.\n" + "code and more\n" * 30),
    (5, "c/x.py", "plain words"),
    (6, "a/b/c/d/deep.py", None),
    (7, None, "no path, no license"),
    (8, "a/b/rights.txt", "all RIGHTS   reserved!\n" + "text of a page " * 20),
    (9, "top.txt", "license terms may apply to rights and versions of things in general"),
    (9, "top.txt", "license terms may apply to rights and versions of things in general"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(3)


def brute_cosines(texts):
    """Largest cosine of each text's lines to a template, by dictionaries."""
    def terms(s):
        return [t for t in re.split(r"[^a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in s)) if t]

    lines = [terms(x) for t in texts for x in (t or "").split("\n")]
    known = {t for _, n in licenses.TEMPLATES for t in terms(n)}
    df = Counter(t for x in lines for t in set(x) & known)
    idf = lambda t: 1 + math.log((len(lines) + 1) / ((df[t] if t in known else 1) + 1))
    vec = lambda x: {t: n * idf(t) for t, n in Counter(x).items()}

    def cos(a, b):
        norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        return sum(v * b.get(t, 0) for t, v in a.items()) / norm if norm else 0

    out = []
    for text in texts:
        scored = [(-round(cos(vec(terms(x)), vec(terms(n))), 9), k) for x in (text or "").split("\n") for k, n in licenses.TEMPLATES]
        c, k = min(scored)
        out.append(k if -c >= 0.8 else None)
    return out


def test_headers_files_and_inheritance(spark):
    rows = {(r["doc_id"], r["path"]): r for r in licenses.scan(frame(spark, FILES)).collect()}
    got = {i: (r["license"], r["origin"], r["from_dir"]) for (i, _), r in rows.items()}
    assert got[1] == ("MIT", "file", None) and got[2] == ("Apache-2.0", "file", None)
    assert got[3] == ("Apache-2.0", "inherited", "a") and got[6] == ("Apache-2.0", "inherited", "a")
    assert got[4] == ("GPL-3.0", "header", None) and got[8] == ("Proprietary", "header", None)
    assert got[5] == ("MIT", "inherited", "") and got[7] == (None, "none", None) and got[9][0] == "MIT"
    assert licenses.scan(frame(spark, FILES)).count() == len(FILES)


def test_own_licenses_match_brute_force(spark, sf_docs):
    docs = sf_docs.withColumn("path", F.concat_ws("/", "source", "lang", "doc_id"))
    rows = sf_docs.select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], brute_cosines([r["text"] for r in rows])))
    got = {r["doc_id"]: r["license"] if r["origin"] in ("header", "file") else None for r in licenses.scan(docs).collect()}
    assert got == want and any(want.values())


def test_edge_rows(spark, make_docs):
    docs = make_docs(EDGE).withColumn("path", F.concat_ws("/", "source", "doc_id")).withColumn("license", F.lit(1))
    assert licenses.scan(docs).count() == len(EDGE)
    assert licenses.scan(frame(spark, [(1, None, None)])).count() == 1
    assert licenses.scan(make_docs([]).withColumn("path", F.lit("x"))).count() == 0


def test_cosines_do_not_depend_on_repetition(spark):
    """Everyday words weigh by their counted frequency, so a corpus repeated 300 times
    gives every cosine again."""
    line = "This work is licensed under the GNU General Public License, version 3 or later."
    prose = ["sooner or later it rains", "now or never", "later that day", "one or two", "tea or coffee", "see you later"] * 5
    rows = [(i, f"d/{i}", t) for i, t in enumerate([line, *prose, "Licensed under the Apache License"])]
    once = frame(spark, rows)
    often = once.crossJoin(spark.range(300).select(F.col("id").alias("k"))) \
        .select(F.col("doc_id"), F.concat_ws("/", F.lit("k"), "k", "path").alias("path"), "text")
    pick = lambda d: {(r["doc_id"], r["license"], r["cosine"]) for r in licenses.scan(d).collect() if r["cosine"]}
    one = pick(once)
    assert {(i, k) for i, k, _ in one} >= {(0, "GPL-3.0")}
    assert pick(often) == one


def test_header_variants_blocks_and_license_texts(spark):
    """Ordinary cases beyond the ten notices, among everyday prose."""
    mit = (licenses.more_templates.__globals__["TEXTS"] / "MIT.txt").read_text()
    gpl = (licenses.more_templates.__globals__["TEXTS"] / "GPL-3.0.txt").read_text()
    code = "\n\nimport os\n" + "value = compute(other value)\n" * 40
    cases = [
        ("Licensed under the MIT License." + code, "MIT", "header"),
        ("Copyright 2020 Acme. All rights reserved." + code, "Proprietary", "header"),
        ("Released under the MIT License, see below." + code, "MIT", "header"),
        ("GNU GENERAL PUBLIC LICENSE" + code, "GPL", "header"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy" + code, "MIT", "header"),
        ("# it under the terms of the GNU General Public License as published by" + code, "GPL", "header"),
        (mit.replace("[year] [fullname]", "2021 Jane Q. Doe"), "MIT", "file"),
        ("".join(f" * {x}\n" for x in mit.split("\n")[4:10]) + " */" + code, "MIT", "header"),
        (gpl, "GPL-3.0", "file"),
        ("# This program is free software: you can redistribute it and/or modify it under the\n"
         "# terms of the GNU General Public License as published by the Free Software Foundation,\n"
         "# either version 3 of the License, or (at your option) any later version.\nimport os\n" + code, "GPL-3.0", "header"),
        ("the weather was fine and any person would see it" + code, None, "none"),
    ]
    prose = [(100 + i, f"p{i}/x", f"the day {i} was of the kind that you see in any person or other value\nand under the tree") for i in range(30)]
    rows = [(i, f"c{i}/x", text) for i, (text, _, _) in enumerate(cases)] + prose
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan(frame(spark, rows)).collect()}
    assert {i: got[i] for i in range(len(cases))} == {i: (k, o) for i, (_, k, o) in enumerate(cases)}
    assert all(got[r[0]] == (None, "none") for r in prose)
