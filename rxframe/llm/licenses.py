"""License scan: TF-IDF cosine of texts to templates, then inheritance by directory.

Compared are whole texts, blocks and lines of every text.  A block is a run of lines
with terms and the same comment mark.  Templates are notices, standard headers and whole
license texts.  Weights are term frequency times ``1 + ln(n / df)``: ``df`` of all ``n``
lines have the term, counted for every term of every line; a template's term in no line
weighs as the rarest counted one.  Only shares of lines count, so repeating all
rows changes no cosine.  Copyright clauses (mark, year, holder) are no part of a text.
A piece carries the license of the template with the largest cosine of ``MIN_COSINE`` or
more; a whole text decides before blocks, blocks before lines.  A text with at least half
of its terms in such pieces is a license file and gives its license to its directory; a
text without a license of its own takes that of the nearest directory above it.

Spark shape: the texts are read twice in the row (counting, then picking lines);
counting shuffles at most one row per term and task, and the counts stay a table that
is cut by a join to the terms of the compared pieces.  A piece can only reach the cosine
if it has one of a template's few rarest terms (the rest is too short a vector), so only
texts with such lines become rows, equal pieces one; and only if it does so without its
terms outside the templates, so only then are those looked up: both are exact filters.
Directories are reduced to distinct ones before ancestors are joined, so a directory
with a third of all files is one row there.

Defined results: null and blank texts have no license of their own but may inherit.
Ties go to the first template by name; in a directory the license file with the
largest cosine wins, then the first license name.  Null paths belong to no directory.
Rows with equal path and text are alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxframe.llm.license_templates import more_templates
from rxframe.llm.text import ascii_lower, join_same
from rxframe.session import materialize

MIN_COSINE = 0.8
FILE_SHARE = 0.5
# fixed values: short notices by license
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_SPLIT = r"[^a-z0-9]+"
# a copyright mark with a year, up to the sentence's end or "all rights reserved"
_CLAUSE = r"(?i)(?:copyright|\(c\)|©)(?:\s|\(c\)|©|,)*(?:[0-9]{4}|[\[<{](?:yyyy|year))" \
          r"(?:(?:(?!licen)[^\n])*?(?=all rights reserved)|[^\n.]*)"
_MARK = r"^\s*([#*/;%!-]*)"


def terms(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), _SPLIT), "")


def _clean(text: Column) -> Column:
    return F.regexp_replace(text, _CLAUSE, " ")


def _lines(docs: DataFrame, text_col: str) -> Column:
    return F.split(_clean(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), "\n")


def term_weights(docs: DataFrame, text_col: str, templates: DataFrame) -> tuple[dict[str, float], DataFrame]:
    """Inverse line frequency of every template term; a table of all counted terms'
    (``t``, ``idf``)."""
    lines = docs.select(F.explode_outer(_lines(docs, text_col)).alias("l"))
    found = lines.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(terms(F.col("l"))))).alias("t"))
    counts = materialize(found.groupBy("t").agg(F.count(F.lit(1)).alias("df")), "license-terms")
    r = counts.agg(F.max(F.when(F.col("t") == "", F.col("df"))).alias("n"), F.min(F.when(F.col("t") != "", F.col("df"))).alias("rarest")).first()
    n, rarest = r["n"] or 1, r["rarest"] or 1
    idf = counts.where("t != ''").select("t", (1 + F.log(F.lit(float(n)) / F.col("df"))).alias("idf"))
    vocabulary = templates.select(F.explode(terms(_clean(F.col("notice")))).alias("t")).distinct()
    known = {r["t"]: r["idf"] for r in vocabulary.join(idf, "t", "left").collect()}
    return {t: 1 + math.log(n / rarest) if w is None else w for t, w in known.items()}, idf


def _template_table(spark: SparkSession, templates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``license``, ``k`` (the template), ``t``, ``idf``, ``tw``: weights of unit length per template."""
    idf = spark.createDataFrame(sorted(weights.items()), "t string, idf double")
    d = templates.select("license", F.md5(F.concat_ws("\n", "license", "notice")).alias("k"), F.explode(terms(_clean(F.col("notice")))).alias("t")) \
        .groupBy("license", "k", "t").agg(F.count(F.lit(1)).alias("tf")).join(idf, "t") \
        .withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("license", "k")))
    return materialize(d.select("license", "k", "t", "idf", (F.col("w") / norm).alias("tw")), "license-templates")


def _needed_terms(table: DataFrame, min_cosine: float) -> DataFrame:
    """``k``, ``t``: per template its rarest terms, so many that the others have a length
    below ``min_cosine``: a piece without any of them cannot reach it."""
    rest = F.sum(F.col("tw") * F.col("tw")).over(
        Window.partitionBy("license", "k").orderBy("idf", "tw", "t").rowsBetween(Window.unboundedPreceding, 0))
    return materialize(table.withColumn("rest", rest).where(F.col("rest") >= (min_cosine - 1e-9) ** 2).select("k", "t"), "license-needed")


def _literals(table: DataFrame) -> str:
    return ", ".join(f"'{t}'" for t in ["", *sorted(r["t"] for r in table.select("t").distinct().collect())])


def _pieces(rows: DataFrame, key: list[str]) -> DataFrame:
    """``kind`` (0 whole text, 1 block, 2 line), first ``line``, ``block``, terms ``ts``."""
    starts = rows.where("lines is not null").select(*key, "lines", F.expr(
        "transform(filter(lines, (x, i) -> size(x.ts) > 0 and (i = 0 or size(get(lines, i - 1).ts) = 0"
        " or get(lines, i - 1).m != x.m)), x -> x.line)").alias("s"))
    blocks = starts.select(*key, "lines", "s", F.expr(
        "filter(transform(s, (b, j) -> slice(lines, b + 1, coalesce(get(s, j + 1), size(lines)) - b)),"
        " b -> exists(b, x -> x.hit))").alias("blocks"))
    whole = "if(size(s) > 1, array(struct(0 as kind, s[0] as line, -1 as block, flatten(lines.ts) as ts)), array())"
    block = "if(size(filter(b, x -> size(x.ts) > 0)) > 1, array(struct(1 as kind, b[0].line as line, b[0].line as block, flatten(b.ts) as ts)), array())"
    line = "transform(filter(b, x -> x.hit), x -> struct(2 as kind, x.line as line, b[0].line as block, x.ts as ts))"
    return blocks.select(*key, F.expr(f"inline(concat({whole}, flatten(transform(blocks, b -> concat({block}, {line})))))")) \
        .withColumn("u", F.unhex(F.sha2(F.array_join("ts", " "), 256)))


def _matches(pieces: DataFrame, table: DataFrame, needed: DataFrame, counted: DataFrame, min_cosine: float) -> DataFrame:
    """``u``, ``license``, ``cosine``: the best template of every piece that reaches one."""
    known = F.expr(f"filter(ts, t -> t in ({_literals(table)}))")
    vocabulary = table.select("t", "idf").distinct()
    inside = pieces.select("u", known.alias("ts")).groupBy("u").agg(F.first("ts").alias("ts")) \
        .select("u", F.explode("ts").alias("t")).groupBy("u", "t").agg(F.count(F.lit(1)).alias("tf")) \
        .join(F.broadcast(vocabulary), "t").groupBy("u").agg(
            F.collect_list(F.struct("t", (F.col("tf") * F.col("idf")).alias("w"))).alias("v"))
    inside = materialize(inside.withColumn("inside", F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * x["w"])), "license-pieces")
    # only templates of which the piece has a needed term
    by_term = needed.groupBy("t").agg(F.collect_list("k").alias("ks"))
    own = inside.select("u", F.explode("v.t").alias("t")).join(F.broadcast(by_term), "t") \
        .select("u", F.explode("ks").alias("k")).distinct()
    vectors = table.groupBy("k", "license").agg(F.map_from_entries(F.collect_list(F.struct("t", "tw"))).alias("tv"))
    dot = F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(F.try_element_at("tv", x["t"]), F.lit(0.0)))
    pairs = own.join(inside, "u").join(F.broadcast(vectors), "k").select("u", "inside", "license", dot.alias("dot"))
    bound = F.round(F.col("dot") / F.sqrt("inside"), 9)
    best = materialize(pairs.where(bound >= min_cosine).groupBy("u", "inside").agg(
        F.min(F.struct((-bound).alias("c"), "license", "dot")).alias("b")).select("u", "inside", "b.license", "b.dot"), "license-best")
    rest = pieces.select("u", F.expr(f"filter(ts, t -> t not in ({_literals(table)}))").alias("ts"))
    other = rest.join(best.select("u"), "u", "left_semi").groupBy("u").agg(F.first("ts").alias("ts")) \
        .select("u", F.explode("ts").alias("t")).groupBy("u", "t").agg(F.count(F.lit(1)).alias("tf"))
    other = materialize(other, "license-others")
    idf = materialize(counted.join(other.select("t").distinct(), "t", "left_semi"), "license-weights")
    w = F.col("tf") * F.col("idf")
    outside = other.join(idf, "t").groupBy("u").agg(F.sum(w * w).alias("outside"))
    norm = F.sqrt(F.col("inside") + F.coalesce("outside", F.lit(0.0)))
    return best.join(outside, "u", "left").select("u", "license", F.round(F.col("dot") / norm, 9).alias("cosine")) \
        .where(F.col("cosine") >= min_cosine)


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id",
         min_cosine: float = MIN_COSINE, file_share: float = FILE_SHARE,
         templates: DataFrame | None = None) -> DataFrame:
    """One row per file: id, path, ``license`` (null: none), ``origin`` (header,
    file, inherited, none), ``cosine`` and ``line`` of an own license, ``from_dir`` of
    an inherited one."""
    spark = files.sparkSession
    templates = templates if templates is not None else spark.createDataFrame([*TEMPLATES, *more_templates()], "license string, notice string")
    d = files.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{path_col}`").alias("_path"),
                     F.col(f"`{text_col}`").alias("_text"), F.xxhash64(F.col(f"`{text_col}`")).alias("_x"))
    weights, counted = term_weights(d, "_text", templates)
    table = _template_table(spark, templates, weights)
    needed = _needed_terms(table, min_cosine)

    mark = lambda l: F.substring(F.regexp_extract(l, _MARK, 1), -1, 1)
    numbered = F.transform(_lines(d, "_text"), lambda l, i: F.struct(i.alias("line"), terms(l).alias("ts"), mark(l).alias("m")))
    rows = d.select("_id", "_path", "_x", numbered.alias("_n"))
    size = F.aggregate("_n", F.lit(0), lambda a, x: a + F.size(x["ts"]))
    flagged = F.expr(f"transform(_n, x -> struct(x.line, x.ts, x.m, exists(x.ts, t -> t in ({_literals(needed)})) as hit))")
    rows = rows.select("_id", "_path", "_x", size.alias("size"), flagged.alias("_n"))
    picked = F.when(F.exists("_n", lambda x: x["hit"]), F.col("_n"))
    rows = materialize(rows.select("_id", "_path", "_x", "size", picked.alias("lines")), "license-lines")

    key = ["_path", "_x"]
    pieces = _pieces(rows, key)
    found = pieces.select(*key, "kind", "line", "block", F.size("ts").alias("n"), "u") \
        .join(_matches(pieces, table, needed, counted, min_cosine), "u").drop("u").distinct()
    first = F.min(F.struct("kind", (-F.col("cosine")).alias("c"), "license", "line")).alias("b")
    in_kind = lambda k: F.when(F.col("kind") == k, F.col("n"))
    by_block = found.groupBy(*key, "block").agg(
        first, F.coalesce(F.max(in_kind(0)), F.max(in_kind(1)), F.sum(in_kind(2))).alias("n"))
    within = F.when(F.col("block") >= 0, F.col("n"))
    own = by_block.groupBy(*key).agg(
        F.coalesce(F.max(F.when(F.col("block") < 0, F.col("n"))), F.sum(within)).alias("in_lines"), F.min("b").alias("b"))
    own = own.select(*key, "in_lines", F.col("b.license").alias("own"), (-F.col("b.c")).alias("cosine"),
                     F.col("b.line").alias("line"))

    light = join_same(rows.select("_id", "_path", "_x", "size"), own, key, "left")
    is_file = F.coalesce(F.col("in_lines") >= file_share * F.col("size"), F.lit(False))
    above = F.when(F.instr("_path", "/") > 0, F.regexp_replace("_path", "/[^/]*$", "")).otherwise(F.lit(""))
    light = materialize(light.withColumn("is_file", is_file).withColumn("dir", F.when(F.col("_path").isNotNull(), above)), "license-own")

    given = light.where("is_file and dir is not null").groupBy("dir") \
        .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "own")).alias("b")).select("dir", F.col("b.own").alias("given"))
    parts = F.split("dir", "/")
    ancestors = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    chain = light.where("dir is not null").select("dir").distinct().select("dir", F.posexplode(ancestors).alias("depth", "up"))
    nearest = chain.join(given.withColumnRenamed("dir", "up"), "up").groupBy("dir") \
        .agg(F.max(F.struct("depth", "up", "given")).alias("b")).select("dir", F.col("b.up").alias("from_dir"), F.col("b.given").alias("given"))
    out = light.join(nearest, "dir", "left")
    inherits = F.col("own").isNull() & F.col("given").isNotNull()
    origin = F.when(F.col("is_file"), "file").when(F.col("own").isNotNull(), "header").when(inherits, "inherited").otherwise("none")
    return out.select(F.col("_id").alias(id_col), F.col("_path").alias(path_col), F.coalesce("own", "given").alias("license"),
                      origin.alias("origin"), "cosine", "line", F.when(inherits, F.col("from_dir")).alias("from_dir"))
