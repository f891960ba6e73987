"""Quality rules: counted base rules and a hashed n-gram likelihood ratio.

Every document is scored by the mean log ratio of two multinomials over hashed
n-grams (words, word pairs, three-character word endings): one counted over the trusted documents, one over the whole
raw corpus.  The mean per n-gram makes long and short documents comparable, and
one fixed threshold decides every document.

Spark shape: the two count tables are one exploded pass with map-side combine
(at most ``buckets`` rows per task are shuffled, whatever the corpus size).  Which texts are trusted is decided on
row numbers: the texts are written once in blocks of rows, and a block gets the numbers of its
trusted rows, so that texts never meet the ids by a shuffle or a broadcast, however many ids there
are.  Their log ratios are one array of ``buckets`` doubles, a bounded scalar.  All per-document
work is in-row expressions, so a decision needs no shuffle of texts and no join.

Defined results: a null or blank text has no words, counts 0 everywhere and fails
the base rule.  No trusted document at all: the ratio is 0 for every n-gram and
only the base rules decide.  Trusted ids are a set: repeated labels count once, a
null id matches nothing.  Extra columns are passed through untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxframe.llm.blocks import marked_rows, store_rows
from rxframe.llm.text import let, words

BUCKETS = 10_000
MIN_MEAN_RATIO = -0.2
WINDOW = 5
_TEMP = ("_ws", "_w1", "_w2", "_w3", "_w5")
SYMBOLS = "[#*$%&|<>]"


def _grams(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the words (``_ws``) and the hashes of words (``_w1``), of word
    pairs (``_w2``) and of the last three characters of each word (``_w3``)."""
    d = docs.withColumn("_ws", words(F.col(f"`{text_col}`")))
    d = d.withColumn("_w1", F.transform("_ws", lambda w: F.xxhash64(w)))
    d = d.withColumn("_w3", F.transform("_ws", lambda w: F.xxhash64(F.substring(w, -3, 3), F.lit(3))))
    return d.withColumn("_w2", F.transform(
        F.slice("_w1", F.lit(1), F.greatest(F.size("_w1") - 1, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(F.col("_w1"), i + 1))))


def _repeat_words(windows: str) -> Column:
    """Words inside windows that occur twice or more in the text.

    ``windows`` holds the window hashes by position.  Without repeats there is
    nothing to do; else (hash, position) pairs are sorted, equal neighbours are
    repeats, and their positions in order give the covered words.
    """
    w = F.col(windows)

    def covered(pairs: Column) -> Column:
        repeated = F.filter(pairs, lambda x, k: (
            ((k > 0) & (F.get(pairs, k - 1)["h"] == x["h"]))
            | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False))))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        return F.aggregate(
            F.sort_array(F.transform(repeated, lambda x: x["i"])), zero,
            lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"),
                                  (p + WINDOW).alias("end")),
            lambda a: a["n"])

    pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(pairs, covered))


def _with_counts(d: DataFrame, text_col: str, out: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_w5", F.transform(
        F.slice("_w2", F.lit(1), F.greatest(F.size("_w1") - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(F.col("_w2"), i + 2), F.get(F.col("_w1"), i + 4))))
    d = d.withColumn(out, F.struct(
        F.size("_ws").cast("long").alias("n_words"),
        F.length(F.array_join("_ws", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words("_w5").alias("n_repeat_words")))
    q = F.col(out)
    failed = (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])
    return d.withColumn(out, q.withField("base_failed", failed))


def base_counts(docs: DataFrame, text_col: str = "text", out: str = "_quality") -> DataFrame:
    """``docs`` with a struct column ``out``: the base counts and ``base_failed``."""
    return _with_counts(_grams(docs, text_col), text_col, out).drop(*_TEMP)


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               trusted_id: str = "doc_id", buckets: int = BUCKETS) -> list[float]:
    """``log p_target - log p_raw`` per bucket, add-one smoothed: ``buckets`` numbers.

    The raw counts cover every document, the target counts every trusted one.
    """
    ids = trusted.select(F.col(f"`{trusted_id}`").alias("_id")).where("_id is not null").distinct()
    stored = store_rows(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_x")), "_x")
    numbers = stored.select("_at", F.col("_row._id").alias("_id")).join(ids, "_id").select("_at")
    d = marked_rows(stored, numbers, "_t").select(F.col("_t").cast("long").alias("_t"), F.col("_row._x").alias("_x"))
    d = _grams(d, "_x").select("_t", F.explode_outer(F.concat("_w1", "_w2", "_w3")).alias("h"))
    counts = d.where("h is not null").groupBy(F.pmod("h", F.lit(buckets)).alias("k")) \
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("_t").alias("target"))
    rows = {r["k"]: (r["raw"], r["target"]) for r in counts.collect()}
    raw, target = sum(r for r, _ in rows.values()), sum(t for _, t in rows.values())
    if not target:
        return [0.0] * buckets
    table = [rows.get(k, (0, 0)) for k in range(buckets)]
    return [math.log((t + 1) / (target + buckets)) - math.log((r + 1) / (raw + buckets)) for r, t in table]


def _mean_ratio(ratios: list[float]) -> Column:
    """Mean log ratio over the row's hashed n-grams; 0 without any."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    grams = F.concat("_w1", "_w2", "_w3")
    total = F.aggregate(grams, F.lit(0.0), lambda a, h: a + F.get(table, F.pmod(h, F.lit(len(ratios))).cast("int")))
    return F.when(F.size("_w1") > 0, total / (F.size("_w1") + F.size("_w2") + F.size("_w3"))).otherwise(F.lit(0.0))


def assess(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           trusted_id: str = "doc_id", buckets: int = BUCKETS, min_ratio: float = MIN_MEAN_RATIO,
           out: str = "_quality") -> DataFrame:
    """``docs`` with the struct ``out``: base counts, ``base_failed``, ``ratio`` and ``kept``.

    ``kept`` is false for a failed base rule, else ``ratio >= min_ratio``.  An input
    column named like ``out`` is replaced.
    """
    ratios = log_ratios(docs, trusted, id_col, text_col, trusted_id, buckets)
    d = _with_counts(_grams(docs, text_col), text_col, out)
    d = d.withColumn(out, F.col(out).withField("ratio", _mean_ratio(ratios)))
    q = F.col(out)
    d = d.withColumn(out, q.withField("kept", ~q["base_failed"] & (q["ratio"] >= min_ratio)))
    return d.drop(*_TEMP)


def keep_good(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` that the rules keep; columns are handled by number, so no name of theirs can clash.

    The row number keeps the filter above the counts: pushed below them, it would
    repeat the whole expression inside its own lambdas.
    """
    names = [f"_in{i}" for i in range(len(docs.columns))]
    mine, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    d = assess(docs.toDF(*names), trusted, mine, text, **options).withColumn("_at", F.monotonically_increasing_id())
    d = d.where(F.col(options.get("out", "_quality"))["kept"] & (F.col("_at") >= 0))
    return d.select(*names).toDF(*docs.columns)


def trusted_labels(labels: DataFrame) -> DataFrame:
    """Ids that every label calls good and none calls toxic."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")) \
        .where("q = 1 and coalesce(t, 0) = 0").select("doc_id")
