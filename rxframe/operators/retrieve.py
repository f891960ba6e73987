"""Bulk retrieval: many requests against the master table at once.

The reference scans the whole master once per request and keeps the first
matches.  Here every request is handled in one plan:

1. the master's distinct names (first row of each) are turned into an inverted index
   ``(key, ord, a, b, dkey)`` with token counts, stored once and passed to every call
   and micro-batch (``build_index``);
2. each *distinct* lowered term gets one equi-join key that every true match
   must contain: its rarest word run in the index, or the term itself when it
   has no word character; the empty term (which matches every row holding a
   word character) is a separate scan, run only when some request uses it;
3. candidates are verified with the exact pattern (single-run terms match
   exactly by token equality), reduced to the first ``k`` rows per term
   (exact, see ``_first_k_per_term``), and only then joined back to the
   requests and reduced again to ``k`` per request.

No step pairs every request with every row: the per-term lists are at most
``k`` long, the term side is broadcast only after a size check, and otherwise
the joins are salted so that a key held by a third of the master (or a term
used by a third of the requests) is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxframe.functions.text import (WORD, inner_separator_runs, py_str_or_nan,
                                    word_pattern, word_runs)
from rxframe.operators.common import salted_equi_join
from rxframe.session import materialize


def dedupe_key(sci_col: str, ord_col: str):
    """Rows dedupe on the raw scientific name; a missing one never equals another."""
    return F.coalesce(F.concat(F.lit("s"), F.col(sci_col)),
                      F.concat(F.lit("n"), F.col(ord_col).cast("string")))


# ---------------------------------------------------------------------------
# word-boundary retrieval
# ---------------------------------------------------------------------------

def _keys(a, b):
    """Index keys of two lowered names.

    ``w<run>`` for every word run of either name and ``s<run>`` for every inner
    non-word run.  The empty term needs no key (see ``_empty_term_rows``).
    """
    return F.array_union(
        F.transform(F.array_union(word_runs(a), word_runs(b)), lambda x: F.concat(F.lit("w"), x)),
        F.transform(F.array_union(inner_separator_runs(a), inner_separator_runs(b)),
                    lambda x: F.concat(F.lit("s"), x)))


@dataclass(frozen=True)
class RetrievalIndex:
    """Stored tables of one master version: ``names`` (a, b, dkey, ord), ``tokens``
    (names by key) and ``counts`` (key, freq)."""
    names: DataFrame
    tokens: DataFrame
    counts: DataFrame


def build_index(master: DataFrame, ord_col: str, trade_col: str, sci_col: str) -> RetrievalIndex:
    """Build the index once per master version.

    Rows that agree in both lowered names and the dedupe key match the same terms, and
    only the first of them can be kept, so they are one name with its smallest order
    (rows without a scientific name never agree): the index grows with names, not rows.
    """
    rows = master.select(py_str_or_nan(trade_col).alias("a"), py_str_or_nan(sci_col).alias("b"),
                         dedupe_key(sci_col, ord_col).alias("dkey"), F.col(ord_col).alias("ord"))
    names = materialize(rows.groupBy("a", "b", "dkey").agg(F.min("ord").alias("ord")), "names")
    tokens = materialize(names.select("*", F.explode(_keys(F.col("a"), F.col("b"))).alias("key")), "tokens")
    counts = materialize(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("freq")), "token-counts")
    return RetrievalIndex(names, tokens, counts)


def boundary_term_keys(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """Distinct lowered terms with their index key and exact pattern."""
    t = F.col("term_l")
    longest = F.aggregate(word_runs(t), F.lit(""),
                          lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))
    key = (F.when(t == "", F.lit("e"))
           .when(longest != "", F.concat(F.lit("w"), longest))
           .otherwise(F.concat(F.lit("s"), t)))
    return (terms.select(F.lower(F.col(term_col)).alias("term_l")).distinct()
            .select("term_l", key.alias("key"), word_pattern(t).alias("pattern")))


# bytes of terms and patterns that may be broadcast
BROADCAST_BYTES = 64 << 20


def _first_k_per_term(cands: DataFrame, k: int, dedupe: bool) -> DataFrame:
    """First ``k`` candidates per term in file order.

    With ``dedupe`` only the first row per ``dkey`` counts (W4).  The reduction
    is exact: a row that is not among the first ``k`` distinct keys of its term
    cannot be among the first ``k`` of any request using that term.  The first
    step is a hash aggregate with map-side combine; the second is a
    ``row_number`` filter that Spark evaluates partially before the shuffle.
    """
    if dedupe:
        cands = (cands.groupBy("term_l", "dkey").agg(F.min("ord").alias("ord")))
    else:
        cands = cands.select("term_l", "ord").distinct()
    w = Window.partitionBy("term_l").orderBy("ord")
    return cands.withColumn("trn", F.row_number().over(w)).where(F.col("trn") <= k).drop("trn")


def _first_k_per_request(req_terms: DataFrame, per_term: DataFrame, req_col: str, k: int,
                         dedupe: bool, small_per_term: bool, salt_buckets: int = 16) -> DataFrame:
    """Join every request's terms to the (at most ``k`` long) per-term lists and
    keep the first ``k`` rows per request.

    The per-term side is broadcast when the term count passed the size check;
    otherwise the join is salted on the request side, because one term (the
    empty one, say) may be used by a third of all requests.  The pairs are
    then hash-partitioned once by request: the dedupe aggregate and the
    ranking window both run on that partitioning (one shuffle, not two).
    """
    rt = req_terms.select(req_col, "term_l")
    if small_per_term:
        pairs = rt.join(F.broadcast(per_term), "term_l")
    else:
        pairs = salted_equi_join(per_term, rt, "term_l", salt_buckets, right_salt_from=req_col)
    pairs = pairs.repartition(req_col)
    if dedupe:
        pairs = pairs.groupBy(req_col, "dkey").agg(F.min("ord").alias("ord"))
    else:
        pairs = pairs.select(req_col, "ord").distinct()
    w = Window.partitionBy(req_col).orderBy("ord")
    return (pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
            .select(req_col, "rn", "ord"))


def boundary_matches_per_term(terms: DataFrame, master: DataFrame, *, term_col: str = "term",
                              ord_col: str, trade_col: str, sci_col: str, k: int = 4,
                              salt_buckets: int = 16, broadcast_rows: int = 500_000, rarest: bool = True,
                              index: RetrievalIndex | None = None) -> tuple[DataFrame, bool]:
    """For every distinct lowered term: its first ``k`` matching names
    ``(term_l, ord, dkey)``.  Also says whether the term side was small enough,
    in rows and bytes, to broadcast (then the per-term result is too).  ``index``
    is the stored index of ``master``; without it one is built for this call."""
    index = index or build_index(master, ord_col, trade_col, sci_col)
    # distinct terms, written once: one small job then gives both the size
    # check for the broadcast and whether the empty term is used at all
    tk = materialize(boundary_term_keys(terms, term_col), "term-keys")
    stats = tk.agg(F.count(F.lit(1)).alias("n"),
                   F.coalesce(F.sum(F.octet_length("term_l") + F.octet_length("pattern")), F.lit(0)).alias("bytes"),
                   F.max((F.col("key") == "e").cast("int")).alias("has_empty")).first()
    small = stats["n"] <= broadcast_rows and stats["bytes"] <= BROADCAST_BYTES
    tk = tk.where(F.col("key") != "e")
    idx = index.tokens
    if rarest:
        tk = _rarest_run_keys(tk, index.counts, small)
    if small:
        cands = idx.join(F.broadcast(tk), "key")
    else:
        cands = salted_equi_join(tk, idx, "key", salt_buckets, right_salt_from="ord")
    # a term that is one word run, or one inner separator run, matches exactly
    # the rows holding it as a token: only other terms need the pattern check
    exact = F.col("key") == F.concat(F.substring("key", 1, 1), F.col("term_l"))
    verified = cands.where(exact | F.expr("a RLIKE pattern") | F.expr("b RLIKE pattern"))
    verified = verified.select("term_l", "ord", "dkey")
    # the empty term's list needs a pass over the whole master: only when used
    if stats["has_empty"]:
        verified = verified.unionByName(_empty_term_rows(index.names))
    return _first_k_per_term(verified, k, True), small


def _rarest_run_keys(tk: DataFrame, counts: DataFrame, small: bool) -> DataFrame:
    """Re-key word terms on their rarest word run in the index (ties: longest,
    then first).  Any run of a term is a sound key (a match holds every run as
    a whole token); the rarest one bounds the candidates a hot token would
    otherwise bring.  A run absent from the index gets frequency 0, so its term
    matches nothing without touching the index.  Token counts are stored with the
    index; the term side is broadcast when it passed the size check."""
    runs = (tk.where(F.col("key").startswith("w"))
            .select("term_l", F.posexplode(word_runs(F.col("term_l"))).alias("i", "run"))
            .select("term_l", "i", F.concat(F.lit("w"), F.col("run")).alias("key"), F.length("run").alias("len")))
    runs_j = F.broadcast(runs) if small else runs
    ranked = counts.join(runs_j, "key", "right").select(
        "term_l", "key", F.struct(F.coalesce("freq", F.lit(0)).alias("f"), (-F.col("len")).alias("l"),
                                  F.col("i")).alias("rank"))
    best = ranked.groupBy("term_l").agg(F.min_by("key", "rank").alias("best"))
    return (tk.join(F.broadcast(best) if small else best, "term_l", "left")
            .select("term_l", F.coalesce("best", "key").alias("key"), "pattern"))


def _empty_term_rows(names: DataFrame) -> DataFrame:
    """Names matched by the empty term (``\\b\\b``): any word character in either
    of them.  Tagged with ``term_l = ''``; reduced with the rest."""
    return names.where(F.col("a").rlike(WORD) | F.col("b").rlike(WORD)).select(F.lit("").alias("term_l"), "ord", "dkey")


def retrieve_topk(request_terms: DataFrame, master: DataFrame, *, req_col: str = "req_id",
                  term_col: str = "term", ord_col: str, trade_col: str, sci_col: str,
                  k: int = 4, salt_buckets: int = 16, broadcast_rows: int = 500_000,
                  index: RetrievalIndex | None = None) -> DataFrame:
    """W4 over J8: per request the first ``k`` rows (file order) that match any
    term on a word boundary in either name, one row per scientific name.

    ``request_terms`` is long form ``(req_col, term_col)``.  Returns
    ``(req_col, rn, ord_col)`` with ``rn`` = 1..k.
    """
    rt = materialize(request_terms.select(req_col, F.lower(F.col(term_col)).alias("term_l")).distinct())
    per_term, small = boundary_matches_per_term(
        rt, master, term_col="term_l", ord_col=ord_col, trade_col=trade_col,
        sci_col=sci_col, k=k, salt_buckets=salt_buckets, broadcast_rows=broadcast_rows, index=index)
    out = _first_k_per_request(rt, per_term, req_col, k, True, small, salt_buckets)
    return out.withColumnRenamed("ord", ord_col)


# ---------------------------------------------------------------------------
# substring retrieval, older variant
# ---------------------------------------------------------------------------

def _grams(c, n: int):
    """All runs of ``n`` characters, overlapping, in one pass over the text."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


@dataclass(frozen=True)
class SubstringIndex:
    """Stored tables of one master version: ``names`` (nid, a, b and ``ords``, the first ``k`` orders
    of the name's rows), ``postings`` (key, nid) and ``counts`` (key, freq) for keys of 1 to ``gram``
    characters."""
    names: DataFrame
    postings: DataFrame
    counts: DataFrame
    gram: int
    k: int


def build_substring_index(master: DataFrame, ord_col: str, trade_col: str, sci_col: str, *,
                          k: int = 5, gram: int = 3) -> SubstringIndex:
    """Build the index once per master version, for lists of up to ``k`` rows.

    Rows with the same two lowered names contain the same terms, and only their first ``k`` orders can
    be kept: the index grows with distinct names.  The rank is limited before the shuffle too, so a
    name on a third of all rows sends ``k`` orders per task.  A null name reads "nan".
    """
    rows = master.select(py_str_or_nan(trade_col).alias("a"), py_str_or_nan(sci_col).alias("b"), F.col(ord_col).alias("ord"))
    rank = F.dense_rank().over(Window.partitionBy("a", "b").orderBy("ord"))
    names = rows.withColumn("r", rank).where(F.col("r") <= k).groupBy("a", "b").agg(F.sort_array(F.collect_set("ord")).alias("ords"))
    names = materialize(names.withColumn("nid", F.monotonically_increasing_id()), "substring-names")
    grams = F.array_distinct(F.flatten(F.array(*[_grams(F.col(c), n) for c in "ab" for n in range(1, gram + 1)])))
    postings = materialize(names.select(F.explode(grams).alias("key"), "nid"), "substring-grams")
    counts = materialize(postings.groupBy("key").agg(F.count(F.lit(1)).alias("freq")), "substring-counts")
    return SubstringIndex(names, postings, counts, gram, k)


def substring_keys(terms: DataFrame, index: SubstringIndex, crowded: int = 64, small: bool = False) -> DataFrame:
    """Distinct terms ``term_l`` -> (term_l, key, need): the lists a name must be in, and how many.

    A term of up to ``gram`` characters is a key itself.  A longer one takes the rarest of its grams;
    where even that list is longer than ``crowded``, the two rarest, and a name must be in both.
    A term with a gram that no name has gets no row: nothing contains it.
    """
    t = F.col("term_l")
    grams = F.when(F.length(t) <= index.gram, F.array(t)).otherwise(F.array_distinct(_grams(t, index.gram)))
    runs = terms.where(t != "").select("term_l", F.explode(grams).alias("key"))
    ranked = index.counts.join(F.broadcast(runs) if small else runs, "key", "right")
    two = F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "key"))), 1, 2)
    best = ranked.groupBy("term_l").agg(two.alias("best")).where(F.col("best")[0]["freq"] > 0)
    used = F.when(F.col("best")[0]["freq"] <= crowded, F.slice("best", 1, 1)).otherwise(F.col("best"))
    return best.select("term_l", used.alias("used")).select("term_l", F.explode("used").alias("u"), F.size("used").alias("need")) \
        .select("term_l", "u.key", "need")


def substring_candidates(keys: DataFrame, index: SubstringIndex, salt_buckets: int = 16, small: bool = False) -> DataFrame:
    """(term_l, nid) of the names that are in all lists of a term; a list may hold a third of all
    names, so without a broadcast it is dealt over ``salt_buckets`` tasks."""
    if small:
        hits = index.postings.join(F.broadcast(keys), "key")
    else:
        hits = salted_equi_join(keys, index.postings, "key", salt_buckets, right_salt_from="nid")
    return hits.groupBy("term_l", "nid").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")) \
        .where("n = need").select("term_l", "nid")


# bytes that a gram of a term may take when broadcast
GRAM_BYTES = 64


def retrieve_substring(request_terms: DataFrame, master: DataFrame | None, *, req_col: str = "req_id",
                       term_col: str = "term", ord_col: str, trade_col: str = "", sci_col: str = "",
                       k: int = 5, gram: int = 3, salt_buckets: int = 16, crowded: int = 64,
                       broadcast_bytes: int = BROADCAST_BYTES, index: SubstringIndex | None = None) -> DataFrame:
    """W5 over J9: first ``k`` rows per request whose lowered trade or scientific
    name contains a term *as written* (the term is not lowered), no dedupe.

    Terms meet the stored gram index (``substring_keys``); candidates are verified with
    ``contains`` on distinct names.  The empty term is contained in every row: its list is the
    first ``k`` rows, without a join.  A null term matches nothing.  ``index`` is the stored index
    of ``master`` for at least ``k`` rows; without it one is built for this call.
    """
    index = index or build_substring_index(master, ord_col, trade_col, sci_col, k=k, gram=gram)
    if k > index.k:
        raise ValueError(f"the index keeps {index.k} rows of a name, {k} are asked for")
    rt = materialize(request_terms.select(req_col, F.col(term_col).alias("term_l")).distinct(), "substring-terms")
    terms = rt.select("term_l").distinct()
    # the grams of all terms bound what the joins below broadcast
    size = terms.agg(F.coalesce(F.sum(F.length("term_l").cast("long") + F.octet_length("term_l") + k), F.lit(0))).first()[0]
    small = size * GRAM_BYTES <= broadcast_bytes
    keys = substring_keys(terms, index, crowded, small)
    cands = substring_candidates(keys, index, salt_buckets, small)
    verified = index.names.join(cands, "nid").where(F.col("a").contains(F.col("term_l")) | F.col("b").contains(F.col("term_l")))
    per_term = _first_k_per_term(verified.select("term_l", F.explode("ords").alias("ord")), k, dedupe=False)
    empty = index.names.select(F.lit("").alias("term_l"), F.explode("ords").alias("ord")).distinct().orderBy("ord").limit(k)
    per_term = per_term.unionByName(empty)
    out = _first_k_per_request(rt, per_term, req_col, k, False, small, salt_buckets)
    return out.withColumnRenamed("ord", ord_col)
