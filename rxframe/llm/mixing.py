"""Mixing sources to target weights: hash-random order, prefix sums, exact cuts.

Every row gets a random key (a hash of its id), rows of a source are ordered by
it, and a source's budget is taken from the front: whole epochs first, then the
rows before the cut, then part of the row at the cut.

Spark shape: keys are cut into ``4096`` equal ranges.  Sizes are summed per
(source, range) with map-side combine, the prefix sums over these few rows find
the one range of each source that holds the cut, and only that range is sorted.
A hot source is thus spread over all tasks and nothing but one 4096th of it is
ever ordered.  The outcome per source is one row (whole epochs, cut key, words at
the cut), so applying it to any number of rows is a comparison in the row.

Defined results: a null source is a source of its own, last in order.  Null or
blank texts have size 0 and take 0.  Rows that agree in id, source and size are
one tie: at the cut they share its words evenly, rounded down.  A null id is
hashed as the empty string.  No rows, or no words at all: targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxframe.llm.text import word_count
from rxframe.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2
BROADCAST_BYTES = 64 << 20
_SRC = ["_s", "_n"]


def _rows(docs: DataFrame, id_col: str, source_col: str, size: Column, seed: str, *more: Column) -> DataFrame:
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    source = F.col(f"`{source_col}`")
    d = docs.select(*more, F.coalesce(source, F.lit("")).alias("_s"), source.isNull().alias("_n"),
                    ident.alias("_id"), size.cast("long").alias("_size"))
    return d.withColumn("_key", F.concat_ws(
        ":", F.md5(F.concat(F.lit(seed), F.col("_id"))), "_id", F.col("_size").cast("string")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(``_s``, ``_n``, ``total``) per source -> with ``target``.

    Sources by code point, null last, take the weights in turn.  ``share`` times
    all sizes is dealt by weight; a target stops at ``max_epochs`` times its
    source, and what is over goes to the others by weight.  In the order of
    limit / weight the limited sources come first, so the level of the others
    follows from running sums: one pass over one row per source.
    """
    by_name = Window.orderBy("_n", "_s")
    d = sizes.withColumn("_w", F.element_at(
        F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    d = d.withColumn("_cap", (F.col("total") * max_epochs).cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_n", "_s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    zero = F.lit(0.0)
    level = (share * F.sum("total").over(everything) - F.coalesce(F.sum("_cap").over(before), zero)) \
        / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), zero))
    d = d.withColumn("_level", level).withColumn("_at", F.row_number().over(order))
    free = F.when(F.col("_cap") / F.col("_w") > F.col("_level"), F.struct("_at", "_level"))
    d = d.withColumn("_free", F.min(free).over(everything))
    target = F.when(F.col("_free").isNull() | (F.col("_at") < F.col("_free._at")), F.col("_cap")) \
        .otherwise(F.col("_w") * F.col("_free._level"))
    return d.select("_s", "_n", "total", target.alias("target"))


def _cuts(rows: DataFrame, weights, share, max_epochs) -> DataFrame:
    """One row per source: size, target, whole epochs and where the last epoch ends."""
    ranged = rows.withColumn("_b", F.substring("_key", 1, 3))
    sums = materialize(ranged.groupBy("_s", "_n", "_b").agg(F.sum("_size").alias("size")), "mix-ranges")
    src = source_targets(sums.groupBy(*_SRC).agg(F.sum("size").alias("total")), weights, share, max_epochs)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("total") > 0, F.floor(budget / F.col("total"))).otherwise(F.lit(0)).cast("long")
    src = src.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("total"))
    src = materialize(src, "mix-sources")
    running = F.sum("size").over(Window.partitionBy(*_SRC).orderBy("_b")) - F.col("size")
    at = sums.withColumn("_off", running).join(src.select(*_SRC, "rest"), _SRC) \
        .where("_off <= rest and rest < _off + size").select(*_SRC, "_b", "_off", "rest")
    ties = ranged.join(at, [*_SRC, "_b"]).groupBy(*_SRC, "_key", "_size", "_off", "rest") \
        .agg(F.count(F.lit(1)).alias("_m"))
    span = F.col("_size") * F.col("_m")
    before = F.col("_off") + F.sum(span).over(Window.partitionBy(*_SRC).orderBy("_key")) - span
    cut = ties.withColumn("_before", before).where(f"_before <= rest and rest < _before + _size * _m") \
        .select(*_SRC, F.col("_key").alias("cut_key"), F.floor((F.col("rest") - F.col("_before")) / F.col("_m"))
                .cast("long").alias("cut_words"))
    return src.join(cut, _SRC, "left")


def _with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Each row with its source's cut.  The cuts are one short row per source, written once; up to
    ``BROADCAST_BYTES`` (measured) they go to the rows, so that a hot source stays spread and no
    text moves; beyond, rows meet them by a shuffle on the source."""
    cuts = materialize(cuts, "mix-cuts")
    size = cuts.agg(F.coalesce(F.sum(F.octet_length("_s") + 200), F.lit(0)).alias("n")).first()["n"]
    return rows.join(F.broadcast(cuts) if size <= BROADCAST_BYTES else cuts, _SRC)


def _last_epoch() -> Column:
    return F.when(F.col("_key") < F.col("cut_key"), F.col("_size")) \
        .when(F.col("_key") == F.col("cut_key"), F.col("cut_words")).otherwise(F.lit(0)).cast("long")


def mix_table(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
              weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = "") -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``taken``
    (words the mix takes, repeats counted)."""
    rows = materialize(_rows(docs, id_col, source_col, word_count(F.col(f"`{text_col}`")), seed,
                             F.col(f"`{id_col}`").alias("_doc")), "mix-rows")
    d = _with_cuts(rows, _cuts(rows, weights, share, max_epochs))
    return d.select(F.col("_doc").alias(id_col), F.col("_size").alias("size"), F.col("total").alias("source_size"),
                    "target", (F.col("epochs") * F.col("_size") + _last_epoch()).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                  chars_col: str | None = "n_chars", weights=WEIGHTS, share: float = SHARE,
                  max_epochs: int = MAX_EPOCHS, seed: str = "") -> DataFrame:
    """The mixed documents, with the columns of ``docs``: one row per epoch that
    takes a document; at a source's cut the text ends after the taken words
    (``chars_col``, where given, is then the length of what is left)."""
    columns = docs.columns
    size = word_count(F.col(f"`{text_col}`"))
    light = materialize(_rows(docs, id_col, source_col, size, seed), "mix-rows")
    cuts = _cuts(light, weights, share, max_epochs)
    whole = [F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")]
    d = _with_cuts(_rows(docs, id_col, source_col, size, seed, *whole), cuts).withColumn("_last", _last_epoch())
    # pieces of a word with the space before it; the first words joined give the text up to the cut
    pieces = F.split(F.col(f"_row.`{text_col}`"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    partial = (F.col("_last") > 0) & (F.col("_last") < F.col("_size"))
    text = F.when(partial, F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.col("_last").cast("int"), F.lit(1))), ""))
    cut = F.col("_row").withField(f"`{text_col}`", text)
    if chars_col and chars_col in columns:
        cut = cut.withField(f"`{chars_col}`", F.length(text).cast(docs.schema[chars_col].dataType))
    once = F.when(partial, cut).otherwise(F.col("_row"))
    times = F.array_repeat(F.col("_row"), F.col("epochs").cast("int"))
    last = F.when(F.col("_last") > 0, F.array(once)).otherwise(F.array().cast(d.select(F.array("_row")).schema[0].dataType))
    # a source that is taken whole or not at all has no cut; blank documents are never taken
    d = d.where("_size > 0").select(F.explode(F.concat(times, last)).alias("_row"))
    return d.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


MIX_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as s, source is null as n, coalesce(cast(doc_id as varchar), '') as id,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from documents),
k as (select *, md5(id) || ':' || id || ':' || cast(size as varchar) as key from d),
src as (select s, n, cast(sum(size) as bigint) as total from k group by s, n),
w as (select *, case (row_number() over (order by n, s) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double
                else 1.0::double end as w, (total * 2)::double as cap from src),
l as (select *, row_number() over (order by cap / w, n, s) as pos,
        (1.5::double * sum(total) over () - coalesce(sum(cap) over (order by cap / w, n, s
             rows between unbounded preceding and 1 preceding), 0)) /
        (sum(w) over () - coalesce(sum(w) over (order by cap / w, n, s
             rows between unbounded preceding and 1 preceding), 0)) as level from w),
f as (select min(pos) as pos, min_by(level, pos) as level from l where cap / w > level),
t as (select s, n, total, case when f.pos is null or l.pos < f.pos then cap else w * f.level end as target from l, f),
b as (select *, cast(floor(target) as bigint) as budget,
        case when total > 0 then cast(floor(target) as bigint) // total else 0 end as epochs from t),
g as (select s, n, key, size, count(*) as m from k group by s, n, key, size),
p as (select *, sum(size * m) over (partition by s, n order by key) - size * m as before from g)
select k.doc_id, k.size, b.total as source_size, b.target,
  cast(b.epochs * k.size + greatest(0, least(k.size, floor((b.budget - b.epochs * b.total - p.before) / p.m))) as bigint) as taken
from k join p using (s, n, key, size) join b using (s, n)
"""
