"""Registry search, paging and display defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxframe.session import materialize

# Display default per language.
NO_VALUE = {"en": "No value", "ar": "لا يوجد"}
# The entry form's options (id, label) in display order.
SYMPTOM_OPTIONS = [
    ("fever", "حرارة مرتفعة / حمى"), ("headache", "صداع / آلام الرأس"), ("cough", "سعال (كحة)"),
    ("stomach", "آلام البطن / مغص"), ("allergy", "حساسية"), ("flu", "زكام / إنفلونزا"),
    ("muscle", "آلام العضلات / المفاصل"), ("eye", "آلام أو التهاب العين"), ("ear", "آلام الأذن"),
    ("skin", "طفح جلدي / حكة"), ("diarrhea", "إسهال"), ("throat", "آلام الحلق"),
]
HISTORY_OPTIONS = [
    ("asthma", "ربو"), ("diabetes", "سكري"), ("hypertension", "ضغط دم مرتفع"),
    ("heart", "أمراض قلب"), ("kidney", "مشاكل في الكلى"), ("liver", "مشاكل في الكبد"),
]


def search_filter(df: DataFrame, params: dict[str, str], agents_col: str | None = None,
                  agent: str = "") -> DataFrame:
    """case-insensitive ``contains`` per non-empty parameter, ANDed;
    ``agent`` matches any ``nameEn`` inside the nested agents list.  All
    parameters empty: no filter."""
    cond = F.lit(True)
    for col, value in params.items():
        if value:
            cond = cond & F.coalesce(F.lower(F.col(col)).contains(value.lower()), F.lit(False))
    if agent and agents_col:
        cond = cond & F.coalesce(F.exists(agents_col, lambda x: F.lower(x["nameEn"]).contains(agent.lower())),
                                 F.lit(False))
    return df.where(cond)


def global_row_number(df: DataFrame, order_col: str, partitions: int | None = None) -> DataFrame:
    """``rn`` = 1..n in ``order_col`` order without a single-task window.

    Rows are range-partitioned and sorted within partitions; each row's index
    in its partition comes from ``monotonically_increasing_id``; the per-partition
    counts (one row per partition: a proven bound) give the offsets.  The
    numbered rows are checkpointed to the shared checkpoint folder so the counts
    and the rows come from one materialisation.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = (df.repartitionByRange(n, order_col).sortWithinPartitions(order_col)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    r = materialize(r, "row-number")
    counts = r.groupBy("_pid").agg((F.max("_local") + 1).alias("_n"))
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (r.join(F.broadcast(offsets), "_pid")
            .withColumn("rn", F.col("_off") + F.col("_local") + 1)
            .drop("_pid", "_local", "_off"))


def page_rows(df: DataFrame, order_col: str, page_size: int) -> DataFrame:
    """Row number, page, page count, first and last row on the page.  The rows
    are computed once; count, range sampling and numbering read the stored table."""
    df = materialize(df, "paged-rows")
    total = df.select(F.count(F.lit(1))).scalar()
    numbered = global_row_number(df, order_col)
    page = F.ceil(F.col("rn") / F.lit(page_size))
    return numbered.select(
        "*", page.alias("page"), F.ceil(total / F.lit(page_size)).alias("page_count"),
        ((page - 1) * page_size + 1).alias("first_row_on_page"),
        F.least(page * page_size, total).alias("last_row_on_page"))


def display_defaults(df: DataFrame, cols: Sequence[str], lang: str = "en",
                     empty_too: Sequence[str] = ()) -> DataFrame:
    """Every listed field with the language's default when missing (and,
    for ``empty_too`` fields, when empty)."""
    d = F.lit(NO_VALUE[lang])
    out = []
    for c in df.columns:
        if c in cols:
            miss = F.col(c).isNull() | ((F.col(c) == "") if c in empty_too else F.lit(False))
            out.append(F.when(miss, d).otherwise(F.col(c).cast("string")).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def agent_slots(agents_col: str, n: int = 3, lang: str = "en", field: str = "nameEn") -> list[Column]:
    """The first ``n`` agent names in fixed slots, default when absent or null."""
    d = F.lit(NO_VALUE[lang])
    return [F.coalesce(F.get(F.col(agents_col), i)[field], d).alias(f"agent_{i + 1}") for i in range(n)]


def option_labels(ids_col, options: Sequence[tuple[str, str]]) -> Column:
    """Selected option ids to their labels in selection order (unknown ids
    dropped); the option table is a fixed literal map, so no join is needed."""
    m = F.create_map(*[F.lit(x) for pair in options for x in pair])
    ids = F.col(ids_col) if isinstance(ids_col, str) else ids_col
    return F.filter(F.transform(ids, lambda x: F.element_at(m, x)), lambda x: x.isNotNull())
