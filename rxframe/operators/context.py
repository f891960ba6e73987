"""Context and prompt tables.

All text is assembled with ``concat``/``concat_ws``/``format``-free column
expressions; per-request lists are at most ``k`` retrieved rows plus one note
per linked name, so the ordered ``collect_list`` per request stays small.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxframe.functions.text import py_number
from rxframe.session import materialize

# ---------------------------------------------------------------------------
# Texts of the consult answer that must match character for character.
CONTEXT_HEADER = "Relevant SFDA Drug Data & Clinical Instructions (Master Dataset):\n"
LEAFLET_PREFIX = "  Official Instructions: "
DOSAGE_PREFIX = "  International Dosage Protocols (Drugs.com): "
BRIDGE_HEADER = "\n[System Note: International Brand Mapping (NER/NEL)]\n"
BRIDGE_LINE = ("- User mentioned '{brand}' (International). Mapped via NER to active ingredient "
               "'{ingredient}' to find local equivalent.\n")
NO_MATCH = "No specific match found in SFDA master database for translated keywords."
CONTEXT_CHARS = 800
USER_MESSAGE = "الأعراض: {symptoms}. التاريخ الطبي: {history}. الأدوية الحالية: {medications}. ما هي نصيحتك؟"
SYSTEM_PROMPT = """أنت صيدلي سعودي خبير.
البيانات التالية (Context) تحتوي على الأدوية المتوفرة لعلاج المريض.
استخدم *فقط* هذه البيانات للإجابة.

بيانات الهيئة (Context):
{context}

---
التعليمات الصارمة (STRICT RULES):
1. **اللغة (LANGUAGE)**: 
   - اكتب باللغة العربية الفصحى فقط. 
   - يمنع منعاً باتاً استخدام أحرف صينية (مثل "毫克", "服用") أو إنجليزية.
   - إذا أردت كتابة "ملجم" أو "مليجرام"، اكتبها بالعربي (ملجم) ولا تستخدم (mg) أو (毫克).
2. **الجرعة**: يجب أن تكون محددة بالأرقام (مثال: "5 مل" أو "قرص واحد"). لا تكتب "على فترات" بدون تحديد. إذا لم تذكر النشرة الجرعة، اكتب: "يرجى استشارة الطبيب لتحديد الجرعة".
3. **عدم التأليف**: لا تخترع أدوية غير موجودة في القائمة أعلاه.

مثال للتنسيق (لا تنسخ البيانات، انسخ الشكل فقط):
📌 1. الأدوية المقترحة:
- [اسم الدواء من القائمة]

💡 2. لماذا اخترنا هذا الدواء؟:
- [اسم الدواء]: [السبب الطبي]

✅ 3. الجرعة وطريقة الاستخدام (لـ {age_weight}):
- [اسم الدواء]: [الكمية (مل/قرص)] كل [عدد] ساعات (حسب النشرة).

💰 4. الأسعار:
- [اسم الدواء]: [السعر] ريال

⚠️ تحذيرات هامة: [تحذيرات من النشرة]"""
# Request formatting of the entry form.
AGE_WEIGHT = "{age} سنة, {weight} كجم"
NONE_AR = "لا يوجد"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class MasterColumns:
    """Names of the master columns the context line reads."""
    trade: str
    sci: str
    form: str
    strength: str
    price: str
    route: str
    route_ar: str | None = None
    leaflet: str | None = None
    intl_dosage: str | None = None


def fill_template(template: str, **cols) -> F.Column:
    """``template`` with ``{name}`` placeholders replaced by columns, as one ``concat``."""
    parts = []
    for piece in re.split(r"(\{[a-z_]+\})", template):
        if piece.startswith("{") and piece.endswith("}") and piece[1:-1] in cols:
            parts.append(cols[piece[1:-1]])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def _py(c, kind: str = "string"):
    """Python's f-string of a pandas cell: missing prints ``nan``, a float its shortest digits."""
    shown = py_number(c) if kind in ("double", "float") else F.col(c).cast("string")
    return F.coalesce(shown, F.lit("nan"))


def context_line(m: MasterColumns, kinds: dict[str, str] | None = None) -> F.Column:
    """One retrieved row as context text; ``kinds`` are the columns' types (floats are
    printed as Python prints them)."""
    kind = (kinds or {}).get
    route = F.coalesce(F.col(m.route_ar), F.col(m.route)) if m.route_ar else F.col(m.route)
    head = F.concat(F.lit("- "), _py(m.trade), F.lit(" ("), _py(m.sci), F.lit("): "), _py(m.form),
                    F.lit(", Strength: "), _py(m.strength, kind(m.strength)), F.lit(", Price: "), _py(m.price, kind(m.price)),
                    F.lit(" SAR, Administration: "), F.coalesce(route.cast("string"), F.lit("nan")),
                    F.lit("\n"))
    leaflet = (F.when(F.col(m.leaflet).isNotNull(),
                      F.concat(F.lit(LEAFLET_PREFIX), F.substring(F.col(m.leaflet).cast("string"), 1, CONTEXT_CHARS),
                               F.lit("...\n")))
               if m.leaflet else None)
    dosage = (F.when(F.col(m.intl_dosage).isNotNull() & (F.col(m.intl_dosage) != ""),
                     F.concat(F.lit(DOSAGE_PREFIX), F.substring(F.col(m.intl_dosage), 1, CONTEXT_CHARS),
                              F.lit("...\n")))
              if m.intl_dosage else None)
    return F.concat_ws("", head, *[x for x in (leaflet, dosage) if x is not None])


def line_table(master: DataFrame, m: MasterColumns, ord_col: str) -> DataFrame:
    """``(ord, line)``: the context line of every master row, built once per version."""
    return master.select(ord_col, context_line(m, dict(master.dtypes)).alias("line"))


def context_lines(ranked: DataFrame, lines: DataFrame, *, req_col: str = "req_id", ord_col: str) -> DataFrame:
    """``(req, rn, line)`` for retrieved rows ``(req, rn, ord)`` from a ``line_table``.

    The same few master rows can be retrieved for many requests (the first
    rows of a frequent term), so the join on ``ord`` may be skewed on the
    retrieved side: AQE's skew-join split handles such partitions, and AQE
    broadcasts the master side when its measured size is small.
    """
    return ranked.join(lines, ord_col).select(req_col, "rn", "line")


def consult_context(requests: DataFrame, lines: DataFrame, links: DataFrame, *,
                    req_col: str = "req_id") -> DataFrame:
    """One context text per request: header and lines in rank order, then a
    bridge note per linked name in link order, else the no-match sentence."""
    body = lines.groupBy(req_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]),
                     "").alias("_lines"))
    note = fill_template(BRIDGE_LINE, brand=F.col("brand"), ingredient=F.col("ingredient"))
    notes = links.groupBy(req_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("link_rank").alias("r"),
                                                                       note.alias("n")))),
                                 lambda x: x["n"]), "").alias("_notes"))
    ctx = F.concat(F.coalesce(F.concat(F.lit(CONTEXT_HEADER), F.col("_lines")), F.lit("")),
                   F.coalesce(F.concat(F.lit(BRIDGE_HEADER), F.col("_notes")), F.lit("")))
    return (requests.select(req_col).join(body, req_col, "left").join(notes, req_col, "left")
            .select(req_col, F.when(ctx == "", F.lit(NO_MATCH)).otherwise(ctx).alias("context")))


# distinct retrieved rows, and bytes of their lines, that may be broadcast
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def used_lines(ranked: DataFrame, lines: DataFrame, *, ord_col: str) -> tuple[DataFrame, bool]:
    """``(ord, line)`` of the rows that ``ranked`` names, stored, and whether they are few enough in bytes to
    be broadcast.  The lines of several rows with one order are one text, in text order.

    However many requests there are, the rows they retrieve are at most ``k`` per distinct term.  Their
    range of orders lets a stored ``lines`` table skip the row groups beyond.
    """
    ords = materialize(ranked.select(ord_col).where(F.col(ord_col).isNotNull()).distinct(), "ords")
    n, low, high = ords.agg(F.count(F.lit(1)), F.min(ord_col), F.max(ord_col)).first()
    found = lines.where(F.col(ord_col).between(low, high)) \
        .join(F.broadcast(ords) if n <= BROADCAST_ROWS else ords, ord_col, "left_semi")
    used = materialize(found.groupBy(ord_col).agg(F.array_join(F.sort_array(F.collect_list("line")), "").alias("line")), "lines-used")
    size = used.agg(F.coalesce(F.sum(F.octet_length("line") + 32), F.lit(0))).first()[0]
    return used, n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def context_keys(requests: DataFrame, ranked: DataFrame, links: DataFrame, *, req_col: str = "req_id", ord_col: str) -> DataFrame:
    """``(req, _ords, _links)`` for every request: what its context is made of, without any text of it."""
    ords = ranked.groupBy(req_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(ord_col).alias("o")))), lambda x: x["o"]).alias("_ords"))
    linked = links.groupBy(req_col).agg(F.collect_list(F.struct(F.col("link_rank").alias("r"), "brand", "ingredient")).alias("_links"))
    return requests.select(req_col).join(ords, req_col, "left").join(linked, req_col, "left")


def with_context(rows: DataFrame, used: DataFrame, *, ord_col: str, k: int) -> DataFrame:
    """T16 on rows with the columns of ``context_keys``: adds ``context``.  The few distinct lines go to
    the requests (one broadcast join per rank), so that no context text is shuffled or sorted."""
    for i in range(k):
        side = used.select(F.col(ord_col).alias(f"_o{i}"), F.col("line").alias(f"_l{i}"))
        rows = rows.join(F.broadcast(side), F.get(F.col("_ords"), F.lit(i)) == F.col(f"_o{i}"), "left").drop(f"_o{i}")
    body = F.concat_ws("", *[f"_l{i}" for i in range(k)])
    notes = F.array_join(F.transform(F.array_sort(F.transform("_links", lambda x: F.struct(
        x["r"].alias("r"), fill_template(BRIDGE_LINE, brand=x["brand"], ingredient=x["ingredient"]).alias("n")))),
        lambda x: x["n"]), "")
    ctx = F.concat(F.when(body != "", F.concat(F.lit(CONTEXT_HEADER), body)).otherwise(""),
                   F.coalesce(F.concat(F.lit(BRIDGE_HEADER), notes), F.lit("")))
    return rows.withColumn("context", F.when(ctx == "", F.lit(NO_MATCH)).otherwise(ctx)) \
        .drop("_ords", "_links", *[f"_l{i}" for i in range(k)])


def prompt_columns(req_col: str = "req_id", system_template: str = SYSTEM_PROMPT, user_template: str = USER_MESSAGE) -> list:
    """T17 of a request with its ``context``."""
    return [F.col(req_col),
            fill_template(system_template, context=F.col("context"), age_weight=F.col("age_weight")).alias("system_prompt"),
            fill_template(user_template, symptoms=F.col("symptoms"), history=F.col("history"),
                          medications=F.col("medications")).alias("user_message")]


def prompt_table(requests: DataFrame, contexts: DataFrame, *, req_col: str = "req_id",
                 system_template: str = SYSTEM_PROMPT, user_template: str = USER_MESSAGE) -> DataFrame:
    """``(req, system_prompt, user_message)``."""
    return requests.join(contexts, req_col).select(*prompt_columns(req_col, system_template, user_template))


def format_request(age, weight, symptom_labels, history_labels, medications, takes_meds) -> dict:
    """The five request strings from form values (columns).  ``*_labels`` are
    arrays already in selection order; empty history and ``takes_meds`` false
    give the Arabic "none"."""
    return {
        "symptoms": F.array_join(symptom_labels, ", "),
        "history": F.when(F.size(history_labels) > 0, F.array_join(history_labels, ", ")).otherwise(F.lit(NONE_AR)),
        "medications": F.when(takes_meds, medications).otherwise(F.lit(NONE_AR)),
        "age_weight": fill_template(AGE_WEIGHT, age=age, weight=weight),
    }
