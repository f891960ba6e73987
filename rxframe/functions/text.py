"""Text column functions (JVM-side expressions only, no Python UDFs).

Each function maps Column(s) to a Column and reproduces one cleaning rule of
the registry pipeline exactly, including Python's Unicode whitespace set and
``re`` word boundaries, which Spark's ``trim``/``\\s``/``\\b`` do not match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set as a regex class (Java and RE2),
# the word / non-word classes of Python's Unicode ``\b``, and the ASCII
# characters ``re.escape`` has to escape (everything ASCII that is not a letter,
# a digit or ``_``).
PY_WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\p{Z}]"
PY_NOT_WS = r"[^\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\p{Z}]"
# the same set as characters (for trim): ASCII controls and space, NEL, and Unicode Z
PY_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")
WORD = r"[\p{L}\p{N}_]"
NONWORD = r"[^\p{L}\p{N}_]"
ASCII_SPECIAL = r"([\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{5E}\x{60}\x{7B}-\x{7F}])"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: remove leading and trailing Unicode whitespace (a
    character-set trim, linear and regex-free)."""
    return F.trim(_c(c), F.lit(PY_WS_CHARS))


def first_token(c) -> Column:
    """``s.split()[0]`` (``""`` when there is none), without a per-row regex split."""
    return F.regexp_extract(_c(c), rf"^{PY_WS}*({PY_NOT_WS}*)", 1)


def ws_collapse(c) -> Column:
    """T1 ``" ".join(str(s).split())``; null gives ``""``."""
    return F.coalesce(F.trim(F.regexp_replace(_c(c), rf"{PY_WS}+", " ")), F.lit(""))


def strength_with_unit(strength, unit) -> Column:
    """Cleaned strength and unit joined by a space; trailing commas dropped."""
    joined = F.trim(F.concat(ws_collapse(strength), F.lit(" "), ws_collapse(unit)))
    return F.trim(F.regexp_replace(joined, ",+$", ""))


def comma_spacing(c) -> Column:
    """Split on ``,``, strip each part, rejoin with ``", "``; null/empty gives ``""``."""
    parts = F.transform(F.split(_c(c), ","), lambda x: py_strip(x))
    return F.coalesce(py_strip(F.array_join(parts, ", ")), F.lit(""))


def first_nonempty(a, b) -> Column:
    """T4: first of two cleaned values that is not empty."""
    return F.coalesce(F.nullif(ws_collapse(a), F.lit("")), ws_collapse(b))


def leaflet_normalise(c) -> Column:
    """T5: Excel CR artefacts and carriage returns to spaces, blank-line runs to one
    newline, space runs to one space, strip.  Null stays null."""
    x = F.replace(F.replace(_c(c), F.lit("_x000D_"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    x = F.regexp_replace(x, rf"\n{PY_WS}*\n", "\n")
    x = F.regexp_replace(x, " {2,}", " ")
    return py_strip(x)


def has_leaflet_text(c) -> Column:
    """``leaflet_normalise(c) != ""``, read off the raw text without normalising it; null gives false."""
    return F.coalesce(F.replace(_c(c), F.lit("_x000D_"), F.lit(" ")).rlike(PY_NOT_WS), F.lit(False))


def has_phrase(c, phrases) -> Column:
    """Whether ``leaflet_normalise(c)`` contains one of ``phrases`` (words with single spaces), read off
    the raw text: a space stands for any run of blanks, returns and Excel marks."""
    gap = r"(?:[ \r]|_x000D_)[ \r]*+(?:_x000D_[ \r]*+)*+"
    return F.coalesce(_c(c).rlike("|".join(p.replace(" ", gap) for p in phrases)), F.lit(False))


# The dosage-page markers.
DOSAGE_TAIL_MARKER = "Additional dosage information"
ADULT_MARKER = "Usual Adult Dose"
PEDIATRIC_MARKER = "Usual Pediatric Dose"
RENAL_MARKER = "Renal Dose Adjustments"
LIVER_MARKER = "Liver Dose Adjustments"


def dosage_normalise(c) -> Column:
    """Missing or ``nan`` gives ``""``; cut at the tail marker; drop a leading
    ``for:``; paragraph breaks to `` | ``; newlines to spaces; collapse; strip."""
    x = F.substring_index(_c(c), DOSAGE_TAIL_MARKER, 1)
    x = F.regexp_replace(x, rf"(?i)^for:{PY_WS}*", "")
    x = F.regexp_replace(x, rf"\n{PY_WS}*\n+", " | ")
    x = F.regexp_replace(x, r"\n", " ")
    x = F.trim(F.regexp_replace(x, rf"{PY_WS}+", " "))
    empty = _c(c).isNull() | (_c(c) == "") | (F.lower(_c(c)) == "nan")
    return F.when(empty, F.lit("")).otherwise(x)


def has_dosage_text(c) -> Column:
    """``dosage_normalise(c) != ""``, read off the raw text: after the cut and the leading ``for:``
    something visible is left, or a paragraph break, which becomes visible."""
    x = F.substring_index(_c(c), DOSAGE_TAIL_MARKER, 1)
    x = F.when(x.rlike("(?i)^for:"), F.regexp_replace(x, rf"(?i)^for:{PY_WS}*", "")).otherwise(x)
    word = (F.length(_c(c)) == 3) & (F.lower(_c(c)) == "nan")
    return F.coalesce(~word & x.rlike(rf"{PY_NOT_WS}|\n{PY_WS}*\n"), F.lit(False))


def dosage_context(adult, pediatric, renal, liver) -> Column:
    """Labelled non-empty parts joined by `` // ``."""
    def part(label, col):
        col = _c(col)
        return F.when(col != "", F.concat(F.lit(label), col))
    return F.concat_ws(" // ", part("[Adult] ", adult), part("[Pediatric] ", pediatric),
                       part("[Renal] ", renal), part("[Liver] ", liver))


def brand_simplify(c) -> Column:
    """First whitespace token, only ASCII letters kept, upper-cased."""
    return F.upper(F.regexp_replace(first_token(c), "[^a-zA-Z]", ""))


def url_slug(c) -> Column:
    """Lower, text before the first `` + ``, keep ``[a-z0-9]``, whitespace and
    ``-``, whitespace runs to ``-``."""
    x = F.substring_index(F.lower(_c(c)), " + ", 1)
    x = F.regexp_replace(x, r"[^a-z0-9\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\p{Z}-]", "")
    return F.regexp_replace(x, rf"{PY_WS}+", "-")


def query_string_form(c) -> Column:
    """Spaces to ``+``."""
    return F.replace(_c(c), F.lit(" "), F.lit("+"))


def section_between(c, marker: str, stop: str, limit: int) -> Column:
    """The text after the first ``marker`` and before the next one
    (``str.split`` semantics), cut at ``stop``, stripped, first ``limit`` chars.
    An absent marker gives ``""``."""
    x = F.split_part(_c(c), F.lit(marker), F.lit(2))
    x = F.substring_index(x, stop, 1)
    return F.coalesce(F.substring(py_strip(x), 1, limit), F.lit(""))


def truncate_with_ellipsis(c, n: int) -> Column:
    """First ``n`` code points followed by ``...``."""
    return F.concat(F.substring(_c(c), 1, n), F.lit("..."))


def comma_items(c) -> Column:
    """Comma list to stripped items; empty items are kept."""
    return F.transform(F.split(_c(c), ","), lambda x: py_strip(x))


def na_to_null(c) -> Column:
    """pandas' default NA words read as missing (Spark keeps them as text)."""
    # pandas' default NA strings.
    na_words = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                "n/a", "nan", "null"]
    return F.when(_c(c).isin(na_words), F.lit(None).cast("string")).otherwise(_c(c))


def py_str_or_nan(c) -> Column:
    """``str(value).lower()`` of a pandas cell: a missing value prints as ``nan``."""
    return F.lower(F.coalesce(_c(c), F.lit("nan")))


def word_pattern(term) -> Column:
    """Regex equal to ``r'\\b' + re.escape(t) + r'\\b'`` for a lowered term ``t``
    under Python's Unicode rules, without look-around (Java and RE2 agree).

    Empty term: ``\\b\\b`` holds next to any word character.
    """
    t = _c(term)
    escaped = F.regexp_replace(t, ASCII_SPECIAL, r"\\$1")
    starts_word = t.rlike(rf"^{WORD}")
    ends_word = t.rlike(rf"{WORD}$")
    head = F.when(starts_word, F.lit(f"(?:^|{NONWORD})")).otherwise(F.lit(WORD))
    tail = F.when(ends_word, F.lit(f"(?:$|{NONWORD})")).otherwise(F.lit(WORD))
    return F.when(t == "", F.lit(WORD)).otherwise(F.concat(head, escaped, tail))


def word_runs(c) -> Column:
    """All maximal word runs (``[\\p{L}\\p{N}_]+``) of a text, in order."""
    return F.regexp_extract_all(_c(c), F.lit(rf"{WORD}+"), F.lit(0))


def inner_separator_runs(c) -> Column:
    """Non-word runs that have a word character on both sides (the only places a
    term made of non-word characters can match with ``\\b`` on both ends)."""
    return F.regexp_extract_all(_c(c), F.lit(rf"{WORD}({NONWORD}+)(?={WORD})"), F.lit(1))


def py_number(c) -> Column:
    """``str()`` of a Python float: the shortest digits that read back as it, plain from 1e-4 to below
    1e16, else with a signed exponent of two digits at least; ``nan``, ``inf``.  Null stays null.

    Older Java versions print one or two digits too many now and then, so the number is taken apart into
    whole digits and a power of ten, and last digits are rounded off where that reads back."""
    def let(value: Column, body) -> Column:  # computed once, however often the body mentions it
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def parts(v):
        mantissa = F.ltrim(F.substring_index(v["t"], "E", 1), F.lit("-"))
        power = F.when(v["t"].contains("E"), F.substring_index(v["t"], "E", -1).try_cast("int")).otherwise(F.lit(0))
        return F.struct(F.replace(mantissa, F.lit("."), F.lit("")).try_cast("long").alias("whole"),
                        (power - F.length(F.split_part(mantissa, F.lit("."), F.lit(2)))).alias("power"), v["x"].alias("x"))

    def shortest(p):
        def chosen(s):
            short = F.concat(s.cast("string"), F.lit("E"), (p["power"] + 1).cast("string")).try_cast("double") == F.abs(p["x"])
            return F.when(short, F.struct(s.alias("whole"), (p["power"] + 1).alias("power"), p["x"].alias("x"))).otherwise(p)
        # a printed last 5 may itself be rounded up: whole numbers in 64 bits say which side they are on
        size = F.abs(p["x"])
        above = F.when((p["whole"] % 10 == 5) & (p["power"] > 0) & (size < 9e18), F.try_multiply(
            p["whole"], F.pow(F.lit(10.0), p["power"]).try_cast("long")) > size.try_cast("long"))
        half = F.when(above, F.lit(4)).otherwise(F.lit(5))
        return let((p["whole"] + half - (p["whole"] + half) % 10).cast("decimal(20,0)").cast("string"),
                   lambda tens: let(F.substring(tens, F.lit(1), F.length(tens) - 1).try_cast("long"), chosen))

    def spelt(d):
        n, e, rest = d["n"], d["e"], F.substring(d["n"], F.lit(2), F.length(d["n"]))
        size = F.abs(e).cast("string")
        scientific = F.concat(
            F.substring(n, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")),
            F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(size, F.greatest(F.length(size), F.lit(2)), F.lit("0")))
        padded = F.rpad(n, F.greatest(e + 2, F.length(n)), F.lit("0"))
        large = F.concat(F.substring(padded, F.lit(1), e + 1), F.lit("."), F.substring(padded, e + 2, F.length(padded)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), n)
        return F.when((e >= 16) | (e < -4), scientific).when(e >= 0, large).otherwise(small)

    def shown(v):
        number = let(let(let(let(v, parts), shortest), shortest), lambda s: let(F.struct(
            F.rtrim(s["whole"].cast("string"), F.lit("0")).alias("n"),
            (F.length(s["whole"].cast("string")) - 1 + s["power"]).alias("e")), spelt))
        size = F.when(v["t"].endswith("Infinity"), F.lit("inf")).when(v["x"] == 0, F.lit("0.0")).otherwise(number)
        return F.when(F.isnan(v["x"]), F.lit("nan")).otherwise(
            F.concat(F.when(v["t"].startswith("-"), F.lit("-")).otherwise(F.lit("")), size))

    both = F.struct(_c(c).cast("double").alias("x"), _c(c).cast("string").alias("t"))
    return F.when(_c(c).isNotNull(), let(both, shown))
