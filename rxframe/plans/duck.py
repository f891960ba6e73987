"""DuckDB SQL text for the oracle side of every key (same rules, written in SQL).

Only used to build ``oracle_sql()`` strings; nothing here runs Spark.
"""

from __future__ import annotations

# Fixed values (regex text, RE2 syntax): Python's whitespace set, word and non-word
# classes, ASCII characters to escape.
WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
NONWORD = r"[^\p{L}\p{N}_]"
ASCII_SPECIAL = r"([\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{5E}\x{60}\x{7B}-\x{7F}])"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def ws(x: str) -> str:
    return f"coalesce(trim(regexp_replace({x}, {lit(WS + '+')}, ' ', 'g')), '')"


def leaflet_norm(x: str) -> str:
    y = f"replace(replace({x}, '_x000D_', ' '), chr(13), ' ')"
    y = f"regexp_replace({y}, {lit(chr(92) + 'n' + WS + '*' + chr(92) + 'n')}, chr(10), 'g')"
    y = f"regexp_replace({y}, ' {{2,}}', ' ', 'g')"
    return strip(y)


def dosage_norm(x: str) -> str:
    y = f"split_part({x}, 'Additional dosage information', 1)"
    y = f"regexp_replace({y}, {lit('(?i)^for:' + WS + '*')}, '')"
    y = f"regexp_replace({y}, {lit(chr(92) + 'n' + WS + '*' + chr(92) + 'n+')}, ' | ', 'g')"
    y = f"replace({y}, chr(10), ' ')"
    y = f"trim(regexp_replace({y}, {lit(WS + '+')}, ' ', 'g'))"
    return f"CASE WHEN {x} IS NULL OR {x} = '' OR lower({x}) = 'nan' THEN '' ELSE {y} END"


def dosage_ctx(a: str, p: str, r: str, l: str) -> str:
    parts = [f"CASE WHEN {c} <> '' THEN {lit(lbl)} || {c} END"
             for lbl, c in (("[Adult] ", a), ("[Pediatric] ", p), ("[Renal] ", r), ("[Liver] ", l))]
    return f"concat_ws(' // ', {', '.join(parts)})"


def word_pattern(t: str) -> str:
    esc = f"regexp_replace({t}, {lit(ASCII_SPECIAL)}, {lit(chr(92) * 2 + chr(92) + '1')}, 'g')"
    head = (f"CASE WHEN regexp_matches({t}, {lit('^' + WORD)}) THEN {lit('(?:^|' + NONWORD + ')')} "
            f"ELSE {lit(WORD)} END")
    tail = (f"CASE WHEN regexp_matches({t}, {lit(WORD + '$')}) THEN {lit('(?:$|' + NONWORD + ')')} "
            f"ELSE {lit(WORD)} END")
    return f"CASE WHEN {t} = '' THEN {lit(WORD)} ELSE {head} || {esc} || {tail} END"


def items(list_expr: str) -> tuple[str, str]:
    """(pos, item) select-list pair for a comma list (zipped unnests)."""
    return (f"unnest(generate_series(0, len(string_split({list_expr}, ',')) - 1))",
            f"unnest(list_transform(string_split({list_expr}, ','), lambda x: {strip('x')}))")
