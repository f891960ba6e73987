"""Oracle SQL (DuckDB) for every key of ``catalog.QUERIES``.

Written as the plain definition of each rule (nested loops and windows where
the reference loops), independent of the Spark plans it checks.
"""

from __future__ import annotations

from rxframe.plans import duck as d

# --- fixtures --------------------------------------------------------------

REG = """reg AS (
  SELECT p_partkey AS ord, p_name AS trade_name, p_type AS scientific_name, p_brand AS dosage_form,
         CAST(p_size AS VARCHAR) || ' mg' AS strength, p_retailprice AS price,
         string_split(p_name, ' ')[-1] AS route,
         'src' || CAST(p_size % 25 AS VARCHAR) AS sci_key,
         'src' || CAST((p_size + 7) % 25 AS VARCHAR) AS brand_key
  FROM part)"""

_P = d.lit("لم يتم إدخال بيانات|No data|No specific match found")

# sheet rows beside the documents' own: (order, texts ...) for every search key
LEAF = f"""leaf_raw AS (
  SELECT doc_id AS ord, source AS search_key, CASE WHEN lang = 'en' THEN text END AS leaflet,
         CASE WHEN lang <> 'de' THEN text END AS practitioner, lang AS route_ar
  FROM documents
  UNION ALL SELECT o, k, a, b, 'none' FROM (SELECT DISTINCT source AS k FROM documents),
    (VALUES (-1, '_x000D_ ' || chr(13), 'x'), (-2, 'No ' || chr(13) || '_x000D_data', 'x'),
            (-3, 'words', 'No specific  match found')) t(o, a, b)),
leaf_clean AS (
  SELECT ord, search_key, {d.leaflet_norm('leaflet')} AS leaflet, {d.leaflet_norm('practitioner')} AS practitioner, route_ar
  FROM leaf_raw),
leaf AS (
  SELECT * FROM leaf_clean WHERE NOT coalesce(regexp_matches(leaflet, {_P}), false)
    AND NOT coalesce(regexp_matches(practitioner, {_P}), false))"""

BLEAF = f"""bleaf AS (
  SELECT doc_id AS ord, source AS search_key,
         {d.leaflet_norm("CASE WHEN lang = 'fr' THEN text END")} AS leaflet,
         'ar-' || lang AS route_ar
  FROM documents)"""

DOS = f"""dos_raw AS (
  SELECT doc_id AS ord, source AS search_key, text AS t FROM documents
  UNION ALL SELECT o, k, t FROM (SELECT DISTINCT source AS k FROM documents),
    (VALUES (1000000000000000, 'for: ' || chr(10)), (1000000000000001, 'NaN')) v(o, t)),
dos AS (
  SELECT ord, search_key, {d.dosage_ctx(d.dosage_norm("t"), "''", "''", "''")} AS dosage_context
  FROM dos_raw)"""

MASTER = """j2 AS (
  SELECT * FROM (SELECT search_key, leaflet, practitioner, route_ar,
                        row_number() OVER (PARTITION BY search_key ORDER BY ord) AS rn
                 FROM leaf WHERE leaflet <> '') WHERE rn = 1),
m1 AS (
  SELECT r.*, j2.leaflet, j2.practitioner, j2.route_ar, j2.leaflet IS NOT NULL AS leaflet_before_gap
  FROM reg r LEFT JOIN j2 ON r.sci_key IS NOT DISTINCT FROM j2.search_key),
j3 AS (
  SELECT * FROM (SELECT search_key, leaflet, route_ar,
                        row_number() OVER (PARTITION BY search_key ORDER BY ord) AS rn
                 FROM bleaf WHERE leaflet <> '') WHERE rn = 1),
m2 AS (
  SELECT m1.* REPLACE (coalesce(m1.leaflet, j3.leaflet) AS leaflet, coalesce(m1.route_ar, j3.route_ar) AS route_ar)
  FROM m1 LEFT JOIN j3 ON m1.brand_key IS NOT DISTINCT FROM j3.search_key),
j4 AS (
  SELECT * FROM (SELECT search_key, dosage_context,
                        row_number() OVER (PARTITION BY search_key ORDER BY ord DESC) AS rn
                 FROM dos WHERE dosage_context <> '') WHERE rn = 1),
master AS (
  SELECT m2.*, coalesce(j4.dosage_context, '') AS intl_dosage
  FROM m2 LEFT JOIN j4 ON m2.sci_key IS NOT DISTINCT FROM j4.search_key)"""

REQ = """req AS (
  SELECT p_partkey AS req_id, replace(p_name, ' ', ', ') AS symptoms, p_type AS history,
         p_name AS medications,
         CAST(p_size AS VARCHAR) || ' سنة, ' || CAST(p_size + 40 AS VARCHAR) || ' كجم' AS age_weight
  FROM part)"""

SYMDICT = """sd AS (
  SELECT p_type AS key, concat_ws(', ', lower(p_type), min(p_name), max(p_name)) AS value
  FROM part GROUP BY p_type)"""

MAPPING = """mapping AS (
  SELECT p_partkey AS ord, upper(split_part(p_name, ' ', 1)) AS search_term, p_name AS brand_name,
         p_brand AS ingredients
  FROM part)"""

_tk = "upper(" + d.strip("coalesce(search_term, 'nan')") + ")"
_bk = "upper(" + d.strip("coalesce(brand_name, 'nan')") + ")"
_ing = d.strip("coalesce(ingredients, 'nan')")
LINKDICT = f"""ld_long AS (
  SELECT ord, 0 AS kind, {_tk} AS key, {_ing} AS ingredient FROM mapping
  UNION ALL SELECT ord, 1, {_bk}, {_ing} FROM mapping
  UNION ALL SELECT ord, 2, regexp_split_to_array({_bk}, {d.lit(d.WS + '+')})[1], {_ing} FROM mapping
    WHERE {_bk} <> '' AND length(regexp_split_to_array({_bk}, {d.lit(d.WS + '+')})[1]) > 2),
ld AS (
  SELECT key, ingredient FROM (
    SELECT key, ingredient, row_number() OVER (PARTITION BY key ORDER BY ord DESC, kind DESC) AS rn
    FROM ld_long) WHERE rn = 1)"""


def _items_cte(name: str, col: str) -> str:
    pos, item = d.items(col)
    return f"""{name} AS (SELECT req_id, {pos} AS pos, {item} AS item FROM req)"""


# entity extraction (C3): std symptoms/history (field 1/2), medications (field 0)
ENTITIES = f"""{_items_cte("sym_items", "symptoms")},
{_items_cte("his_items", "history")},
{_items_cte("med_items", "medications")},
exp_lists AS (
  SELECT i.req_id, i.field, i.pos,
         coalesce(list_transform(string_split(sd.value, ','), lambda y: {d.strip('y')}), [i.item]) AS lst
  FROM (SELECT *, 1 AS field FROM sym_items UNION ALL SELECT *, 2 AS field FROM his_items) i
  LEFT JOIN sd ON sd.key = i.item),
expanded AS (
  SELECT req_id, field, pos, unnest(generate_series(0, len(lst) - 1)) AS sub, unnest(lst) AS term
  FROM exp_lists),
meds AS (
  SELECT m.req_id, m.pos, m.item AS term, ld.ingredient
  FROM med_items m LEFT JOIN ld ON ld.key = upper({d.strip('m.item')})
  WHERE m.item <> ''),
text_links AS (
  SELECT e.req_id, e.term AS brand, ld.ingredient, e.field, e.pos, e.sub
  FROM expanded e JOIN ld ON ld.key = upper({d.strip('e.term')}) WHERE e.term <> ''),
all_links AS (
  SELECT req_id, term AS brand, ingredient, 0 AS field, pos, 0 AS sub FROM meds WHERE ingredient IS NOT NULL
  UNION ALL SELECT * FROM text_links),
links AS (
  SELECT req_id, brand, ingredient, field, pos, sub FROM (
    SELECT *, row_number() OVER (PARTITION BY req_id, brand ORDER BY field, pos, sub) AS rn FROM all_links)
  WHERE rn = 1),
sterms AS (
  SELECT DISTINCT req_id, term FROM (
    SELECT req_id, term FROM expanded
    UNION ALL SELECT req_id, term FROM meds
    UNION ALL SELECT req_id, ingredient FROM meds WHERE ingredient IS NOT NULL
    UNION ALL SELECT req_id, ingredient FROM links))"""

# word-boundary retrieval by nested loop over distinct terms x master rows
RETRIEVE = f"""pat AS (
  SELECT term_l, {d.word_pattern('term_l')} AS pattern FROM (SELECT DISTINCT lower(term) AS term_l FROM sterms)),
mrows AS (
  SELECT ord, lower(coalesce(trade_name, 'nan')) AS a, lower(coalesce(scientific_name, 'nan')) AS b,
         coalesce('s' || scientific_name, 'n' || CAST(ord AS VARCHAR)) AS dkey
  FROM reg),
term_hits AS (
  SELECT p.term_l, m.ord, m.dkey FROM pat p JOIN mrows m
    ON (contains(m.a, p.term_l) AND regexp_matches(m.a, p.pattern))
    OR (contains(m.b, p.term_l) AND regexp_matches(m.b, p.pattern))),
req_hits AS (
  SELECT DISTINCT s.req_id, h.ord, h.dkey FROM sterms s JOIN term_hits h ON h.term_l = lower(s.term)),
firsts AS (SELECT req_id, dkey, min(ord) AS ord FROM req_hits GROUP BY req_id, dkey),
ranked AS (
  SELECT * FROM (SELECT req_id, ord, row_number() OVER (PARTITION BY req_id ORDER BY ord) AS rn FROM firsts)
  WHERE rn <= 4)"""


def _py(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), 'nan')"


LINES = f"""lines AS (
  SELECT r.req_id, r.rn,
    '- ' || {_py('m.trade_name')} || ' (' || {_py('m.scientific_name')} || '): ' || {_py('m.dosage_form')}
    || ', Strength: ' || {_py('m.strength')} || ', Price: ' || {_py('m.price')}
    || ' SAR, Administration: ' || coalesce(m.route_ar, m.route, 'nan') || chr(10)
    || coalesce('  Official Instructions: ' || substring(m.leaflet, 1, 800) || '...' || chr(10), '')
    || CASE WHEN m.intl_dosage IS NOT NULL AND m.intl_dosage <> ''
            THEN '  International Dosage Protocols (Drugs.com): ' || substring(m.intl_dosage, 1, 800) || '...' || chr(10)
            ELSE '' END AS line
  FROM ranked r JOIN master m ON m.ord = r.ord)"""

CONTEXT = f"""body AS (SELECT req_id, string_agg(line, '' ORDER BY rn) AS lines_txt FROM lines GROUP BY req_id),
notes AS (
  SELECT req_id, string_agg('- User mentioned ''' || brand || ''' (International). Mapped via NER to active ingredient '''
                            || ingredient || ''' to find local equivalent.' || chr(10), '' ORDER BY field, pos, sub) AS notes_txt
  FROM links GROUP BY req_id),
ctx AS (
  SELECT q.req_id,
         coalesce('Relevant SFDA Drug Data & Clinical Instructions (Master Dataset):' || chr(10) || b.lines_txt, '')
         || coalesce(chr(10) || '[System Note: International Brand Mapping (NER/NEL)]' || chr(10) || n.notes_txt, '') AS c
  FROM req q LEFT JOIN body b ON b.req_id = q.req_id LEFT JOIN notes n ON n.req_id = q.req_id),
contexts AS (
  SELECT req_id, CASE WHEN c = '' THEN 'No specific match found in SFDA master database for translated keywords.'
                      ELSE c END AS context FROM ctx)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


CONSULT_BASE = (REG, LEAF, BLEAF, DOS, MASTER, REQ, SYMDICT, MAPPING, LINKDICT, ENTITIES, RETRIEVE, LINES, CONTEXT)


def _prompt_sql() -> str:
    from rxframe.operators.context import SYSTEM_PROMPT, USER_MESSAGE
    sys_parts = SYSTEM_PROMPT.split("{context}")
    head, tail = sys_parts[0], sys_parts[1]
    tail_a, tail_b = tail.split("{age_weight}")
    u = USER_MESSAGE
    u1, rest = u.split("{symptoms}")
    u2, rest = rest.split("{history}")
    u3, u4 = rest.split("{medications}")
    return (_with(*CONSULT_BASE) +
            f"SELECT q.req_id, {d.lit(head)} || c.context || {d.lit(tail_a)} || q.age_weight || {d.lit(tail_b)} AS system_prompt,\n"
            f"  {d.lit(u1)} || q.symptoms || {d.lit(u2)} || q.history || {d.lit(u3)} || q.medications || {d.lit(u4)} AS user_message\n"
            f"FROM req q JOIN contexts c ON c.req_id = q.req_id")


ORACLES: dict[str, str] = {
    "master_build": _with(REG, LEAF, BLEAF, DOS, MASTER) + "SELECT * FROM master",
    "link_dictionary": _with(MAPPING, LINKDICT) + "SELECT key, ingredient FROM ld",
    "request_terms": _with(REQ, SYMDICT, MAPPING, LINKDICT, ENTITIES) + "SELECT req_id, term FROM sterms",
    "entity_link": _with(REQ, SYMDICT, MAPPING, LINKDICT, ENTITIES)
    + "SELECT req_id, brand, ingredient, row_number() OVER (PARTITION BY req_id ORDER BY field, pos, sub) AS link_pos FROM links",
    "retrieve_topk": _with(REG, REQ, SYMDICT, MAPPING, LINKDICT, ENTITIES, RETRIEVE)
    + "SELECT req_id, rn, ord FROM ranked",
    "context_lines": _with(*CONSULT_BASE[:-1]) + "SELECT req_id, rn, line FROM lines",
    "consult_context": _with(*CONSULT_BASE) + "SELECT req_id, context FROM contexts",
    "prompt_table": _prompt_sql(),
}


# --- batch 2: quality, single lookups, cleaning -------------------------------

LEAFSHEET = """lf AS (
  SELECT doc_id AS ord, source AS search_key,
    CASE WHEN lang = 'de' THEN 'No data ' || text WHEN lang = 'es' THEN NULL
         ELSE replace(text, '. ', '.' || chr(13) || chr(10) || ' ' || chr(10) || chr(10)) || '_x000D_' END AS leaflet,
    CASE WHEN lang = 'fr' THEN '  ' || text || '  ' END AS practitioner,
    CASE WHEN lang <> 'es' OR n_chars > 1000 THEN source END AS trade_ar,
    CASE WHEN lang <> 'es' THEN source || '  x' END AS sci_ar
  FROM documents)"""

RAWEVENTS = """raw AS (
  SELECT event_id, '{"id": ' || CAST(event_id AS VARCHAR) || ', "props": ' || props
    || CASE WHEN event_type = 'click' THEN ', "value": null' ELSE '' END
    || CASE WHEN user_id > 50 THEN ', "user": ' || CAST(user_id AS VARCHAR) ELSE '' END
    || CASE WHEN event_type <> 'error' THEN ', "type": "' || event_type || '"' ELSE '' END || '}' AS raw
  FROM events)"""

DOSPAGES = """pages_d AS (
  SELECT doc_id, source,
    replace(replace(replace(replace(text, '.' || chr(10), '.' || chr(10) || 'Usual Adult Dose' || chr(10)),
      ', ', ', Usual Pediatric Dose '), chr(10) || 'E', chr(10) || chr(10) || 'Renal Dose Adjustments E'),
      chr(10) || 'L', chr(10) || chr(10) || 'Liver Dose Adjustments' || chr(10) || chr(10) || 'L') AS page
  FROM documents)"""


def _section(t: str, marker: str, stop: str, n: int) -> str:
    return f"coalesce(substring({d.strip(f'split_part(split_part({t}, {d.lit(marker)}, 2), {stop}, 1)')}, 1, {n}), '')"


SECTIONS = f"""sections AS (
  SELECT * FROM (SELECT doc_id, source,
    {_section('page', 'Usual Adult Dose', "'Usual'", 1000)} AS adult,
    {_section('page', 'Usual Pediatric Dose', "'Usual'", 1000)} AS pediatric,
    {_section('page', 'Renal Dose Adjustments', 'chr(10) || chr(10)', 500)} AS renal,
    {_section('page', 'Liver Dose Adjustments', 'chr(10) || chr(10)', 500)} AS liver
  FROM pages_d) WHERE adult <> '' OR pediatric <> '')"""

_AGENTS = "[{'nameEn': p_brand}, {'nameEn': ' ' || lower(p_type) || chr(9) || ' '}, " \
          "{'nameEn': CASE WHEN p_size > 25 THEN p_brand END}, {'nameEn': CASE WHEN p_size > 45 THEN '' END}]"
RAWREG = f"""rawreg AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, '  ' || p_name || ' ,x ' AS tradeName,
    p_type || ' ,  ' || lower(p_type) AS scientificName, p_brand AS registerNumber,
    CAST(p_size + 1990 AS VARCHAR) AS registerYear,
    CAST(p_size AS VARCHAR) || CASE WHEN p_size > 25 THEN ' ,,' ELSE '' END AS strength,
    CASE WHEN p_size > 40 THEN '' ELSE 'mg' END AS strengthUnit,
    lower(p_type) || chr(10) || chr(9) || ' form' AS doesageForm,
    string_split(p_name, ' ')[-1] AS administrationRoute, CAST(p_retailprice AS VARCHAR) AS price,
    p_brand AS manufacturerName, CAST(NULL AS VARCHAR) AS manufacturerCountry, p_brand || ' Co' AS companyName,
    'SA' AS companyCountryEn, 'Marketed' AS marketingStatus, 'Prescription' AS legalStatus,
    CASE WHEN p_size > 10 THEN ' OTC ' WHEN p_size > 5 THEN '' END AS legalStatusEn,
    'Store below 25C' AS storageConditions, CAST(NULL AS VARCHAR) AS distributionArea,
    {_AGENTS} AS agents
  FROM part)"""


def _t3(x: str) -> str:
    return f"coalesce({d.strip(f'array_to_string(list_transform(string_split({x}, {chr(39)},{chr(39)}), lambda y: {d.strip(chr(121))}), {chr(39)}, {chr(39)})')}, '')"


def _t2(a: str, b: str) -> str:
    return f"trim(regexp_replace(trim({d.ws(a)} || ' ' || {d.ws(b)}), ',+$', ''))"


_A10 = ("coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(agents, "
        "lambda x: x.nameEn IS NOT NULL AND x.nameEn <> ''), lambda x: " + d.ws("x.nameEn") + "))), ', '), '')")

REGCLEAN = f"""SELECT id AS record_id, {_t3('tradeName')} AS "Trade Name", {_t3('scientificName')} AS "Scientific Name",
  {d.ws('registerNumber')} AS "Registration Number", {d.ws('registerYear')} AS "Registration Year",
  {_t2('strength', 'strengthUnit')} AS "Strength", {d.ws('doesageForm')} AS "Dosage Form",
  {d.ws('administrationRoute')} AS "Administration Route", {d.ws('price')} AS "Price (SAR)",
  {d.ws('manufacturerName')} AS "Manufacturer", {d.ws('manufacturerCountry')} AS "Manufacturer Country",
  {d.ws('companyName')} AS "Selling Company", {d.ws('companyCountryEn')} AS "Company Country",
  {d.ws('marketingStatus')} AS "Marketing Status",
  coalesce(nullif({d.ws('legalStatusEn')}, ''), {d.ws('legalStatus')}) AS "Legal Status",
  {d.ws('storageConditions')} AS "Storage Conditions", {d.ws('distributionArea')} AS "Distribution Area",
  {_A10} AS "Agents"
FROM rawreg"""

_T3_NOTE = None


def _leaflet_clean_sql() -> str:
    cols = ["search_key", "leaflet", "practitioner", "trade_ar", "sci_ar"]
    norm = ", ".join(f"{d.leaflet_norm(c)} AS {c}" for c in cols)
    return (_with(LEAFSHEET) +
            f", kept AS (SELECT * FROM lf WHERE NOT (leaflet IS NULL AND trade_ar IS NULL AND sci_ar IS NULL)),\n"
            f"norm AS (SELECT ord, {norm} FROM kept)\n"
            f"SELECT * FROM norm WHERE NOT coalesce(regexp_matches(leaflet, {_P}), false)"
            f" AND NOT coalesce(regexp_matches(practitioner, {_P}), false)")


def _dosage_clean_sql() -> str:
    raw_adult = "'for:  ' || adult || chr(10) || chr(10) || 'Additional dosage information ' || source"
    cols = {"adult": raw_adult, "pediatric": "pediatric", "renal": "renal", "liver": "liver"}
    norm = ", ".join(f"{d.dosage_norm(v)} AS {k}" for k, v in cols.items())
    return (_with(DOSPAGES, SECTIONS) +
            f", cleaned AS (SELECT doc_id, source, {norm} FROM sections)\n"
            f"SELECT *, {d.dosage_ctx('adult', 'pediatric', 'renal', 'liver')} AS dosage_context FROM cleaned\n"
            f"WHERE NOT (adult = '' AND pediatric = '' AND renal = '' AND liver = '')")


_ST = "upper(regexp_replace(regexp_split_to_array(" + d.strip("trade_name") + ", " + d.lit(d.WS + "+") \
      + ")[1], '[^a-zA-Z]', '', 'g'))"
_SLUG_CLASS = d.lit(r"[^a-z0-9\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\p{Z}-]")

ORACLES.update({
    "dq_duplicate_ids": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem "
                        "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "dq_duplicate_keys": _with(REG) + """, dup AS (
  SELECT trade_name, count(*) AS n, min(ord) AS first_ord FROM reg
  WHERE trade_name IS NOT NULL AND trade_name <> '' GROUP BY trade_name HAVING count(*) > 1)
SELECT trade_name, n, first_ord, (SELECT count(*) FROM dup) AS duplicate_keys FROM dup ORDER BY first_ord LIMIT 5""",
    "dq_field_presence": _with(RAWEVENTS) + """, k AS (SELECT unnest(list_distinct(json_keys(raw))) AS field FROM raw)
SELECT field, (SELECT count(*) FROM raw) - count(*) AS missing FROM k GROUP BY field
HAVING (SELECT count(*) FROM raw) - count(*) > 0""",
    "dq_critical_empty": """WITH dd AS (SELECT text, lang, source, regexp_extract(text, '^([A-Z][a-z]+) ', 1) AS title FROM documents),
c AS (SELECT 'text' AS field, count(*) FILTER (WHERE text IS NULL OR text = '') AS empty FROM dd
  UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL OR lang = '') FROM dd
  UNION ALL SELECT 'source', count(*) FILTER (WHERE source IS NULL OR source = '') FROM dd
  UNION ALL SELECT 'title', count(*) FILTER (WHERE title IS NULL OR title = '') FROM dd)
SELECT field, empty FROM c WHERE empty > 0""",
    "dq_filter_report": _with(LEAFSHEET) + f""", r AS (
  SELECT count(*) AS before, count(*) FILTER (WHERE NOT coalesce(regexp_matches(leaflet, {_P}), false)
                                           AND NOT coalesce(regexp_matches(practitioner, {_P}), false)) AS after FROM lf)
SELECT before, after, before - after AS removed FROM r""",
    "dataset_status": _with(REG) + """, sd_ord AS (SELECT p_type AS key, min(p_partkey) AS ord FROM part GROUP BY p_type)
SELECT (SELECT count(*) FROM reg) AS rows, (SELECT count(*) FROM sd_ord) AS map_size,
  (SELECT string_agg(key, ', ' ORDER BY ord) FROM (SELECT * FROM sd_ord ORDER BY ord LIMIT 3)) AS sample_keys""",
    "lookup_first_wins": _with(REG, LEAF, BLEAF, DOS, MASTER)
    + "SELECT ord, sci_key, leaflet, practitioner, route_ar FROM m1",
    "lookup_gap_fill": _with(REG, LEAF, BLEAF, DOS, MASTER) + "SELECT ord, brand_key, leaflet, route_ar FROM m2",
    "lookup_last_wins": _with(REG, LEAF, BLEAF, DOS, MASTER)
    + "SELECT r.ord, r.sci_key, coalesce(j4.dosage_context, '') AS intl_dosage FROM reg r "
      "LEFT JOIN j4 ON r.sci_key IS NOT DISTINCT FROM j4.search_key",
    "coverage_report": _with(REG, LEAF, BLEAF, DOS, MASTER) + """SELECT count(*) AS rows,
  count(*) FILTER (WHERE leaflet_before_gap) AS leaflets_first, count(leaflet) AS leaflets_after,
  count(leaflet) - count(*) FILTER (WHERE leaflet_before_gap) AS new_hits,
  round(CAST(count(leaflet) AS DOUBLE) * 100.0 / count(*), 2) AS coverage_pct,
  count(*) FILTER (WHERE intl_dosage <> '') AS dosage_rows FROM master""",
    "resume_anti_join": "SELECT DISTINCT doc_id FROM documents d WHERE doc_id IS NOT NULL "
                        "AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "union_by_name": "SELECT doc_id, text, source FROM documents "
                     "UNION ALL BY NAME SELECT conv_id, turn, text FROM conversations",
    "nest_details": """WITH li AS (
  SELECT l_orderkey, count(*) AS n, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ';'
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS details
  FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, o.o_orderstatus, coalesce(li.n, 0) AS n_details, coalesce(li.details, '') AS details
FROM orders o LEFT JOIN li ON li.l_orderkey = o.o_orderkey""",
    "nested_distinct_join": f"""WITH a AS (
  SELECT l.l_orderkey AS o_orderkey, ' ' || s.s_name || '  ' AS nm
  FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey)
SELECT o_orderkey, coalesce(string_agg(DISTINCT {d.ws('nm')}, ', ' ORDER BY {d.ws('nm')})
  FILTER (WHERE nm IS NOT NULL AND nm <> ''), '') AS agents FROM a GROUP BY o_orderkey""",
    "search_terms": _with(REG) + f""", k AS (SELECT {_ST} AS search_term, trade_name, ord FROM reg WHERE trade_name IS NOT NULL)
SELECT search_term, arg_min(trade_name, ord) AS original_name FROM k GROUP BY search_term HAVING length(search_term) > 2""",
    "slugify": f"""SELECT p_partkey,
  regexp_replace(regexp_replace(split_part(lower(concat_ws(' + ', p_name, p_type)), ' + ', 1), {_SLUG_CLASS}, '', 'g'),
                 {d.lit(d.WS + '+')}, '-', 'g') AS slug,
  replace(p_name, ' ', '+') AS query_form FROM part""",
    "registry_clean": _with(RAWREG) + REGCLEAN,
    "leaflet_clean": _leaflet_clean_sql(),
    "section_extract": _with(DOSPAGES, SECTIONS) + "SELECT * FROM sections",
    "dosage_clean": _dosage_clean_sql(),
})


# --- batch 3: sources, search, display, pages, retrieval variants ----------------

from rxframe.operators.search import HISTORY_OPTIONS, NO_VALUE, SYMPTOM_OPTIONS  # noqa: E402

_RAW_COLS = ("id, tradeName, scientificName, registerNumber, registerYear, strength, strengthUnit, doesageForm, "
             "administrationRoute, price, manufacturerName, manufacturerCountry, companyName, companyCountryEn, "
             "marketingStatus, legalStatus, legalStatusEn, storageConditions, distributionArea")


def _unescape(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {d.lit(ent)}, {d.lit(ch)})"
    return x


def _label_case(x: str, options) -> str:
    whens = " ".join(f"WHEN {d.lit(i)} THEN {d.lit(lbl)}" for i, lbl in options)
    return f"CASE {x} {whens} END"


def _ids(options) -> str:
    return "[" + ", ".join(d.lit(i) for i, _ in options) + "]"


_AR = d.lit(NO_VALUE["ar"])
_NULLDISP_FIELDS = ["tradeName", "scientificName", "strengthUnit", "manufacturerCountry", "legalStatusEn",
                    "distributionArea", "price"]

ANCHORS = f"""a0 AS (SELECT page_id, regexp_extract_all(html, {d.lit('<a href="[^"]*">[^<]*</a>')}) AS l FROM pages),
a1 AS (SELECT page_id, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS a FROM a0),
anchors AS (SELECT page_id, pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href,
                   {_unescape(d.lit('>([^<]*)</a>').join(['regexp_extract(a, ', ', 1)']))} AS text FROM a1),
links AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank
                         FROM anchors WHERE contains(text, 'e')) WHERE rank <= 3)"""

_INNER = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
_NODES = f"string_split(regexp_replace({_INNER}, '<[^>]*>', chr(1), 'g'), chr(1))"
_KEPT = f"list_filter(list_transform({_NODES}, lambda x: {d.strip(_unescape('x'))}), lambda x: x <> '')"
_BODY = f"CASE WHEN {_INNER} <> '' THEN array_to_string({_KEPT}, chr(10)) END"

REQCHAT = """req AS (
  SELECT conv_id * 1000 + turn AS req_id, text AS symptoms, '' AS history, '' AS medications
  FROM conversations WHERE role = 'user')"""

ORACLES.update({
    "registry_json_scan": _with(RAWREG) + f"""SELECT {_RAW_COLS}, CAST(len(agents) AS BIGINT) AS n_agents,
  array_to_string(list_transform(agents, lambda x: coalesce(x.nameEn, '<null>')), '|') AS agent_names FROM rawreg""",
    "page_envelope_flatten": "SELECT CASE WHEN p % 5 = 4 THEN p - 1 ELSE p END AS page, o_orderkey, o_custkey, o_orderstatus, "
                             "o_totalprice FROM (SELECT *, CAST(floor(o_orderkey / 100) AS BIGINT) AS p FROM orders)",
    "csv_roundtrip": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_mktsegment = 'AUTOMOBILE' "
                     "THEN NULL WHEN c_mktsegment = 'BUILDING' THEN '  BUILDING ' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "dictionary_scan": """SELECT event_id, k AS key, json_extract_string(props, '$."' || k || '"') AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""",
    "registry_search": _with(RAWREG) + """, hits AS (
  SELECT CAST(id AS BIGINT) AS ord, tradeName, registerNumber FROM rawreg
  WHERE contains(lower(tradeName), 'ring')
    AND len(list_filter(agents, lambda x: coalesce(contains(lower(x.nameEn), 'brand#1'), false))) > 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY ord) AS rn, count(*) OVER () AS total FROM hits)
SELECT ord, tradeName, registerNumber, rn, CAST(ceil(rn / 10) AS BIGINT) AS page,
  CAST(ceil(total / 10) AS BIGINT) AS page_count, (CAST(ceil(rn / 10) AS BIGINT) - 1) * 10 + 1 AS first_row_on_page,
  least(CAST(ceil(rn / 10) AS BIGINT) * 10, total) AS last_row_on_page FROM numbered""",
    "null_display": _with(RAWREG) + "SELECT id, " + ", ".join(
        (f"CASE WHEN {c} IS NULL OR {c} = '' THEN {_AR} ELSE {c} END AS {c}" if c == "legalStatusEn"
         else f"coalesce({c}, {_AR}) AS {c}") for c in _NULLDISP_FIELDS)
    + f", coalesce(agents[1].nameEn, {_AR}) AS agent_1, coalesce(agents[2].nameEn, {_AR}) AS agent_2, "
      f"coalesce(agents[3].nameEn, {_AR}) AS agent_3 FROM rawreg",
    "request_format": f"""WITH c AS (
  SELECT c_custkey, c_name, c_nationkey AS nk, c_acctbal,
    [{_ids(SYMPTOM_OPTIONS)}[c_nationkey % 12 + 1], {_ids(SYMPTOM_OPTIONS)}[(c_nationkey + 5) % 12 + 1], 'unknown'] AS sym_ids,
    CASE WHEN c_acctbal < 0 THEN CAST([] AS VARCHAR[]) ELSE [{_ids(HISTORY_OPTIONS)}[c_nationkey % 6 + 1]] END AS his_ids
  FROM customer),
l AS (SELECT *, list_filter(list_transform(sym_ids, lambda x: {_label_case('x', SYMPTOM_OPTIONS)}), lambda x: x IS NOT NULL) AS sl,
             list_filter(list_transform(his_ids, lambda x: {_label_case('x', HISTORY_OPTIONS)}), lambda x: x IS NOT NULL) AS hl
      FROM c)
SELECT c_custkey, array_to_string(sl, ', ') AS symptoms,
  CASE WHEN len(hl) > 0 THEN array_to_string(hl, ', ') ELSE {_AR} END AS history,
  CASE WHEN c_acctbal > 5000 THEN c_name ELSE {_AR} END AS medications,
  CAST(nk + 20 AS VARCHAR) || ' سنة, ' || CAST(CAST(round(c_acctbal / 100) AS BIGINT) AS VARCHAR) || ' كجم' AS age_weight
FROM l""",
    "page_links_topk": _with(ANCHORS) + "SELECT page_id, rank, href, text FROM links",
    "page_fields": _with(ANCHORS) + "SELECT page_id, text AS label, arg_max(href, pos) AS value FROM anchors "
                                    "GROUP BY page_id, text",
    "page_text": f"""WITH b AS (SELECT page_id, {_unescape("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS title,
  {_BODY} AS body,
  array_to_string(list_transform(regexp_extract_all(html, '<h[23][^>]*>([^<]*)</h[23]>', 1), lambda x: {_unescape('x')}), chr(10)) AS headings
  FROM pages)
SELECT page_id, title, CASE WHEN NOT contains(body, {d.lit("لم يتم إدخال بيانات")}) AND length(body) > 10 THEN body END AS body,
  headings FROM b""",
    "page_outcomes": _with(ANCHORS) + """, n AS (SELECT page_id, count(*) AS n_results FROM links GROUP BY page_id),
cls AS (
  SELECT CASE WHEN contains(p.html, 'Just a moment') OR st IN (403, 429) THEN 'blocked'
              WHEN st <> 200 OR contains(title, 'Page Not Found') OR contains(title, '404') THEN 'not_found'
              WHEN contains(p.html, 'no-results-content') THEN 'no_results'
              WHEN coalesce(n.n_results, 0) > 0 THEN 'hit' ELSE 'miss' END AS outcome
  FROM (SELECT *, CASE WHEN contains(url, '#') THEN 404 ELSE 200 END AS st,
               regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages) p
  LEFT JOIN n ON n.page_id = p.page_id)
SELECT outcome, count(*) AS pages FROM cls GROUP BY outcome""",
    "retrieve_substring": _with(REG, REQ, SYMDICT, MAPPING, LINKDICT, ENTITIES) + """, mrows AS (
  SELECT ord, lower(coalesce(trade_name, 'nan')) AS a, lower(coalesce(scientific_name, 'nan')) AS b FROM reg),
th AS (SELECT t.term, m.ord FROM (SELECT DISTINCT term FROM sterms) t JOIN mrows m
       ON contains(m.a, t.term) OR contains(m.b, t.term)),
rh AS (SELECT DISTINCT s.req_id, th.ord FROM sterms s JOIN th ON th.term = s.term)
SELECT req_id, rn, ord FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY ord) AS rn FROM rh)
WHERE rn <= 5""",
    "retrieve_indexed": _with(REG, REQCHAT.replace("FROM conversations WHERE role = 'user')", """FROM conversations WHERE role = 'user'
  UNION ALL SELECT p_partkey, replace(p_name, ' ', ', '), p_type, p_name FROM part)"""),
                              SYMDICT, MAPPING, LINKDICT, ENTITIES, RETRIEVE) + """, tf AS (
  SELECT term_l, dkey, min(ord) AS ord FROM term_hits GROUP BY term_l, dkey)
SELECT term_l, ord FROM (SELECT *, row_number() OVER (PARTITION BY term_l ORDER BY ord) AS rn FROM tf) WHERE rn <= 4""",
})


ORACLES["stream_consult"] = ORACLES["prompt_table"]
ORACLES["stream_page_extract"] = ORACLES["page_text"].replace(
    "WITH b AS (SELECT page_id, ", "WITH b AS (SELECT page_id, url, ").replace(
    "SELECT page_id, title, CASE", "SELECT page_id, url, title, CASE")

ORACLES["page_cards"] = f"""WITH c0 AS (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS l FROM pages),
c1 AS (SELECT page_id, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS card FROM c0),
c2 AS (SELECT page_id, pos,
         nullif({d.strip(_unescape("regexp_extract(card, '>([^<]*)</a>', 1)"))}, '') AS name,
         nullif({d.strip(_unescape("regexp_extract(card, 'href=\"/([a-z]+)\"', 1)"))}, '') AS ingredients
       FROM c1 WHERE pos < 5)
SELECT page_id, pos, name, ingredients FROM c2 WHERE name IS NOT NULL AND ingredients IS NOT NULL"""

ORACLES["master_versions"] = _with(REG, LEAF, BLEAF, DOS, MASTER) + "SELECT ord, sci_key, leaflet, intl_dosage FROM master"

ORACLES["detail_fields"] = """SELECT p_partkey AS page_id, CAST(0 AS BIGINT) AS pos, 'Trade Name' AS label, upper(p_name) AS value FROM part
UNION ALL SELECT p_partkey, 1, 'Scientific Name', p_type FROM part
UNION ALL SELECT p_partkey, 2, 'Brand', p_brand FROM part"""

ORACLES["detail_sections"] = """SELECT p_partkey AS page_id, 'leaflet' AS section, p_name || chr(10) || p_brand AS text FROM part
UNION ALL SELECT p_partkey, 'practitioner', 'Size ' || CAST(p_size AS VARCHAR) FROM part WHERE p_size <= 40"""

ORACLES["page_main_block"] = """SELECT doc_id AS page_id,
  'Usual Adult Dose' || chr(10) || text || chr(10) || ' Renal Dose Adjustments ' || chr(10) || source AS main_text,
  'Usual Adult Dose' || chr(10) || 'Renal Dose Adjustments' AS headings
FROM documents WHERE lang IN ('en', 'fr', 'es')"""

ORACLES["dom_links"] = """SELECT p_partkey AS page_id, CAST(n AS BIGINT) AS rank, '/' || n || '/' || p_partkey AS href
FROM part, (VALUES (1), (2)) t(n)"""

ORACLES["dom_cards"] = """SELECT p_partkey AS page_id, CAST(0 AS BIGINT) AS pos, p_name AS name, p_type AS ingredients FROM part
UNION ALL SELECT p_partkey, 2, p_brand || ' & Co\u00b7\u00e9', p_type FROM part
UNION ALL SELECT p_partkey, 3, p_name, '' FROM part
UNION ALL SELECT p_partkey, 4, p_brand, p_brand FROM part"""

_LONG = "CASE WHEN length({0}) > 10 THEN {0} END"
ORACLES["leaflet_records"] = f"""SELECT p_type AS search_key, '/drug/' || p_partkey AS url, upper(p_name) AS trade_name, p_brand AS brand,
  {_LONG.format("(p_name || chr(10) || p_brand)")} AS leaflet,
  CASE WHEN p_size <= 40 THEN {_LONG.format("('Size ' || p_size)")} END AS practitioner FROM part"""

ORACLES["stream_records"] = ORACLES["leaflet_records"].replace("SELECT p_type AS search_key", "SELECT p_type || ' /drug/' || p_partkey AS search_key")

HARVEST = f"""hv AS (
  SELECT doc_id, text, lang, source, p_partkey - doc_id AS shift, p_type, p_type || ', ' || lower(p_type) AS sci, p_name || ', x' AS trade
  FROM documents JOIN part ON p_partkey IN (doc_id + 1, doc_id + 2)),
leaf AS (
  SELECT * FROM (SELECT doc_id AS ord, sci AS search_key, {d.leaflet_norm('text')} AS leaflet, lang || ' leaflet' AS practitioner,
                        lang AS route_ar FROM hv WHERE shift = 1 AND p_type NOT LIKE 'SMALL%')
  WHERE NOT regexp_matches(leaflet, {_P})),
bleaf AS (
  SELECT doc_id AS ord, trade AS search_key, {d.strip('text')} AS leaflet, 'ar-' || lang AS route_ar
  FROM hv WHERE shift = 2 AND length({d.strip('text')}) > 10),
pages_d AS (
  SELECT doc_id, sci AS source, 'Usual Adult Dose' || chr(10) || text || chr(10) || ' Renal Dose Adjustments ' || chr(10) || source AS page
  FROM hv WHERE shift = 1 AND lang IN ('en', 'fr', 'es')),
{SECTIONS},
dos AS (
  SELECT doc_id AS ord, source AS search_key,
         {d.dosage_ctx(*[d.dosage_norm(c) for c in ("adult", "pediatric", "renal", "liver")])} AS dosage_context
  FROM sections),
reg AS (SELECT record_id, "Trade Name" AS trade_name, "Trade Name" AS brand_key, "Scientific Name" AS scientific_name,
               "Scientific Name" AS sci_key FROM ({REGCLEAN}))"""
ORACLES["master_chain"] = _with(RAWREG, HARVEST, MASTER) + """SELECT record_id, trade_name, scientific_name, leaflet, practitioner,
  route_ar, leaflet_before_gap, intl_dosage FROM master"""
