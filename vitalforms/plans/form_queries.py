"""Queries over recognised forms: rendering, extraction, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalforms.catalog import fields as fcat
from vitalforms.catalog import forms as formcat
from vitalforms.catalog import labels as lcat
from vitalforms.catalog.keywords import FORM_KEYWORDS, FORM_KEYWORDS_LONG, SEX_KEYWORDS
from vitalforms.functions import codes, names, patterns
from vitalforms.functions import text as tx
from vitalforms.operators import classify, compose, extract, forms
from vitalforms.plans import digitize as digit
from vitalforms.plans import tables as t
from vitalforms.plans.registry import RAW, query, with_ctes

WS = "' ' || chr(9) || chr(10) || chr(13)"


def _pick(keys):
    known = [k for k in keys if k in t.RAW_FIELDS]
    return "coalesce(" + ", ".join([f"nullif(trim({k}), '')" for k in known] + ["''"]) + ")"


def _text_sql(kind):
    parts = [("'" + lit.replace("'", "''").replace("\n", "' || chr(10) || '") + "'") if lit else _pick(keys)
             for lit, keys in compose.template_parts(compose.FORM_TEXT[kind])]
    return " || ".join(parts)


def _texts(kind):
    return with_ctes(RAW, f"texts AS (SELECT doc_id, {_text_sql(kind)} AS form_text FROM raw)")


def _register_render(kind, name):
    @query(name, _texts(kind) + "SELECT doc_id, form_text FROM texts")
    def render(spark, d):
        return compose.with_rendered(t.field_dictionaries(spark, d), "fields", kind).select("doc_id", "form_text")


for _kind, _name in (("birth", "form_render_birth"), ("death", "form_render_death"),
                     ("marriage", "form_render_marriage"), ("groom", "form_render_groom"),
                     ("bride", "form_render_bride")):
    _register_render(_kind, _name)


def _form_texts(spark, d, kind):
    return compose.with_rendered(t.field_dictionaries(spark, d), "fields", kind).select("doc_id", "form_text")


def _case_sql(keywords, low="lower(line)"):
    arms = " ".join(f"WHEN contains({low}, '{k}') THEN '{v}'" for k, v in keywords)
    return f"CASE {arms} END"


def _scan_sql(form):
    return (f"lines AS (SELECT doc_id, unnest(string_split(form_text, chr(10))) AS raw_line, "
            f"generate_subscripts(string_split(form_text, chr(10)), 1) AS n FROM texts), "
            f"tagged AS (SELECT doc_id, n, {_case_sql(lcat.KEYWORDS[form])} AS label, "
            f"trim(substr(line, instr(line, ':') + 1), {WS}) AS value "
            f"FROM (SELECT doc_id, n, trim(raw_line, {WS}) AS line FROM lines) WHERE contains(line, ':')), "
            f"scan AS (SELECT doc_id, label, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY n) AS k "
            f"FROM tagged WHERE label IS NOT NULL AND value <> '') WHERE k = 1)")


_PATTERN_SQL = {
    "date": f"nullif(regexp_extract(form_text, '{patterns.DATE}', 0), '')",
    "sex": f"nullif(regexp_extract(form_text, '{patterns.SEX}', 0), '')",
    "age": f"nullif(regexp_extract(form_text, '{patterns.AGE}', 1), '')",
    "citizenship": f"nullif(regexp_extract(form_text, '{patterns.CITIZENSHIP}', 0), '')",
    "civil_status": f"nullif(regexp_extract(form_text, '{patterns.CIVIL_STATUS}', 0), '')",
    "religion": f"nullif(regexp_extract(form_text, '{patterns.RELIGION}', 0), '')",
}


def _capital(e):
    return f"(upper(substr({e}, 1, 1)) || lower(substr({e}, 2)))"


def _labels_sql(form):
    """(doc_id, one column per label) with fallbacks and assembled names."""
    labels = list(dict.fromkeys(v for _, v in lcat.KEYWORDS[form]))
    wide = ", ".join(f"max(CASE WHEN label = '{x}' THEN value END) AS {x}" for x in labels)
    filled = []
    by_label = {v: k for k, v in lcat.PATTERN_FILL[form].items()}
    for x in labels:
        if x in by_label:
            e = _PATTERN_SQL[by_label[x]]
            if by_label[x] in ("sex", "citizenship", "civil_status"):
                e = _capital(e)
            filled.append(f"coalesce(w.{x}, {e}) AS {x}")
        else:
            filled.append(f"w.{x}")
    people = ", ".join(
        "nullif(concat_ws(' ', " + ", ".join(
            f"nullif(trim({p}_{part}), '')" if f"{p}_{part}" in labels else "NULL"
            for part in ("FIRST", "MIDDLE", "LAST")) + f"), '') AS {o}"
        for p, o in lcat.NAME_GROUPS[form])
    return (f"w AS (SELECT doc_id, {wide} FROM scan GROUP BY doc_id), "
            f"full_labels AS (SELECT texts.doc_id, {', '.join(filled)} FROM texts LEFT JOIN w USING (doc_id)), "
            f"got AS (SELECT *, {people} FROM full_labels)")


@query("keyword_scan", _texts("birth").rstrip() + ", " + _scan_sql("102") + " SELECT doc_id, label, value FROM scan")
def keyword_scan(spark, d):
    scanned = extract.with_keyword_scan(_form_texts(spark, d, "birth"), "form_text", lcat.KEYWORDS["102"])
    return extract.label_rows(scanned, "doc_id")


def _outputs(prefix, table):
    return ", ".join(f"{prefix}_{a} AS {b}" for a, b in table)


@query("form_extract_102", _texts("birth").rstrip() + ", " + _scan_sql("102") + ", " + _labels_sql("102")
       + f" SELECT doc_id, {_outputs('F102', lcat.OUTPUT_1A)}, name_of_child, name_of_mother, name_of_father FROM got")
def form_extract_102(spark, d):
    got = extract.with_labels(_form_texts(spark, d, "birth"), "form_text", "102")
    return forms.flatten_form(got.withColumn("form", forms.form_1a(F.col("labels"))), "doc_id", "form")


@query("form_extract_103", _texts("death").rstrip() + ", " + _scan_sql("103") + ", " + _labels_sql("103")
       + f" SELECT doc_id, {_outputs('F103', lcat.OUTPUT_2A)}, name_of_deceased FROM got")
def form_extract_103(spark, d):
    got = extract.with_labels(_form_texts(spark, d, "death"), "form_text", "103")
    return forms.flatten_form(got.withColumn("form", forms.form_2a(F.col("labels"))), "doc_id", "form")


# Marriage texts whose lines name the role, as the role keywords expect.
_ROLE_TEXT = {
    r: "\n".join(f"{r.capitalize()} {label}: {{{key}}}" for label, key in (
        ("Name (First)", f"{r}_first_name"), ("Name (Middle)", f"{r}_middle_name"),
        ("Name (Last)", f"{r}_last_name"), ("Age", f"{r}_age"),
        ("Citizenship", f"{r}_nationality|{r}_citizenship"),
        ("Father (First)", f"{r}_father_first"), ("Father (Last)", f"{r}_father_last"),
        ("Mother (First)", f"{r}_mother_first"), ("Mother (Last)", f"{r}_mother_last"))) + "\n"
    for r in ("husband", "wife")
}
_ROLE_MARRIAGE = ("Registry No.: {registry_number|registry_no}\n" + _ROLE_TEXT["husband"] + _ROLE_TEXT["wife"]
                  + "15. PLACE OF MARRIAGE: {place_marriage_city}\n"
                  "16. DATE OF MARRIAGE: {date_marriage_month} {date_marriage_day}, {date_marriage_year}\n")
compose.FORM_TEXT.setdefault("marriage_roles", _ROLE_MARRIAGE)


@query("form_extract_97", _texts("marriage_roles").rstrip() + ", " + _scan_sql("97") + ", " + _labels_sql("97")
       + " SELECT doc_id, " + ", ".join(
           [f"F97_{r.upper()}_{a} AS {r}_{b}" for r in ("husband", "wife") for a, b in lcat.OUTPUT_3A_SPOUSE]
           + [f"{r}_name{s}" for r in ("husband", "wife") for s in ("", "_of_father", "_of_mother")])
       + f", {_outputs('F97', lcat.OUTPUT_3A_EVENT)} FROM got")
def form_extract_97(spark, d):
    got = extract.with_labels(_form_texts(spark, d, "marriage_roles"), "form_text", "97")
    return forms.flatten_form(got.withColumn("form", forms.form_3a(F.col("labels"))), "doc_id", "form")


@query("form_extract_90", _texts("groom").rstrip() + ", " + _scan_sql("90_groom") + ", " + _labels_sql("90_groom")
       + f" SELECT doc_id, {_outputs('F90_GROOM', lcat.OUTPUT_90_APPLICANT)}, {_outputs('F90', lcat.OUTPUT_1A[:2])}, "
       "name_of_applicant, name_of_father, maiden_name_of_mother FROM got")
def form_extract_90(spark, d):
    got = extract.with_labels(_form_texts(spark, d, "groom"), "form_text", "90_groom")
    return got.select("doc_id", forms.applicant(F.col("labels"), "groom").alias("a")).select("doc_id", "a.*")


@query("form_extract_sections", with_ctes(RAW) + f"""
SELECT doc_id, {_pick(('registry_number', 'registry_no'))} AS registry_number,
  nullif(concat_ws(' ', {', '.join(f"nullif(trim(husband_{p}_name), '')" for p in ('first', 'middle', 'last'))}), '') AS husband_name,
  nullif(concat_ws(' ', {', '.join(f"nullif(trim(wife_{p}_name), '')" for p in ('first', 'middle', 'last'))}), '') AS wife_name,
  nullif(trim(wife_age), '') AS wife_age, nullif(trim(husband_nationality), '') AS husband_nationality,
  concat_ws(' ', husband_father_first, husband_father_last) AS husband_name_of_father,
  concat_ws(' ', wife_mother_first, wife_mother_last) AS wife_name_of_mother FROM raw""")
def form_extract_sections(spark, d):
    """Two-column forms read by section, with inline names split."""
    got = extract.with_labels(_form_texts(spark, d, "marriage"), "form_text", "97", mode="sections")
    flat = forms.flatten_form(got.withColumn("form", forms.form_3a(F.col("labels"))), "doc_id", "form")
    return flat.select("doc_id", "registry_number", "husband_name", "wife_name", "wife_age",
                       "husband_nationality", "husband_name_of_father", "wife_name_of_mother")


@query("pattern_search", with_ctes(
    "texts AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' born March ' || (doc_id % 28 + 1) || ', 1990 male single' "
    "WHEN 1 THEN ' on 3/14/2001 FEMALE age ' || (doc_id % 90) || ' Born Again' WHEN 2 THEN ' LCR-2024-' || lpad(CAST(doc_id % 9999 AS VARCHAR), 4, '0') "
    "|| ' filipino' ELSE '' END AS form_text FROM documents)") + f"""
SELECT doc_id, {_PATTERN_SQL['date']} AS date, {_capital(_PATTERN_SQL['sex'])} AS sex, {_PATTERN_SQL['age']} AS age,
  {_capital(_PATTERN_SQL['citizenship'])} AS citizenship, {_capital(_PATTERN_SQL['civil_status'])} AS civil_status,
  {_PATTERN_SQL['religion']} AS religion, nullif(regexp_extract(form_text, '{patterns.REGISTRY_NUMBER}', 0), '') AS registry_number
FROM texts""")
def pattern_search(spark, d):
    k = F.col("doc_id")
    tail = (F.when(k % 4 == 0, F.concat(F.lit(" born March "), (k % 28 + 1).cast("string"), F.lit(", 1990 male single")))
            .when(k % 4 == 1, F.concat(F.lit(" on 3/14/2001 FEMALE age "), (k % 90).cast("string"), F.lit(" Born Again")))
            .when(k % 4 == 2, F.concat(F.lit(" LCR-2024-"), F.lpad((k % 9999).cast("string"), 4, "0"), F.lit(" filipino")))
            .otherwise(""))
    docs = t.read(spark, d, "documents", t.wanted_partitions(spark)).select("doc_id", F.concat("text", tail).alias("form_text"))
    x = F.col("form_text")
    return docs.select("doc_id", *[patterns.FINDERS[n](x).alias(n) for n in (
        "date", "sex", "age", "citizenship", "civil_status", "religion")],
        patterns.find_registry_number(x).alias("registry_number"))


@query("entity_fill", with_ctes(RAW) + """
, e AS (SELECT doc_id, child_first_name || ' ' || trim(mother_last_name) AS person, place_birth_city AS place, dob_year AS dt FROM raw)
SELECT doc_id, 'F102_CHILD_FIRST' AS label, regexp_extract(person, '^(\\S+)', 1) AS value FROM e
UNION ALL SELECT doc_id, 'F102_CHILD_LAST', regexp_extract(person, '(\\S+)$', 1) FROM e
UNION ALL SELECT doc_id, 'F102_CHILD_MIDDLE', regexp_extract(person, '^\\S+ (.+) \\S+$', 1) FROM e WHERE len(string_split(person, ' ')) > 2
UNION ALL SELECT doc_id, 'F102_PLACE_OF_BIRTH', place FROM e
UNION ALL SELECT doc_id, 'F102_DATE_OF_BIRTH', dt FROM e
UNION ALL SELECT doc_id, 'name_of_child', person FROM e""")
def entity_fill(spark, d):
    """Forms without lines, filled from an entity table (first hit per type)."""
    raw = t.raw_columns(spark, d)
    rows = raw.select("doc_id", F.inline(F.array(
        F.struct(F.lit("PERSON").alias("label"), F.concat("child_first_name", F.lit(" "), F.trim("mother_last_name")).alias("text"), F.lit(5).alias("start")),
        F.struct(F.lit("PERSON").alias("label"), F.lit("Someone Else").alias("text"), F.lit(90).alias("start")),
        F.struct(F.lit("LOC").alias("label"), F.col("place_birth_city").alias("text"), F.lit(40).alias("start")),
        F.struct(F.lit("DATE").alias("label"), F.col("dob_year").alias("text"), F.lit(60).alias("start")))))
    docs = raw.select("doc_id", F.lit("unreadable scan").alias("form_text"))
    joined = docs.join(extract.generic_entities(rows, "doc_id"), "doc_id", "left")
    return extract.label_rows(extract.with_labels(joined, "form_text", "102", entities="entities"), "doc_id")


@query("entity_groups", """
WITH e AS (SELECT user_id AS doc_id, event_type AS label, trim(props) AS text, min(event_id) AS s FROM events GROUP BY 1, 2, 3)
SELECT doc_id, label, string_agg(text, '|' ORDER BY s) AS texts FROM e GROUP BY 1, 2""")
def entity_groups(spark, d):
    rows = t.read(spark, d, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("label"), F.col("props").alias("text"),
        F.col("event_id").alias("start"))
    return extract.ordered_entities(rows, "doc_id").select("doc_id", "label", F.array_join("texts", "|").alias("texts"))


# --- classification ----------------------------------------------------------

def _score(text, words):
    return " + ".join(f"CAST(contains(lower({text}), '{w.lower()}') AS INT)" for w in words)


def _best(scores):
    names_ = list(scores)
    top = f"greatest({', '.join(scores[n] for n in names_)})"
    arms = " ".join(f"WHEN {scores[n]} = {top} THEN '{n}'" for n in names_[:-1])
    return f"CASE {arms} ELSE '{names_[-1]}' END"


# Documents with a phrase of one of the forms, so that every class occurs.
_PHRASES = ("Certificate of Live Birth", "date of death", "Solemnizing Officer", "nothing", "newborn PSA")
_CLASS_TEXT = "text || ' ' || split_part('" + ",".join(_PHRASES) + "', ',', CAST(doc_id % 5 + 1 AS INT))"


def _class_docs(spark, d):
    return t.read(spark, d, "documents").selectExpr("doc_id", f"{_CLASS_TEXT} AS body")


def _classes_sql(table):
    scores = ", ".join(f"{_score('body', w)} AS s_{c}" for c, w in table.items())
    return (f"WITH b AS (SELECT doc_id, {_CLASS_TEXT} AS body FROM documents), s AS (SELECT doc_id, {scores} FROM b) "
            f"SELECT doc_id, {_best({c: f's_{c}' for c in table})} AS form_code, "
            + ", ".join(f"s_{c} AS score_{c}" for c in table) + " FROM s")


@query("keyword_classify", _classes_sql(FORM_KEYWORDS))
def keyword_classify(spark, d):
    out = classify.with_keyword_class(_class_docs(spark, d), "body", keep_scores=True)
    return out.drop("body")


@query("keyword_classify_long", _classes_sql(FORM_KEYWORDS_LONG))
def keyword_classify_long(spark, d):
    out = classify.with_keyword_class(_class_docs(spark, d), "body", FORM_KEYWORDS_LONG, keep_scores=True)
    return out.drop("body")


@query("classify_proba", f"SELECT doc_id, form_code, form_code AS label, 1.0 AS confidence, "
       + ", ".join(f"CAST(form_code = '{c}' AS DOUBLE) AS p_{c}" for c in formcat.TEXT_CLASSES)
       + f" FROM ({_classes_sql(FORM_KEYWORDS)})", casts="confidence DOUBLE")
def classify_proba(spark, d):
    out = classify.classify(_class_docs(spark, d), "body", "doc_id")
    return out.select("doc_id", "form_code", "label", "confidence",
                      *[F.col("probabilities")[c].alias(f"p_{c}") for c in formcat.TEXT_CLASSES])


@query("sex_route", _texts("groom").rstrip() + ", s AS (SELECT doc_id, "
       + ", ".join(f"{_score('form_text', w)} AS s_{c}" for c, w in SEX_KEYWORDS.items())
       + f" FROM texts) SELECT doc_id, {_best({c: f's_{c}' for c in SEX_KEYWORDS})} AS role FROM s")
def sex_route(spark, d):
    return classify.with_role(_form_texts(spark, d, "groom"), "form_text").select("doc_id", "role")


# --- whole pipeline ------------------------------------------------------------

@query("digitize", with_ctes(RAW) + f"""
, typed AS (SELECT raw.*, {t.ORDER_TYPE} AS form_type FROM raw JOIN orders ON doc_id = o_orderkey)
SELECT doc_id, form_type, CASE form_type WHEN 'birth' THEN {_pick(('registry_number', 'registry_no'))} ELSE
    {_pick(('registry_no',))} END AS registry_number,
  CASE form_type WHEN 'birth' THEN dob_month || ' ' || dob_day || ', ' || dob_year
    WHEN 'death' THEN dod_month || ' ' || dod_day || ', ' || dod_year
    ELSE date_marriage_month || ' ' || date_marriage_day || ', ' || date_marriage_year END AS event_date
FROM typed""")
def digitize(spark, d):
    done = digit.digitize(t.typed_dictionaries(spark, d))
    get = tx.map_getter("labels")
    kind = F.col("form_type")
    prefix = {"birth": "F102", "death": "F103", "marriage": "F97"}
    event = {"birth": "DATE_OF_BIRTH", "death": "DATE_OF_DEATH", "marriage": "DATE_OF_MARRIAGE"}
    reg, when = F, F
    for k, p in prefix.items():
        reg = reg.when(kind == k, get(f"{p}_REGISTRY_NO"))
        when = when.when(kind == k, get(f"{p}_{event[k]}"))
    return done.select("doc_id", "form_type", reg.alias("registry_number"), when.alias("event_date"))


@query("digitize_json")
def digitize_json(spark, d):
    return digit.digitize(t.typed_dictionaries(spark, d), mode="sections").select(
        "doc_id", "form_type", "form_code", "form_json")


_STORED = {}
for _t, _h in (("birth", "1A"), ("death", "2A"), ("marriage", "3A")):
    _own = t.KEYS_OF_TYPE[_t]
    _cols = {}
    for _target, _src in fcat.STORED[_h].items():
        _known = [k for k in _src if k in _own]
        if _known:
            _cols[_target] = "coalesce(" + ", ".join(f"nullif({k}, '')" for k in _known) + ")"
    for _k in _own:
        if _k not in fcat.STORED[_h]:
            _cols[_k] = _k
    _STORED[_t] = _cols


@query("stored_fields", with_ctes(RAW) + ", typed AS (SELECT raw.*, " + t.ORDER_TYPE
       + " AS form_type FROM raw JOIN orders ON doc_id = o_orderkey), l AS ("
       + " UNION ALL ".join(
           f"SELECT doc_id, '{target}' AS field_name, {e} AS extracted_value, "
           f"{0.9 if target in t.KEYS_OF_TYPE[kind] else 0.0} AS conf, "
           f"{target + ' IS NOT NULL' if target in t.KEYS_OF_TYPE[kind] else 'false'} AS own "
           f"FROM typed WHERE form_type = '{kind}'"
           for kind, cols in _STORED.items() for target, e in cols.items())
       + ") SELECT doc_id, field_name, extracted_value, CASE WHEN own THEN conf ELSE 0.0 END AS ner_confidence_score "
         "FROM l WHERE trim(extracted_value) <> ''", casts="ner_confidence_score DOUBLE")
def stored_fields(spark, d):
    return digit.stored_rows(digit.with_text(t.typed_dictionaries(spark, d)))


_CERT = with_ctes(RAW) + f"""
, c AS (SELECT raw.*, doc_id // 2 AS application_id, CASE WHEN (doc_id // 2) % 11 = 0 THEN 'groom'
  WHEN doc_id % 2 = (CASE WHEN (doc_id // 2) % 7 = 0 THEN 1 ELSE 0 END) THEN 'groom' ELSE 'bride' END AS role FROM raw),
n AS (SELECT application_id, count(*) FILTER (role = 'groom') AS g, count(*) FILTER (role = 'bride') AS b FROM c GROUP BY 1)
"""


@query("licence_pairs", _CERT + """
SELECT application_id, max(dob_month || ' ' || dob_day || ', ' || dob_year) FILTER (role = 'groom') AS groom_born,
  max(dob_month || ' ' || dob_day || ', ' || dob_year) FILTER (role = 'bride') AS bride_born
FROM c JOIN n USING (application_id) WHERE g = 1 AND b = 1 GROUP BY 1""")
def licence_pairs(spark, d):
    good, _ = digit.licences(t.certificates(spark, d), mode="sections")
    return good.select("application_id", F.col("groom.date_of_birth").alias("groom_born"),
                       F.col("bride.date_of_birth").alias("bride_born"))


@query("licence_rejects", _CERT + """
SELECT application_id, role, CASE WHEN g = 0 OR b = 0 THEN 'missing role' ELSE 'duplicate role' END AS reason
FROM c JOIN n USING (application_id) WHERE g <> 1 OR b <> 1""")
def licence_rejects(spark, d):
    _, bad = digit.licences(t.certificates(spark, d), mode="sections")
    return bad.select("application_id", "role", "reason")


@query("licence_page_fields", """
WITH p AS (SELECT o_orderkey AS k, 'June ' || (o_orderkey % 28 + 1) || ', ' || year(o_orderdate) AS dom,
  'St. Ann Church, Capas' AS pom, CASE WHEN o_custkey % 2 = 0 THEN 'Ana' END AS first_name, c_mktsegment AS seg, c_name
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT k, 'June ' || (k % 28 + 1) AS marriage_day, trim(split_part(dom, ',', 2)) AS marriage_month,
  'St. Ann Church' AS marriage_venue, 'Capas' AS marriage_city, 'Capas' AS city_municipality,
  coalesce(first_name, 'Top ' || seg) AS bride_first, c_name AS bride_residence, '' AS groom_first, '' AS license_no FROM p""")
def licence_page_fields(spark, d):
    o, c = t.read(spark, d, "orders"), t.read(spark, d, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    raw = F.create_map(
        F.lit("date_of_marriage"), F.concat(F.lit("June "), (F.col("o_orderkey") % 28 + 1).cast("string"), F.lit(", "),
                                            F.year("o_orderdate").cast("string")),
        F.lit("place_of_marriage"), F.lit("St. Ann Church, Capas"),
        F.lit("bride_first"), F.concat(F.lit("Top "), "c_mktsegment"))
    person = F.create_map(F.lit("first_name"), F.when(F.col("o_custkey") % 2 == 0, "Ana"),
                          F.lit("address"), F.col("c_name"))
    pages = j.select(F.col("o_orderkey").alias("k"), raw.alias("raw"), person.alias("person"))
    bride = pages.withColumn("page", F.expr(compose.licence_page("raw", "person", "bride")))
    empty = bride.withColumn("other", F.create_map().cast("map<string,string>"))
    whole = empty.select("k", F.expr(compose.licence_pages("other", "page")).alias("m"))
    return whole.select("k", *[F.col("m")[f].alias(f) for f in (
        "marriage_day", "marriage_month", "marriage_venue", "marriage_city", "city_municipality",
        "bride_first", "bride_residence", "groom_first", "license_no")])


# --- screen forms, reports -------------------------------------------------------

@query("screen_form", with_ctes(RAW) + """
SELECT doc_id, trim(concat_ws(' ', nullif(child_first_name, ''), nullif(child_middle_name, ''), nullif(child_last_name, ''))) AS f1a_child_name,
  dob_month || ' ' || dob_day || ', ' || dob_year AS f1a_dob, concat_ws(', ', place_birth_city, n) AS f1a_pob,
  age AS f2a_age, concat_ws(', ', nullif(place_death_hospital, ''), n) AS f2a_pod,
  trim(concat_ws(' ', husband_first_name, nullif(husband_middle_name, ''), husband_last_name)) AS f3a_husband_name,
  concat_ws(', ', place_marriage_city, n) AS f3a_pom
FROM (SELECT *, place_birth_province AS n FROM raw)""")
def screen_form(spark, d):
    raw = t.raw_columns(spark, d)
    src = {"child_first": "child_first_name", "child_middle": "child_middle_name", "child_last": "child_last_name",
           "dob_month": "dob_month", "dob_day": "dob_day", "dob_year": "dob_year", "pob_city": "place_birth_city",
           "pob_province": "place_birth_province", "age_years": "age", "pod_hospital": "place_death_hospital",
           "pod_province": "place_death_province", "groom_first": "husband_first_name",
           "groom_middle": "husband_middle_name", "groom_last": "husband_last_name",
           "marriage_city": "place_marriage_city", "marriage_province": "place_marriage_province"}
    pairs = [x for k, v in src.items() for x in (F.lit(k), F.col(v))]
    stored = raw.select("doc_id", F.create_map(*pairs).alias("f"))
    shown = {h: compose.screen_fields("f", h) for h in ("1A", "2A", "3A")}
    wanted = {"f1a_child_name": "1A", "f1a_dob": "1A", "f1a_pob": "1A", "f2a_age": "2A", "f2a_pod": "2A",
              "f3a_husband_name": "3A", "f3a_pom": "3A"}
    return stored.select("doc_id", *[F.expr(shown[h][c]).alias(c) for c, h in wanted.items()])


def _cert_line(label, expr):
    return f"'{label}: ' || coalesce(nullif({expr}, ''), '{compose.BLANK}')"


@query("certificate_report", with_ctes(RAW) + "SELECT doc_id, 'LCR Form No. 1A (Birth available)' || chr(10) || "
       "'TO WHOM IT MAY CONCERN:' || chr(10) || 'We certify that, among others, the following facts of birth appear in "
       "our Registry of Births of this office:' || chr(10) || " + " || chr(10) || ".join([
           _cert_line("Registry Number", "coalesce(nullif(registry_number, ''), registry_no)"),
           _cert_line("Date of Registration", "date_of_registration"),
           _cert_line("Name of Child", "''"), _cert_line("Sex", "sex"),
           _cert_line("Date of Birth", "dob_month || ' ' || dob_day || ', ' || dob_year"),
           _cert_line("Place of Birth", "''"), _cert_line("Name of Mother", "''"),
           _cert_line("Nationality of Mother", "mother_citizenship"), _cert_line("Name of Father", "''"),
           _cert_line("Nationality of Father", "father_citizenship"),
           _cert_line("Date of Marriage of Parents", "parents_marriage_month || ' ' || parents_marriage_day || ', ' || parents_marriage_year"),
           _cert_line("Place of Marriage of Parents", "concat_ws(', ', parents_marriage_city, parents_marriage_province)"),
           f"'This certification is issued to {compose.BLANK} upon his/her request.'"])
       + " AS report, 'Form 1A — ' AS title FROM raw")
def certificate_report(spark, d):
    stored = t.field_dictionaries(spark, d).select("doc_id", F.expr(compose.stored_fields("fields", "1A", False)).alias("f"))
    return stored.select("doc_id", F.expr(compose.certificate("f", "1A")).alias("report"),
                         F.expr(compose.preview_title("f", "1A")).alias("title"))


# --- names, dates, places ----------------------------------------------------------

@query("name_join", with_ctes(RAW) + """
SELECT doc_id, concat_ws(' ', nullif(trim(child_first_name), ''), nullif(trim(child_middle_name), ''), nullif(trim(child_last_name), '')) AS full_name FROM raw""")
def name_join(spark, d):
    raw = t.raw_columns(spark, d)
    return raw.select("doc_id", names.join_name(F.col("child_first_name"), F.col("child_middle_name"),
                                                F.col("child_last_name")).alias("full_name"))


@query("name_split", """
WITH p AS (SELECT p_partkey, string_split(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_type ELSE p_type END, ' ') AS w FROM part)
SELECT p_partkey, w[1] AS first, CASE WHEN len(w) > 2 THEN array_to_string(w[2:len(w) - 1], ' ') END AS middle,
  CASE WHEN len(w) > 1 THEN w[len(w)] END AS last FROM p""")
def name_split(spark, d):
    k = F.col("p_partkey") % 3
    full = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.col("p_type"))
    return t.read(spark, d, "part").select("p_partkey", names.split_name(full).alias("n")).select("p_partkey", "n.*")


@query("date_place", """
SELECT s_suppkey, trim('' || ' ' || '' || ', ' || CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE s_name END) AS raw_date,
  CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE ', ' || s_name END AS clean_date,
  CASE WHEN s_nationkey % 4 = 0 THEN s_name ELSE s_name || ', Tarlac' END AS place,
  CASE WHEN s_nationkey % 2 = 0 THEN 'March 5, 2001' ELSE '3/5/2001' END AS free_text, DATE '2001-03-05' AS parsed
FROM supplier""")
def date_place(spark, d):
    from vitalforms.functions import fragments as sql

    s = t.read(spark, d, "supplier").select(
        "s_suppkey", F.when(F.col("s_nationkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("y"), "s_name",
        F.when(F.col("s_nationkey") % 4 == 0, "0").otherwise("Tarlac").alias("p"),
        F.when(F.col("s_nationkey") % 2 == 0, "March 5, 2001").otherwise("3/5/2001").alias("free_text"))
    raw = s.withColumn("raw_date", F.expr(sql.record_date("''", "''", "y")))
    return raw.select("s_suppkey", "raw_date", tx.blank_if_separators(F.col("raw_date")).alias("clean_date"),
                      F.expr(sql.record_place("s_name", "p")).alias("place"), "free_text",
                      names.parse_date(F.col("free_text")).alias("parsed"))


@query("comma_parts", """
SELECT s_suppkey, trim(list_filter([trim(x) FOR x IN string_split(s, ',')], lambda x: x <> '')[1]) AS first_part,
  coalesce(list_filter([trim(x) FOR x IN string_split(s, ',')], lambda x: x <> '')[3], '') AS third_part
FROM (SELECT s_suppkey, ' , ' || s_name || ', ,b' || CASE WHEN s_suppkey % 2 = 0 THEN ',c' ELSE '' END AS s FROM supplier)""")
def comma_parts(spark, d):
    s = t.read(spark, d, "supplier").select("s_suppkey", F.concat(
        F.lit(" , "), "s_name", F.lit(", ,b"), F.when(F.col("s_suppkey") % 2 == 0, ",c").otherwise("")).alias("s"))
    return s.select("s_suppkey", tx.comma_part(F.col("s"), 0).alias("first_part"),
                    tx.comma_part(F.col("s"), 2).alias("third_part"))


@query("label_codes", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'FORM_OTHER' WHEN 1 THEN 'FORM_HEADER' WHEN 2 THEN 'FORM_QUESTION' WHEN 3 THEN 'FORM_ANSWER' ELSE 'FORM_OTHER' END AS by_number,
  CASE event_type WHEN 'view' THEN 'FORM_OTHER' WHEN 'click' THEN 'FORM_ANSWER' ELSE 'FORM_HEADER' END AS by_name,
  CASE WHEN event_id % 50 < 47 THEN substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabdefghnqrt', CAST(event_id % 50 + 1 AS INT), 1) END AS character,
  CASE event_id % 4 WHEN 0 THEN '1A' WHEN 1 THEN '2A' WHEN 2 THEN '3A' ELSE '1A' END AS form_hint,
  event_id % 4 = 3 AS is_page_label
FROM events""")
def label_codes(spark, d):
    k = F.col("event_id")
    name = F.when(F.col("event_type") == "view", "Misc").when(F.col("event_type") == "click", "ANSWER").otherwise("header")
    label = codes.lookup({0: "F102_SEX", 1: "F103_AGE", 2: "F97_REGISTRY_NO", 3: "FORM_OTHER"}, (k % 4).cast("int"))
    return t.read(spark, d, "events").select(
        "event_id", codes.page_label_of_number(k % 5).alias("by_number"), codes.page_label(name).alias("by_name"),
        codes.character_class(k % 50).alias("character"), codes.hint_of_label(label).alias("form_hint"),
        codes.is_page_label(label).alias("is_page_label"))


@query("char_index", """
WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS n FROM benchmark)
SELECT item_id, string_agg(CAST(ord(ch) - 31 AS VARCHAR), ' ' ORDER BY n) AS indices, count(*) AS size
FROM c WHERE ord(ch) BETWEEN 32 AND 126 GROUP BY 1""")
def char_index(spark, d):
    coded = t.read(spark, d, "benchmark").select("item_id", tx.char_index(F.col("text")).alias("i"))
    return coded.select("item_id", F.array_join(F.transform("i", lambda x: x.cast("string")), " ").alias("indices"),
                        F.size("i").cast("long").alias("size"))


@query("path_parts", """
SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, replace(regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\\.[^.]*$', ''), '_', ' ') AS label,
  lower(regexp_extract(p, '\\.([^.]+)$', 1)) AS ext, CASE WHEN contains(p, 'form2a') THEN 'form2a' WHEN contains(p, 'form90') THEN 'form90' ELSE 'form1a' END AS folder
FROM (SELECT page_id, url, split_part('a/form2a/,b/form90/,c/', ',', CAST(page_id % 3 + 1 AS INT)) || 'scan_' || page_id || '.JPG' AS p FROM pages)""")
def path_parts(spark, d):
    from vitalforms.operators.corpus import folder_of

    p = t.read(spark, d, "pages").selectExpr(
        "url", "page_id", "split_part('a/form2a/,b/form90/,c/', ',', CAST(page_id % 3 + 1 AS INT)) || 'scan_' || "
        "CAST(page_id AS STRING) || '.JPG' AS p")
    return p.select("page_id", tx.basename(F.col("url")).alias("base"), tx.stem_label(F.col("p")).alias("label"),
                    tx.extension(F.col("p")).alias("ext"), folder_of(F.col("p")).alias("folder"))
