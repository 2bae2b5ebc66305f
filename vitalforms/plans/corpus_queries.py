"""Queries over span corpora, splits, pools, generators and the text model."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalforms.functions import spans as sp
from vitalforms.operators import compose, corpus, model
from vitalforms.operators import spans as span_ops
from vitalforms.plans import tables as t
from vitalforms.plans.registry import DATA, RAW, query, with_ctes
from vitalforms.session import work_dir
from vitalforms.store.models import ModelRegistry

# --- spans ---------------------------------------------------------------------

def _spans(spark, d):
    """Four spans per turn: blank edges, one symbol, too long, and a cut word."""
    turns = t.read(spark, d, "conversations").selectExpr(
        "conv_id * 100 + turn AS doc_id", "role AS source", "'  ' || text || ' .' AS text")
    n = F.length("text")
    spans = F.array(
        sp.span(F.lit(0), F.least(n, F.lit(40)), F.lit("A")), sp.span(n - 1, n, F.lit("B")),
        sp.span(F.lit(0), n, F.lit("C")), sp.span(F.lit(3), F.lit(9), F.lit("D")),
        sp.span(F.lit(0), F.lit(2), F.lit("E")))
    return turns.withColumn("spans", spans)


_SPANS = """tx AS (SELECT conv_id * 100 + turn AS doc_id, role AS source, '  ' || text || ' .' AS text FROM conversations),
sp AS (SELECT doc_id, source, text, unnest(['A', 'B', 'C', 'D', 'E']) AS label,
  unnest([0, length(text) - 1, 0, 3, 0]) AS s, unnest([least(length(text), 40), length(text), length(text), 9, 2]) AS e FROM tx),
bo AS (SELECT *, substr(text, s + 1, e - s) AS body FROM sp)"""


@query("span_offsets", """
SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER w, 0) AS BIGINT) AS start,
  CAST(coalesce(sum(length(text) + 1) OVER w, 0) + length(text) AS BIGINT) AS "end" FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def span_offsets(spark, d):
    turns = t.read(spark, d, "conversations").select("conv_id", "turn", "text")
    return span_ops.block_offsets(turns, "conv_id", "turn", "text").select("conv_id", "turn", "start", "end")


@query("span_clean", with_ctes(_SPANS) + """
SELECT doc_id, label, s + length(body) - length(ltrim(body, ' ' || chr(10) || chr(9))) AS start,
  s + length(body) - length(ltrim(body, ' ' || chr(10) || chr(9))) + length(trim(body, ' ' || chr(10) || chr(9))) AS "end"
FROM bo WHERE e > s AND e - s <= 200 AND trim(body, ' ' || chr(10) || chr(9)) <> ''
  AND NOT (length(trim(body, ' ' || chr(10) || chr(9))) = 1 AND contains('.:,;!?()[]{}%$#@&*+-=/<>|\\''"', trim(body, ' ' || chr(10) || chr(9))))""", casts="start INT,end INT")
def span_clean(spark, d):
    cleaned = _spans(spark, d).withColumn("spans", sp.clean_spans(F.col("text"), F.col("spans"), max_length=200))
    return span_ops.span_rows(cleaned, ["doc_id"]).select("doc_id", "label", "start", "end")


@query("span_audit", with_ctes(_SPANS) + """
, r AS (SELECT source, CASE WHEN trim(body, ' ' || chr(10)) = '' THEN 'EMPTY' WHEN trim(body, ' ' || chr(10)) <> body THEN 'WHITESPACE'
  WHEN length(body) = 1 AND NOT regexp_matches(body, '^[\\p{L}\\p{N}]$') THEN 'SINGLE PUNCTUATION CHAR' END AS reason FROM bo)
SELECT source, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1, 2""")
def span_audit(spark, d):
    counts, _ = span_ops.audit_spans(span_ops.span_rows(_spans(spark, d), ["doc_id", "source"]), "source")
    return counts


@query("span_audit_first", with_ctes(_SPANS) + """
, r AS (SELECT *, CASE WHEN trim(body, ' ' || chr(10)) = '' THEN 'EMPTY' WHEN trim(body, ' ' || chr(10)) <> body THEN 'WHITESPACE'
  WHEN length(body) = 1 AND NOT regexp_matches(body, '^[\\p{L}\\p{N}]$') THEN 'SINGLE PUNCTUATION CHAR' END AS reason FROM bo),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, s, e, label) AS rank FROM r WHERE reason IS NOT NULL)
SELECT source, doc_id, s AS start, label, reason, rank FROM k WHERE rank <= 10""", casts="start INT,rank INT")
def span_audit_first(spark, d):
    _, first = span_ops.audit_spans(span_ops.span_rows(_spans(spark, d), ["doc_id", "source"]), "source")
    return first.select("source", "doc_id", "start", "label", "reason", "rank")


@query("span_align", with_ctes(_SPANS) + """
, d AS (SELECT doc_id, text, s, e, substr(text, s + 1, e - s) AS body FROM sp WHERE label = 'D'),
c AS (SELECT *, length(regexp_extract(substr(text, 1, s), '(\\w*)$', 1)) AS h, length(regexp_extract(substr(text, e + 1), '^(\\w*)', 1)) AS tl FROM d),
x AS (SELECT doc_id, text, s - CASE WHEN regexp_matches(body, '^\\w') THEN h ELSE 0 END AS s, e + CASE WHEN regexp_matches(body, '\\w$') THEN tl ELSE 0 END AS e, s AS s0, e AS e0, body, h, tl FROM c),
y AS (SELECT *, substr(text, s + 1, e - s) AS wide FROM x)
SELECT doc_id, s AS start, e AS "end" FROM y WHERE trim(wide, ' ' || chr(10)) = wide""", casts="start INT,end INT")
def span_align(spark, d):
    """Cut words are taken in whole; spans that keep a blank edge drop out."""
    only = _spans(spark, d).withColumn("spans", F.filter("spans", lambda s: s["label"] == "D"))
    fitted = only.withColumn("wide", F.transform("spans", lambda s: span_ops.snap(F.col("text"), s)))
    rows = span_ops.span_rows(fitted, ["doc_id"], spans="wide")
    return rows.filter("trim(BOTH ' \n' FROM span_text) = span_text").select("doc_id", "start", "end")


@query("span_corpus")
def span_corpus(spark, d):
    """Cleaning, alignment and overlap removal in one pass."""
    done = span_ops.span_corpus(_spans(spark, d))
    return done.select("doc_id", "skipped", F.size("spans").alias("kept"),
                       F.to_json("spans").alias("spans"))


@query("span_nonoverlap", """
WITH r AS (SELECT DISTINCT user_id AS doc_id, CAST(floor(value) AS INT) % 400 AS s,
  CAST(floor(value) AS INT) % 400 + CAST(user_id % 3 + event_id % 5 + 1 AS INT) AS e FROM events),
g AS (SELECT doc_id, list([{'s': s, 'e': e}] ORDER BY s - e, s) AS spans FROM r GROUP BY doc_id),
k AS (SELECT doc_id, unnest(list_reduce(spans, lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: k.s < x[1].e AND x[1].s < k.e)) = 0
  THEN list_concat(kept, x) ELSE kept END)) AS x FROM g)
SELECT doc_id, x.s AS start, x.e AS "end", 'X' AS label FROM k""", casts="start INT,end INT")
def span_nonoverlap(spark, d):
    """Longest-first choice among overlapping spans of a document."""
    rows = t.read(spark, d, "events").selectExpr(
        "user_id AS doc_id", "CAST(floor(value) AS INT) % 400 AS start",
        "CAST(floor(value) AS INT) % 400 + CAST(user_id % 3 + event_id % 5 + 1 AS INT) AS `end`", "'X' AS label")
    return span_ops.choose_spans(rows, ["doc_id"])


@query("span_locate", with_ctes(RAW) + """
, x AS (SELECT doc_id, 'Child: ' || child_first_name || ' ' || child_last_name || chr(10) || 'Born: ' || dob_year || chr(10) || 'Mother: ' || child_first_name AS text,
  child_first_name AS a, child_last_name AS b, dob_year AS c FROM raw)
SELECT doc_id, 'F102_CHILD_FIRST' AS label, 7 AS start, 7 + length(a) AS "end" FROM x
UNION ALL SELECT doc_id, 'F102_CHILD_LAST', 8 + length(a), 8 + length(a) + length(b) FROM x
UNION ALL SELECT doc_id, 'F102_DATE_OF_BIRTH', instr(text, c) - 1, instr(text, c) - 1 + length(c) FROM x
UNION ALL SELECT doc_id, 'F102_MOTHER_FIRST', length(text) - length(a), length(text) FROM x""", casts="start INT,end INT")
def span_locate(spark, d):
    """The mother's equal first name is found at its second occurrence."""
    raw = t.raw_columns(spark, d)
    text = F.concat(F.lit("Child: "), "child_first_name", F.lit(" "), "child_last_name", F.lit("\nBorn: "),
                    "dob_year", F.lit("\nMother: "), "child_first_name")
    done = corpus.annotated_examples(raw.withColumn("text", text), "doc_id", "text", {
        "F102_CHILD_FIRST": F.col("child_first_name"), "F102_CHILD_LAST": F.col("child_last_name"),
        "F102_DATE_OF_BIRTH": F.col("dob_year"), "F102_MOTHER_FIRST": F.col("child_first_name")})
    return span_ops.span_rows(done, ["doc_id"]).select("doc_id", "label", "start", "end")


# --- splits ----------------------------------------------------------------------

@query("split_stratified", """
WITH b AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY lang) AS c
  FROM documents WHERE source <> 'src3')
SELECT doc_id, lang, CASE WHEN n <= greatest(1, CAST(floor(c * 0.2 + 1e-9) AS BIGINT)) THEN 'dev' ELSE 'train' END AS split FROM b
UNION ALL SELECT doc_id, lang, 'train' FROM documents WHERE source = 'src3'""")
def split_stratified(spark, d):
    docs = t.read(spark, d, "documents").select("doc_id", "lang", "source")
    return corpus.stratified_split(docs, "lang", "doc_id", 0.2, F.col("source") == "src3").select(
        "doc_id", "lang", "split")


@query("ordered_cut", """
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= CAST(floor((SELECT count(*) FROM orders) * 0.8 + 1e-9) AS BIGINT) THEN 'train' ELSE 'dev' END AS split FROM orders""")
def ordered_cut(spark, d):
    return corpus.ordered_split(t.read(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("shuffled_cut", """
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('42|' || o_orderkey)) <= CAST(floor((SELECT count(*) FROM orders) * 0.9 + 1e-9) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM orders""")
def shuffled_cut(spark, d):
    return corpus.shuffled_split(t.read(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("validation_flags", """
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id)) <=
  greatest(1, CAST(floor(count(*) OVER (PARTITION BY event_type) * 0.1 + 1e-9) AS BIGINT)) AS is_val FROM events""")
def validation_flags(spark, d):
    return corpus.validation_flags(t.read(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id")


@query("fixed_sample", "SELECT c_custkey, c_name FROM customer ORDER BY md5('42|' || c_custkey) LIMIT 200")
def fixed_sample(spark, d):
    return corpus.fixed_sample(t.read(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 200)


@query("capped_split", with_ctes(DATA) + """
, c AS (SELECT data_id, row_number() OVER (ORDER BY data_id) AS n FROM data)
SELECT data_id, CASE WHEN n <= CAST(floor((SELECT count(*) FROM c WHERE n <= 50000) * 0.9 + 1e-9) AS BIGINT) THEN 'train' ELSE 'val' END AS split
FROM c WHERE n <= 50000""")
def capped_split(spark, d):
    """The first 50,000 field rows, nine tenths of them to train on."""
    return corpus.capped_split(t.document_data(spark, d).select("data_id"), "data_id", cap=50_000)


# --- unions, counts, pools ----------------------------------------------------------

@query("corpus_union_counts", """
SELECT source, count(*) AS docs, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS entities, 0 AS skipped FROM (
  SELECT 'documents' AS source, length(text) AS n FROM documents UNION ALL SELECT 'benchmark', length(text) FROM benchmark
  UNION ALL SELECT 'turns', length(text) FROM conversations) GROUP BY 1""", casts="entities BIGINT,skipped BIGINT")
def corpus_union_counts(spark, d):
    whole = F.array(sp.span(F.lit(0), F.length("text"), F.lit("TEXT")))
    parts = {
        "documents": t.read(spark, d, "documents").select("lang", "text", whole.alias("spans")),
        "benchmark": t.read(spark, d, "benchmark").select("text", whole.alias("spans")),
        "boosters": None,
        "turns": t.read(spark, d, "conversations").select("text", whole.alias("spans")),
    }
    return corpus.corpus_counts(corpus.merge_corpora(parts), ["source"])


@query("class_coverage", """
SELECT lang, count(DISTINCT source) AS classes, count(*) AS rows, CAST(floor(count(*) / greatest(count(DISTINCT source), 1)) AS BIGINT) AS per_class FROM documents GROUP BY 1""")
def class_coverage(spark, d):
    return corpus.class_coverage(t.read(spark, d, "documents"), "source", ["lang"])


@query("first_seen_dedup", """
WITH f AS (SELECT p_name, min(p_partkey) AS first_position FROM part GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY first_position) AS rank FROM f""")
def first_seen_dedup(spark, d):
    return corpus.first_seen(t.read(spark, d, "part").select("p_name", "p_partkey"), "p_name", "p_partkey")


@query("name_combinations", """
SELECT (SELECT count(DISTINCT p_name) FROM part) AS first, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS last,
  (SELECT count(DISTINCT n_name) FROM nation) AS middle, (SELECT count(DISTINCT p_name) FROM part) * (SELECT count(DISTINCT c_mktsegment) FROM customer) * (SELECT count(DISTINCT n_name) FROM nation) AS combinations""")
def name_combinations(spark, d):
    pools = {"first": t.read(spark, d, "part").select(F.col("p_name").alias("name")),
             "last": t.read(spark, d, "customer").select(F.col("c_mktsegment").alias("name")),
             "middle": t.read(spark, d, "nation").select(F.col("n_name").alias("name"))}
    return corpus.combination_count(pools, "name").withColumn("combinations", F.col("combinations").cast("long"))


@query("annotation_repair", """
WITH a AS (SELECT CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS image, 'x/form3a/p' || page_id || '.jpg' AS image_path,
  CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'label ' || page_id END AS label, CASE WHEN page_id % 10 = 0 THEN '' ELSE 'text ' || page_id END AS text FROM pages),
b AS (SELECT CASE WHEN coalesce(image, '') <> '' THEN image ELSE image_path END AS i, CASE WHEN coalesce(label, '') <> '' THEN label ELSE text END AS tt FROM a)
SELECT CASE WHEN contains(i, 'form1a') THEN 'form1a' WHEN contains(i, 'form2a') THEN 'form2a' WHEN contains(i, 'form3a') THEN 'form3a' WHEN contains(i, 'form90') THEN 'form90' ELSE 'form1a' END
  || '/' || regexp_extract(i, '([^/]*)$', 1) AS image_path, tt AS text FROM b WHERE i <> '' AND tt <> ''""")
def annotation_repair(spark, d):
    a = t.read(spark, d, "pages").selectExpr(
        "CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS image", "'x/form3a/p' || page_id || '.jpg' AS image_path",
        "CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'label ' || page_id END AS label",
        "CASE WHEN page_id % 10 = 0 THEN '' ELSE 'text ' || page_id END AS text")
    fixed, _ = corpus.repair_annotations(a)
    return fixed


# --- generators --------------------------------------------------------------------

def _seeds(spark, d):
    """One seed per order; names and places come from its customer's rows."""
    raw = t.raw_columns(spark, d)
    return raw.select(F.col("doc_id").alias("seed_id"), F.col("child_first_name").alias("first_name"),
                      F.col("child_last_name").alias("last_name"), F.col("place_birth_city").alias("city"),
                      F.col("place_birth_province").alias("province"))


# The stored fields of each form, written out once more for the check.
_FIELD_NAMES = """names(form, list) AS (VALUES
  ('1A', 'registry_no city_municipality province date_issuance child_first child_middle child_last sex dob_day dob_month dob_year pob_hospital pob_city pob_province mother_first mother_middle mother_last mother_citizenship mother_age father_first father_middle father_last father_citizenship parents_marriage_day parents_marriage_month parents_marriage_year parents_marriage_city parents_marriage_province date_submitted prepared_by'),
  ('2A', 'registry_no city_municipality province date_issuance deceased_first deceased_middle deceased_last sex age_years civil_status citizenship dod_day dod_month dod_year pod_hospital pod_city pod_province cause_immediate cause_antecedent cause_underlying date_submitted'),
  ('3A', 'registry_no city_municipality province date_issuance husband_first husband_middle husband_last husband_age husband_citizenship husband_mother_first husband_mother_last husband_mother_citizenship husband_father_first husband_father_last husband_father_citizenship wife_first wife_middle wife_last wife_age wife_citizenship wife_mother_first wife_mother_last wife_mother_citizenship wife_father_first wife_father_last wife_father_citizenship marriage_day marriage_month marriage_year marriage_venue marriage_city marriage_province date_submitted'),
  ('90', 'registry_no city_municipality date_issuance license_no marriage_day marriage_month marriage_year marriage_venue marriage_city groom_first groom_middle groom_last groom_age groom_citizenship groom_mother_first groom_mother_last groom_father_first groom_father_last bride_first bride_middle bride_last bride_age bride_citizenship bride_mother_first bride_mother_last bride_father_first bride_father_last groom_residence bride_residence')),
fields AS (SELECT form, unnest(string_split(list, ' ')) AS field FROM names)"""


def _draw_sql(key, salt, n):
    """A number below ``n`` from the digest of a key and a salt, both SQL."""
    return f"(('0x' || substr(md5({key} || '|' || {salt}), 1, 7))::BIGINT % {n})"


def _number_sql(purpose, low, n):
    return f"CAST({_draw_sql('key', f'field || {purpose!r}', n)} + {low} AS VARCHAR)"


def _pick_sql(entries, purpose=""):
    return f"([{', '.join(map(repr, entries.split('|')))}])[{_draw_sql('key', f'field || {purpose!r}', entries.count('|') + 1)} + 1]"


_MONTH_NAMES = "January|February|March|April|May|June|July|August|September|October|November|December"
_NATIONS = "Filipino|American|Chinese|Japanese|Korean|Spanish|British|Australian|Canadian|Indian|Stateless"
_GENERATED_VALUE = f"""CASE WHEN regexp_matches(field, '(registry|license)_no$') THEN {_number_sql('year', 1985, 40)} || '-' || lpad({_number_sql('serial', 100, 89900)}, 5, '0')
  WHEN regexp_matches(field, 'first$') THEN first_name WHEN regexp_matches(field, '(middle|last)$') THEN last_name
  WHEN regexp_matches(field, 'day$') THEN {_number_sql('', 1, 31)} WHEN regexp_matches(field, 'year$') THEN {_number_sql('', 1985, 40)}
  WHEN regexp_matches(field, 'month$') THEN {_pick_sql(_MONTH_NAMES)} WHEN regexp_matches(field, '(hospital|venue)$') THEN city || ' Hall ' || {_number_sql('', 1, 7)}
  WHEN regexp_matches(field, '(city|municipality)$') THEN city WHEN regexp_matches(field, 'province$') THEN province
  WHEN regexp_matches(field, 'citizenship$') THEN {_pick_sql(_NATIONS)} WHEN field = 'civil_status' THEN {_pick_sql('Single|Married|Annulled')}
  WHEN field = 'sex' THEN {_pick_sql('Female|Male')} WHEN regexp_matches(field, '_?age(_years)?$') THEN {_number_sql('', 0, 105)}
  WHEN regexp_matches(field, '^date_') THEN {_number_sql('year', 1985, 40)} || '-' || lpad({_number_sql('month', 1, 12)}, 2, '0') || '-' || lpad({_number_sql('day', 1, 31)}, 2, '0')
  WHEN field = 'prepared_by' THEN first_name || ' ' || last_name WHEN regexp_matches(field, '^cause_') THEN {_pick_sql('Stroke|Dengue Fever|Drowning|Asthma|Burns')}
  WHEN regexp_matches(field, 'residence$') THEN {_number_sql('', 1, 250)} || ' ' || {_pick_sql('Mabuhay Lane|Harbour Road|Old Mill Street', 'street')} || ', ' || city || ', ' || province END"""


@query("generated_fields", with_ctes(_FIELD_NAMES) + f"""
, g AS (SELECT c_custkey AS seed_id, c_name AS first_name, c_mktsegment AS last_name, r_name AS city, n_name AS province
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
k AS (SELECT *, seed_id || '.' || sample AS key FROM g, (VALUES (1), (2)) v(sample), fields)
SELECT seed_id, form, sample, field, {_GENERATED_VALUE} AS text, CASE WHEN {_draw_sql('key', "field || 'split'", 100)} < 10 THEN 'val' ELSE 'train' END AS split
FROM k""")
def generated_fields(spark, d):
    """Every field of every form, two samples per customer."""
    nations = t.read(spark, d, "nation").join(t.read(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    seeds = t.read(spark, d, "customer").join(nations, F.expr("c_nationkey = n_nationkey")).selectExpr(
        "c_custkey AS seed_id", "c_name AS first_name", "c_mktsegment AS last_name", "r_name AS city", "n_name AS province")
    seeds = seeds.repartition(t.dealt_partitions(spark))  # short rows from which much is computed
    return functools.reduce(DataFrame.unionByName, [corpus.generate_field_values(seeds, f, 2) for f in corpus.GENERATED_FIELDS])


@query("generated_field_counts", """
SELECT f.form, f.n * (SELECT count(*) FROM orders) AS rows FROM (VALUES ('1A', 30), ('2A', 21), ('3A', 33), ('90', 29)) f(form, n)""")
def generated_field_counts(spark, d):
    seeds = _seeds(spark, d)
    out = None
    for form in corpus.GENERATED_FIELDS:
        part = corpus.generate_field_values(seeds, form).groupBy("form").agg(F.count(F.lit(1)).alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


def _texts_sql():
    """The sentences of each class with their slots replaced, chosen by the same draw."""
    slots = {"{a}": "first_name || ' ' || last_name", "{b}": "last_name || ' ' || first_name", "{p}": "city || ', ' || province",
             "{d}": "day", "{s}": "sex", "{c}": "cause"}
    arms = []
    for label, options in corpus.TEXT_PATTERNS.items():
        chosen = f"([{', '.join(repr(o) for o in options)}])[{_draw_sql('CAST(seed_id AS VARCHAR)', repr(label), len(options))} + 1]"
        for slot, value in slots.items():
            chosen = f"replace({chosen}, '{slot}', {value})"
        arms.append(f"SELECT seed_id, '{label}' AS label, {chosen} AS text FROM s")
    return " UNION ALL ".join(arms)


def _seed_draw(salt, n):
    return _draw_sql("CAST(seed_id AS VARCHAR)", repr(salt), n)


@query("generated_texts", with_ctes(RAW) + f"""
, g AS (SELECT doc_id AS seed_id, child_first_name AS first_name, child_last_name AS last_name, place_birth_city AS city, place_birth_province AS province FROM raw),
s AS (SELECT *, ({_seed_draw('textyear', 40)} + 1985) || '-' || lpad(CAST({_seed_draw('textmonth', 12)} + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST({_seed_draw('textday', 31)} + 1 AS VARCHAR), 2, '0') AS day,
  (['Female', 'Male'])[{_seed_draw('text-sex', 2)} + 1] AS sex, (['Stroke', 'Dengue Fever', 'Drowning', 'Asthma', 'Burns'])[{_seed_draw('text-cause', 5)} + 1] AS cause FROM g)
""" + _texts_sql())
def generated_texts(spark, d):
    return corpus.generate_labelled_texts(_seeds(spark, d))


@query("annotated_examples")
def annotated_examples(spark, d):
    """Rendered birth forms with the spans of their values."""
    raw = t.raw_columns(spark, d)
    rendered = raw.withColumn("fields", t.field_map(t.KEYS_OF_TYPE["birth"])).withColumn(
        "text", compose.form_text("fields", "birth"))
    done = corpus.annotated_examples(rendered, "doc_id", "text", {
        "F102_DATE_OF_REGISTRATION": F.col("date_of_registration"),
        "F102_CHILD_FIRST": F.col("child_first_name"), "F102_CHILD_LAST": F.col("child_last_name"),
        "F102_SEX": F.col("sex"), "F102_MOTHER_FIRST": F.col("mother_first_name"),
        "F102_MOTHER_LAST": F.col("mother_last_name"), "F102_FATHER_FIRST": F.col("father_first_name"),
        "F102_FATHER_LAST": F.col("father_last_name"), "F102_MARRIAGE_PLACE": F.col("parents_marriage_city")})
    return done.select("doc_id", F.size("spans").alias("n_spans"), F.to_json("spans").alias("spans"))


# --- text model ------------------------------------------------------------------------

_TOKENS = r"""tok AS (SELECT key, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM src),
tr AS (SELECT key, unnest(w) AS term FROM tok UNION ALL
  SELECT key, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM tok),
tf AS (SELECT key, term, count(*) AS tf FROM tr GROUP BY 1, 2),
voc AS (SELECT term, sum(tf) AS tf_total, count(*) AS df FROM tf GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5000),
vocab AS (SELECT *, ln((1 + (SELECT count(*) FROM src)) / (1 + df)) + 1 AS idf FROM voc)"""
_SRC = "src AS (SELECT doc_id AS key, lang AS label, text FROM documents)"


def _whole_documents(spark, d):
    """Dealt out, since counting the terms of a text takes far longer than reading it."""
    return t.read(spark, d, "documents", t.dealt_partitions(spark)).select("doc_id", "lang", "text")


@query("tfidf_vocabulary", with_ctes(_SRC, _TOKENS) + "SELECT term, CAST(tf_total AS BIGINT) AS tf_total, df, round(idf, 9) AS idf FROM vocab")
def tfidf_vocabulary(spark, d):
    return model.vocabulary(_whole_documents(spark, d), max_features=5000).withColumn("idf", F.round("idf", 9))


_FIT = """raww AS (SELECT key, term, (1 + ln(tf)) * idf AS x FROM tf JOIN vocab USING (term)),
nrm AS (SELECT key, sqrt(sum(x * x)) AS nm FROM raww GROUP BY 1),
wt AS (SELECT key, term, x / nm AS w FROM raww JOIN nrm USING (key)),
cls AS (SELECT label, ln(count(*) / (SELECT count(*) FROM src)) AS log_prior FROM src GROUP BY 1),
sm AS (SELECT label, term, sum(w) AS s FROM wt JOIN src USING (key) GROUP BY 1, 2),
tot AS (SELECT label, sum(s) AS t FROM sm GROUP BY 1),
wgt AS (SELECT cls.label, vocab.term, ln((coalesce(s, 0) + 0.1) / (t + 0.1 * (SELECT count(*) FROM vocab))) AS weight
  FROM cls CROSS JOIN vocab LEFT JOIN sm ON sm.label = cls.label AND sm.term = vocab.term JOIN tot ON tot.label = cls.label),
sc AS (SELECT src.key, cls.label, cls.log_prior + coalesce((SELECT sum(w * weight) FROM wt JOIN wgt USING (term) WHERE wt.key = src.key AND wgt.label = cls.label), 0) AS l FROM src CROSS JOIN cls),
mx AS (SELECT key, max(l) AS top FROM sc GROUP BY 1),
z AS (SELECT key, sum(exp(l - top)) AS z FROM sc JOIN mx USING (key) GROUP BY 1)"""


@query("mnb_predict", with_ctes(_SRC, _TOKENS, _FIT) + """
SELECT key AS doc_id, arg_max(label, l) AS label, round(max(1 / z), 4) AS confidence FROM sc JOIN z USING (key) GROUP BY 1""")
def mnb_predict(spark, d):
    """Fit on the documents' languages, then score the same documents."""
    docs = _whole_documents(spark, d)
    fitted = model.fit(docs, "doc_id", "lang", work_dir(spark, "text-model"), max_features=5000)
    return fitted.predict(docs, "doc_id").select("doc_id", "label", "confidence")


@query("model_quality")
def model_quality(spark, d):
    """Hold-out report: fit on the train split, report on the rest."""
    from vitalforms.operators import metrics

    root = work_dir(spark, "text-model")
    parts = corpus.stratified_split(_whole_documents(spark, d), "lang", "doc_id", 0.2)
    parts.write.parquet(f"{root}/split")  # the split is read by the fit, its classes, the prediction and the report
    docs = spark.read.schema(parts.schema).parquet(f"{root}/split").repartition(t.dealt_partitions(spark))
    fitted = model.fit(docs.filter("split = 'train'"), "doc_id", "lang", f"{root}/model", max_features=5000)
    held = docs.filter("split = 'dev'")
    scored = fitted.predict(held, "doc_id").join(held.select("doc_id", "lang"), "doc_id")
    return metrics.classification_report(scored.selectExpr("lang AS actual", "label AS predicted"))


_HELD = r""", held AS (SELECT doc_id AS key, text FROM documents WHERE doc_id % 5 = 0),
htok AS (SELECT key, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM held),
htr AS (SELECT key, unnest(w) AS term FROM htok UNION ALL SELECT key, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM htok),
hraw AS (SELECT key, term, (1 + ln(count(*))) * any_value(idf) AS x FROM htr JOIN vocab USING (term) GROUP BY 1, 2),
hnrm AS (SELECT key, sqrt(sum(x * x)) AS nm FROM hraw GROUP BY 1),
hs AS (SELECT key, label, sum(x / nm * weight) AS s FROM hraw JOIN hnrm USING (key) JOIN wgt USING (term) GROUP BY 1, 2),
hl AS (SELECT held.key, cls.label, log_prior + coalesce(s, 0) AS l FROM held CROSS JOIN cls LEFT JOIN hs ON hs.key = held.key AND hs.label = cls.label),
hm AS (SELECT key, max(l) AS top FROM hl GROUP BY 1)
SELECT key AS doc_id, arg_max(label, l) AS label, round(1 / sum(exp(l - top)), 4) AS confidence FROM hl JOIN hm USING (key) GROUP BY 1"""


@query("model_registry", with_ctes(_SRC + " WHERE doc_id % 5 <> 0)", _TOKENS, _FIT).replace("FROM documents) WHERE", "FROM documents WHERE").rstrip() + _HELD)
def model_registry(spark, d):
    """A published model, loaded by name, scores the documents that it has not seen."""
    docs = _whole_documents(spark, d)
    models = ModelRegistry(spark, work_dir(spark, "models"))
    models.publish("language", docs.where("doc_id % 5 <> 0"), "doc_id", "lang", max_features=5000)
    return models.classify("language", docs.where("doc_id % 5 = 0"), "text", "doc_id").select("doc_id", "label", "confidence")
