"""Queries over the record store: lists, search, upserts, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F


from vitalforms.catalog import forms
from vitalforms.functions import codes
from vitalforms.functions.text import map_getter
from vitalforms.operators import compose, merge, records
from vitalforms.plans import tables as t
from vitalforms.plans.registry import DATA, DOCS, FIELDS, LATEST, TYPES, USERS, query, with_ctes

_SHOWN = ("registry_number", "date", "amount_paid", "child_name", "date_of_birth", "place_of_birth",
          "deceased_name", "date_of_death", "place_of_death", "husband_name", "wife_name",
          "date_of_marriage", "place_of_marriage", "license_no")


def _records(spark, d, documents=None):
    docs = documents if documents is not None else t.documents(spark, d)
    return records.records(docs, t.document_types(spark), t.users(spark, d),
                           t.document_data(spark, d), t.data_fields(spark))


_WIDE_FIELDS = sorted({n for names in t.LINE_FIELDS.values() for n in names})
_WIDE = ("wide AS (SELECT doc_id, " + ", ".join(
    f"max(CASE WHEN field_name = '{f}' THEN extracted_value END) AS {f}" for f in _WIDE_FIELDS)
    + " FROM latest GROUP BY doc_id)")


def _n(f):
    return f"coalesce(w.{f}, '')" if f in _WIDE_FIELDS else "''"


def _name(p, middle=True):
    parts = [_n(f"{p}_first")] + (["''"] if middle else []) + [_n(f"{p}_last")]
    return "trim(" + " || ' ' || ".join(parts) + ")"


def _clean(e):
    return f"CASE WHEN trim({e}, ' ,') = '' THEN '' ELSE {e} END"


def _date(p):
    return _clean(f"trim({_n(p + '_month')} || ' ' || '' || ', ' || {_n(p + '_year')})")


def _place(a, b):
    return _clean(f"trim({_n(a)} || CASE WHEN {_n(b)} IN ('', '0') THEN '' ELSE ', ' || {_n(b)} END)")


def _if(kinds, e):
    arms = ", ".join(f"'{k}'" for k in kinds)
    return f"CASE WHEN kind IN ({arms}) THEN {e} END"


def _couple(a, b):
    h, w = f"nullif({_name(a, False)}, '')", f"nullif({_name(b, False)}, '')"
    return f"coalesce({h} || ' & ' || {w}, {h}, {w}, username)"


_MARR = ("marriage-cert", "marriage-license")
_LIST_SQL = with_ctes(DOCS, USERS, DATA, FIELDS, TYPES, LATEST, _WIDE) + f"""
SELECT 'DOC-' || CAST(d.doc_id AS VARCHAR) AS id, d.doc_id, kind AS type,
  CASE kind WHEN 'birth' THEN coalesce(nullif({_name('child', False)}, ''), username)
    WHEN 'death' THEN coalesce(nullif({_name('deceased', False)}, ''), username)
    WHEN 'marriage-cert' THEN {_couple('husband', 'wife')} ELSE {_couple('groom', 'bride')} END AS name,
  strftime(upload_date, '%Y-%m-%d') AS date_uploaded, status,
  {_clean(_n('registry_no'))} AS registry_number, {_clean(_n('date_issuance'))} AS date,
  {_clean(_n('amount_paid'))} AS amount_paid,
  {_if(['birth'], _clean(_name('child')))} AS child_name, {_if(['birth'], _date('dob'))} AS date_of_birth,
  {_if(['birth'], _place('pob_city', 'pob_province'))} AS place_of_birth,
  {_if(['death'], _clean(_name('deceased')))} AS deceased_name, {_if(['death'], _date('dod'))} AS date_of_death,
  {_if(['death'], _place('pod_hospital', 'pod_city'))} AS place_of_death,
  CASE kind WHEN 'marriage-cert' THEN {_clean(_name('husband'))} WHEN 'marriage-license' THEN {_clean(_name('groom'))} END AS husband_name,
  CASE kind WHEN 'marriage-cert' THEN {_clean(_name('wife'))} WHEN 'marriage-license' THEN {_clean(_name('bride'))} END AS wife_name,
  {_if(_MARR, _date('marriage'))} AS date_of_marriage,
  {_if(_MARR, _place('marriage_venue', 'marriage_city'))} AS place_of_marriage,
  {_if(['marriage-license'], _clean(_n('license_no')))} AS license_no
FROM docs d JOIN types USING (type_id) JOIN users USING (user_id) LEFT JOIN wide w USING (doc_id)
"""


@query("records_list", _LIST_SQL)
def records_list(spark, d):
    get = map_getter("form_data")
    return records.newest_first(_records(spark, d)).select(
        "id", "doc_id", "type", "name", F.col("date").alias("date_uploaded"), "status",
        *[get(f).alias(f) for f in _SHOWN])


@query("records_search", with_ctes(DOCS, USERS, DATA, FIELDS, TYPES, LATEST, _WIDE) + f"""
SELECT doc_id, kind AS type, status, {_couple('husband', 'wife')} AS name, strftime(upload_date, '%Y-%m-%d') AS date
FROM docs d JOIN types USING (type_id) JOIN users USING (user_id) LEFT JOIN wide w USING (doc_id)
WHERE kind = 'marriage-cert' AND status = 'Approved' AND upload_date >= DATE '1999-06-15'
  AND (contains(lower({_couple('husband', 'wife')}), 'nf-1') OR contains('doc-' || CAST(doc_id AS VARCHAR), 'nf-1'))
""")
def records_search(spark, d):
    """The conditions on document columns run before the pivot."""
    cond = {"kind": "marriage-cert", "status": "Approved", "date_bucket": "year",
            "as_of": F.lit("2000-06-15").cast("date")}
    docs = records.prefilter_documents(t.documents(spark, d), **cond)
    return records.search_records(_records(spark, d, docs), term="NF-1", **cond).select(
        "doc_id", "type", "status", "name", "date")


@query("status_by_type", with_ctes(DOCS) + """
SELECT type_id, status, count(*) AS documents FROM docs GROUP BY ROLLUP (type_id, status)""")
def status_by_type(spark, d):
    return records.status_counts(t.documents(spark, d))


@query("dashboard_counts", with_ctes(DOCS) + """
SELECT type_id, status, CAST(date_trunc('month', upload_date) AS TIMESTAMP) AS month, count(*) AS documents
FROM docs GROUP BY 1, 2, 3""")
def dashboard_counts(spark, d):
    return records.dashboard_counts(t.documents(spark, d))


@query("date_buckets", with_ctes(DOCS) + """
SELECT bucket, count(*) AS documents FROM docs, (VALUES ('today', DATE '2000-06-15'), ('week', DATE '2000-06-08'),
 ('month', DATE '2000-05-16'), ('year', DATE '1999-06-15')) b(bucket, floor_date)
WHERE upload_date >= floor_date GROUP BY 1""")
def date_buckets(spark, d):
    as_of = F.lit("2000-06-15").cast("date")
    names = ("today", "week", "month", "year")
    hits = F.array(*[F.when(F.col("upload_date") >= records.date_floor(n, as_of).cast("timestamp"), F.lit(n))
                     for n in names])
    return (t.documents(spark, d).select(F.explode(F.array_compact(hits)).alias("bucket"))
            .groupBy("bucket").agg(F.count(F.lit(1)).alias("documents")))


@query("pivot_fields", with_ctes(DATA, FIELDS, LATEST, _WIDE) + "SELECT doc_id, "
       + ", ".join(_WIDE_FIELDS) + " FROM wide")
def pivot_fields(spark, d):
    named = records.named_data(t.document_data(spark, d), t.data_fields(spark))
    return records.pivot_columns(named, _WIDE_FIELDS)


@query("unpivot_fields", " UNION ALL ".join(
    f"SELECT p_partkey, '{c}' AS field_name, CAST({c} AS VARCHAR) AS extracted_value, 0.9 AS ner_confidence_score "
    f"FROM part WHERE trim(CAST({c} AS VARCHAR)) <> ''" for c in ("p_name", "p_brand", "p_type", "p_size")), casts="ner_confidence_score DOUBLE")
def unpivot_fields(spark, d):
    return records.unpivot_fields(t.read(spark, d, "part"), "p_partkey",
                                  ["p_name", "p_brand", "p_type", "p_size"], F.lit(0.9))


@query("pivot_roundtrip", """
SELECT p_partkey, p_name, p_brand, p_type FROM part""")
def pivot_roundtrip(spark, d):
    long = records.unpivot_fields(t.read(spark, d, "part"), "p_partkey", ["p_name", "p_brand", "p_type"])
    back = long.withColumnRenamed("p_partkey", "doc_id").withColumn("data_id", F.col("doc_id"))
    return records.pivot_columns(back, ["p_name", "p_brand", "p_type"]).withColumnRenamed("doc_id", "p_partkey")


@query("filled_field_counts", with_ctes(DATA, FIELDS, LATEST) + """
SELECT doc_id, CAST(count(*) AS INT) AS filled FROM latest WHERE extracted_value <> '' GROUP BY doc_id""")
def filled_field_counts(spark, d):
    named = records.named_data(t.document_data(spark, d), t.data_fields(spark))
    return records.pivot_fields(named).select("doc_id", records.filled_count(F.col("fields")).alias("filled"))


@query("receipts", with_ctes(DOCS, DATA, FIELDS, LATEST) + """
SELECT d.doc_id, '' AS issued_to, coalesce(a.extracted_value, '') AS amount_paid, '' AS or_number,
  '' AS date_paid, TRY_CAST(trim(a.extracted_value) AS DECIMAL(10, 2)) AS amount
FROM docs d LEFT JOIN latest a ON a.doc_id = d.doc_id AND a.field_name = 'amount_paid'""")
def receipts(spark, d):
    return records.receipts(t.documents(spark, d), t.document_data(spark, d), t.data_fields(spark))


@query("code_map", with_ctes(DOCS, TYPES) + """
SELECT doc_id, type_code, kind, hint, type_name AS title, CASE hint WHEN '1A' THEN 'birth' WHEN '2A' THEN 'death'
  ELSE 'marriage' END AS pipeline_type, type_id AS stored_type,
  CASE hint WHEN '90' THEN 'Marriage License Application' ELSE type_name END AS document_title
FROM docs JOIN types USING (type_id)""")
def code_map(spark, d):
    docs = t.documents(spark, d).join(F.broadcast(t.document_types(spark)), "type_id")
    kind = codes.kind_of_code(F.col("type_code"))
    step = docs.withColumn("kind", kind).withColumn("hint", codes.hint_of_kind(F.col("kind")))
    folder = codes.lookup(forms.column_map("hint", "folder"), F.col("hint"))
    return step.select("doc_id", "type_code", "kind", "hint", codes.screen_title(F.col("kind")).alias("title"),
                       codes.pipeline_type_of_hint(F.col("hint")).alias("pipeline_type"),
                       codes.type_id_of_hint(F.col("hint")).alias("stored_type"),
                       codes.document_title(folder).alias("document_title"))


# Corrections: every third order corrects its first line's field and one new
# field named after its priority; a few are blank and must be skipped.
_CORR = [
    "o_orderkey AS doc_id", "'1A' AS hint",
    "CASE WHEN o_orderkey % 9 = 0 THEN '  ' ELSE 'fixed ' || CAST(o_custkey AS STRING) END AS value",
    "'note_' || lower(substr(o_orderpriority, 3)) AS new_name",
    f"CASE o_orderkey % 4 WHEN 0 THEN 'Child_First' WHEN 1 THEN 'deceased_first' WHEN 2 THEN 'husband_first' "
    "ELSE 'groom_first' END AS old_name",
]
_CORR_SQL = ("corr AS (SELECT doc_id, unnest([old_name, new_name]) AS field_name, value FROM (SELECT "
             + ", ".join(_CORR) + " FROM orders WHERE o_orderkey % 3 = 0)), "
             "good AS (SELECT * FROM corr WHERE trim(value) <> '')")
_NEW_SQL = ("fresh AS (SELECT lower(field_name) AS k, min(field_name) AS field_name FROM good "
            "WHERE lower(field_name) NOT IN (SELECT lower(field_name) FROM fields) GROUP BY 1), "
            "added AS (SELECT CAST((SELECT max(field_id) FROM fields) + row_number() OVER (ORDER BY md5('|' || k)) AS INT) AS field_id, "
            "field_name FROM fresh), every AS (SELECT field_id, field_name FROM fields UNION ALL SELECT * FROM added)")


def _corrections(spark, d):
    base = t.read(spark, d, "orders").filter(F.col("o_orderkey") % 3 == 0).selectExpr(*_CORR)
    requests = base.select("doc_id", F.create_map("old_name", "value", "new_name", "value").alias("form_data"))
    return merge.correction_rows(requests)


@query("register_fields", with_ctes(FIELDS, _CORR_SQL, _NEW_SQL) + """
SELECT field_id, field_name, 'text' AS data_type FROM every""")
def register_fields(spark, d):
    return merge.register_fields(t.data_fields(spark), _corrections(spark, d).select("field_name"))


@query("upsert_corrections", with_ctes(DATA, FIELDS, _CORR_SQL, _NEW_SQL) + """,
w AS (SELECT doc_id, field_id, max(value) AS v FROM good JOIN every e ON lower(good.field_name) = lower(e.field_name) GROUP BY 1, 2),
tgt AS (SELECT doc_id, field_id, max(data_id) AS data_id FROM data GROUP BY 1, 2),
b AS (SELECT w.*, tgt.data_id FROM w LEFT JOIN tgt USING (doc_id, field_id))
SELECT data.data_id, data.doc_id, data.field_id, coalesce(b.v, data.extracted_value) AS extracted_value,
  data.ner_confidence_score, (data.is_corrected OR b.v IS NOT NULL) AS is_corrected
FROM data LEFT JOIN b ON b.data_id = data.data_id
UNION ALL
SELECT (SELECT max(data_id) FROM data) + row_number() OVER (ORDER BY md5('|' || doc_id || '|' || field_id)),
  doc_id, field_id, v, 0.0, true FROM b WHERE data_id IS NULL""")
def upsert_corrections(spark, d):
    corr = _corrections(spark, d)
    known = merge.register_fields(t.data_fields(spark), corr.select("field_name"))
    return merge.upsert_corrections(t.document_data(spark, d), merge.with_field_id(corr, known), ["value"])


@query("upsert_in_order", with_ctes(DATA, FIELDS) + f"""
SELECT doc_id, field_id, CASE WHEN doc_id % 2 = 0 THEN repeat('apple ', 60) || doc_id ELSE 'zebra' END AS extracted_value, true AS is_corrected
FROM (SELECT o_orderkey AS doc_id, (SELECT field_id FROM fields WHERE field_name = 'registry_no') AS field_id FROM orders)""")
def upsert_in_order(spark, d):
    """Two requests for one field: the later wins, whatever its value, and long values stay whole."""
    orders = t.read(spark, d, "orders").selectExpr("o_orderkey AS doc_id")
    seq = orders.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).filter("seq = 1 OR doc_id % 2 = 0")
    value = F.when(F.col("seq") == 1, F.lit("zebra")).otherwise(F.concat(F.repeat(F.lit("apple "), 60), F.col("doc_id").cast("string")))
    rows = merge.correction_rows(seq.withColumn("form_data", F.create_map(F.lit("registry_no"), value)), "seq")
    known = t.data_fields(spark)
    corrected = merge.with_field_id(rows, known)
    merged = merge.upsert_corrections(t.document_data(spark, d), corrected, ["seq"])
    wanted = merge.with_field_id(spark.createDataFrame([("registry_no",)], "field_name string"), known).select("field_id")
    latest = merged.join(F.broadcast(wanted), "field_id").groupBy("doc_id", "field_id").agg(
        F.max_by(F.struct("extracted_value", "is_corrected"), "data_id").alias("r"))
    return latest.select("doc_id", "field_id", "r.extracted_value", "r.is_corrected")


@query("status_update", with_ctes(DOCS) + """
SELECT doc_id, user_id, type_id, CASE WHEN doc_id % 5 = 0 THEN 'Approved' WHEN doc_id % 5 = 1 THEN 'Rejected' ELSE status END AS status,
  upload_date FROM docs""")
def status_update(spark, d):
    docs = t.documents(spark, d)
    # two updates of a document, of which the later wins; NULL leaves the status alone
    first = docs.select("doc_id", F.lit(1).alias("seq"), F.when(F.col("doc_id") % 5 < 2, "Rejected").alias("status"))
    second = docs.select("doc_id", F.lit(2).alias("seq"), F.when(F.col("doc_id") % 5 == 0, "Approved").alias("status"))
    return merge.update_status(docs, first.unionByName(second), ["seq"]).select("doc_id", "user_id", "type_id", "status", "upload_date")


@query("orphan_report", with_ctes(DOCS, USERS, DATA, FIELDS, TYPES) + """
, u AS (SELECT * FROM users WHERE user_id % 50 <> 0), ty AS (SELECT * FROM types WHERE type_id <> 4),
dd AS (SELECT * FROM docs WHERE doc_id % 40 <> 0), ff AS (SELECT * FROM fields WHERE field_name <> 'child_first')
SELECT 'documents.type_id' AS relation, doc_id AS row_id, CAST(type_id AS BIGINT) AS missing_key FROM docs WHERE type_id NOT IN (SELECT type_id FROM ty)
UNION ALL SELECT 'documents.user_id', doc_id, user_id FROM docs WHERE user_id NOT IN (SELECT user_id FROM u)
UNION ALL SELECT 'document_data.doc_id', data_id, doc_id FROM data WHERE doc_id NOT IN (SELECT doc_id FROM dd)
UNION ALL SELECT 'document_data.field_id', data_id, field_id FROM data WHERE field_id NOT IN (SELECT field_id FROM ff)""")
def orphan_report(spark, d):
    """Every child row is checked; some parents are taken away to give orphans."""
    docs, data = t.documents(spark, d), t.document_data(spark, d)
    types = t.document_types(spark).filter("type_id <> 4")
    users = t.users(spark, d).filter("user_id % 50 <> 0")
    fields = t.data_fields(spark).filter("field_name <> 'child_first'")
    kept = docs.filter("doc_id % 40 <> 0").select("doc_id")
    both = merge.orphans(docs, types, users, data, fields).filter("relation not like 'document_data.doc_id'")
    gone = data.join(kept, "doc_id", "left_anti").select(
        F.lit("document_data.doc_id").alias("relation"), F.col("data_id").alias("row_id"),
        F.col("doc_id").alias("missing_key"))
    return both.unionByName(gone)


@query("cascade_delete", with_ctes(DOCS, DATA) + """
SELECT data.data_id, data.doc_id, data.field_id FROM data
WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE status = 'Rejected')""")
def cascade_delete(spark, d):
    gone = t.documents(spark, d).filter("status = 'Rejected'")
    return merge.cascade_delete(t.document_data(spark, d), gone).select("data_id", "doc_id", "field_id")


@query("edited_keys", """
WITH e AS (SELECT l_orderkey AS doc_id, CASE l_linenumber WHEN 1 THEN 'f1a_sex' WHEN 2 THEN 'form1A' WHEN 3 THEN 'f2a_dod'
  WHEN 4 THEN 'f3a_husband_mother_nat' WHEN 5 THEN 'certFormContent' WHEN 6 THEN 'f1a_verified_pos' ELSE 'child_first' END AS key FROM lineitem)
SELECT doc_id, key, CASE key WHEN 'f1a_sex' THEN 'sex' WHEN 'f2a_dod' THEN 'date_of_death'
  WHEN 'f3a_husband_mother_nat' THEN 'husband_mother_citizenship' WHEN 'f1a_verified_pos' THEN 'verified_position'
  WHEN 'child_first' THEN 'child_first' END AS field_name,
  key IN ('form1A', 'certFormContent') AS rejected, count(*) AS n FROM e GROUP BY ALL""")
def edited_keys(spark, d):
    keys = {1: "f1a_sex", 2: "form1A", 3: "f2a_dod", 4: "f3a_husband_mother_nat", 5: "certFormContent",
            6: "f1a_verified_pos", 7: "child_first"}
    key = codes.lookup(keys, F.col("l_linenumber"))
    rows = t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), key.alias("key"))
    done = rows.withColumn("field_name", compose.canonical_edit_key(F.col("key")))
    return (done.withColumn("rejected", F.col("field_name").isNull())
            .groupBy("doc_id", "key", "field_name", "rejected").agg(F.count(F.lit(1)).alias("n")))


@query("edited_fields", """
WITH e AS (SELECT l_orderkey AS doc_id, (['autopsy', 'husband_consent_residence', 'wife_dob_day', 'groom_prev_marriage',
  'bride_mother_citizenship', 'f1a_mother_nat', 'form2A', 'mother_religion', 'marriage_time', 'bride_husband_first', 'f3a_dom',
  'date_of_marriage_of_parents'])[1 + l_partkey % 12] AS key FROM lineitem)
SELECT key, CASE key WHEN 'f1a_mother_nat' THEN 'mother_citizenship' WHEN 'f3a_dom' THEN 'date_of_marriage'
  WHEN 'form2A' THEN NULL WHEN 'bride_husband_first' THEN NULL ELSE key END AS field_name,
  count(*) AS n, count(DISTINCT doc_id) AS documents FROM e GROUP BY ALL""")
def edited_fields(spark, d):
    """Edited keys of all parts of the field dictionary, with the documents they come from."""
    keys = ("autopsy", "husband_consent_residence", "wife_dob_day", "groom_prev_marriage", "bride_mother_citizenship",
            "f1a_mother_nat", "form2A", "mother_religion", "marriage_time", "bride_husband_first", "f3a_dom",
            "date_of_marriage_of_parents")
    key = codes.lookup(dict(enumerate(keys)), (F.col("l_partkey") % len(keys)).cast("int"))
    rows = t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), key.alias("key"))
    done = rows.withColumn("field_name", compose.canonical_edit_key(F.col("key")))
    return done.groupBy("key", "field_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


@query("required_fields", """
WITH r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'form1a' WHEN 1 THEN 'form2a' WHEN 2 THEN 'form3a' ELSE 'form90' END AS folder,
  c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS d, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS p FROM customer),
e AS (SELECT c_custkey, folder, list_filter(CASE folder
  WHEN 'form1a' THEN [CASE WHEN coalesce(d, '') = '' THEN 'Missing required field: date_of_birth' END, CASE WHEN coalesce(p, '') = '' THEN 'Missing required field: place_of_birth' END]
  WHEN 'form2a' THEN ['Missing required field: date_of_death', 'Missing required field: place_of_death']
  WHEN 'form3a' THEN ['Missing required field: husband_name', 'Missing required field: wife_name', 'Missing required field: date_of_marriage']
  ELSE ['Missing required field: husband_name', 'Missing required field: wife_name', 'Missing required field: date_of_application'] END, lambda x: x IS NOT NULL) AS errs FROM r)
SELECT c_custkey, folder, len(errs) = 0 AS is_valid, array_to_string(errs, '; ') AS errors FROM e""")
def required_fields(spark, d):
    from vitalforms.operators.validate import required_errors

    folder = codes.lookup({0: "form1a", 1: "form2a", 2: "form3a", 3: "form90"}, (F.col("c_custkey") % 4).cast("int"))
    data = F.create_map(
        F.lit("name"), F.col("c_name"),
        F.lit("date_of_birth"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")),
        F.lit("place_of_birth"), F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment")))
    rows = t.read(spark, d, "customer").select("c_custkey", folder.alias("folder"), data.alias("data"))
    errs = rows.withColumn("errs", required_errors(F.col("data"), F.col("folder")))
    return errs.select("c_custkey", "folder", (F.size("errs") == 0).alias("is_valid"),
                       F.array_join("errs", "; ").alias("errors"))
