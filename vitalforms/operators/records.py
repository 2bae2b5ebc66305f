"""Record list: documents joined to their fields, composed and searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalforms.catalog import fields as cat
from vitalforms.functions import codes
from vitalforms.functions import fragments as sql
from vitalforms.functions.text import db_trim, map_getter, null_chain


def latest_values(data: DataFrame, keys: tuple[str, ...] = ("doc_id", "field_name")) -> DataFrame:
    """Last write per key wins; equal data ids fall back to the larger value."""
    return data.groupBy(*keys).agg(
        F.max(F.struct("data_id", "extracted_value")).alias("_last")
    ).select(*keys, F.col("_last.extracted_value").alias("extracted_value"))


def pivot_fields(data: DataFrame) -> DataFrame:
    """Long field rows to one ``fields`` map per document.

    The last-write choice runs first, combined on the map side, so a map
    never holds more entries than there are distinct field names.
    """
    entry = F.struct("field_name", "extracted_value")
    return latest_values(data).groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("fields"))


def pivot_columns(data: DataFrame, known: list[str]) -> DataFrame:
    """Wide form of ``pivot_fields`` for a list of known field names."""
    get = map_getter("fields")
    return pivot_fields(data).select("doc_id", *[get(f).alias(f) for f in known])


def unpivot_fields(records: DataFrame, key: str, columns: list[str],
                   confidence: Column | None = None) -> DataFrame:
    """Wide columns to one row per non-blank field."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("extracted_value"))
                      for c in columns])
    return (records
            .select(key, (confidence if confidence is not None else F.lit(0.0)).alias("ner_confidence_score"),
                    F.inline_outer(pairs))
            .filter(db_trim(F.col("extracted_value")) != ""))


def named_data(document_data: DataFrame, data_fields: DataFrame) -> DataFrame:
    """Field rows with their names (the dictionary is a small dimension)."""
    return document_data.join(data_fields.select("field_id", "field_name"), "field_id")


def listed_documents(documents: DataFrame, types: DataFrame, users: DataFrame) -> DataFrame:
    """Documents with their type and uploader; unmatched ones are left out."""
    return (documents
            .join(F.broadcast(types.select("type_id", "type_code", "type_name")), "type_id")
            .join(users.select("user_id", F.col("username").alias("uploader_name")), "user_id"))


def _composed(kind: str, r: sql.Get) -> dict[str, str]:
    """Screen field -> expression, for one kind of record."""
    def name(p: str) -> str:
        return sql.record_name(r(f"{p}_first"), r(f"{p}_middle"), r(f"{p}_last"))

    def short_name(p: str) -> str:
        return sql.record_name(r(f"{p}_first"), r(f"{p}_last"))

    def date(p: str) -> str:
        return sql.record_date(r(f"{p}_month"), r(f"{p}_day"), r(f"{p}_year"))

    def place(a: str, b: str) -> str:
        return sql.record_place(r(a), r(b))

    if kind == "birth":
        return {
            "child_name": name("child"), "sex": r("sex"), "date_of_birth": date("dob"),
            "place_of_birth": place("pob_city", "pob_province"),
            "mother_name": name("mother"), "mother_nationality": r("mother_citizenship"),
            "father_name": name("father"), "father_nationality": r("father_citizenship"),
            "parents_marriage_date": date("parents_marriage"),
            "parents_marriage_place": place("parents_marriage_city", "parents_marriage_province"),
        }
    if kind == "death":
        return {
            "deceased_name": name("deceased"), "sex": r("sex"), "age": r("age_years"),
            "civil_status": r("civil_status"), "nationality": r("citizenship"),
            "date_of_death": date("dod"), "place_of_death": place("pod_hospital", "pod_city"),
            "cause_of_death": r("cause_immediate"),
        }
    certificate = kind == "marriage-cert"
    out: dict[str, str] = {}
    for shown, stored in (("husband", "husband" if certificate else "groom"),
                          ("wife", "wife" if certificate else "bride")):
        out[f"{shown}_name"] = name(stored)
        out[f"{shown}_age"] = r(f"{stored}_age")
        out[f"{shown}_nationality"] = r(f"{stored}_citizenship")
        for parent in ("mother", "father"):
            out[f"{shown}_{parent}_name"] = short_name(f"{stored}_{parent}")
            if certificate:
                out[f"{shown}_{parent}_nationality"] = r(f"{stored}_{parent}_citizenship")
    out["date_of_marriage"] = date("marriage")
    out["place_of_marriage"] = place("marriage_venue", "marriage_city")
    if not certificate:
        out["license_no"] = r("license_no")
    return out


KINDS = ("birth", "death", "marriage-cert", "marriage-license")


def form_data(kind: str, fields: str) -> Column:
    """Screen fields of a record as a map, by record kind."""
    r = sql.key_of(fields)
    shared = {k: sql.null_chain(*[r(s) for s in src]) for k, src in cat.SHARED_SCREEN.items()}

    def whole(values: dict[str, str]) -> str:
        return sql.as_map(shared | {k: sql.null_chain(v) for k, v in values.items()})

    composed = sql.case(kind, {k: whole(_composed(k, r)) for k in KINDS}, whole({}))
    # separator-only values such as " , " are blanked in one pass over the map
    return F.expr(f"transform_values({composed}, (k, v) -> CASE WHEN btrim(v, ' ,') = '' THEN '' ELSE v END)")


def display_name(kind: str, fields: str, fallback: str) -> Column:
    """Name shown in the list: the person, the couple, or the uploader."""
    r = sql.key_of(fields)

    def shown(*people: str) -> str:
        # a bare '0' counts as no name
        names = [sql.record_name(r(f"{p}_first"), r(f"{p}_last")) for p in people]
        return sql.or_chain(sql.join_filled(" & ", *names, unlike="0"), fallback)

    return F.expr(sql.case(kind, {
        "birth": shown("child"), "death": shown("deceased"),
        "marriage-cert": shown("husband", "wife"), "marriage-license": shown("groom", "bride"),
    }, fallback))


def records(documents: DataFrame, types: DataFrame, users: DataFrame,
            document_data: DataFrame, data_fields: DataFrame) -> DataFrame:
    """The record list, unordered."""
    listed = listed_documents(documents, types, users).withColumn(
        "type", codes.kind_of_code(F.col("type_code")))
    # No semi-join is needed before the pivot when both sides meet on doc_id
    # right after it: the left join keeps listed documents only.
    fields = pivot_fields(named_data(document_data, data_fields))
    joined = listed.join(fields, "doc_id", "left")
    return joined.select(
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("id"),
        "doc_id", "type",
        display_name("type", "fields", "uploader_name").alias("name"),
        F.date_format("upload_date", "yyyy-MM-dd").alias("date"),
        "status", "upload_date",
        form_data("type", "fields").alias("form_data"),
    )


def newest_first(records_df: DataFrame) -> DataFrame:
    return records_df.orderBy(F.desc("upload_date"), F.desc("doc_id"))


def date_floor(bucket: str, as_of: Column) -> Column:
    """Earliest date a date bucket accepts."""
    return {
        "today": as_of,
        "week": F.date_sub(as_of, 7),
        "month": F.date_sub(as_of, 30),
        "year": F.add_months(as_of, -12),
    }[bucket]


def prefilter_documents(documents: DataFrame, kind: str = "", status: str = "",
                        date_bucket: str = "", as_of: Column | None = None) -> DataFrame:
    """The search conditions that need no field values, applied before the pivot."""
    out = documents
    if kind:
        type_id = {k: i for i, k in enumerate(KINDS, start=1)}[kind]
        out = out.filter(F.col("type_id") == type_id)
    if status:
        out = out.filter(F.col("status") == status)
    if date_bucket:
        floor = date_floor(date_bucket, as_of if as_of is not None else F.current_date())
        out = out.filter(F.col("upload_date") >= floor.cast("timestamp"))
    return out


def search_records(records_df: DataFrame, term: str = "", kind: str = "", status: str = "",
                   date_bucket: str = "", as_of: Column | None = None) -> DataFrame:
    """AND of the given conditions; an empty one always passes."""
    out = records_df
    if term:
        low = term.lower()
        out = out.filter(F.contains(F.lower("name"), F.lit(low)) | F.contains(F.lower("id"), F.lit(low)))
    if kind:
        out = out.filter(F.col("type") == kind)
    if status:
        out = out.filter(F.col("status") == status)
    if date_bucket:
        floor = date_floor(date_bucket, as_of if as_of is not None else F.current_date())
        out = out.filter(F.col("date").cast("date") >= floor)
    return out


def filled_count(fields: Column) -> Column:
    """Number of fields that hold a value."""
    return F.size(F.map_filter(fields, lambda _, v: F.coalesce(v, F.lit("")) != ""))


def receipts(documents: DataFrame, document_data: DataFrame, data_fields: DataFrame) -> DataFrame:
    """Issuance and payment fields of each document, amount also as a decimal."""
    wanted = ["issued_to", "amount_paid", "or_number", "date_paid"]
    named = named_data(document_data, data_fields.filter(F.col("field_name").isin(wanted)))
    wide = pivot_columns(named, wanted)
    out = documents.select("doc_id").join(wide, "doc_id", "left")
    return out.select("doc_id", *[null_chain(F.col(c)).alias(c) for c in wanted],
                      F.col("amount_paid").try_cast("decimal(10,2)").alias("amount"))


def status_counts(documents: DataFrame) -> DataFrame:
    """Documents per type and status with subtotals and the grand total."""
    return documents.rollup("type_id", "status").agg(F.count(F.lit(1)).alias("documents"))


def dashboard_counts(documents: DataFrame) -> DataFrame:
    """Documents per type, status and month."""
    month = F.date_trunc("month", F.col("upload_date")).alias("month")
    return documents.groupBy("type_id", "status", month).agg(F.count(F.lit(1)).alias("documents"))
