"""The analytics tables seen as the record store and as recognised forms.

Every view is a list of SQL expressions that read one table (or a join of
tables) the same way in any engine, so a check in another engine starts from
the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalforms.catalog.fields import DATA_FIELDS
from vitalforms.catalog.forms import FORM_TYPES
from vitalforms.functions.patterns import MONTHS
from vitalforms.functions.text import apart
from vitalforms.session import small_table

# Which stored field a line number stands for, per form type.
LINE_FIELDS = {
    1: ("child_first", "child_last", "dob_month", "dob_year", "pob_city", "pob_province", "registry_no"),
    2: ("deceased_first", "deceased_last", "dod_month", "dod_year", "pod_hospital", "pod_city", "date_issuance"),
    3: ("husband_first", "husband_last", "wife_first", "wife_last", "marriage_month", "marriage_year",
        "marriage_city"),
    4: ("groom_first", "groom_last", "bride_first", "bride_last", "license_no", "marriage_venue", "amount_paid"),
}
FIELD_ID = {name: i for i, name in enumerate(DATA_FIELDS, start=1)}

DOCUMENTS = [
    "o_orderkey AS doc_id", "o_custkey AS user_id", "CAST(o_orderkey % 4 + 1 AS INT) AS type_id",
    "CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Pending' ELSE 'Rejected' END AS status",
    "o_orderdate AS upload_date",
]
USERS = ["c_custkey AS user_id", "c_name AS username"]


def _field_case() -> str:
    arms = " ".join(
        f"WHEN {(t - 1) * 8 + line} THEN {FIELD_ID[name]}"
        for t, names in LINE_FIELDS.items() for line, name in enumerate(names, start=1))
    return f"CAST(CASE (l_orderkey % 4) * 8 + l_linenumber {arms} END AS INT)"


DOCUMENT_DATA = [
    "(l_orderkey * 8 + l_linenumber) * 1000000000 + (l_partkey * 10007 + l_suppkey) % 1000000000 AS data_id",
    "l_orderkey AS doc_id", f"{_field_case()} AS field_id",
    "CASE WHEN l_partkey % 11 = 0 THEN ' ' "
    "ELSE l_returnflag || l_linestatus || '-' || CAST(l_suppkey AS STRING) END AS extracted_value",
    "CAST(l_discount AS DOUBLE) AS ner_confidence_score", "l_linestatus = 'F' AS is_corrected",
]


def _pool(entries: str, index: str) -> str:
    n = entries.count(",") + 1
    return f"split_part('{entries}', ',', CAST(({index}) % {n} + 1 AS INT))"


_FIRST = "Aldo,Brina,Celso,Dalia,Emil,Fina,Gorio,Hilda"
_LAST = "De Abril,Bituin,Calixto,Dimaano,Estacio,Fortun,Galvan"
_CITY = "Alta Vista,Belmira,Corvina,Dos Rios,Esperia,Fontana,Gavilan"
_CITIZEN = "Filipino,American,Chinese,Japanese"
_RELIGION = "Roman Catholic,Islam,Baptist"
_CIVIL = "Single,Married,Widowed"
_CAUSE = "Pneumonia,Septicemia,Renal Failure"
_MONTHS = ",".join(MONTHS)

_K, _C = "o_orderkey", "o_custkey"
_MONTH = _pool(_MONTHS, "month(o_orderdate) - 1")
_DAY, _YEAR = "CAST(day(o_orderdate) AS STRING)", "CAST(year(o_orderdate) AS STRING)"


def _blank(when: str, value: str) -> str:
    return f"CASE WHEN {when} THEN ' ' ELSE {value} END"


def _person(prefix: str, shift: int) -> dict[str, str]:
    return {
        f"{prefix}_first_name": _pool(_FIRST, f"{_K} + {shift}"),
        f"{prefix}_middle_name": _blank(f"({_K} + {shift}) % 5 = 0", _pool(_LAST, f"{_C} + {shift}")),
        f"{prefix}_last_name": _pool(_LAST, f"{_K} + {_C} + {shift}"),
    }


# Raw field dictionary of every order, one expression per key.
RAW_FIELDS: dict[str, str] = {
    "registry_number": f"CASE WHEN {_K} % 10 = 0 THEN NULL ELSE {_YEAR} || '-' || "
                       f"lpad(CAST({_K} % 100000 AS STRING), 5, '0') END",
    "registry_no": f"'LCR-' || lpad(CAST({_K} % 10000 AS STRING), 4, '0')",
    "date_of_registration": f"{_MONTH} || ' ' || {_DAY} || ', ' || {_YEAR}",
    "sex": f"CASE {_K} % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE ' ' END",
    "dob_month": _MONTH, "dob_day": _DAY, "dob_year": _YEAR,
    "place_birth_hospital": _blank(f"{_K} % 4 = 0", "'Clinic of ' || " + _pool(_CITY, _C)),
    "place_birth_city": _pool(_CITY, _C), "place_birth_province": "n_name",
    "nationality_of_mother": _blank(f"{_K} % 6 = 0", _pool(_CITIZEN, _K)),
    "mother_citizenship": _pool(_CITIZEN, _C),
    "father_citizenship": _pool(_CITIZEN, f"{_C} + 1"),
    **_person("child", 0), **_person("mother", 1), **_person("father", 2),
    "parents_marriage_month": _MONTH, "parents_marriage_day": _DAY,
    "parents_marriage_year": "CAST(year(o_orderdate) - 9 AS STRING)",
    "parents_marriage_city": _pool(_CITY, _K), "parents_marriage_province": "n_name",
    **_person("deceased", 3),
    "age": _blank(f"{_K} % 7 = 0", f"CAST({_K} % 90 + 1 AS STRING)"),
    "civil_status": _blank(f"{_K} % 8 = 0", _pool(_CIVIL, _K)),
    "citizenship": _pool(_CITIZEN, _K),
    "dod_month": _MONTH, "dod_day": _DAY, "dod_year": _YEAR,
    "place_death_hospital": "'Clinic of ' || " + _pool(_CITY, _C),
    "place_death_city": _pool(_CITY, _K), "place_death_province": "n_name",
    "cause_of_death": _pool(_CAUSE, _K), "cause_antecedent": _pool(_CAUSE, _C),
    "cause_underlying": _blank(f"{_K} % 2 = 0", _pool(_CAUSE, f"{_C} + 1")),
    **_person("husband", 4), **_person("wife", 5),
    "husband_age": f"CAST({_K} % 60 + 18 AS STRING)", "wife_age": f"CAST({_C} % 60 + 18 AS STRING)",
    "husband_nationality": _pool(_CITIZEN, _K), "wife_citizenship": _pool(_CITIZEN, _C),
    "husband_father_first": _pool(_FIRST, f"{_K} + 6"), "husband_father_last": _pool(_LAST, f"{_K} + 6"),
    "wife_mother_first": _pool(_FIRST, f"{_C} + 7"), "wife_mother_last": _pool(_LAST, f"{_C} + 7"),
    "place_marriage_city": _pool(_CITY, _K), "place_marriage_province": "n_name",
    "date_marriage_month": _MONTH, "date_marriage_day": _DAY, "date_marriage_year": _YEAR,
}
RAW_FROM = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"

_SHARED = ("registry_number", "registry_no", "date_of_registration", "sex")
KEYS_OF_TYPE = {
    "birth": tuple(k for k in RAW_FIELDS if k in _SHARED or k.startswith(
        ("dob_", "place_birth", "child_", "mother_", "father_", "parents_", "nationality_of"))),
    "death": tuple(k for k in RAW_FIELDS if k in _SHARED[1:] or k.startswith(
        ("deceased_", "age", "civil", "citizenship", "dod_", "place_death", "cause_"))),
    "marriage": tuple(k for k in RAW_FIELDS if k in _SHARED[1:3] or k.startswith(
        ("husband_", "wife_", "place_marriage", "date_marriage"))),
}
# Form type of an order and the hint that comes with it (none for a quarter).
ORDER_TYPE = f"CASE {_K} % 3 WHEN 0 THEN 'birth' WHEN 1 THEN 'death' ELSE 'marriage' END"
ORDER_HINT = f"CASE WHEN {_K} % 4 = 0 THEN NULL ELSE {ORDER_TYPE} END"


PARTITIONS = "spark.vitalforms.read.partitions"


def wanted_partitions(spark: SparkSession) -> int | None:
    """Into how many partitions costly rows are dealt when they are read; unset (None) leaves the files' own splits."""
    value = spark.conf.get(PARTITIONS, "")
    return int(value) if value else None


def dealt_partitions(spark: SparkSession) -> int:
    """The same for short rows from which much is computed: unset, a few tasks for every core.

    The file of a million such rows is a few MB, which is one split or two.
    """
    least = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return wanted_partitions(spark) or least


def read(spark: SparkSession, folder: str, table: str, partitions: int | None = None) -> DataFrame:
    """One table; ``partitions`` deals its rows out anew, for files whose row groups are too few to split."""
    rows = spark.read.parquet(f"{folder}/{table}.parquet")
    return rows if partitions is None else rows.repartition(partitions)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").selectExpr(*DOCUMENTS)


def users(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "customer").selectExpr(*USERS)


def document_types(spark: SparkSession) -> DataFrame:
    return small_table(spark, [r[:3] for r in FORM_TYPES], "type_id int, type_code string, type_name string")


def data_fields(spark: SparkSession) -> DataFrame:
    return small_table(spark, [(i, n, "text") for n, i in FIELD_ID.items()],
                       "field_id int, field_name string, data_type string")


def document_data(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").selectExpr(*DOCUMENT_DATA)


def _raw_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What the raw fields are made of: an order, its customer and nation."""
    o = read(spark, folder, "orders", dealt_partitions(spark))
    c, n = (read(spark, folder, t) for t in ("customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(
        n, F.col("c_nationkey") == F.col("n_nationkey"))


def raw_columns(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """doc_id and every raw field as a column."""
    return _raw_rows(spark, folder).selectExpr("o_orderkey AS doc_id", *extra, *[f"{e} AS {k}" for k, e in RAW_FIELDS.items()])


def field_map(keys: tuple[str, ...]) -> Column:
    """Map of the given raw columns, without the missing ones."""
    pairs: list[Column] = []
    for k in keys:
        pairs += [F.lit(k), F.col(k)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _every_field(keys: tuple[str, ...]) -> Column:
    """Map of the given raw fields, missing ones as NULL; made of ``_raw_rows`` and compiled (see ``text.apart``)."""
    pairs: list[Column] = []
    for i, k in enumerate(keys):
        pairs += [F.lit(k), F.expr(RAW_FIELDS[k]) if i else apart(F.expr(RAW_FIELDS[k]))]
    return F.create_map(*pairs)


def _dictionaries(rows: DataFrame, fields: Column, *columns: str) -> DataFrame:
    """The columns, and a map without its missing entries.

    The map is a column that is mentioned twice, so it is not drawn into the
    filter, which would evaluate the expressions of its values node by node.
    """
    made = rows.select(*columns, fields.alias("_every"))
    kept = F.when(F.size("_every") >= 0, F.map_filter("_every", lambda _, v: v.isNotNull()))
    return made.withColumn("fields", kept).drop("_every")


def field_dictionaries(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, fields) with every raw field of each order."""
    rows = _raw_rows(spark, folder).withColumn("doc_id", F.col("o_orderkey"))
    return _dictionaries(rows, _every_field(tuple(RAW_FIELDS)), "doc_id")


def typed_dictionaries(spark: SparkSession, folder: str, beside: DataFrame | None = None) -> DataFrame:
    """(doc_id, form_hint, fields) with the fields of each order's own form.

    ``beside`` has further columns by doc_id; they are joined before the
    dictionaries are made, which are many times as long as an order.
    """
    rows = _raw_rows(spark, folder).selectExpr("*", "o_orderkey AS doc_id", f"{ORDER_TYPE} AS _type", f"{ORDER_HINT} AS form_hint")
    extra = [] if beside is None else [c for c in beside.columns if c != "doc_id"]
    if beside is not None:
        rows = rows.join(beside, "doc_id")
    fields = F
    for kind, keys in KEYS_OF_TYPE.items():
        fields = fields.when(F.col("_type") == kind, _every_field(keys))
    made = _dictionaries(rows, fields, "doc_id", "form_hint", *extra)
    return made.select("doc_id", "form_hint", "fields", *extra)


def certificates(spark: SparkSession, folder: str) -> DataFrame:
    """(application_id, role, fields): two certificates per application.

    Orders 2n and 2n+1 form application n; roles are swapped for every
    seventh application and doubled for every eleventh.
    """
    rows = _raw_rows(spark, folder).selectExpr(
        "*", "CAST(floor(o_orderkey / 2) AS BIGINT) AS application_id",
        "CASE WHEN (CAST(floor(o_orderkey / 2) AS BIGINT)) % 11 = 0 THEN 'groom' "
        "WHEN o_orderkey % 2 = (CASE WHEN (CAST(floor(o_orderkey / 2) AS BIGINT)) % 7 = 0 THEN 1 ELSE 0 END) THEN 'groom' "
        "ELSE 'bride' END AS role")
    return _dictionaries(rows, _every_field(KEYS_OF_TYPE["birth"]), "application_id", "role")
