"""How often the store reads, moves and sorts its rows."""

import os

from pyspark.sql import functions as F

from vitalforms.operators import compose
from vitalforms.operators.ranking import digest, ranked, with_digest_bucket
from vitalforms.store.records import SCHEMAS, RecordStore


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranked_rows_move_once(spark):
    rows = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    keyed = with_digest_bucket(rows.withColumn("_d", digest(F.col("id"))), "_d")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = ranked(keyed, ["_d"], out="n")
    assert "SortMergeJoin" not in _plan(out)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    got = [r["id"] for r in out.orderBy("n").collect()]
    assert got == [r["id"] for r in keyed.orderBy("_d").collect()]
    assert sorted(r["n"] for r in out.collect()) == list(range(1, 501))


def test_ranked_null_bucket_keeps_its_rows(spark):
    rows = spark.createDataFrame([("b",), ("a",), (None,)], "k string")
    out = ranked(rows.withColumn("_bucket", F.substring("k", 1, 1)), ["k"], out="n")
    assert {(r["k"], r["n"]) for r in out.collect()} == {("a", 1), ("b", 2), (None, 3)}


def test_upload_rows_are_made_once(spark, tmp_path):
    fields = spark.createDataFrame([(1, "sex", "text")], SCHEMAS["fields"])
    store = RecordStore.create(spark, f"{tmp_path}/store", spark.createDataFrame([], SCHEMAS["documents"]).drop("bucket"),
                               spark.createDataFrame([], SCHEMAS["data"]).drop("bucket"), fields, buckets=2)
    uploads = spark.createDataFrame([("u1", 1, "birth", {"sex": "Male", "note": "n", "blank": " ", "none": None})],
                                    "upload_key string, user_id long, form_hint string, fields map<string,string>")
    store.ingest(uploads.withColumn("uploaded_at", F.lit("2020-01-01").cast("timestamp")), "desk", 0)
    assert os.path.isdir(f"{tmp_path}/store/staging/long=1")
    assert {(r["field_name"], r["extracted_value"]) for r in store.document_data().join(store.fields(), "field_id").collect()} == {
        ("sex", "Male"), ("note", "n")}


def test_stored_choices_stand_outside_of_lambdas(spark):
    raw = spark.createDataFrame([({"registry_number": "", "registry_no": "7", "city": "x", "note": "n", "empty": "", "none": None},), (None,)],
                                "r map<string,string>")
    out = raw.selectExpr(f"{compose.stored_fields('r', '1A')} AS m")
    assert _plan(out).count("lambdafunction") <= 4  # the carried keys, and what keeps the projection apart
    first, none = [r["m"] for r in out.collect()]
    assert first["registry_no"] == "7" and first["city_municipality"] == "x" and first["note"] == "n"
    assert first["province"] == "" and "empty" not in first and "none" not in first and none is None
