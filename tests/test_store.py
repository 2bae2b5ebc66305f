from pyspark.sql import functions as F

from vitalforms.operators import merge, records

DATA = "data_id long, doc_id long, field_id int, extracted_value string, ner_confidence_score double, is_corrected boolean"


def store(spark):
    fields = spark.createDataFrame([(1, "Sex", "text"), (2, "city", "text")], "field_id int, field_name string, data_type string")
    data = spark.createDataFrame([(10, 1, 1, "M", 0.9, False), (11, 1, 1, "F", 0.8, False), (12, 2, 2, "Capas", 0.7, False)], DATA)
    return fields, data


def corrected(spark, fields, data):
    req = spark.createDataFrame([(1, {"sex": "Male", " ": "x"}), (2, {"note": "n", "city": "  "}), (3, {"CITY": "y" * 300})],
                                "doc_id long, form_data map<string,string>")
    rows = merge.correction_rows(req)
    known = merge.register_fields(fields, rows.select("field_name"))
    return known, merge.upsert_corrections(data, merge.with_field_id(rows, known), ["value"])


def test_upsert_and_registration(spark):
    known, out = corrected(spark, *store(spark))
    assert {r.field_id: r.field_name for r in known.collect()} == {1: "Sex", 2: "city", 3: "note"}
    got = {(r.doc_id, r.field_id, r.data_id): r for r in out.collect()}
    assert len(got) == 5
    assert got[1, 1, 10].extracted_value == "M" and not got[1, 1, 10].is_corrected
    assert got[1, 1, 11].extracted_value == "Male" and got[1, 1, 11].is_corrected and got[1, 1, 11].ner_confidence_score == 0.8
    new = [r for k, r in got.items() if k[0] in (2, 3) and r.data_id > 12]
    assert sorted(len(r.extracted_value) for r in new) == [1, 300] and all(r.ner_confidence_score == 0 for r in new)


def test_upsert_is_idempotent(spark):
    known, once = corrected(spark, *store(spark))
    again, twice = corrected(spark, known, once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, again.collect()))


def test_pivot_undoes_unpivot(spark):
    wide = spark.createDataFrame([(1, "a", "b"), (2, "c", None), (3, " ", "d")], "doc_id long, x string, y string")
    long = records.unpivot_fields(wide, "doc_id", ["x", "y"]).withColumn("data_id", F.col("doc_id"))
    back = {r.doc_id: (r.x, r.y) for r in records.pivot_columns(long, ["x", "y"]).collect()}
    assert back == {1: ("a", "b"), 2: ("c", None), 3: (None, "d")}


def test_latest_value_wins(spark):
    rows = spark.createDataFrame([(1, "f", 5, "old"), (1, "f", 9, "new"), (1, "g", 1, "z")],
                                 "doc_id long, field_name string, data_id long, extracted_value string")
    assert records.pivot_fields(rows).first().fields == {"f": "new", "g": "z"}


def test_search(spark):
    rows = spark.createDataFrame([
        ("DOC-1", "birth", "Lea Ramos", "2000-06-15", "Pending"), ("DOC-12", "birth", "Ana", "2000-06-08", "Pending"),
        ("DOC-3", "death", "LEA", "1999-06-15", "Approved")], "id string, type string, name string, date string, status string")
    as_of = F.lit("2000-06-15").cast("date")

    def ids(**kw):
        return [r.id for r in records.search_records(rows, as_of=as_of, **kw).collect()]

    assert ids() == ["DOC-1", "DOC-12", "DOC-3"] and ids(term="lea") == ["DOC-1", "DOC-3"]
    assert ids(term="doc-1") == ["DOC-1", "DOC-12"] and ids(kind="death") == ["DOC-3"]
    assert ids(date_bucket="today") == ["DOC-1"] and ids(date_bucket="week") == ["DOC-1", "DOC-12"]
    assert ids(date_bucket="year", status="Approved") == ["DOC-3"]
