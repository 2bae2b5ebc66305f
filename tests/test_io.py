import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from vitalforms.session import work_dir
from vitalforms.sources import annotations as ann
from vitalforms.sources import requests, tables, writers
from vitalforms.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_every_sql_check_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_runs(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "form_data" not in df.columns


@pytest.mark.parametrize("name", ["records_search", "keyword_scan", "label_rollup", "validation_flags", "sequence_text",
                                  "licence_rejects", "status_update"])
def test_queries_match_sql(spark, name):
    from tools.compare import compare

    assert compare(spark, SF, [name]) == []


def test_work_dir_is_below_the_configured_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert work_dir(spark, "x").startswith(root) and work_dir(spark, "x") != work_dir(spark, "x")


def test_annotation_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"image_path": "form1a/x.jpg", "text": " A "}, {"image_path": "form1a/y.jpg", "text": "B"},'
                                     ' {"image_path": "form2a/x.jpg", "text": " "}]')
    files = spark.createDataFrame([("form1a/x.jpg",), ("form2a/x.jpg",)], "image_path string")
    kept, missing = ann.usable_annotations(ann.read_annotations(spark, str(tmp_path / "a.json")), files)
    assert [tuple(r) for r in kept.collect()] == [("form1a/x.jpg", "A")] and missing.first().missing == 1


def test_folder_with_sidecars(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for name, body in (("a_b.jpg", "x"), ("c.PNG", "x"), ("d.jpg", "x"), ("e.pdf", "x"), ("c.txt", " label c \n"), ("d.txt", " ")):
        (tmp_path / "s" / name).write_text(body)
    got = ann.folder_annotations(ann.list_files(spark, str(tmp_path)), ann.read_sidecars(spark, str(tmp_path)), str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("s/a_b.jpg", "a b"), ("s/c.PNG", "label c")]


def test_word_list_rules(spark):
    rows = ["# x", "", "a01-000u-00-00 ok 154 408 768 27 51 AT A", "a01-000u-00-01 err 154 1 1 1 1 AT B", "short ok x",
            "b02-001-00-02 ok 1 2 3 4 5 NN " + "y" * 33]
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    assert [tuple(r) for r in ann.read_word_list(df, max_length=32).collect()] == [("a01/a01-000u/a01-000u-00-00.png", "A")]


def test_requests(spark):
    rows = [('{"doc_id": 5, "status": null, "formData": {"a": "1"}}',), ('{"status": "x"}',), ("broken",), ('{"doc_id": 6}',)]
    got = requests.decode_requests(spark.createDataFrame(rows, "body string")).collect()
    assert [(r.doc_id, r.status, r.form_data) for r in got] == [(5, None, {"a": "1"}), (6, None, {})]


def test_results_leave_missing_fields_out(spark, tmp_path):
    writers.write_results(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ['{"a":1}']


def test_schemas_parse():
    assert all(tables.schema(t).fields for t in tables.SCHEMAS)
    assert "password_hash" not in tables.schema("users").fieldNames()


def test_repeated_uploads_are_dropped_across_batches(spark, tmp_path):
    start = datetime.datetime(2026, 1, 1, 8)
    for i, rows in enumerate(([("k1", start), ("k1", start)], [("k1", start + datetime.timedelta(minutes=5)), ("k2", start)])):
        spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), "key string, ts timestamp", files_per_trigger=1)
    jobs.run_available(jobs.drop_repeats(stream, "ts", ["key"]), str(tmp_path / "cp"), jobs.batch_folder_writer(str(tmp_path / "out")))
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["k1", "k2"]


def test_stream_counts_match_batch(spark, tmp_path):
    from vitalforms.plans.catalogue import QUERIES

    got = {(r.window_start.date(), r.event_type): r.n for r in QUERIES["stream_window"](spark, SF).collect()}
    ev = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.to_date("ts").alias("d"), "event_type").count().collect()
    assert got == {(r.d, r.event_type): r["count"] for r in ev}


def test_nested_name_file_repeats_last_names_as_middle_names(spark, tmp_path):
    (tmp_path / "names.json").write_text('{"first_names": {"all": ["Ada", "Bo"]},\n "last_names": ["Cruz"]}')
    got = sorted(tuple(r) for r in ann.read_name_pools(spark, str(tmp_path / "names.json")).collect())
    assert got == [("first", "Ada"), ("first", "Bo"), ("last", "Cruz"), ("middle", "Cruz")]
