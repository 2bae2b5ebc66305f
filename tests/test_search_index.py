import pytest

from pyspark.sql import functions as F

from vitalforms.operators.records import search_records
from vitalforms.session import work_dir
from vitalforms.store import search
from vitalforms.store.search import SearchIndex, grams_of

ROWS = [(1, "DOC-1", "birth", "Lea Ramos", "2000-06-15", "Pending"), (12, "DOC-12", "birth", "Ana", "2000-06-08", "Pending"),
        (3, "DOC-3", "death", "LEA & Ñandú Öz", "1999-06-15", "Approved"), (123, "DOC-123", "death", None, None, None),
        (40, "DOC-40", "birth", "", "2000-01-01", "Approved"), (41, "DOC-41", "birth", "Al", "2000-01-01", "Approved"),
        (42, "DOC-42", "birth", "aaaaaa", "2000-01-01", "Approved")]
TERMS = ["", "l", "le", "lea", "LEA R", "doc-1", "DOC-12", "-12", "ñandú", "& ñ", "zzz", "aaa", "aaaaaaa", "lea ramos", "mos", "lea  r"]


@pytest.mark.parametrize("lookup", [1000, 1])
def test_index_finds_what_the_scan_finds(spark, monkeypatch, lookup):
    monkeypatch.setattr(search, "LOOKUP", lookup)
    records = spark.createDataFrame(ROWS, "doc_id long, id string, type string, name string, date string, status string")
    index = SearchIndex.build(records, work_dir(spark, "test-search"), buckets=8)
    for term in TERMS:
        want = {r.id for r in search_records(records, term).collect()}
        assert {r.id for r in index.search(term).collect()} == want, term
    as_of = F.lit("2000-06-15").cast("date")
    assert [r.id for r in index.search("doc", kind="birth", status="Pending", date_bucket="today", as_of=as_of).collect()] == ["DOC-1"]


def test_search_reads_few_files(spark):
    rows = spark.range(400).selectExpr("id AS doc_id", "concat('DOC-', id) AS id", "concat('name ', uuid()) AS name")
    index = SearchIndex.build(spark.createDataFrame(rows.collect()), work_dir(spark, "test-search"), buckets=16)
    term = index.records().where("doc_id = 77").first()["name"][5:20]
    found = index.search(term)
    assert [r.doc_id for r in found.collect()] == [77]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan.replace("isnotnull(part#", "part") or "PartitionFilters: [(part" in plan, plan
    assert "EqualTo(doc_id,77)]" in plan


def test_grams():
    assert grams_of("Abcab") == ["abc", "bca", "cab"] and grams_of("ab") == []
