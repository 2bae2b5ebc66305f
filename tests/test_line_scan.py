"""Dictionaries and lines of a form are made outside of lambdas; white space of any kind is stripped."""

import pytest
from pyspark.sql import functions as F

from vitalforms.functions.text import WHITESPACE, joined_lines
from vitalforms.operators import compose, extract
from vitalforms.plans import tables

KEYWORDS = [("sex", "S"), ("registry no", "R"), ("name", "N")]


@pytest.fixture
def folder(spark, tmp_path):
    made = {"orders": ([(7, 1), (8, 1), (None, 1)], "o_orderkey long, o_custkey long"), "customer": ([(1, 2)], "c_custkey long, c_nationkey long"),
            "nation": ([(2, "NARNIA")], "n_nationkey long, n_name string")}
    for name, (rows, schema) in made.items():
        out = spark.createDataFrame(rows, schema)
        out = out.withColumn("o_orderdate", F.lit("2020-03-04").cast("timestamp")) if name == "orders" else out
        out.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_dictionaries_are_made_outside_of_the_filter(spark, folder):
    for made in (tables.certificates, tables.typed_dictionaries, tables.field_dictionaries):
        rows = made(spark, folder)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "map_filter(_every" in plan and "map_filter(map(" not in plan
        assert rows.count() == 3
    by_id = {r.doc_id: r for r in tables.typed_dictionaries(spark, folder).collect()}
    assert by_id[7].fields["deceased_first_name"] and "child_first_name" not in by_id[7].fields and by_id[8].fields["husband_age"]
    assert all(v is not None for r in by_id.values() for v in r.fields.values()) and by_id[None].form_hint == "marriage"


def test_columns_beside_are_joined_before_dictionaries(spark, folder):
    beside = spark.createDataFrame([(7, "a"), (7, "b"), (None, "c")], "doc_id long, note string")
    rows = tables.typed_dictionaries(spark, folder, beside)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("AS _every") < plan.index("Join")  # the plan is printed from its root
    assert sorted((r.doc_id, r.note) for r in rows.collect()) == [(7, "a"), (7, "b")]


def test_lines_and_values_are_stripped_of_any_white_space(spark):
    texts = ["", " \r\n ", "Sex:　\x1fMale  \r\n\x0c\x85 Registry No. : x : y \nSEX: Female\nname:   name : é z",
             "nothing\nsex\n: sex", "sex" + " " * 5000 + ":" + " " * 5000 + "a" + " " * 5000 + "\nName:b", "".join(WHITESPACE) + "sex:c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    lined = {r.i: r.t for r in rows.select("i", joined_lines(F.col("t")).alias("t")).collect()}
    assert lined[0] == lined[1] == "" and lined[3] == "nothing\nsex\n: sex" and len(lined[2].split("\n")) == 5
    got = {r.i: r.labels for r in extract.with_keyword_scan(rows, "t", KEYWORDS).collect()}
    assert got == {0: {}, 1: {}, 2: {"S": "Male", "R": "x : y", "N": "é z"}, 3: {"S": "sex"}, 4: {"S": "a", "N": "b"}, 5: {"S": "c"}}
    plan = extract.with_keyword_scan(rows, "t", KEYWORDS)._jdf.queryExecution().analyzed().toString()
    assert "lower(_lines" in plan and "lower(lambda" not in plan


def test_sections_give_their_lines_a_role(spark):
    text = "Registry No.: 1 \nHUSBAND:\n 1. NAME (First): Al  (Middle):   (Last): Bo \n\n2b. AGE: 5\nWIFE: \nWIFE:\n2b. AGE: 6 \n"
    rows = spark.createDataFrame([(text,), ("",)], "t string")
    got = [r.x for r in rows.select(extract.sectioned_lines(F.col("t"), "97").alias("x")).collect()]
    assert got == [["Registry No.: 1", "husband NAME (First): Al", "husband NAME (Middle):", "husband NAME (Last): Bo", "husband AGE: 5", "wife AGE: 6"], []]


def test_text_is_rendered_from_fields_looked_up_once(spark):
    rows = spark.createDataFrame([("death", {"sex": "　F ", "age": " ", "age_years": "9"}), ("x", {"sex": "é"}), (None, None)],
                                 "k string, m map<string,string>")
    made = [r.form_text for r in compose.with_text_of_type(rows, "m", "k").collect()]
    assert "2. SEX: F\n4. AGE: 9\n" in made[0] and "2. SEX: é\n" in made[1] and "3. DATE OF BIRTH:  , \n" in made[2]
