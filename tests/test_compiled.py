"""Look-ups of a form stand outside of lambdas, where Spark compiles them; the results are those of the array forms."""

from pyspark.sql import functions as F

from vitalforms.functions import text as tx
from vitalforms.functions.names import join_name
from vitalforms.operators import compose, extract, forms


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_not_empty_is_filled(spark):
    rows = spark.createDataFrame([("",), (None,), (" ",), ("a",), ("é",)], "x string")
    got = rows.select(tx.not_empty(F.col("x")).alias("a"), tx.filled(F.col("x")).alias("b"), tx.apart(F.col("x")).alias("c"), "x")
    assert all(r.a == r.b and r.c == r.x for r in got.collect()) and [r.a for r in got.collect()] == [None, None, " ", "a", "é"]


def test_render_joins_outside_of_lambdas(spark):
    rows = spark.createDataFrame([({"a": " x ", "b": " "},), ({"b": "y"},), (None,)], "m map<string,string>")
    made = rows.select(F.expr(compose.render("A: {a|b}\n{b} 'q' {none}\n", lambda k: f"m['{k}']")).alias("t"))
    assert [r.t for r in made.collect()] == ["A: x\n 'q' \n", "A: y\ny 'q' \n", "A: \n 'q' \n"]
    assert "zip_with(" not in plan(made)


def test_names_and_records_have_no_lambda_a_field(spark):
    labels = spark.createDataFrame([({"F97_WIFE_FIRST": " Mia ", "F97_WIFE_LAST": "", "F97_WIFE_AGE": ""},)], "labels map<string,string>")
    named = labels.select(join_name(F.col("labels")["F97_WIFE_FIRST"], F.col("labels")["F97_WIFE_LAST"], F.lit(" ")).alias("n"))
    assert named.first().n == "Mia" and "lambda" not in plan(named)
    record = labels.select(forms.form_3a(F.col("labels")).alias("f"))
    assert record.first().f.wife.age is None and plan(record).count("lambdafunction") <= 3


def test_offers_fill_gaps_alone(spark):
    rows = spark.createDataFrame([(1, {"a": "1"}, None), (2, {}, None), (3, {"a": "1"}, "z"), (4, None, "z")],
                                 "k int, m map<string,string>, o string")
    got = extract.fill_missing(rows, "m", extract._as_map({"a": F.lit("new"), "b": F.col("o"), "c": F.lit("")}))
    assert got.columns == rows.columns
    assert {r.k: r.m for r in got.collect()} == {1: {"a": "1"}, 2: {"a": "new"}, 3: {"a": "1", "b": "z"}, 4: None}


def test_first_value_of_a_label_and_values_stripped_on_the_left(spark):
    text = "Sex:   Male 　\n  Registry No. :x\nsex: Female\nname (first):\n"
    got = extract.with_keyword_scan(spark.createDataFrame([(text,)], "t string"), "t", [("sex", "S"), ("registry no", "R"), ("name", "N")])
    assert got.first().labels == {"S": "Male", "R": "x"}
