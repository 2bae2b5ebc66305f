import datetime

import pytest
from pyspark.sql import functions as F

from vitalforms.functions import distance, names, patterns
from vitalforms.functions import fragments as sql
from vitalforms.functions import text as tx


def column(spark, value, *exprs):
    return spark.createDataFrame([(value,)], "v string").select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first()


@pytest.mark.parametrize("parts, full", [
    (("Lea", "de la Paz", "Ramos"), "Lea de la Paz Ramos"), (("Lea", None, "Ramos"), "Lea Ramos"),
    (("Lea", "", "Ramos"), "Lea Ramos"), ((None, None, None), ""), (("  Lea ", "\tde\n", " Ramos "), "Lea de Ramos"),
    (("Lea", None, None), "Lea"), ((None, None, "Ramos"), "Ramos"),
])
def test_join_name(spark, parts, full):
    row = spark.createDataFrame([parts], "a string, b string, c string").select(
        names.join_name(F.col("a"), F.col("b"), F.col("c")).alias("n")).first()
    assert row.n == full


@pytest.mark.parametrize("full, parts", [
    ("Lea", ("Lea", None, None)), ("Lea Ramos", ("Lea", None, "Ramos")), ("Lea de Ramos", ("Lea", "de", "Ramos")),
    (" Lea  de la   Paz Ramos ", ("Lea", "de la Paz", "Ramos")), ("", (None, None, None)), (None, (None, None, None)),
])
def test_split_name(spark, full, parts):
    assert tuple(column(spark, full, names.split_name(F.col("v"))).c0) == parts


def test_split_then_join_is_identity(spark):
    n = names.split_name(F.col("v"))
    got = column(spark, "Juan dela Cruz Santos", names.join_name(n["first"], n["middle"], n["last"]))
    assert got.c0 == "Juan dela Cruz Santos"


def test_record_and_screen_dates_differ_on_missing_parts(spark):
    row = spark.createDataFrame([("March", None, "2001")], "m string, d string, y string").selectExpr(
        f"{sql.record_date('m', 'd', 'y')} AS a", f"{sql.screen_date('m', 'd', 'y')} AS b",
        f"{sql.record_name('m', 'd', 'y')} AS c", f"{sql.screen_name('m', 'd', 'y')} AS e",
        f"{sql.record_place('m', 'd')} AS f").first()
    assert tuple(row) == ("March , 2001", "March 2001", "March  2001", "March 2001", "March")


def test_parse_date(spark):
    for value in ("March 5, 2001", "march  5 2001", "3/5/2001", "3-5-2001"):
        assert column(spark, value, names.parse_date(F.col("v"))).c0 == datetime.date(2001, 3, 5)
    assert column(spark, "sometime", names.parse_date(F.col("v"))).c0 is None


def test_patterns(spark):
    text = "Registered 12/05/1999 as LCR-2024-00123, MALE, roman catholic, 45 years old, WIDOWED filipino"
    x = F.col("v")
    row = column(spark, text, patterns.find_date(x), patterns.find_sex(x), patterns.find_religion(x),
                 patterns.find_age(x), patterns.find_age(x, strict=True), patterns.find_civil_status(x),
                 patterns.find_citizenship(x), patterns.find_registry_number(x))
    assert tuple(row) == ("12/05/1999", "Male", "roman catholic", "12", "45", "Widowed", "Filipino", "LCR-2024-00123")


def test_word_distance_counts_tokens(spark):
    rows = spark.createDataFrame([("a b c d", "a x c"), ("", "one two"), ("same words", "same words"),
                                  (" ".join(f"t{i}" for i in range(400)), " ".join(f"t{i}" for i in range(1, 401)))],
                                 "a string, b string")
    got = [r.d for r in rows.select(distance.word_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [2, 2, 0, 2]


def test_char_index(spark):
    assert column(spark, " A~é", tx.char_index(F.col("v"))).c0 == [1, 34, 95]
    assert column(spark, "é", tx.char_index(F.col("v"))).c0 == [1]


def test_paths(spark):
    row = column(spark, "a/b.c/scan_one.v2.JPG", tx.basename(F.col("v")), tx.stem_label(F.col("v")), tx.extension(F.col("v")))
    assert tuple(row) == ("scan_one.v2.JPG", "scan one.v2", "jpg")
