import pytest
from pyspark.sql import functions as F

from vitalforms.operators import classify, compose, extract, forms, records, validate
from vitalforms.plans import digitize

BIRTH = ("Registry No.: 2024-00017\n1. NAME (First): Lea  (Middle): de la Paz  (Last): Ramos\n2. SEX: female\n"
         "3. DATE OF BIRTH: May 4, 1999\n4. PLACE OF BIRTH: Capas\n"
         "7. MAIDEN NAME (First): Rosa  (Middle): Cruz  (Last): Paz\n8. CITIZENSHIP: Filipino\n"
         "14. NAME (First): Jose  (Middle): Lim  (Last): Ramos\n15. CITIZENSHIP: Korean\n")


def labels(spark, text, form, **kw):
    df = spark.createDataFrame([(1, text)], "doc_id int, t string")
    return extract.with_labels(df, "t", form, **kw).first().labels


def test_lines_mode_keeps_inline_parts_and_first_keyword(spark):
    got = labels(spark, BIRTH, "102")
    assert got["F102_CHILD_FIRST"] == "Lea  (Middle): de la Paz  (Last): Ramos"
    assert "F102_MOTHER_FIRST" not in got and "F102_FATHER_FIRST" not in got
    assert got["F102_MOTHER_CITIZENSHIP"] == "Filipino" and got["F102_FATHER_CITIZENSHIP"] == "Korean"
    assert got["F102_SEX"] == "female" and got["F102_REGISTRY_NO"] == "2024-00017"


def test_sections_mode_separates_people(spark):
    got = labels(spark, BIRTH, "102", mode="sections")
    assert got["name_of_child"] == "Lea de la Paz Ramos"
    assert got["name_of_mother"] == "Rosa Cruz Paz" and got["name_of_father"] == "Jose Lim Ramos"


def test_sections_mode_reads_two_column_forms(spark):
    text = ("HUSBAND:\n1. NAME (First): Leo  (Middle): B  (Last): Tan\n2b. AGE: 31\nWIFE:\n"
            "1. NAME (First): Mia  (Middle):   (Last): Uy\n4b. CITIZENSHIP/NATIONALITY: Chinese\n"
            "10. NAME OF MOTHER (First): Ana  (Middle): C  (Last): Uy\n16. DATE OF MARRIAGE: May 1, 2010\n")
    got = labels(spark, text, "97", mode="sections")
    assert got["husband_name"] == "Leo B Tan" and got["wife_name"] == "Mia Uy"
    assert got["F97_HUSBAND_AGE"] == "31" and got["F97_WIFE_CITIZENSHIP"] == "Chinese"
    assert got["wife_name_of_mother"] == "Ana C Uy" and got["F97_DATE_OF_MARRIAGE"] == "May 1, 2010"


def test_pattern_fallback_only_fills_gaps(spark):
    got = labels(spark, "The deceased, a MARRIED Japanese farmer aged 77, died on June 1, 2001", "103")
    assert got["F103_CIVIL_STATUS"] == "Married" and got["F103_CITIZENSHIP"] == "Japanese"
    assert got["F103_AGE"] == "77" and got["F103_DATE_OF_DEATH"] == "June 1, 2001"
    assert labels(spark, "CIVIL STATUS: none\nmarried", "103")["F103_CIVIL_STATUS"] == "none"


def test_entities_fill_before_patterns(spark):
    df = spark.createDataFrame([("x born March 3, 1990", {"PERSON": "Ana Luz Sy", "GPE": "Capas", "DATE": "1990",
                                                         "F102_SEX": "Female"})], "t string, e map<string,string>")
    got = extract.with_labels(df, "t", "102", entities="e").first().labels
    assert got["name_of_child"] == "Ana Luz Sy" and got["F102_PLACE_OF_BIRTH"] == "Capas"
    assert got["F102_DATE_OF_BIRTH"] == "1990" and got["F102_SEX"] == "Female"


@pytest.mark.parametrize("form", ["102", "103", "97", "90_groom", "90_bride"])
@pytest.mark.parametrize("mode", ["lines", "sections"])
def test_edge_texts_do_not_fail(spark, form, mode):
    texts = ["", "   \n\n\t ", "@@ ## $$", "1. NAME (First): A  (Last): B\n" * 200, "SEX Male DATE May 1 2000",
             "\x00\x01\x02", "\n\n\n", "HUSBAND:\nWIFE:\n", "::::\n:x", None, "Kasarian: Lalaki\nPetsa: Enero 5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, t string")
    got = {r.doc_id: r.labels for r in extract.with_labels(df, "t", form, mode=mode).collect()}
    assert len(got) == len(texts) and got[0] == {} and got[1] == {} and got[9] == {}


def test_flatten_and_json_drop_missing(spark):
    df = spark.createDataFrame([(1, {"F97_WIFE_AGE": "30", "wife_name": "Mia Uy"})], "doc_id int, labels map<string,string>")
    df = df.withColumn("form", forms.form_3a(F.col("labels")))
    flat = forms.flatten_form(df, "doc_id", "form").first()
    assert flat.wife_name == "Mia Uy" and flat.husband_name is None
    assert df.select(forms.flat_map(df, "form").alias("m")).first().m == {"wife_name": "Mia Uy", "wife_age": "30"}
    assert df.select(forms.form_json(F.col("form")).alias("j")).first().j == \
        '{"husband":{},"wife":{"name":"Mia Uy","age":"30"}}'


def test_detect_form_type_precedence(spark):
    rows = [({"child_first_name": "x", "dod_day": "1"}, "birth"), ({"dod_day": "1", "wife_first_name": "x"}, "death"),
            ({"wife_first_name": "x"}, "marriage"), ({"other": "x"}, "birth")]
    df = spark.createDataFrame(rows, "f map<string,string>, want string")
    assert all(r.got == r.want for r in df.withColumn("got", compose.detect_form_type("f")).collect())


def test_stored_fields_alias_and_passthrough(spark):
    raw = {"registry_number": "", "registry_no": "7", "mother_nationality": "Korean", "extra": "x", "blank": ""}
    got = spark.createDataFrame([(raw,)], "r map<string,string>").selectExpr(
        f"{compose.stored_fields('r', '1A')} AS m").first().m
    assert got["registry_no"] == "7" and got["mother_citizenship"] == "Korean" and got["extra"] == "x"
    assert "blank" not in got and got["child_first"] == ""


def test_licence_page_splits_at_commas_or_parses(spark):
    df = spark.createDataFrame([({"date_of_marriage": "February 14, 2022", "place_of_marriage": "Hall , Capas"},
                                 {"first": " Leo "})], "r map<string,string>, p map<string,string>")
    plain = df.selectExpr(f"{compose.licence_page('r', 'p', 'groom')} AS m").first().m
    assert plain["marriage_day"] == "February 14" and plain["marriage_month"] == "2022"
    assert plain["groom_first"] == "Leo" and plain["marriage_venue"] == "Hall" and "marriage_year" not in plain
    parsed = df.selectExpr(f"{compose.licence_page('r', 'p', 'groom', parse=True)} AS m").first().m
    assert (parsed["marriage_day"], parsed["marriage_month"], parsed["marriage_year"]) == ("14", "February", "2022")


@pytest.mark.parametrize("text, code", [
    ("Municipal Form No. 102 Certificate of Live Birth newborn", "form102"),
    ("Certificate of Death, cause of death unknown, burial", "form103"),
    ("Certificate of Marriage, solemnizing officer and witnesses", "form97"),
    ("nothing at all", "form102"), ("", "form102"), (None, "form102"),
])
def test_keyword_class_and_tie(spark, text, code):
    df = spark.createDataFrame([(1, text)], "doc_id int, t string")
    assert classify.classify(df, "t", "doc_id").first().form_code == code


def test_role(spark):
    df = spark.createDataFrame([("SEX: Male",), ("4. SEX: Female",), ("?",)], "t string")
    assert [r.role for r in classify.with_role(df, "t").collect()] == ["GROOM", "BRIDE", "GROOM"]


def test_licence_pairing_rejects_conflicts(spark):
    base = {"child_first_name": "A", "sex": "Male"}
    rows = [(1, "groom", base), (1, "bride", {**base, "sex": "Female"}), (2, "groom", base), (2, "groom", base), (3, "bride", base)]
    df = spark.createDataFrame(rows, "application_id int, role string, fields map<string,string>")
    good, bad = digitize.licences(df)
    assert [r.application_id for r in good.collect()] == [1]
    assert sorted((r.application_id, r.reason) for r in bad.collect()) == [
        (2, "missing role"), (2, "missing role"), (3, "missing role")]
    good, bad = digitize.licences(df.withColumn("role", F.when(F.col("role") == "groom", "bride").otherwise("groom")),
                                  role_from_sex=True)
    assert [r.application_id for r in good.collect()] == [1]


def test_required_errors(spark):
    df = spark.createDataFrame([({"name": "x", "date_of_birth": ""},)], "d map<string,string>")
    row = df.select(validate.required_errors(F.col("d"), F.lit("form1a")).alias("e"),
                    validate.required_errors(F.col("d"), F.lit("other")).alias("o")).first()
    assert row.e == ["Missing required field: date_of_birth", "Missing required field: place_of_birth"] and row.o == []


def test_display_name(spark):
    rows = [("birth", {"child_first": "Lea"}), ("marriage-cert", {"husband_first": "Leo", "wife_last": "Uy"}),
            ("marriage-license", {"bride_first": "Mia"}), ("death", {}), ("other", {"child_first": "Lea"})]
    df = spark.createDataFrame(rows, "k string, f map<string,string>").withColumn("u", F.lit("clerk"))
    got = [r.n for r in df.select(records.display_name("k", "f", "u").alias("n")).collect()]
    assert got == ["Lea", "Leo & Uy", "Mia", "clerk", "clerk"]


def test_sections_tidy_a_text_once():
    assert str(extract.sectioned_lines(F.col("t"), "97")).count("NAME OF (?=") == 1
