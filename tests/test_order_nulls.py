"""Later updates win and rows with nulls stay."""

from pyspark.sql import functions as F

from vitalforms.operators import corpus, merge


def test_later_status_wins(spark):
    docs = spark.createDataFrame([(1, "Pending"), (2, "Pending")], "doc_id long, status string")
    updates = spark.createDataFrame([(1, 1, "Rejected"), (1, 2, "Approved"), (2, 1, None)], "doc_id long, seq int, status string")
    got = {r.doc_id: r.status for r in merge.update_status(docs, updates, ["seq"]).collect()}
    assert got == {1: "Approved", 2: "Pending"}


def test_null_booster_is_none(spark):
    df = spark.createDataFrame([(1, "g", True), (2, "g", False), (3, "g", None), (4, "g", None)], "id int, g string, booster boolean")
    out = corpus.stratified_split(df, "g", "id", 0.34, F.col("booster")).collect()
    assert sorted(r.id for r in out) == [1, 2, 3, 4]


def test_null_positions_come_last_and_are_counted(spark):
    rows = [(5, "a"), (None, "b"), (1, "c"), (None, "d"), (None, "d"), (3, "e")]
    df = spark.createDataFrame(rows, "n int, t string")
    for ratio, want in ((0.34, 2), (0.5, 3), (0.7, 4), (0.84, 5), (1.0, 6)):
        got = corpus.ordered_split(df, "n", ratio).collect()
        train = [r.n for r in got if r.split == "train"]
        assert len(got) == 6 and len(train) == want
        assert sorted(n for n in train if n is not None) == [1, 3, 5][:want]
    empty = corpus.ordered_split(df.filter("n IS NULL"), "n", 0.67).collect()
    assert sorted(r.split for r in empty) == ["dev", "train", "train"]


def test_cap_takes_the_first_rows(spark):
    df = spark.createDataFrame([(None,), (4,), (2,), (None,), (9,)], "n int")
    for cap, want in ((2, [2, 4]), (4, [2, 4, 9, None]), (9, [2, 4, 9, None, None])):
        got = corpus.capped_split(df, "n", cap, 0.5).collect()
        assert sorted((r.n for r in got), key=lambda n: (n is None, n)) == want
        assert sum(r.split == "train" for r in got) == len(want) // 2


def test_null_positions_in_groups(spark):
    df = spark.createDataFrame([(None, "g"), (1, "g"), (None, "g"), (None, None), (2, None)], "n int, g string")
    got = corpus.stratified_split(df, "g", "n", 0.67).collect()
    assert len(got) == 5 and sorted((str(r.g), str(r.n)) for r in got if r.split == "dev") == [("None", "2"), ("g", "1"), ("g", "None")]


def test_no_cap_by_default(spark):
    assert corpus.capped_split(spark.range(60).withColumnRenamed("id", "n"), "n").count() == 60
