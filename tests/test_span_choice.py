"""Longest-first choice of spans over rows, against a plain fold."""

import random

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from vitalforms.functions import spans as sp
from vitalforms.operators.spans import choose_spans

ROW = "doc string, start int, end int, label string"


def plain(rows):
    kept = []
    order = sorted({r for r in rows if None not in r[1:3] and r[2] > r[1]},
                   key=lambda r: (r[1] - r[2], r[1], r[3] is not None, r[3] or ""))
    for r in order:
        if all(k[0] != r[0] or k[2] <= r[1] or r[2] <= k[1] for k in kept):
            kept.append(r)
    return sorted(kept, key=repr)


def chosen(spark, rows):
    return sorted((tuple(r) for r in choose_spans(spark.createDataFrame(rows, ROW), ["doc"]).collect()), key=repr)


def test_random_spans_null_keys_and_labels(spark):
    draw = random.Random(7)
    rows = []
    for doc in (None, "a", "b", "c"):
        for _ in range(60):
            start = draw.randrange(120)
            rows.append((doc, start, start + draw.choice([-1, 0, 1, 2, 3, 5, 8, 13, 40]), draw.choice([None, "X", "Y"])))
    rows += [("d", None, 4, "X"), ("d", 4, None, "X"), *rows[:20]]
    assert chosen(spark, rows) == plain(rows)


def test_chain_of_shorter_and_shorter_spans_takes_rounds(spark):
    rows, at = [], 0
    for size in range(24, 4, -1):
        rows.append(("a", at, at + size, "X"))
        at += size - 1
    assert chosen(spark, rows) == plain(rows)
    assert len(plain(rows)) == 10


def test_empty_table_and_empty_spans(spark):
    empty = choose_spans(spark.createDataFrame([], ROW), ["doc"])
    assert empty.collect() == [] and empty.columns == ["doc", "start", "end", "label"]
    assert chosen(spark, [("a", 3, 3, "X"), ("a", 5, 2, "X")]) == []


def test_one_document_with_many_spans(spark):
    """Nested pairs below one another, 120,000 spans of one document; extra columns are ignored."""
    rows = spark.range(120_000).select(
        F.lit("a").alias("doc"), F.lit(0).alias("group"), (F.col("id") * 4).cast("int").alias("start"),
        (F.col("id") * 4 + 3 + F.col("id") % 2 * 3).cast("int").alias("end"), F.lit("X").alias("label"))
    done = choose_spans(rows, ["doc"])
    assert done.agg(F.count("*"), F.min(F.col("end") - F.col("start")), F.max("start")).first() == (60_001, 3, 479_996)


def test_same_choice_as_inside_a_row(spark):
    draw = random.Random(3)
    rows = [("a", s, s + draw.randrange(1, 9), "X") for s in (draw.randrange(300) for _ in range(90))]
    table = spark.createDataFrame(rows, ROW).groupBy("doc").agg(F.collect_set(sp.span(*map(F.col, ("start", "end", "label")))).alias("s"))
    inside = table.select("doc", F.inline(sp.drop_overlaps(F.col("s")))).collect()
    assert sorted((tuple(r) for r in inside), key=repr) == chosen(spark, rows)


def test_no_round_is_planned_with_a_broadcast(spark, monkeypatch):
    """A round's file is small beside the cells of its spans, so its size must not decide."""
    plans, write = [], DataFrameWriter.parquet

    def parquet(self, *args, **options):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    rows = [("a", s, s + 7, "X") for s in range(0, 40, 3)]
    assert chosen(spark, rows) == plain(rows)
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
