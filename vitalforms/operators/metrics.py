"""Recognition and extraction quality, from whole prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalforms.catalog import forms
from vitalforms.functions import codes
from vitalforms.functions.distance import char_distance, word_distance
from vitalforms.functions.text import safe_ratio, words


def pair_predictions(predictions: DataFrame, truths: DataFrame, key: Sequence[str]) -> DataFrame:
    """Predictions next to their truths; a row without a partner is an error."""
    p = predictions.select(*key, F.col("text").alias("pred"), F.lit(True).alias("_p"))
    t = truths.select(*key, F.col("text").alias("truth"), F.lit(True).alias("_t"))
    both = p.join(t, list(key), "full_outer")
    lone = F.col("_p").isNull() | F.col("_t").isNull()
    checked = F.when(lone, F.raise_error(F.lit("predictions and truths differ in number"))
                     .cast("string")).otherwise(F.col("truth"))
    return both.select(*key, "pred", checked.alias("truth"))


def error_rates(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """CER, WER and exact match in per cent, with the number of pairs.

    Both error rates are ratios of sums, 0 when the truths are empty.
    """
    each = pairs.select(
        *group,
        char_distance("pred", "truth").alias("cd"), F.length("truth").alias("cl"),
        word_distance(F.col("pred"), F.col("truth")).alias("wd"), F.size(words(F.col("truth"))).alias("wl"),
        (F.col("pred") == F.col("truth")).cast("int").alias("hit"))
    return each.groupBy(*group).agg(
        safe_ratio(F.sum("cd"), F.sum("cl"), 100).alias("cer"),
        safe_ratio(F.sum("wd"), F.sum("wl"), 100).alias("wer"),
        safe_ratio(F.sum("hit"), F.count(F.lit(1)), 100).alias("exact_match"),
        F.count(F.lit(1)).alias("n"))


def char_error_rate(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return pairs.groupBy(*group).agg(safe_ratio(
        F.sum(char_distance("pred", "truth")), F.sum(F.length("truth")), 100).alias("cer"))


def word_error_rate(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return pairs.groupBy(*group).agg(safe_ratio(
        F.sum(word_distance(F.col("pred"), F.col("truth"))),
        F.sum(F.size(words(F.col("truth")))), 100).alias("wer"))


def exact_match(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return pairs.groupBy(*group).agg(safe_ratio(
        F.sum((F.col("pred") == F.col("truth")).cast("int")), F.count(F.lit(1)), 100).alias("exact_match"))


def worst_predictions(pairs: DataFrame, key: str, k: int = 5, group: Sequence[str] = ()) -> DataFrame:
    """The k pairs with the largest edit distance, ties in key order.

    Spark keeps only k rows per group and task before it shuffles them.
    """
    w = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(
        F.desc("distance"), key)
    scored = pairs.withColumn("distance", char_distance("pred", "truth")).filter("distance > 0")
    return (scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(*group, key, "truth", "pred", "distance", "rank"))


def compare_models(rates: DataFrame) -> DataFrame:
    """Mark the model with the smallest CER (the first by name on a tie)."""
    best = rates.agg(F.min(F.struct("cer", "model"))["model"]).scalar()
    return rates.withColumn("is_best", F.col("model") == best)


def metric_drift(live: DataFrame, saved: DataFrame, limit: float = 2.0) -> DataFrame:
    """Models whose live CER differs from the saved one by more than ``limit``."""
    diff = F.abs(F.col("cer") - F.col("saved_cer"))
    return (live.select("model", "cer").join(saved.select("model", "saved_cer"), "model")
            .withColumn("difference", diff).filter(diff > limit))


def char_confusion(pairs: DataFrame, alphabet: Column | None = None) -> DataFrame:
    """Counts of (true, predicted) characters at equal positions.

    The shorter text is padded with blanks; pairs outside the alphabet
    (printable ASCII by default) are not counted.
    """
    def chars(c: str) -> Column:
        return F.filter(F.split(F.col(c), ""), lambda x: x != "")

    both = F.arrays_zip(chars("truth").alias("t"), chars("pred").alias("p"))
    blank = F.lit(" ")
    each = pairs.select(F.explode_outer(both).alias("c")).filter("c IS NOT NULL").select(
        F.coalesce("c.t", blank).alias("truth_char"), F.coalesce("c.p", blank).alias("pred_char"))

    def inside(c: str) -> Column:
        if alphabet is not None:
            return F.array_contains(alphabet, F.col(c))
        return F.col(c).between(" ", "~")

    return (each.filter(inside("truth_char") & inside("pred_char"))
            .groupBy("truth_char", "pred_char").agg(F.count(F.lit(1)).alias("n")))


def _prf() -> dict[str, Column]:
    precision = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return {"precision": precision, "recall": recall}


def with_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of tp/fp/fn counts, 0 where undefined."""
    p, r = F.col("precision"), F.col("recall")
    return counts.withColumns(_prf()).withColumn("f1", safe_ratio(2 * p * r, p + r))


def _hits(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per distinct key with flags: expected, found.

    Both sides are unioned and combined per key, so a very frequent label
    needs no join and meets map-side combining.
    """
    both = (expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("f"))
            .unionByName(found.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("f"))))
    return both.groupBy(*keys).agg(F.max("e").alias("e"), F.max("f").alias("f"))


def label_counts(expected: DataFrame, found: DataFrame) -> DataFrame:
    """tp, fp, fn per label from (test_id, label) sets.

    A label that no test expects is not scored.
    """
    hits = _hits(expected, found, ["test_id", "label"])
    return hits.groupBy("label").agg(
        F.sum(F.col("e") * F.col("f")).alias("tp"),
        F.sum((1 - F.col("e")) * F.col("f")).alias("fp"),
        F.sum(F.col("e") * (1 - F.col("f"))).alias("fn"),
    ).filter(F.col("tp") + F.col("fn") > 0)


def label_scores(expected: DataFrame, found: DataFrame) -> DataFrame:
    return with_scores(label_counts(expected, found))


def label_rollup(counts: DataFrame, form: Column) -> DataFrame:
    """Scores per label, per form and overall, from summed counts."""
    totals = counts.withColumn("form", form).rollup("form", "label").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return with_scores(totals)


def label_family(label: Column) -> Column:
    """``F102`` of ``F102_SEX``; page labels form a family of their own."""
    return F.regexp_extract(label, r"^([A-Z]+\d*)_", 1)


def expected_recall(tests: DataFrame, extras: int = 5) -> DataFrame:
    """Correct, expected and recall per test, with the first extra labels.

    ``tests`` has (test_id, form, expected array, found array).
    """
    want, got = F.array_distinct("expected"), F.array_distinct("found")
    return tests.select(
        "test_id", "form",
        F.size(F.array_intersect(want, got)).alias("correct"), F.size(want).alias("total"),
        F.slice(F.array_sort(F.array_except(got, want)), 1, extras).alias("extra"),
    ).withColumn("recall", safe_ratio(F.col("correct"), F.col("total"), 100)
                 ).withColumn("grade", codes.band(F.col("recall"), forms.RECALL_GRADES))


def accuracy_rollup(scored: DataFrame) -> DataFrame:
    """Accuracy per test, form and overall from (test_id, form, correct, total)."""
    out = scored.rollup("form", "test_id").agg(
        F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    pct = safe_ratio(F.col("correct"), F.col("total"), 100)
    return out.withColumn("accuracy", pct).withColumn(
        "mark", codes.band(F.col("accuracy"), forms.ACCURACY_MARKS))


def span_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Scores per label over exact (doc_id, start, end, label) spans."""
    hits = _hits(truth, found, ["doc_id", "start", "end", "label"])
    counts = hits.groupBy("label").agg(
        F.sum(F.col("e") * F.col("f")).alias("tp"),
        F.sum((1 - F.col("e")) * F.col("f")).alias("fp"),
        F.sum(F.col("e") * (1 - F.col("f"))).alias("fn"))
    return with_scores(counts).withColumn("is_zero", F.col("f1") == 0)


def mean_page_score(scores: DataFrame) -> DataFrame:
    """Mean F1 of the page-understanding labels."""
    return scores.filter(codes.is_page_label(F.col("label"))).agg(
        safe_ratio(F.sum("f1"), F.count(F.lit(1))).alias("mean_f1"))


def confusion_matrix(results: DataFrame) -> DataFrame:
    """Counts per (actual, predicted)."""
    return results.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def classification_report(results: DataFrame) -> DataFrame:
    """Scores and support per class plus overall accuracy.

    Works on the confusion matrix, whose size is the number of class pairs.
    """
    cells = confusion_matrix(results)
    ends = cells.select(F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"),
                 F.lit(0).cast("long").alias("tp")))).alias("x")).select("x.*")
    per = ends.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("said").alias("said"),
                                    F.sum("support").alias("support"))
    scored = with_scores(per.withColumn("fp", F.col("said") - F.col("tp"))
                         .withColumn("fn", F.col("support") - F.col("tp")))
    accuracy = per.agg(safe_ratio(F.sum("tp"), F.sum("support"))).scalar()
    return scored.select("label", "precision", "recall", "f1", "support", accuracy.alias("accuracy"))


def run_consistency(runs: DataFrame) -> DataFrame:
    """Whether all runs of a test found the same label set.

    ``runs`` has (test_id, run, labels array); sets are compared by digest.
    """
    sig = F.md5(F.array_join(F.array_sort(F.array_distinct("labels")), "\x1f"))
    return (runs.select("test_id", sig.alias("_s")).groupBy("test_id")
            .agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"), F.count(F.lit(1)).alias("runs"))
            .select("test_id", "runs", (F.col("_lo") == F.col("_hi")).alias("consistent")))


def composite_score(sections: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Mean of section percentages with its grade."""
    mean = safe_ratio(F.sum("score"), F.count(F.lit(1)))
    return sections.groupBy(*group).agg(mean.alias("score")).withColumn(
        "grade", codes.band(F.col("score"), forms.REPORT_GRADES))


def output_stats(steps: DataFrame, group: Sequence[str]) -> DataFrame:
    """Share of blank steps in per cent and mean top confidence."""
    return steps.groupBy(*group).agg(
        safe_ratio(F.sum((F.col("idx") == 0).cast("int")), F.count(F.lit(1)), 100).alias("blank_pct"),
        safe_ratio(F.sum("conf"), F.count(F.lit(1))).alias("mean_conf"))
