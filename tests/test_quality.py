import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vitalforms.operators import boxes, metrics, model
from vitalforms.catalog.regions import region_table


def test_metric_self_check(spark):
    pairs = spark.createDataFrame([("Hello World", "Hello World"), ("Test", "Tset"), ("Sample Text", "Sample Txt")],
                                  "pred string, truth string")
    row = metrics.error_rates(pairs).first()
    assert row.cer == pytest.approx(3 / 25 * 100) and row.wer == pytest.approx(2 / 5 * 100)
    assert row.exact_match == pytest.approx(100 / 3) and row.n == 3


def test_empty_truths_give_zero(spark):
    row = metrics.error_rates(spark.createDataFrame([("abc", "")], "pred string, truth string")).first()
    assert (row.cer, row.wer, row.exact_match) == (0.0, 0.0, 0.0)


def test_unpaired_prediction_raises(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, text string")
    with pytest.raises(Exception, match="differ in number"):
        metrics.pair_predictions(a, a.filter("k = 1"), ["k"]).collect()


def test_label_scores_ignore_unexpected_labels(spark):
    want = spark.createDataFrame([(1, "A"), (2, "A"), (2, "B")], "test_id int, label string")
    found = spark.createDataFrame([(1, "A"), (1, "B"), (1, "Z"), (1, "Z")], "test_id int, label string")
    got = {r.label: (r.tp, r.fp, r.fn, round(r.f1, 4)) for r in metrics.label_scores(want, found).collect()}
    assert got == {"A": (1, 0, 1, 0.6667), "B": (0, 1, 1, 0.0)}


def test_char_confusion_pads_the_shorter_text(spark):
    pairs = spark.createDataFrame([("ab", "abc"), ("xé", "xy")], "pred string, truth string")
    got = {(r.truth_char, r.pred_char): r.n for r in metrics.char_confusion(pairs).collect()}
    assert got == {("a", "a"): 1, ("b", "b"): 1, ("c", " "): 1, ("x", "x"): 1}


def test_worst_predictions_limit_runs_before_the_shuffle(spark):
    pairs = spark.range(100).selectExpr("id", "'m' || id % 1 AS model", "repeat('a', CAST(id AS INT)) AS pred", "'' AS truth")
    top = metrics.worst_predictions(pairs, "id", 2, ["model"])
    assert [r.id for r in top.orderBy("rank").collect()] == [99, 98]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_consistency_and_composite(spark):
    runs = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["b", "a", "a"]), (2, 1, ["a"]), (2, 2, [])],
                                 "test_id int, run int, labels array<string>")
    assert {r.test_id: r.consistent for r in metrics.run_consistency(runs).collect()} == {1: True, 2: False}
    sections = spark.createDataFrame([(90.0,), (60.0,)], "score double")
    assert tuple(metrics.composite_score(sections).first()) == (75.0, "GOOD")


def test_boxes_are_clamped_and_inverted_ones_dropped(spark):
    pages = spark.createDataFrame([(1, "birth", 1000, 1000, 0, 0, 1200, 1000)],
                                  "page_id int, form_type string, w int, h int, left int, top int, right int, bottom int")
    got = {r.field: r for r in boxes.field_boxes(pages, region_table(spark)).collect()}
    assert "dob_month" not in got and len(got) == 25
    assert got["registry_number"].x2 == 999 and got["sex"].x1 == 36
    words = spark.createDataFrame([(1, 0, "Male", 40, 145, 60, 160), (1, 1, "?", 0, 900, 5, 905)],
                                  "page_id int, word_no int, text string, x1 int, y1 int, x2 int, y2 int")
    assert [(r.text, r.field) for r in boxes.word_regions(words, pages, region_table(spark)).collect()] == [("Male", "sex")]


def brute_force(train, texts, alpha=0.1):
    import re

    def terms(text):
        w = re.findall(r"\b\w\w+\b", text.lower())
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    docs = [(terms(x), y) for x, y in train]
    vocab = sorted({k for d, _ in docs for k in d})
    idf = {k: math.log((1 + len(docs)) / (1 + sum(k in d for d, _ in docs))) + 1 for k in vocab}

    def vec(d):
        raw = {k: (1 + math.log(n)) * idf[k] for k, n in d.items() if k in idf}
        norm = math.sqrt(sum(v * v for v in raw.values())) or 1
        return {k: v / norm for k, v in raw.items()}

    labels = sorted({y for _, y in docs})
    out = []
    for text in texts:
        logs = []
        for lab in labels:
            sums = Counter()
            for d, y in docs:
                if y == lab:
                    sums.update(vec(d))
            total = sum(sums.values()) + alpha * len(vocab)
            prior = math.log(sum(y == lab for _, y in docs) / len(docs))
            logs.append(prior + sum(v * math.log((sums[k] + alpha) / total) for k, v in vec(terms(text)).items()))
        top = max(logs)
        z = sum(math.exp(x - top) for x in logs)
        out.append((labels[logs.index(top)], round(1 / z, 4)))
    return out


def test_text_model_matches_brute_force(spark, tmp_path):
    train = [("certificate of live birth child born", "birth"), ("birth of a child, live", "birth"),
             ("certificate of death deceased died", "death"), ("cause of death, deceased", "death"),
             ("marriage of husband and wife wife", "marriage")]
    texts = ["live birth", "deceased person", "husband wife", "unknown zzz", ""]
    fitted = model.fit(spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(train)], "id int, text string, y string"),
                       "id", "y", str(tmp_path / "m"))
    got = {r.id: (r.label, r.confidence) for r in fitted.predict(
        spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id").collect()}
    assert [got[i] for i in range(len(texts))] == brute_force(train, texts)


def test_generated_texts_train_a_perfect_model(spark, tmp_path):
    from vitalforms.operators import corpus

    seeds = spark.range(60).selectExpr("id AS seed_id", "'Ana' || id % 7 AS first_name", "'Cruz' AS last_name",
                                       "'Capas' AS city", "'Tarlac' AS province")
    texts = corpus.generate_labelled_texts(seeds).selectExpr("label || seed_id AS id", "label", "text", "seed_id")
    fitted = model.fit(texts.filter("seed_id >= 12"), "id", "label", str(tmp_path / "m"))
    held = texts.filter("seed_id < 12")
    scored = fitted.predict(held, "id").join(held.selectExpr("id", "label AS actual"), "id")
    assert scored.count() == 36 and scored.filter(F.col("label") != F.col("actual")).count() == 0
