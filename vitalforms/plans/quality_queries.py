"""Queries over predictions, label sets, sequences, histories and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalforms.catalog import forms as formcat
from vitalforms.catalog.regions import region_rows, region_table
from vitalforms.functions import codes
from vitalforms.operators import boxes, history, metrics, sequences
from vitalforms.plans import tables as t
from vitalforms.plans.registry import query, values, with_ctes

# Three "models" read every conversation turn and part name with different
# faults; the truths are reduced to ASCII so that every engine measures
# characters alike.
# The SQL engine measures distances in bytes: each other letter of the texts stands for one unused control character.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_TRUTH = f"translate(text, '{_LETTERS}', " + " || ".join(f"chr({i})" for i in range(11, 11 + len(_LETTERS))) + ")"
_PREDS = {
    "clean": "truth",
    "ocr": "translate(truth, 'aeo', '4c0')",
    "short": "substr(truth, 3) || 'zz'",
}
_SHORT = "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' ' || p_type END"


def _pairs(spark, d):
    """(model, sample_id, truth, pred) over part names."""
    base = t.read(spark, d, "part", t.dealt_partitions(spark)).selectExpr("p_partkey AS sample_id", f"{_SHORT} AS truth")
    each = F.inline_outer(F.array(*[F.struct(F.lit(m).alias("model"), F.expr(e).alias("pred"))
                                    for m, e in _PREDS.items()]))
    return base.select("sample_id", "truth", each)


_PAIRS = ("base AS (SELECT p_partkey AS sample_id, " + _SHORT + " AS truth FROM part), pairs AS ("
          + " UNION ALL ".join(f"SELECT '{m}' AS model, sample_id, truth, {e} AS pred FROM base"
                               for m, e in _PREDS.items()) + ")")
# tokens to one ASCII letter each, by their place among the pair's distinct tokens
_TOK = """tok AS (SELECT *, string_split(truth, ' ') AS tw, string_split(pred, ' ') AS pw,
  list_distinct(list_concat(string_split(truth, ' '), string_split(pred, ' '))) AS al FROM pairs),
enc AS (SELECT *, array_to_string([chr(CAST(64 + list_position(al, x) AS INT)) FOR x IN tw], '') AS te,
  array_to_string([chr(CAST(64 + list_position(al, x) AS INT)) FOR x IN pw], '') AS pe FROM tok)"""
_RATES = """rates AS (SELECT model, sum(levenshtein(pred, truth)) * 1.0 / sum(length(truth)) * 100 AS cer,
  sum(levenshtein(pe, te)) * 1.0 / sum(len(tw)) * 100 AS wer,
  sum(CAST(pred = truth AS INT)) * 1.0 / count(*) * 100 AS exact_match, count(*) AS n FROM enc GROUP BY model)"""


@query("combined_evaluation", with_ctes(_PAIRS, _TOK, _RATES) + """
SELECT model, CAST(cer AS DOUBLE) AS cer, CAST(wer AS DOUBLE) AS wer, CAST(exact_match AS DOUBLE) AS exact_match, n FROM rates""")
def combined_evaluation(spark, d):
    return metrics.error_rates(_pairs(spark, d), ["model"])


@query("char_error_rate", with_ctes(f"p AS (SELECT role, {_TRUTH} AS truth FROM conversations)") + """
SELECT role, CAST(sum(levenshtein(translate(truth, 'aeo', '4c0'), truth)) AS DOUBLE) / sum(length(truth)) * 100 AS cer FROM p GROUP BY 1""")
def char_error_rate(spark, d):
    """Whole conversation turns, however long."""
    turns = t.read(spark, d, "conversations", t.wanted_partitions(spark)).select("role", F.col("text").alias("truth"))
    return metrics.char_error_rate(turns.withColumn("pred", F.expr(_PREDS["ocr"])), ["role"])


@query("word_error_rate", with_ctes(_PAIRS, _TOK) + """
SELECT CAST(sum(levenshtein(pe, te)) AS DOUBLE) / sum(len(tw)) * 100 AS wer FROM enc""")
def word_error_rate(spark, d):
    return metrics.word_error_rate(_pairs(spark, d))


@query("exact_match", with_ctes(_PAIRS) + """
SELECT model, CAST(sum(CAST(pred = truth AS INT)) AS DOUBLE) / count(*) * 100 AS exact_match FROM pairs GROUP BY 1""")
def exact_match(spark, d):
    return metrics.exact_match(_pairs(spark, d), ["model"])


@query("worst_predictions", with_ctes(_PAIRS) + """
SELECT * FROM (SELECT model, sample_id, truth, pred, levenshtein(pred, truth) AS distance,
  row_number() OVER (PARTITION BY model ORDER BY levenshtein(pred, truth) DESC, sample_id) AS rank
  FROM pairs WHERE levenshtein(pred, truth) > 0) WHERE rank <= 5""", casts="distance INT,rank INT")
def worst_predictions(spark, d):
    return metrics.worst_predictions(_pairs(spark, d), "sample_id", 5, ["model"])


@query("model_compare", with_ctes(_PAIRS, _TOK, _RATES) + """
SELECT model, CAST(cer AS DOUBLE) AS cer, n, cer = (SELECT min(cer) FROM rates) AS is_best FROM rates""")
def model_compare(spark, d):
    rates = metrics.error_rates(_pairs(spark, d), ["model"])
    return metrics.compare_models(rates).select("model", "cer", "n", "is_best")


@query("metric_drift", with_ctes(_PAIRS, _TOK, _RATES) + """
SELECT model, CAST(cer AS DOUBLE) AS cer, CAST(abs(cer - 1.0) AS DOUBLE) AS difference FROM rates WHERE abs(cer - 1.0) > 2.0""")
def metric_drift(spark, d):
    live = metrics.error_rates(_pairs(spark, d), ["model"])
    saved = live.select("model", F.lit(1.0).alias("saved_cer"))
    return metrics.metric_drift(live, saved).select("model", "cer", "difference")


@query("pair_check", with_ctes(_PAIRS) + """
SELECT count(*) AS n, sum(CAST(truth = pred AS INT)) AS same FROM pairs WHERE model = 'ocr'""", casts="same BIGINT")
def pair_check(spark, d):
    p = _pairs(spark, d).filter("model = 'ocr'")
    both = metrics.pair_predictions(p.select("sample_id", F.col("pred").alias("text")),
                                    p.select("sample_id", F.col("truth").alias("text")), ["sample_id"])
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("truth") == F.col("pred")).cast("long")).alias("same"))


@query("char_confusion", with_ctes(_PAIRS) + """
, c AS (SELECT truth, pred, unnest(range(1, greatest(length(truth), length(pred)) + 1)) AS i FROM pairs)
SELECT CASE WHEN i <= length(truth) THEN substr(truth, i, 1) ELSE ' ' END AS truth_char,
  CASE WHEN i <= length(pred) THEN substr(pred, i, 1) ELSE ' ' END AS pred_char, count(*) AS n FROM c GROUP BY 1, 2""")
def char_confusion(spark, d):
    return metrics.char_confusion(_pairs(spark, d))


# --- label sets -----------------------------------------------------------------

# Every order line expects a label of its form; some are missed, some extra.
_LABEL = ("CASE l_orderkey % 3 WHEN 0 THEN 'F102_' WHEN 1 THEN 'F103_' ELSE 'F97_' END || "
          "CASE l_linenumber WHEN 1 THEN 'SEX' WHEN 2 THEN 'AGE' WHEN 3 THEN 'REGISTRY_NO' WHEN 4 THEN 'RELIGION' "
          "ELSE 'DATE' END")
_EXPECTED = "l_suppkey % 4 <> 0"
_FOUND = "l_partkey % 5 <> 0"
_SETS = (f"ex AS (SELECT DISTINCT l_orderkey AS test_id, {_LABEL} AS label FROM lineitem WHERE {_EXPECTED}), "
         f"fo AS (SELECT DISTINCT l_orderkey AS test_id, {_LABEL} AS label FROM lineitem WHERE {_FOUND}), "
         "h AS (SELECT coalesce(ex.label, fo.label) AS label, CAST(ex.label IS NOT NULL AND fo.label IS NOT NULL AS INT) AS tp, "
         "CAST(ex.label IS NULL AS INT) AS fp, CAST(fo.label IS NULL AS INT) AS fn "
         "FROM ex FULL OUTER JOIN fo ON ex.test_id = fo.test_id AND ex.label = fo.label)")
_SCORES = ("CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, "
           "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall")
_F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1"


def _label_sets(spark, d):
    line = t.read(spark, d, "lineitem")
    rows = [line.filter(c).selectExpr("l_orderkey AS test_id", f"{_LABEL} AS label") for c in (_EXPECTED, _FOUND)]
    return rows[0], rows[1]


@query("label_scores", with_ctes(_SETS) + f"""
, c AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM h GROUP BY 1 HAVING sum(tp) + sum(fn) > 0),
s AS (SELECT *, {_SCORES} FROM c) SELECT *, {_F1} FROM s""", casts="tp BIGINT,fp BIGINT,fn BIGINT")
def label_scores(spark, d):
    return metrics.label_scores(*_label_sets(spark, d))


@query("label_rollup", with_ctes(_SETS) + f"""
, c AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM h GROUP BY 1 HAVING sum(tp) + sum(fn) > 0),
r AS (SELECT split_part(label, '_', 1) AS form, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c
  GROUP BY ROLLUP (split_part(label, '_', 1), label)),
s AS (SELECT *, {_SCORES} FROM r) SELECT *, {_F1} FROM s""", casts="tp BIGINT,fp BIGINT,fn BIGINT")
def label_rollup(spark, d):
    counts = metrics.label_counts(*_label_sets(spark, d))
    return metrics.label_rollup(counts, metrics.label_family(F.col("label")))


def _tests(spark, d):
    """(test_id, form, expected, found) with a few labels per order."""
    line = t.read(spark, d, "lineitem").selectExpr(
        "l_orderkey AS test_id", f"{_LABEL} AS label", f"{_EXPECTED} AS e", f"{_FOUND} AS f")
    return line.groupBy("test_id").agg(
        F.min(codes.hint_of_label(F.col("label"))).alias("form"),
        F.collect_set(F.when(F.col("e"), F.col("label"))).alias("expected"),
        F.collect_set(F.when(F.col("f"), F.col("label"))).alias("found"))


_TESTS = (f"li AS (SELECT l_orderkey AS test_id, {_LABEL} AS label, {_EXPECTED} AS e, {_FOUND} AS f FROM lineitem), "
          "pl AS (SELECT test_id, label, bool_or(e) AS e, bool_or(f) AS f FROM li GROUP BY 1, 2), "
          "tests AS (SELECT test_id, CASE test_id % 3 WHEN 0 THEN '1A' WHEN 1 THEN '2A' ELSE '3A' END AS form, "
          "CAST(count(*) FILTER (e AND f) AS INT) AS correct, CAST(count(*) FILTER (e) AS INT) AS total, "
          "coalesce(array_to_string(list_slice(list(label ORDER BY label) FILTER (f AND NOT e), 1, 5), ','), '') AS extra "
          "FROM pl GROUP BY test_id)")


@query("expected_recall", with_ctes(_TESTS) + """
, r AS (SELECT *, CASE WHEN total > 0 THEN correct / total * 100 ELSE 0 END AS recall FROM tests)
SELECT *, CASE WHEN recall >= 70 THEN 'GOOD' WHEN recall >= 40 THEN 'PARTIAL' ELSE 'POOR' END AS grade FROM r""")
def expected_recall(spark, d):
    return metrics.expected_recall(_tests(spark, d)).withColumn("extra", F.array_join("extra", ","))


@query("accuracy_by_form", with_ctes(_TESTS) + """
, r AS (SELECT form, test_id, sum(correct) AS correct, sum(total) AS total FROM tests GROUP BY ROLLUP (form, test_id)),
s AS (SELECT *, CASE WHEN total > 0 THEN correct / total * 100 ELSE 0 END AS accuracy FROM r)
SELECT *, CASE WHEN accuracy >= 70 THEN 'pass' WHEN accuracy >= 50 THEN 'warn' ELSE 'fail' END AS mark FROM s""", casts="correct BIGINT,total BIGINT")
def accuracy_by_form(spark, d):
    return metrics.accuracy_rollup(metrics.expected_recall(_tests(spark, d)))


@query("span_scores", f"""
WITH sp AS (SELECT conv_id * 100 + turn AS doc_id, length(text) AS n, role AS label, turn FROM conversations),
a AS (SELECT doc_id, 0 AS s, n AS e, label FROM sp), b AS (SELECT doc_id, 0 AS s, CASE WHEN turn % 3 = 0 THEN n - 1 ELSE n END AS e,
  CASE WHEN turn % 5 = 0 THEN 'FORM_OTHER' ELSE label END AS label FROM sp),
h AS (SELECT coalesce(a.label, b.label) AS label, CAST(a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AS INT) AS tp,
  CAST(a.doc_id IS NULL AS INT) AS fp, CAST(b.doc_id IS NULL AS INT) AS fn FROM a FULL OUTER JOIN b USING (doc_id, s, e, label)),
c AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM h GROUP BY 1), s AS (SELECT *, {_SCORES} FROM c),
f AS (SELECT *, {_F1} FROM s) SELECT *, f1 = 0 AS is_zero FROM f""", casts="tp BIGINT,fp BIGINT,fn BIGINT")
def span_scores(spark, d):
    turns = t.read(spark, d, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), F.lit(0).alias("start"),
        F.length("text").alias("end"), F.col("role").alias("label"), "turn")
    found = turns.withColumn("end", F.when(F.col("turn") % 3 == 0, F.col("end") - 1).otherwise(F.col("end"))
                             ).withColumn("label", F.when(F.col("turn") % 5 == 0, "FORM_OTHER").otherwise(F.col("label")))
    return metrics.span_scores(turns, found)


_RESULT = "CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END"


@query("confusion_matrix", f"""
SELECT quality AS actual, {_RESULT} AS predicted, count(*) AS n FROM labels GROUP BY 1, 2""")
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(t.read(spark, d, "labels").selectExpr("quality AS actual", f"{_RESULT} AS predicted"))


@query("classification_report", f"""
WITH r AS (SELECT quality AS a, {_RESULT} AS p FROM labels), l AS (SELECT DISTINCT a AS label FROM r),
c AS (SELECT label, (SELECT count(*) FROM r WHERE a = label AND p = label) AS tp, (SELECT count(*) FROM r WHERE a <> label AND p = label) AS fp,
  (SELECT count(*) FROM r WHERE a = label AND p <> label) AS fn FROM l), s AS (SELECT *, {_SCORES} FROM c)
SELECT label, precision, recall, {_F1}, tp + fn AS support, (SELECT avg(CAST(a = p AS DOUBLE)) FROM r) AS accuracy FROM s""")
def classification_report(spark, d):
    rows = t.read(spark, d, "labels").selectExpr("quality AS actual", f"{_RESULT} AS predicted")
    return metrics.classification_report(rows)


@query("run_consistency", """
WITH r AS (SELECT user_id % 20 AS test_id, user_id AS run, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS s
  FROM events WHERE user_id % 3 <> 0 OR event_type <> 'view' GROUP BY 1, 2)
SELECT test_id, count(*) AS runs, count(DISTINCT s) = 1 AS consistent FROM r GROUP BY 1""")
def run_consistency(spark, d):
    rows = t.read(spark, d, "events").filter("user_id % 3 <> 0 OR event_type <> 'view'").selectExpr(
        "user_id % 20 AS test_id", "user_id AS run", "event_type")
    runs = rows.groupBy("test_id", "run").agg(F.collect_set("event_type").alias("labels"))
    return metrics.run_consistency(runs)


@query("composite_score", """
WITH s AS (SELECT c_nationkey, c_mktsegment AS section, CAST(count(*) FILTER (c_acctbal > 0) AS DOUBLE) / count(*) * 100 AS score FROM customer GROUP BY 1, 2),
g AS (SELECT c_nationkey, round(sum(score) / count(*), 6) AS score FROM s GROUP BY 1)
SELECT c_nationkey, score, CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 75 THEN 'GOOD' WHEN score >= 60 THEN 'ACCEPTABLE' ELSE 'NEEDS IMPROVEMENT' END AS grade FROM g""")
def composite_score(spark, d):
    from vitalforms.functions.text import safe_ratio

    sections = t.read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(
        safe_ratio(F.sum((F.col("c_acctbal") > 0).cast("int")), F.count(F.lit(1)), 100).alias("score"))
    return metrics.composite_score(sections, ["c_nationkey"]).withColumn("score", F.round("score", 6))


@query("output_stats", """
SELECT user_id, CAST(count(*) FILTER (CAST(floor(value) AS INT) % 4 = 0) AS DOUBLE) / count(*) * 100 AS blank_pct,
  round(sum(value) / count(*), 6) AS mean_conf FROM events GROUP BY 1""")
def output_stats(spark, d):
    steps = t.read(spark, d, "events").selectExpr(
        "user_id", "CAST(floor(value) AS INT) % 4 AS idx", "value AS conf")
    return metrics.output_stats(steps, ["user_id"]).withColumn("mean_conf", F.round("mean_conf", 6))


# --- sequences and histories --------------------------------------------------------

_IDX = "CASE WHEN event_type = 'view' THEN 0 ELSE CAST(length(event_type) * 8 + floor(value) % 3 AS INT) END"
_STEPS = f"st AS (SELECT user_id, event_id AS step, {_IDX} AS idx FROM events)"
_KEPT = ("k AS (SELECT *, lag(idx) OVER (PARTITION BY user_id ORDER BY step) AS prev FROM st), "
         "e AS (SELECT user_id, step, chr(idx + 31) AS char FROM k WHERE idx <> 0 AND (prev IS NULL OR prev <> idx) AND idx BETWEEN 1 AND 95)")


def _steps(spark, d):
    return t.read(spark, d, "events").selectExpr("user_id", "event_id AS step", f"{_IDX} AS idx")


@query("sequence_collapse", with_ctes(_STEPS, _KEPT) + "SELECT user_id, step, char FROM e")
def sequence_collapse(spark, d):
    return sequences.collapse_steps(_steps(spark, d), "user_id", "step", "idx").select("user_id", "step", "char")


@query("sequence_text", with_ctes(_STEPS, _KEPT) + """
SELECT u.user_id, coalesce(string_agg(char, '' ORDER BY step), '') AS text FROM (SELECT DISTINCT user_id FROM st) u LEFT JOIN e USING (user_id) GROUP BY 1""")
def sequence_text(spark, d):
    """Segments of hot sequences are joined piece by piece."""
    return sequences.decode_greedy(_steps(spark, d), "user_id", "step", "idx")


@query("running_mean", """
WITH e AS (SELECT event_type, event_id, CAST(floor(value) AS BIGINT) AS v, user_id % 5 + 1 AS w FROM events)
SELECT event_type, event_id, CAST(sum(v * w) OVER o AS DOUBLE) / sum(w) OVER o AS mean FROM e
WINDOW o AS (PARTITION BY event_type ORDER BY event_id)""")
def running_mean(spark, d):
    """Five groups hold everything, so each is scanned in segments."""
    e = t.read(spark, d, "events").selectExpr(
        "event_type", "event_id", "CAST(floor(value) AS BIGINT) AS v", "user_id % 5 + 1 AS w")
    return history.running_mean(e, ["event_type"], "event_id", "v", "w", segment_rows=500).select(
        "event_type", "event_id", "mean")


@query("running_mean_by_day", """
WITH e AS (SELECT event_type, event_id, CAST(ts AS DATE) AS day, CAST(floor(value) AS BIGINT) AS v, user_id % 5 + 1 AS w FROM events)
SELECT event_type, event_id, CAST(sum(v * w) OVER o AS DOUBLE) / sum(w) OVER o AS mean FROM e
WINDOW o AS (PARTITION BY event_type ORDER BY day, event_id ROWS UNBOUNDED PRECEDING)""")
def running_mean_by_day(spark, d):
    """The same in the order of a date with many ties."""
    e = t.read(spark, d, "events").selectExpr(
        "event_type", "event_id", "CAST(ts AS DATE) AS day", "CAST(floor(value) AS BIGINT) AS v", "user_id % 5 + 1 AS w")
    return history.running_mean(e, ["event_type"], "day", "v", "w", tie=["event_id"], segment_rows=500).select(
        "event_type", "event_id", "mean")


_DAILY = """d AS (SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS epoch,
  round(sum(value) / count(*), 6) AS loss FROM events GROUP BY 1, 2)"""


def _daily(spark, d):
    epoch = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    return t.read(spark, d, "events").groupBy("event_type", epoch.alias("epoch")).agg(
        F.round(F.sum("value") / F.count(F.lit(1)), 6).alias("loss"))


@query("best_so_far", with_ctes(_DAILY) + """
SELECT event_type, epoch, loss, coalesce(loss < min(loss) OVER (PARTITION BY event_type ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM d""")
def best_so_far(spark, d):
    return history.best_so_far(_daily(spark, d), ["event_type"], "epoch", "loss")


@query("early_stopping", "WITH RECURSIVE " + _DAILY + """,
o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY epoch) AS n FROM d),
f(event_type, n, best, wait, stop) AS (
  SELECT event_type, n, loss, 0, CAST(NULL AS BIGINT) FROM o WHERE n = 1 UNION ALL
  SELECT o.event_type, o.n, CASE WHEN f.stop IS NOT NULL OR o.loss > f.best - 0.001 THEN f.best ELSE o.loss END,
    CASE WHEN f.stop IS NOT NULL THEN f.wait WHEN o.loss > f.best - 0.001 THEN f.wait + 1 ELSE 0 END,
    CASE WHEN f.stop IS NOT NULL THEN f.stop WHEN o.loss > f.best - 0.001 AND f.wait + 1 >= 5 THEN o.epoch END
  FROM f JOIN o ON o.event_type = f.event_type AND o.n = f.n + 1)
SELECT event_type, arg_max(best, n) AS best_loss, max(stop) IS NOT NULL AS stopped, max(stop) AS stop_epoch FROM f GROUP BY 1""")
def early_stopping(spark, d):
    return history.early_stopping(_daily(spark, d), "event_type", "epoch", "loss", patience=5)


# --- boxes ----------------------------------------------------------------------------

_PAGES = ["p_partkey AS page_id",
          "CASE p_partkey % 4 WHEN 0 THEN 'birth' WHEN 1 THEN 'death' WHEN 2 THEN 'marriage' ELSE 'marriage_license' END AS form_type",
          "CAST(800 + p_size * 3 AS INT) AS w", "CAST(1100 + p_size * 5 AS INT) AS h", "CAST(p_size % 20 AS INT) AS `left`",
          "CAST(p_size % 30 AS INT) AS top", "CAST(790 + p_size * 3 AS INT) AS `right`", "CAST(1090 + p_size * 5 AS INT) AS bottom"]
_REGION_CTE = values("regions", "form_type, field, rx1, ry1, rx2, ry2", region_rows())


def _px(origin, ratio, lo, hi, size):
    return (f"greatest(0, least(CAST(trunc(\"{origin}\" + CAST({ratio} AS DOUBLE) * (\"{hi}\" - \"{lo}\")) AS INT), {size} - 1))")


_BOX = ("pg AS (SELECT " + ", ".join(_PAGES).replace("`", '"') + " FROM part), bx AS (SELECT page_id, form_type, field, "
        f"{_px('left', 'rx1', 'left', 'right', 'w')} AS x1, {_px('top', 'ry1', 'top', 'bottom', 'h')} AS y1, "
        f"{_px('left', 'rx2', 'left', 'right', 'w')} AS x2, {_px('top', 'ry2', 'top', 'bottom', 'h')} AS y2 "
        "FROM pg JOIN regions USING (form_type)), box AS (SELECT * FROM bx WHERE x2 > x1 AND y2 > y1)")


@query("field_boxes", with_ctes(_REGION_CTE, _BOX) + "SELECT * FROM box")
def field_boxes(spark, d):
    return boxes.field_boxes(t.read(spark, d, "part").selectExpr(*_PAGES), region_table(spark))


_WORDS = ["l_partkey AS page_id", "l_orderkey * 8 + l_linenumber AS word_no", "l_returnflag AS text",
          "CAST(l_quantity * 15 AS INT) AS x1", "CAST(l_suppkey * 11 % 1100 AS INT) AS y1",
          "CAST(l_quantity * 15 + 30 AS INT) AS x2", "CAST(l_suppkey * 11 % 1100 + 12 AS INT) AS y2"]


@query("word_regions", with_ctes(_REGION_CTE, _BOX, "wd AS (SELECT " + ", ".join(_WORDS) + " FROM lineitem)") + """
SELECT page_id, word_no, text, field FROM wd JOIN box USING (page_id)
WHERE (wd.x1 + wd.x2) / 2.0 BETWEEN box.x1 AND box.x2 AND (wd.y1 + wd.y2) / 2.0 BETWEEN box.y1 AND box.y2""")
def word_regions(spark, d):
    pages = t.read(spark, d, "part").selectExpr(*_PAGES)
    words = t.read(spark, d, "lineitem").selectExpr(*_WORDS)
    return boxes.word_regions(words, pages, region_table(spark))


@query("grade_bands", """
SELECT c_custkey, CASE WHEN c_acctbal >= 90 THEN 'EXCELLENT' WHEN c_acctbal >= 75 THEN 'GOOD' WHEN c_acctbal >= 60 THEN 'ACCEPTABLE' ELSE 'NEEDS IMPROVEMENT' END AS report,
  CASE WHEN c_acctbal >= 70 THEN 'GOOD' WHEN c_acctbal >= 40 THEN 'PARTIAL' ELSE 'POOR' END AS recall FROM customer""")
def grade_bands(spark, d):
    v = F.col("c_acctbal")
    return t.read(spark, d, "customer").select("c_custkey", codes.band(v, formcat.REPORT_GRADES).alias("report"),
                                               codes.band(v, formcat.RECALL_GRADES).alias("recall"))
