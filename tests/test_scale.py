"""Ranks, cuts and scans against brute force, with hot groups."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vitalforms.functions import distance
from vitalforms.operators import corpus, history, model, sequences
from vitalforms.operators.scan import running, with_segment
from vitalforms.plans import corpus_queries, quality_queries, tables


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds two thirds of 3,000 rows."""
    rng = random.Random(7)
    rows = [(i * 3 + 1, "hot" if i % 3 else f"g{i % 40}", rng.randint(0, 5), rng.random()) for i in range(3000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "pos long, grp string, idx int, loss double").cache(), sorted(rows)


def test_stratified_split_is_exact(skewed):
    df, rows = skewed
    got = {r.pos: r.split for r in corpus.stratified_split(df, "grp", "pos", 0.2).collect()}
    assert len(got) == len(rows)
    for g in {r[1] for r in rows}:
        own = [r[0] for r in rows if r[1] == g]
        dev = set(own[:max(1, int(len(own) * 0.2))])
        assert all((got[p] == "dev") == (p in dev) for p in own)


def test_random_flags_are_exact_and_repeatable(skewed):
    df, rows = skewed
    first = sorted(r.pos for r in corpus.validation_flags(df, "grp", "pos").filter("is_val").collect())
    again = sorted(r.pos for r in corpus.validation_flags(df.repartition(7), "grp", "pos").filter("is_val").collect())
    want = []
    for g in {r[1] for r in rows}:
        own = sorted((hashlib.md5(f"42|{r[0]}".encode()).hexdigest(), r[0]) for r in rows if r[1] == g)
        want += [p for _, p in own[:max(1, int(len(own) * 0.1))]]
    assert first == again == sorted(want)


@pytest.mark.parametrize("size", [0, 1, 200, 3000, 9999])
def test_fixed_sample_size(skewed, size):
    df, rows = skewed
    assert corpus.fixed_sample(df, "pos", size).count() == min(size, len(rows))


@pytest.mark.parametrize("n, ratio", [(0, 0.8), (1, 0.8), (10, 0.8), (7, 0.5)])
def test_ordered_split_small(spark, n, ratio):
    got = corpus.ordered_split(spark.range(n), "id", ratio).filter("split = 'train'").count()
    assert got == int(n * ratio + 1e-9)


def test_first_seen_rank(skewed):
    df, rows = skewed
    got = {r.grp: r["rank"] for r in corpus.first_seen(df, "grp", "pos").collect()}
    assert got == {g: i for i, g in enumerate(dict.fromkeys(r[1] for r in rows), start=1)}


@pytest.mark.parametrize("segment_rows", [100, 10_000])
def test_running_values_do_not_depend_on_segments(skewed, segment_rows):
    df, rows = skewed
    got = {r.pos: r for r in running(df, ["grp"], "pos", {
        "total": ("sum", F.col("idx")), "low": ("min", F.col("loss")), "prev": ("lag", F.col("idx"))},
        segment_rows=segment_rows).collect()}
    seen = {}
    for pos, g, idx, loss in rows:
        total, low, prev = seen.get(g, (0, 9.0, None))
        seen[g] = (total + idx, min(low, loss), idx)
        assert (got[pos].total, got[pos].low, got[pos].prev) == (total + idx, min(low, loss), prev)


@pytest.mark.parametrize("segment_rows", [100, 10_000])
def test_decode_greedy(skewed, segment_rows):
    df, rows = skewed
    step = df.withColumn("sym", F.when(F.col("idx") > 0, F.col("idx") + 40).otherwise(0))
    got = {r.grp: r.text for r in sequences.decode_greedy(step, "grp", "pos", "sym", segment_rows).collect()}
    for g in {r[1] for r in rows}:
        out, prev = "", None
        for r in rows:
            if r[1] == g:
                s = r[2] + 40 if r[2] else 0
                if s and s != prev:
                    out += chr(s + 31)
                prev = s
        assert got[g] == out


@pytest.mark.parametrize("segment_rows", [100, 10_000])
def test_best_so_far(skewed, segment_rows):
    df, rows = skewed
    got = {r.pos: r.is_best for r in history.best_so_far(df, ["grp"], "pos", "loss", segment_rows=segment_rows).collect()}
    best = {}
    for pos, g, _, loss in rows:
        assert got[pos] == (loss < best.get(g, 9.0))
        best[g] = min(best.get(g, 9.0), loss)


def test_early_stopping_example(spark):
    losses = [1.0, 0.9, 0.85, 0.84, 0.84, 0.84, 0.84]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(losses, 1)] + [("s", 1, 0.5), ("s", 2, 0.4)],
                               "run string, epoch int, loss double")
    got = {r.run: tuple(r)[1:] for r in history.early_stopping(df, "run", "epoch", "loss", patience=3).collect()}
    assert got == {"r": (0.84, True, 7), "s": (0.4, False, None)}


@pytest.mark.parametrize("order", ["pos", "day", "name", "at"])
def test_segments_of_a_burst_stay_balanced(spark, order):
    """Nearly all rows of a group lie in a short stretch of its order column."""
    rows = spark.range(4000).selectExpr(
        "CAST(NULL AS STRING) AS grp", "IF(id < 10, id * 1000000, 9000000 + id) AS pos", "id")
    rows = rows.selectExpr("*", "date_add(DATE'1900-01-01', CAST(IF(id < 10, id, 30000 + id) AS INT)) AS day",
                           "lpad(CAST(pos AS STRING), 7, '0') AS name", "timestamp_seconds(pos) AS at")
    sizes = [r["count"] for r in with_segment(rows, ["grp"], order, 500).groupBy("_seg").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 750
    got = running(rows, ["grp"], order, {"n": ("sum", F.lit(1)), "before": ("lag", F.col("id"))}, segment_rows=500)
    assert got.filter("n <> id + 1 OR NOT (before <=> IF(id = 0, NULL, id - 1))").isEmpty() and got.count() == 4000


def test_rows_without_an_order_value_come_first(spark):
    rows = spark.createDataFrame([("g", None, 5), ("g", 1, 1), ("g", 2, 1), ("g", 3, 1)], "grp string, pos int, v int")
    got = running(rows, ["grp"], "pos", {"total": ("sum", F.col("v"))}, segment_rows=1)
    assert {r.pos: r.total for r in got.collect()} == {None: 5, 1: 6, 2: 7, 3: 8}


def test_orders_of_one_file_are_dealt_to_all_cores(spark, tmp_path):
    spark.sql("SELECT id AS o_orderkey, id % 7 AS o_custkey, DATE '2001-02-03' + CAST(id % 90 AS INT) AS o_orderdate FROM range(2000)").coalesce(
        1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id AS c_custkey, 1 AS c_nationkey FROM range(7)").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT 1 AS n_nationkey, 'N' AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    rows = tables.field_dictionaries(spark, str(tmp_path)).select("doc_id", F.spark_partition_id().alias("part"))
    assert rows.select("part").distinct().count() >= 4 * spark.sparkContext.defaultParallelism
    assert rows.agg(F.count("*"), F.count_distinct("doc_id")).first() == (2000, 2000)


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_parts_of_one_file_are_dealt_and_their_words_compared_once(spark, tmp_path):
    spark.sql("SELECT id AS p_partkey, 'a b c' AS p_name, 't' AS p_type FROM range(2000)").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = quality_queries._pairs(spark, str(tmp_path)).select("sample_id", F.spark_partition_id().alias("part"))
    assert rows.agg(F.count_distinct("part")).first()[0] >= 4 * spark.sparkContext.defaultParallelism and rows.count() == 6000
    words = spark.createDataFrame([("é ü é", "é ö")], "a string, b string").select(distance.word_distance(F.col("a"), F.col("b")).alias("d"))
    assert plan(words).count("array_distinct(") == 1 and words.first().d == 2


def test_generated_fields_hold_each_kind_once(spark):
    """The values are those drawn for each field by itself, in an expression that does not grow with the fields."""
    seeds = spark.createDataFrame([(i, "Ana", "Cruz", None if i == 3 else "Vigan", " ") for i in (1, 2, 3, None)],
                                  "seed_id long, first_name string, last_name string, city string, province string")
    made = corpus.generate_field_values(seeds, "90", 2)
    assert plan(made).count("md5(") < 40
    got = {(r.seed_id, r.sample, r.field): (r.text, r.split) for r in made.collect()}
    for sample in (1, 2):
        key = F.concat_ws(".", F.col("seed_id").cast("string"), F.lit(sample).cast("string"))
        for field, kind in corpus.GENERATED_FIELDS["90"]:
            split = F.when(corpus.draw(key, field + "split", 100) < 10, "val").otherwise("train")
            alone = seeds.select("seed_id", corpus.generated_value(kind, field, key, *map(F.col, seeds.columns[1:])).alias("t"), split.alias("s"))
            for r in alone.collect() if field in ("license_no", "marriage_day", "marriage_city", "groom_residence", "bride_age") else ():
                assert got.get((r.seed_id, sample, field)) == ((r.t, r.s) if (r.t or "").strip() else None)


def test_customers_of_one_file_are_dealt_to_all_cores(spark, tmp_path):
    spark.sql("SELECT id AS c_custkey, 'c' || id AS c_name, 'm' AS c_mktsegment, 1 AS c_nationkey FROM range(2000)").coalesce(
        1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT 1 AS n_nationkey, 'N' AS n_name, 1 AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.sql("SELECT 1 AS r_regionkey, 'R' AS r_name").write.parquet(f"{tmp_path}/region.parquet")
    rows = corpus_queries.generated_fields(spark, str(tmp_path)).where("form = '1A'").select("seed_id", F.spark_partition_id().alias("part"))
    assert rows.agg(F.count_distinct("part"), F.count_distinct("seed_id"), F.count("*")).first()[0] >= 4 * spark.sparkContext.defaultParallelism


def test_segments_are_found_by_halving(spark):
    """A row is compared with ten bounds at most, however many there are."""
    rows = spark.sql("SELECT 'g' AS grp, IF(id % 9 = 0, NULL, CAST(id % 700 AS DOUBLE)) AS pos FROM range(5000) "
                     "UNION ALL SELECT NULL, CAST('NaN' AS DOUBLE) FROM range(30) UNION ALL SELECT NULL, -1.5D")
    got = with_segment(rows, ["grp"], "pos", 1)
    assert "filter(_bounds" not in plan(got)
    seen = {(r.grp, r.pos): r._seg for r in got.where("pos IS NOT NULL AND NOT isnan(pos)").collect()}
    of_g = [seen["g", float(i)] for i in range(700)]
    assert of_g == sorted(of_g) and len(set(of_g)) > 500 and got.where("pos IS NULL AND _seg <> 0").isEmpty()
    assert got.where("isnan(pos)").select("_seg").distinct().count() == 1


def test_segments_count_the_bounds_below(spark):
    rows = spark.sql("SELECT 'g' AS grp, CAST(id AS INT) AS pos FROM range(1, 4001)")
    sizes = [r["count"] for r in with_segment(rows, ["grp"], "pos", 4).groupBy("_seg").count().collect()]
    assert sum(sizes) == 4000 and 990 <= len(sizes) <= 1000 and max(sizes) <= 12


def test_documents_of_one_file_are_dealt_and_their_tokens_found_once(spark, tmp_path):
    spark.sql("SELECT id AS doc_id, 'en' AS lang, 'a bb cc bb' AS text FROM range(2000)").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_queries._whole_documents(spark, str(tmp_path)).select("doc_id", F.spark_partition_id().alias("part"))
    assert rows.agg(F.count_distinct("part")).first()[0] >= 4 * spark.sparkContext.defaultParallelism and rows.count() == 2000
    counted = model.term_arrays(spark.createDataFrame([(1, "Bb cc bb"), (2, None), (3, "é")], "k int, t string"), "k", "t")
    assert plan(counted).count("regexp_extract_all(") == 1
    assert {r.k: [(x.term, x.tf) for x in r.terms] for r in counted.collect()} == {
        1: [("bb", 2), ("bb cc", 1), ("cc", 1), ("cc bb", 1)], 2: [], 3: []}


def test_split_documents_are_stored_once_and_dealt(spark, tmp_path, monkeypatch):
    """The hold-out report fits and scores on dealt rows of a stored split."""
    spark.sql("SELECT id AS doc_id, IF(id % 2 = 0, 'en', 'de') AS lang, IF(id % 2 = 0, 'the cat', 'der hund') AS text FROM range(400)").coalesce(
        1).write.parquet(f"{tmp_path}/documents.parquet")
    seen, fit = [], model.fit
    monkeypatch.setattr(model, "fit", lambda df, *a, **k: (seen.append(df), fit(df, *a, **k))[1])
    got = {r.label: (r.support, r.f1) for r in corpus_queries.model_quality(spark, str(tmp_path)).collect()}
    assert got == {"en": (40, 1.0), "de": (40, 1.0)}
    assert seen[0].rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert "/split" in "".join(seen[0].inputFiles())
