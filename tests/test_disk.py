"""Shuffle files and intermediate tables do not stay when a step is done."""

import os

from pyspark.sql import functions as F

from vitalforms.operators import model
from vitalforms.operators.ranking import digest, ranked_by_digest
from vitalforms.session import shuffles_dropped
from vitalforms.store.records import SCHEMAS, RecordStore


def _shuffles(spark):
    return {int(k) for k in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()).keySet()}


def test_a_write_gives_back_its_shuffles(spark, tmp_path):
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", _shuffles(spark)
    conf = spark.conf.get(key)
    with shuffles_dropped(spark):
        spark.range(100).repartition(3, "id").write.parquet(f"{tmp_path}/t")
    assert _shuffles(spark) <= before and spark.conf.get(key) == conf


def test_digest_ranks_move_rows_without_their_digests(spark):
    rows = spark.createDataFrame([(i % 40, f"v{i}") for i in range(80)] + [(None, "n")], "id int, v string")
    out = ranked_by_digest(rows, [F.col("id")], ["v"], out="n")
    got = [(r.id, r.v) for r in out.orderBy("n").collect()]
    assert out.columns == ["id", "v", "n"] and sorted(r.n for r in out.collect()) == list(range(1, 82))
    assert got == [(r.id, r.v) for r in rows.orderBy(digest(F.col("id")), "v").collect()]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):plan.index("Join") if plan.index("Join") > plan.index("RepartitionByExpression") else None]
    assert "_w" not in below.split("\n")[0] and "RepartitionByExpression" in below


def test_uploads_leave_the_rows_of_the_last_batch_alone(spark, tmp_path):
    store = RecordStore.create(spark, f"{tmp_path}/store", spark.createDataFrame([], SCHEMAS["documents"]).drop("bucket"),
                               spark.createDataFrame([], SCHEMAS["data"]).drop("bucket"),
                               spark.createDataFrame([(1, "sex", "text")], SCHEMAS["fields"]), buckets=2)
    for n in (0, 1):
        uploads = spark.createDataFrame([(f"u{n}", 1, "birth", {"sex": " Male"})], "upload_key string, user_id long, form_hint string, fields map<string,string>")
        store.ingest(uploads.withColumn("uploaded_at", F.lit("2020-01-01").cast("timestamp")), "desk", n)
    assert set(os.listdir(f"{tmp_path}/store/staging")) <= {"long=2", "names=2"}
    assert sorted((r.doc_id, r.raw_text.count("2. SEX: Male\n")) for r in store.logs().collect()) == [(1, 1), (2, 1)]
    assert [r.extracted_value for r in store.document_data().collect()] == [" Male", " Male"]


def test_fit_keeps_the_model_alone(spark, tmp_path):
    texts = spark.createDataFrame([(1, "aa bb aa", "x"), (2, "cc bb", "y")], "id int, text string, y string")
    fitted = model.fit(texts, "id", "y", f"{tmp_path}/m")
    assert set(os.listdir(f"{tmp_path}/m")) == {"vocab", "priors", "weights"}
    assert {r.id: r.label for r in fitted.predict(texts, "id").collect()} == {1: "x", 2: "y"}
