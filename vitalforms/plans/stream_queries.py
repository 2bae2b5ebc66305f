"""Streaming jobs run over everything that is available, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalforms.plans import tables as t
from vitalforms.plans.registry import DATA, FIELDS, query, with_ctes
from vitalforms.session import work_dir
from vitalforms.streaming import jobs


def _stream(spark, d, table):
    # the trailing * lets the path be one file as well as a folder of files
    schema = t.read(spark, d, table).schema
    return jobs.file_stream(spark, f"{d}/{table}.parquet*", schema)


def _events(spark, d):
    return _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_window", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_window(spark, d):
    root = work_dir(spark, "stream-window")
    counts = jobs.window_counts(_events(spark, d), "ts", "event_type")
    jobs.run_available(counts, f"{root}/checkpoint", jobs.batch_folder_writer(f"{root}/out"), "complete")
    last = spark.read.parquet(f"{root}/out")
    newest = last.agg(F.max("batch").alias("batch"))
    return last.join(F.broadcast(newest), "batch", "left_semi").select("window_start", "event_type", "n")


@query("stream_dedup", """
SELECT DISTINCT user_id, event_type, CAST(date_trunc('day', ts) AS DATE) AS day FROM events""")
def stream_dedup(spark, d):
    """One upload per user, kind and day: repeats are dropped while the day's
    keys are still in state (the delay spans the whole table)."""
    root = work_dir(spark, "stream-dedup")
    stream = _events(spark, d).withColumn("day", F.to_date("ts"))
    once = jobs.drop_repeats(stream, "ts", ["user_id", "event_type", "day"], "60 days")
    jobs.run_available(once, f"{root}/checkpoint", jobs.batch_folder_writer(f"{root}/out"))
    return spark.read.parquet(f"{root}/out").select("user_id", "event_type", "day")


@query("stream_ingest", """
SELECT o_orderkey AS doc_id, 'registry_no' AS field_name, 'R-' || o_custkey AS extracted_value FROM orders
UNION ALL SELECT o_orderkey, 'child_first', 'Ana' FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'nationality_of_mother', 'Filipino' FROM orders""")
def stream_ingest(spark, d):
    root = work_dir(spark, "stream-ingest")
    orders = _stream(spark, d, "orders")
    docs = orders.select(
        F.col("o_orderkey").alias("doc_id"), F.lit("birth").alias("form_hint"),
        F.create_map(F.lit("registry_no"), F.concat(F.lit("R-"), F.col("o_custkey").cast("string")),
                     F.lit("name_of_child_first"), F.when(F.col("o_orderkey") % 2 == 0, "Ana").otherwise(" "),
                     F.lit("nationality_of_mother"), F.lit("Filipino")).alias("fields"))
    jobs.ingest(docs, f"{root}/checkpoint", f"{root}/out")
    return spark.read.parquet(f"{root}/out").filter("field_name <> 'name_of_child_first'").select(
        "doc_id", "field_name", "extracted_value")


@query("stream_corrections", with_ctes(DATA, FIELDS) + """
, t AS (SELECT doc_id, field_id, max(data_id) AS data_id FROM data GROUP BY 1, 2),
c AS (SELECT o_orderkey AS doc_id, 'stream ' || o_custkey AS v FROM orders WHERE o_orderkey % 4 = 0),
f AS (SELECT data_id, v FROM c JOIN t USING (doc_id) JOIN fields USING (field_id) WHERE field_name = 'child_first')
SELECT data.data_id, coalesce(f.v, extracted_value) AS extracted_value, is_corrected OR f.v IS NOT NULL AS is_corrected
FROM data LEFT JOIN f USING (data_id)
UNION ALL SELECT (SELECT max(data_id) FROM data) + row_number() OVER (ORDER BY md5('|' || doc_id || '|' || (SELECT field_id FROM fields WHERE field_name = 'child_first'))), v, true
FROM c WHERE doc_id NOT IN (SELECT doc_id FROM t JOIN fields USING (field_id) WHERE field_name = 'child_first')""")
def stream_corrections(spark, d):
    root = work_dir(spark, "stream-corrections")
    t.data_fields(spark).write.parquet(f"{root}/fields/v=0")
    t.document_data(spark, d).write.parquet(f"{root}/data/v=0")
    orders = _stream(spark, d, "orders")
    requests = orders.filter("o_orderkey % 4 = 0").select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("seq"),
        F.create_map(F.lit("CHILD_FIRST"), F.concat(F.lit("stream "), F.col("o_custkey").cast("string")),
                     F.lit("blank"), F.lit("  ")).alias("form_data"))
    jobs.correct(requests, f"{root}/checkpoint", f"{root}/fields", f"{root}/data", ["seq"])
    versions = spark.read.parquet(f"{root}/data")
    newest = versions.agg(F.max("v").alias("v"))
    return versions.join(F.broadcast(newest), "v", "left_semi").select("data_id", "extracted_value", "is_corrected")


# Three arrivals: two thirds of the time span in order, the rest of it together with rows of the first days, which come too late.
_ARRIVALS = """b AS (SELECT min(ts) AS t0, max(ts) AS t1 FROM events),
a AS (SELECT *, CASE WHEN event_id % 50 = 0 AND ts < t0 + INTERVAL 3 DAY THEN 3 WHEN ts < t0 + (t1 - t0) / 3 THEN 1
  WHEN ts < t0 + (t1 - t0) / 3 * 2 THEN 2 ELSE 3 END AS arrival FROM events, b)"""


@query("stream_window_late", f"""WITH {_ARRIVALS},
m AS (SELECT max(ts) FILTER (WHERE arrival < 3) - INTERVAL 1 DAY AS late_before, max(ts) - INTERVAL 1 DAY AS closed_before FROM a),
w AS (SELECT *, date_trunc('day', ts) AS day FROM a, m WHERE arrival < 3 OR date_trunc('day', ts) + INTERVAL 1 DAY > late_before)
SELECT CAST(day AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM w WHERE day + INTERVAL 1 DAY <= closed_before GROUP BY ALL""")
def stream_window_late(spark, d):
    """Windows in append mode over three micro-batches: closed ones come out once, late rows and open windows do not."""
    root = work_dir(spark, "stream-window-late")
    events = t.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    t0, t1 = events.agg(F.min(F.unix_micros("ts"))).scalar(), events.agg(F.max(F.unix_micros("ts"))).scalar()
    third, since = (t1 - t0) / 3, F.unix_micros("ts") - t0
    arrival = (F.when((F.col("event_id") % 50 == 0) & (since < 3 * 86_400_000_000), 3).when(since < third, 1)
               .when(since < third * 2, 2).otherwise(3))
    dealt = events.select("event_id", "event_type", "ts", arrival.alias("arrival"))
    counts = jobs.window_counts(jobs.file_stream(spark, f"{root}/in/*", dealt.drop("arrival").schema), "ts", "event_type")
    for n in (1, 2, 3):
        dealt.where(F.col("arrival") == n).drop("arrival").write.parquet(f"{root}/in/arrival={n}")
        jobs.run_available(counts, f"{root}/checkpoint", jobs.batch_folder_writer(f"{root}/out"))
    return spark.read.parquet(f"{root}/out").select("window_start", "event_type", "n")
