"""Writers: annotations, results, predictions, span corpora, reports, uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalforms.operators.ranking import digest, ranked, with_digest_bucket


def write_annotations(df: DataFrame, path: str) -> None:
    """Annotation rows as JSON, one folder per split when there is one."""
    writer = df.write.mode("overwrite")
    if "split" in df.columns:
        writer = writer.partitionBy("split")
    writer.json(path)


def write_results(df: DataFrame, path: str) -> None:
    """Records as JSON lines without their missing fields."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def prediction_rows(pairs: DataFrame) -> DataFrame:
    match = F.when(F.col("truth") == F.col("pred"), "✓").otherwise("✗")
    return pairs.select(F.col("truth").alias("Ground Truth"), F.col("pred").alias("Prediction"),
                        match.alias("Match"))


def write_predictions(pairs: DataFrame, path: str) -> None:
    """Truth, prediction and match mark as tab-separated text."""
    prediction_rows(pairs).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def write_span_corpus(corpus: DataFrame, path: str) -> None:
    """Cleaned (text, spans) examples, partitioned by split when there is one."""
    writer = corpus.write.mode("overwrite")
    if "split" in corpus.columns:
        writer = writer.partitionBy("split")
    writer.parquet(path)


def write_reports(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def upload_rows(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """New document rows of uploads (upload_key, user_id, type_id, uploaded_at).

    Ids follow the largest stored one in digest order of the upload key;
    status is Pending.
    """
    last = documents.agg(F.coalesce(F.max("doc_id"), F.lit(0))).scalar()
    keyed = with_digest_bucket(uploads.withColumn("_d", digest(F.col("upload_key"))), "_d")
    return ranked(keyed, ["_d"], out="_n").select(
        (last + F.col("_n")).alias("doc_id"), "user_id", "type_id",
        F.lit("Pending").alias("status"), F.lit(0.0).cast("float").alias("mnb_confidence_score"),
        F.col("uploaded_at").alias("upload_date"), "upload_key")


def log_rows(documents: DataFrame, text: DataFrame) -> DataFrame:
    """Log rows of new documents: (doc_id, raw_text, clean_text, created_at)."""
    return documents.join(text, "upload_key").select(
        "doc_id", F.col("text").alias("raw_text"), F.col("text").alias("clean_text"),
        F.col("upload_date").alias("created_at"))
