"""Reading the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Schemas of the record store.
SCHEMAS = {
    "documents": "doc_id int, user_id int, type_id int, status string, "
                 "mnb_confidence_score float, upload_date timestamp",
    "document_data": "data_id int, doc_id int, field_id int, extracted_value string, "
                     "ner_confidence_score float, is_corrected boolean",
    "data_fields": "field_id int, field_name string, data_type string",
    "document_types": "type_id int, type_code string, type_name string",
    "ocr_logs": "log_id int, doc_id int, raw_text string, clean_text string, created_at timestamp",
    "users": "user_id int, username string, role string",
    "activity_logs": "log_id int, user_id int, action string, timestamp timestamp",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def parquet_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a folder of parquet files or folders."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
               bounds: tuple[int, int] | None = None, partitions: int = 64, **options: str) -> DataFrame:
    """A table over JDBC, read in parallel ranges of a numeric key when given.

    Password hashes are never selected from the users table.
    """
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", "10000")
    source = f"(select user_id, username, role from {table}) as u" if table == "users" else table
    reader = reader.option("dbtable", source)
    if partition_column and bounds:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", bounds[0]).option("upperBound", bounds[1])
                  .option("numPartitions", partitions))
    return reader.options(**options).load()
