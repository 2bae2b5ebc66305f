"""Decoding of request bodies and property columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUEST = "doc_id int, status string, formData map<string,string>"


def decode_requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(doc_id, status, form_data) of JSON bodies; bodies without a doc_id go."""
    parsed = bodies.select(F.from_json(F.col(body), REQUEST).alias("r"))
    empty = F.create_map().cast("map<string,string>")
    return parsed.filter(F.col("r.doc_id").isNotNull()).select(
        F.col("r.doc_id").alias("doc_id"), F.col("r.status").alias("status"),
        F.coalesce("r.formData", empty).alias("form_data"))
