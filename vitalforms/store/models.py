"""Versioned text models.

``publish`` writes a model's tables under a folder of their own and then one
manifest row, so a version is seen only when it is whole.  Batch and stream
scoring load the newest version, or one by number; where a name has no version
yet, texts are classified by the keyword rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalforms.operators import classify, model

MANIFEST = "name string, version int, path string, label string, documents long"


class ModelRegistry:
    """Models by name and version below one shared folder; one writer a name at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        spark.createDataFrame([], MANIFEST).write.mode("append").parquet(f"{self.root}/manifest")  # so that it can be read

    def versions(self, name: str) -> DataFrame:
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        return rows.where(F.col("name") == name)

    def publish(self, name: str, documents: DataFrame, key: str, label: str, text: str = "text", **options) -> int:
        """Fit on (key, text, label) and store the next version; returns its number.

        A run that ends before its manifest row leaves a folder that the next
        one overwrites.
        """
        last = self.versions(name).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]
        path = f"{self.root}/{name}/v={last + 1}"
        model.fit(documents, key, label, path, text, **options)
        row = documents.agg(F.count(F.lit(1)).alias("documents")).select(
            F.lit(name).alias("name"), F.lit(last + 1).alias("version"), F.lit(path).alias("path"), F.lit(label).alias("label"), "documents")
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return last + 1

    def load(self, name: str, version: int | None = None) -> model.TextModel | None:
        """The newest model of a name, or one version; None where there is none."""
        rows = self.versions(name)
        if version is not None:
            rows = rows.where(F.col("version") == version)
        found = rows.orderBy(F.desc("version")).select("path").head(1)
        return model.TextModel.load(self.spark, found[0]["path"]) if found else None

    def classify(self, name: str, df: DataFrame, text: str, key: str) -> DataFrame:
        """``classify`` by the newest model of a name, or by the keyword rule where there is none."""
        return classify.classify(df, text, key, self.load(name))
