"""Record search by an index of trigrams.

``build`` writes the composed records once and a postings table: one row per
(trigram, record) of the lower-cased name and id.  A search takes the trigrams
of its term, keeps the rarest few, intersects their postings and verifies the
records found with ``contains``, so its result equals that of the scan.  Terms
shorter than three characters have no trigram and fall back to the scan of the
written records.

Postings lie in folders by trigram (hash of it) and sorted by it, records in
folders by record (hash of doc_id), so a search reads a few folders of each and
in them the row groups whose statistics fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalforms.operators.records import search_records

GRAM = 3
MOST_GRAMS = 3       # the rarest trigrams of a term that are intersected; the rest is left to the verification
LOOKUP = 1_000       # candidates up to which records are read by key; beyond it the join reads their folders whole


def grams(text: Column) -> Column:
    """The different trigrams of a lower-cased text, without those that reach over its end."""
    low = F.lower(text)
    # substrings of a text shorter than three characters would be the text itself
    at = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(low, i, F.lit(GRAM))))


def grams_of(term: str) -> list[str]:
    low = term.lower()
    return sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})


class SearchIndex:
    """Written records and their trigram postings below one shared folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    @classmethod
    def build(cls, records: DataFrame, root: str, buckets: int = 64) -> SearchIndex:
        """Index records (doc_id, id, name, and what a search shows and filters by).

        A null name has no trigrams.  A gram that all records share (such as the
        start of every id) is spread over several files of its folder.
        """
        index = cls(records.sparkSession, root, buckets)
        spread = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(8))
        part = index._bucket_of(F.col("doc_id"))
        records.withColumn("part", part).repartition("part", spread).sortWithinPartitions("part", "doc_id").write.partitionBy(
            "part").parquet(f"{index.root}/records")
        stored = index.spark.read.schema(index._schema(records)).parquet(f"{index.root}/records")
        both = F.array_union(grams(F.coalesce(F.col("name"), F.lit(""))), grams(F.col("id")))
        rows = stored.select(F.explode(both).alias("gram"), "doc_id").withColumn("slot", index._bucket_of(F.col("gram")))
        rows.repartition("slot", spread).sortWithinPartitions("slot", "gram", "doc_id").write.partitionBy("slot").parquet(
            f"{index.root}/postings")
        index._postings().groupBy("slot", "gram").agg(F.count(F.lit(1)).alias("n")).repartition("slot").sortWithinPartitions(
            "slot", "gram").write.partitionBy("slot").parquet(f"{index.root}/grams")
        return index

    def _bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _schema(records: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema) + ", part int"

    def _postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, doc_id long, slot int").parquet(f"{self.root}/postings")

    def records(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/records").drop("part")

    def _slots(self, wanted: list[str]) -> dict[str, int]:
        """Folder of each trigram of a term, by the hash that wrote it."""
        table = self.spark.createDataFrame([(g,) for g in wanted], "gram string")
        return {r["gram"]: r["slot"] for r in table.select("gram", self._bucket_of(F.col("gram")).alias("slot")).collect()}

    def rarest(self, term: str) -> list[str] | None:
        """The trigrams to intersect; None if some trigram of the term is in no record."""
        slots = self._slots(grams_of(term))
        counts = self.spark.read.schema("gram string, n long, slot int").parquet(f"{self.root}/grams").where(
            F.col("slot").isin(sorted(set(slots.values()))) & F.col("gram").isin(list(slots)))
        found = {r["gram"]: r["n"] for r in counts.collect()}  # one row a trigram of the term
        if len(found) < len(slots):
            return None
        return sorted(found, key=lambda g: (found[g], g))[:MOST_GRAMS]

    def candidates(self, chosen: list[str]) -> DataFrame:
        """doc_id of the records that hold all of these trigrams, combined on the map side."""
        slots = sorted(set(self._slots(chosen).values()))
        hits = self._postings().where(F.col("slot").isin(slots) & F.col("gram").isin(chosen))
        bits = F
        for i, g in enumerate(chosen):
            bits = bits.when(F.col("gram") == g, F.lit(1 << i))
        met = hits.groupBy("doc_id").agg(F.bit_or(bits).alias("bits"))
        return met.where(F.col("bits") == (1 << len(chosen)) - 1).select("doc_id")

    def search(self, term: str = "", **conditions: object) -> DataFrame:
        """The records that ``search_records`` finds, by way of the postings."""
        every = self.records()
        if len(term) < GRAM or not grams_of(term):
            return search_records(every, term, **conditions)
        chosen = self.rarest(term)
        if chosen is None:
            return every.where("false")
        keys = self.candidates(chosen)
        few = [r["doc_id"] for r in keys.limit(LOOKUP + 1).collect()]
        if len(few) <= LOOKUP:
            ids = self.spark.createDataFrame([(i,) for i in few], "doc_id long").withColumn("part", self._bucket_of(F.col("doc_id")))
            parts = sorted({r["part"] for r in ids.select("part").collect()})
            near = self.spark.read.parquet(f"{self.root}/records").where(
                F.col("part").isin(parts) & F.col("doc_id").isin(few)).drop("part")
        else:
            near = every.join(keys, "doc_id", "left_semi")
        return search_records(near, term, **conditions)
