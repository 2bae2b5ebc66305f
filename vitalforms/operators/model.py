"""Multinomial naive Bayes over TF-IDF features, as plain aggregations.

Term counts, document frequencies and class sums are grouped with map-side
combining; the fitted model is a few small tables: at most ``max_features``
vocabulary rows and one weight per term and class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalforms.session import drop_folder, shuffles_dropped

TOKEN = r"[\p{L}\p{N}_]{2,}"  # whole runs of letters, digits and underscores


def tokens(text: Column) -> Column:
    """Lower-cased word tokens of two or more characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def terms(t: Column) -> Column:
    """Single tokens and pairs of neighbours, of an array column of tokens (each mention of it is evaluated)."""
    ahead = F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
    body = F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0)))
    pairs = F.zip_with(body, ahead, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(t, pairs)


def term_arrays(df: DataFrame, key: str, text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, terms): the different terms of a text with their counts, as one array a row.

    A row holds its whole text, so its terms are sorted and counted inside
    the row and no occurrence is moved.  The tokens are a column of their own,
    so that a text is searched once.
    """
    split = df.select(key, *extra, tokens(F.col(text)).alias("_w"))
    listed = split.select(key, *extra, F.sort_array(terms(F.col("_w"))).alias("_s"))
    new = F.transform("_s", lambda t, i: F.when((i == 0) | (F.get("_s", i - 1) != t), i))
    runs = listed.withColumn("_p", F.filter(new, lambda p: p.isNotNull()))
    counts = F.transform("_p", lambda p, k: F.struct(
        F.get("_s", p).alias("term"), (F.coalesce(F.get("_p", k + 1), F.size("_s")) - p).alias("tf")))
    return runs.select(key, *extra, counts.alias("terms"))


def term_rows(arrays: DataFrame, key: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, term, tf): one row per different term.

    The outer form of explode keeps the optimizer from counting every text a
    second time just to test that it has terms.
    """
    rows = arrays.select(key, *extra, F.explode_outer("terms").alias("r")).filter("r IS NOT NULL")
    return rows.select(key, *extra, "r.term", "r.tf")


def vocabulary(documents: DataFrame, text: str = "text", max_features: int | None = None) -> DataFrame:
    """(term, tf_total, df, idf) of all terms, or of the ``max_features`` most
    frequent ones, ties by term.

    idf = ln((1 + n) / (1 + df)) + 1 with n the number of documents.  Both
    counts come from one grouping by term, combined on the map side.
    """
    texts = documents.select(F.lit(0).alias("_k"), F.col(text).alias("_text"))
    return vocabulary_of(term_arrays(texts, "_k", "_text"), "_k", max_features)


def vocabulary_of(arrays: DataFrame, key: str, max_features: int | None = None) -> DataFrame:
    """``vocabulary`` from counted terms."""
    n = arrays.agg(F.count(F.lit(1))).scalar()
    rows = term_rows(arrays, key)
    stats = rows.groupBy("term").agg(F.sum("tf").alias("tf_total"), F.count(F.lit(1)).alias("df"))
    top = stats if max_features is None else stats.orderBy(F.desc("tf_total"), "term").limit(max_features)
    return top.select("term", "tf_total", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted_terms(arrays: DataFrame, vocab: DataFrame, key: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, term, x, and the other columns of ``vocab``) of the known terms: sub-linear tf times idf.

    The vocabulary is joined by term: where the planner finds it small it is
    sent to the texts and no term row moves.
    """
    known = term_rows(arrays, key, extra).join(vocab, "term")
    return known.withColumn("x", (1 + F.log("tf")) * F.col("idf")).drop("tf", "idf")


@dataclass
class TextModel:
    """Fitted vocabulary, class priors and term weights."""

    vocab: DataFrame
    priors: DataFrame
    weights: DataFrame
    digits: int = 4

    def predict(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        """label, confidence and probability map per document.

        A document without known terms gets the priors.  Ties go to the first
        label by name.
        """
        wide = self.weights.groupBy("term").agg(
            F.map_from_entries(F.collect_list(F.struct("label", "weight"))).alias("_w"))
        known = self.vocab.select("term", "idf").join(wide, "term")
        # sums per document and label are combined in the task that holds the text
        sums = (weighted_terms(term_arrays(df, key, text), known, key).select(key, "x", F.explode("_w").alias("label", "_weight"))
                .groupBy(key, "label").agg(F.sum(F.col("x") * F.col("_weight")).alias("_s"),
                                           F.sum(F.col("x") * F.col("x")).alias("_q"))
                .groupBy(key).agg(F.map_from_entries(F.collect_list(
                    F.struct("label", (F.col("_s") / F.sqrt("_q")).alias("s")))).alias("_scores")))
        prior = self.priors.agg(F.array_sort(F.collect_list(F.struct("label", "log_prior")))).scalar()
        joined = df.select(key).join(sums, key, "left").withColumn("_priors", prior)

        def likelihood(label: Column) -> Column:
            return F.coalesce(F.col("_scores")[label], F.lit(0.0))

        step = joined.withColumn("_l", F.transform("_priors", lambda p: F.struct(
            p["label"].alias("label"), (p["log_prior"] + likelihood(p["label"])).alias("l"))))
        step = step.withColumn("_top", F.array_max(F.transform("_l", lambda e: e["l"])))
        step = step.withColumn("_z", F.aggregate(
            "_l", F.lit(0.0), lambda acc, e: acc + F.exp(e["l"] - F.col("_top"))))
        share = F.transform("_l", lambda e: F.struct(
            e["label"].alias("label"), F.round(F.exp(e["l"] - F.col("_top")) / F.col("_z"), self.digits).alias("p")))
        first = F.get(F.filter("_l", lambda e: e["l"] == F.col("_top")), F.lit(0))["label"]
        return step.select(key, first.alias("label"),
                           F.round(1 / F.col("_z"), self.digits).alias("confidence"),
                           F.map_from_entries(share).alias("probabilities"))

    def save(self, path: str) -> None:
        for name in ("vocab", "priors", "weights"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> "TextModel":
        return cls(*[spark.read.parquet(f"{path}/{n}") for n in ("vocab", "priors", "weights")])


def fit(df: DataFrame, key: str, label: str, path: str, text: str = "text",
        alpha: float = 0.1, max_features: int | None = None) -> TextModel:
    """Fit on (key, text, label) and store the model under ``path``.

    The terms of every text are counted once and stored; the vocabulary, the
    lengths of the documents and the class sums come from these counts.  A
    length meets the counts before they are taken apart, so term rows are summed
    where they arise.  ``key`` tells the rows apart.  The counts, which are
    longer than the texts, and what else the model does not need are deleted.
    """
    spark = df.sparkSession
    with shuffles_dropped(spark):
        _fit(df, key, label, path, text, alpha, max_features)
    for name in ("terms", "norms", "sums"):
        drop_folder(spark, f"{path}/{name}")
    return TextModel.load(spark, path)


def _fit(df: DataFrame, key: str, label: str, path: str, text: str, alpha: float, max_features: int | None) -> None:
    spark = df.sparkSession
    counted = term_arrays(df, key, text, (label,))
    counted.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/terms")
    counted = spark.read.schema(counted.schema).parquet(f"{path}/terms")
    vocabulary_of(counted, key, max_features).write.mode("overwrite").parquet(f"{path}/vocab")
    vocab = spark.read.parquet(f"{path}/vocab")
    idf = vocab.select("term", "idf")
    norms = weighted_terms(counted, idf, key).groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_norm"))
    norms.write.mode("overwrite").parquet(f"{path}/norms")
    normed = counted.join(spark.read.schema(norms.schema).parquet(f"{path}/norms"), key)
    x = weighted_terms(normed, idf, key, (label, "_norm"))
    x.groupBy(F.col(label).cast("string").alias("label"), "term").agg(
        F.sum(F.col("x") / F.col("_norm")).alias("w")).write.mode("overwrite").parquet(f"{path}/sums")
    sums = spark.read.parquet(f"{path}/sums")
    size = vocab.agg(F.count(F.lit(1))).scalar()
    classes = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("_c"))
    priors = classes.select("label", F.log(F.col("_c") / classes.agg(F.sum("_c")).scalar()).alias("log_prior"))
    priors.write.mode("overwrite").parquet(f"{path}/priors")
    priors = spark.read.parquet(f"{path}/priors")
    totals = sums.groupBy("label").agg(F.sum("w").alias("_t"))
    # every class needs a weight for every term: classes x vocabulary rows
    every = priors.agg(F.collect_list("label")).scalar()
    grid = vocab.select("term", F.explode(every).alias("label"))
    weights = (grid.join(sums, ["label", "term"], "left").join(F.broadcast(totals), "label")
               .select("label", "term", F.log((F.coalesce("w", F.lit(0.0)) + alpha)
                                              / (F.col("_t") + alpha * size)).alias("weight")))
    weights.write.mode("overwrite").parquet(f"{path}/weights")
