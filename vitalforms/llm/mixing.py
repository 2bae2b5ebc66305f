"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, served up to
``epochs`` times over.  A document's virtual finish time is the number of
words its source has sent up to its end, divided by the source's target; the
mix is the head of all documents in the order of that time, cut at the total
budget.  Running sums are taken inside ranges of the shuffled order and of
the finish time, to which the totals of the ranges before are added, so no
source and no range of time has to fit a task.  The totals themselves are
summed in blocks of ranges in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalforms.llm.common import n_words, staged

RANGE_ROWS = 2_000
BLOCK_DIGITS = 3     # a block is 16^3 ranges


def targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, epochs: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the budget shared
    by weight, each target at most ``epochs`` times its source's size."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int") + 1))
    filled = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    so_far = filled.rowsBetween(Window.unboundedPreceding, -1)
    rest = filled.rowsBetween(0, Window.unboundedFollowing)
    every = filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The level that holds if all sources before this one, in order of size to weight, are capped.
    level = ((F.sum("source_size").over(every) * percent / F.lit(100.0)
              - epochs * F.coalesce(F.sum("source_size").over(so_far), F.lit(0))) / F.sum("weight").over(rest))
    cap = (epochs * F.col("source_size")).cast("double")
    full = weighted.withColumn("_level", level).withColumn(
        "_open", F.col("_level") * F.col("weight") < epochs * F.col("source_size"))
    first = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(every)
    return full.select("source", "source_size", F.coalesce(F.least(F.col("weight") * first, cap), cap).alias("target"))


def sums_before(totals: DataFrame, keys: list[str], place: str, block: Column) -> DataFrame:
    """(keys, place, before): what the rows (keys, place, sum) of lower places hold.  ``block`` never falls where the
    place rises; only the rows of one block, and one row of each block, are summed together."""
    cut = totals.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(place)
    across = Window.partitionBy(*keys).orderBy("_block")
    held = cut.groupBy(*keys, "_block").agg(F.sum("sum").alias("_held"))
    ahead = held.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_ahead"),
                        (F.sum("_held").over(across) - F.col("_held")).alias("_before"))
    same = F.col("_block") == F.col("_ahead")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    within = cut.withColumn("_within", F.sum("sum").over(inside) - F.col("sum"))
    return within.join(ahead, same).select(*keys, place, (F.col("_within") + F.col("_before")).alias("before"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, draw): words of each text and its place in the shuffle, by its row where it has no doc_id."""
    row = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    return docs.select("doc_id", "source", n_words().alias("size"),
                       F.md5(F.coalesce(F.col("doc_id").cast("string"), row).cast("binary")).alias("draw"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, epochs: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), one row per input row.

    ``copies`` says how often the mix has the document and ``taken`` the words
    of these copies.  The order inside a source is that of md5(doc_id), so
    reruns agree.  Texts without words take nothing and come at the place of
    their draw, so they share no point in time; rows without a doc_id are drawn
    by their place in the input, so one split alike; null sources form
    the last source; rows that repeat a doc_id are served each.  Extra columns
    are ignored; an empty table gives no rows.
    """
    rows = staged(sized(docs), "sizes")
    shares = staged(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, epochs), "targets")
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    digits = min(8, max(1, len(f"{ranges:x}")))
    dealt = rows.withColumn("range", F.substring("draw", 1, digits))
    totals = dealt.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    before = staged(sums_before(totals, ["source"], "range", F.substring("range", 1, max(0, digits - BLOCK_DIGITS))), "ranges")
    inside = Window.partitionBy("source", "range").orderBy("draw", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    queued = dealt.withColumn("_sent", F.sum("size").over(inside)).alias("q").join(
        before.alias("b"), F.col("q.source").eqNullSafe(F.col("b.source")) & (F.col("q.range") == F.col("b.range"))).join(
        shares.alias("s"), F.col("q.source").eqNullSafe(F.col("s.source"))).select(
        "q.doc_id", "q.draw", "q.size", "s.source_size", "s.target",
        F.monotonically_increasing_id().alias("row"), (F.col("_sent") + F.col("before")).alias("sent"))
    queued = staged(queued, "queued")
    turns = queued.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)]))).withColumn(
        "finish", F.when(F.col("size") > 0, (F.col("sent") + F.col("epoch") * F.col("source_size")) / F.col("target")).otherwise(
            F.col("epoch") + F.conv(F.substring("draw", 1, 8), 16, 10).cast("double") / (1 << 32)))
    spans = max(1, epochs * ranges)
    turns = turns.withColumn("span", F.floor(F.col("finish") * spans).cast("long"))
    held = turns.groupBy("span").agg(F.sum("size").alias("sum"))
    ahead = sums_before(held, [], "span", F.shiftright("span", 4 * BLOCK_DIGITS)).withColumnRenamed("before", "ahead")
    order = Window.partitionBy("span").orderBy("finish", "draw", "doc_id", "epoch", "row").rowsBetween(
        Window.unboundedPreceding, 0)
    budget = rows.agg(F.floor(F.sum("size") * percent / F.lit(100)).alias("budget"))
    served = turns.withColumn("_run", F.sum("size").over(order)).join(staged(ahead, "spans"), "span")
    served = served.where(F.col("_run") + F.col("ahead") <= budget.scalar())
    copies = served.groupBy("row").agg(F.count("*").alias("copies"))
    return queued.join(copies, "row", "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("copies", F.lit(0))).cast("long").alias("taken"),
        F.coalesce("copies", F.lit(0)).cast("int").alias("copies"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, epochs: int = 2) -> DataFrame:
    """The documents the mix takes, each as often as it takes them, with all columns of ``docs``.

    doc_id must tell the rows apart, but for repeated rows, which share their copies.
    """
    copies = staged(mixture(docs, weights, percent, epochs).where("copies > 0").groupBy("doc_id").agg(
        F.max("copies").alias("_copies")), "copies").withColumnRenamed("doc_id", "_doc")
    return docs.join(copies, F.col("doc_id").eqNullSafe(F.col("_doc"))).select(
        *[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).drop("_copy")
