"""Training histories: running means, best-so-far marks, early stopping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalforms.functions.text import safe_ratio
from vitalforms.operators.scan import SEGMENT_ROWS, running


def running_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, weight: str,
                 tie: Sequence[str] = (), segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Weighted mean of each row and the rows before it."""
    out = running(df, keys, order, {
        "_sum": ("sum", F.col(value) * F.col(weight)), "_n": ("sum", F.col(weight))},
        tie=tie, segment_rows=segment_rows)
    return out.withColumn("mean", safe_ratio(F.col("_sum"), F.col("_n"))).drop("_sum", "_n")


def best_so_far(df: DataFrame, keys: Sequence[str], order: str, loss: str,
                tie: Sequence[str] = (), segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Mark rows whose loss is strictly below all earlier ones."""
    out = running(df, keys, order, {"_best": ("min", F.col(loss))}, inclusive=False,
                  tie=tie, segment_rows=segment_rows)
    return out.withColumn("is_best", F.col("_best").isNull() | (F.col(loss) < F.col("_best"))).drop("_best")


def early_stopping(df: DataFrame, run: str, epoch: str, loss: str,
                   patience: int = 10, min_delta: float = 0.001) -> DataFrame:
    """Where training stops: best loss, stop flag and stop epoch per run.

    Each loss is judged against a best that depends on all earlier ones, so
    the run's losses are folded in order; a run has one row per epoch.
    """
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("wait"),
                     F.lit(None).cast("long").alias("stop_epoch"))

    def state(best: Column, wait: Column, stop: Column) -> Column:
        return F.struct(best.cast("double").alias("best"), wait.cast("int").alias("wait"),
                        stop.cast("long").alias("stop_epoch"))

    def step(acc: Column, x: Column) -> Column:
        waited = acc["wait"] + 1
        worse = x["loss"] > acc["best"] - F.lit(min_delta)
        return (
            F.when(acc["stop_epoch"].isNotNull(), acc)
            .when(acc["best"].isNull(), state(x["loss"], F.lit(0), F.lit(None)))
            .when(worse, state(acc["best"], waited, F.when(waited >= patience, x["epoch"])))
            .otherwise(state(x["loss"], F.lit(0), F.lit(None)))
        )

    points = F.array_sort(F.collect_list(F.struct(
        F.col(epoch).cast("long").alias("epoch"), F.col(loss).cast("double").alias("loss"))))
    folded = df.groupBy(run).agg(points.alias("_p")).select(
        run, F.aggregate("_p", start, step).alias("_s"))
    return folded.select(run, F.col("_s.best").alias("best_loss"),
                         F.col("_s.stop_epoch").isNotNull().alias("stopped"),
                         F.col("_s.stop_epoch").alias("stop_epoch"))
