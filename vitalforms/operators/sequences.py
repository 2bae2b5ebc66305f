"""Greedy decoding of index sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalforms.functions.text import index_char
from vitalforms.operators.scan import SEGMENT_ROWS, running


def collapse_steps(steps: DataFrame, key: str, order: str, idx: str, segment_rows: int = SEGMENT_ROWS,
                   keep_segment: bool = False) -> DataFrame:
    """Steps that emit a character: not blank (0), not a repeat of the step before.

    The repeat test looks at the raw previous index, blanks included; an index
    outside the alphabet emits nothing.
    """
    seen = running(steps, [key], order, {"_prev": ("lag", F.col(idx))}, segment_rows=segment_rows,
                   keep_segment=keep_segment)
    fresh = F.col("_prev").isNull() | (F.col("_prev") != F.col(idx))
    return (seen.filter((F.col(idx) != 0) & fresh)
            .withColumn("char", index_char(F.col(idx))).filter(F.col("char").isNotNull()).drop("_prev"))


def decode_greedy(steps: DataFrame, key: str, order: str, idx: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Decoded text per sequence ('' when nothing is emitted).

    Characters are joined per segment first, so a long sequence is put
    together from a few pieces and never collected character by character.
    """
    kept = collapse_steps(steps, key, order, idx, segment_rows, keep_segment=True)
    chars = F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.col("char").alias("c"))))
    piece = kept.groupBy(key, "_seg").agg(
        F.array_join(F.transform(chars, lambda x: x["c"]), "").alias("piece"))
    pieces = F.array_sort(F.collect_list(F.struct("_seg", "piece")))
    text = piece.groupBy(key).agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("text"))
    return steps.select(key).distinct().join(text, key, "left").select(
        key, F.coalesce("text", F.lit("")).alias("text"))
