"""Running values over ordered groups, cut into segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalforms.operators.ranking import null_safe_join

SEGMENT_ROWS = 1_000_000
QUANTILES = 1024
_SEG = "_seg"

_MERGE = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "min": F.least,
    "max": F.greatest,
}
_FOLD = {"sum": F.sum, "min": F.min, "max": F.max}


def position(df: DataFrame, order: str) -> Column:
    """A number that never falls where the order column rises (a text's first bytes)."""
    kind, col = df.schema[order].dataType, F.col(order)
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(col.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    return col.cast("double")


def with_segment(df: DataFrame, keys: Sequence[str], order: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Add ``_seg``: the range of the order column a row lies in, within its group.

    Every group is cut at quantiles of its order column into as many ranges
    as hold ``segment_rows`` rows, at most QUANTILES; a burst of rows in a
    short stretch is cut as finely as its rows demand.  Rows of one order
    value stay together, and rows without one come first.
    """
    pos = position(df, order)
    points = F.percentile_approx(pos, [i / QUANTILES for i in range(1, QUANTILES)], 4 * QUANTILES)
    parts = F.least(F.ceil(F.col("_rows") / segment_rows), F.lit(QUANTILES)).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get("_points", F.floor(i * QUANTILES / parts).cast("int") - 1))
    bounds = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), points.alias("_points")).select(
        *keys, F.when(parts > 1, F.array_distinct(cuts)).otherwise(F.array().cast("array<double>")).alias("_bounds"))
    joined = null_safe_join(df, bounds, keys)
    # the bounds rise: how many are not above a position is found by halving, not by comparing with each of them
    below = F.aggregate(F.array(*[F.lit(QUANTILES >> i) for i in range(1, QUANTILES.bit_length())]), F.lit(0), lambda n, step: F.when(
        F.get("_bounds", n + step - 1) <= pos, n + step).otherwise(n))
    return joined.withColumn(_SEG, F.when(pos.isNull(), 0).otherwise(below).cast("long")).drop("_bounds")


def running(df: DataFrame, keys: Sequence[str], order: str,
            values: Mapping[str, tuple[str, Column]], inclusive: bool = True,
            tie: Sequence[str] = (), segment_rows: int = SEGMENT_ROWS,
            keep_segment: bool = False) -> DataFrame:
    """Running aggregates of each group in order.

    ``values`` maps an output name to ``(kind, column)`` where kind is sum,
    min, max or lag.  With ``inclusive=False`` the current row is left out.
    Every segment is scanned on its own; the totals of the segments before it
    give each its starting value.
    """
    inputs = {f"_in_{n}": c for n, (_, c) in values.items()}
    base = with_segment(df.withColumns(inputs) if inputs else df, keys, order, segment_rows)
    w = Window.partitionBy(*keys, _SEG).orderBy(order, *tie)
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    local = {"_first": F.row_number().over(w) == 1}
    totals, carries = [], {}
    before = Window.partitionBy(*keys).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, _) in values.items():
        col = F.col(f"_in_{name}")
        if kind == "lag":
            local[f"_loc_{name}"] = F.lag(col).over(w)
            totals.append(F.max_by(F.struct(col.alias("v")), F.struct(order, *tie)).alias(f"_t_{name}"))
            carries[f"_c_{name}"] = F.lag(F.col(f"_t_{name}")["v"]).over(
                Window.partitionBy(*keys).orderBy(_SEG))
        else:
            local[f"_loc_{name}"] = _FOLD[kind](col).over(frame)
            totals.append(_FOLD[kind](col).alias(f"_t_{name}"))
            carries[f"_c_{name}"] = _FOLD[kind](F.col(f"_t_{name}")).over(before)
    carry = (base.groupBy(*keys, _SEG).agg(*totals)
             .select(*keys, _SEG, *[c.alias(n) for n, c in carries.items()]))
    out = null_safe_join(base.withColumns(local), carry, [*keys, _SEG])
    final = {}
    for name, (kind, _) in values.items():
        loc, car = F.col(f"_loc_{name}"), F.col(f"_c_{name}")
        if kind == "lag":
            final[name] = F.when(F.col("_first"), car).otherwise(loc)
        else:
            final[name] = _MERGE[kind](loc, car)
    helpers = [c for n in values for c in (f"_in_{n}", f"_loc_{n}", f"_c_{n}")]
    drop = [*helpers, "_first"] + ([] if keep_segment else [_SEG])
    return out.withColumns(final).drop(*drop)
