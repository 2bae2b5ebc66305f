"""Equal shards by histogram sort.

Rows are ordered by (crc32 of the text, hash of doc_id), packed into one
non-negative number, so equal texts are neighbours and a group of copies of
any size still has boundaries inside it.  Splitters are found by counting the
exact bytes below candidate boundaries: each round divides the cells in which
a target lies into finer ones, counts bytes per cell across all partitions
and keeps the cell of each target, until its bytes are within the tolerance.
Then every row goes to its shard in a single exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalforms.llm.common import staged, utf8_size

KEY_BITS, ROUND_BITS = 63, 9
SLOT_ROWS = 100_000


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key): what the splitters are sought on."""
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        "doc_id", (utf8_size() + 8).alias("size"), crc.alias("text_crc32"),
        F.shiftleft(crc, 31).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 31) - 1))).alias("key"))


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.001) -> list[int]:
    """Keys at which shards 1 .. shards-1 begin; at most (shards - 1) * 2^ROUND_BITS counts
    reach the driver in a round, whatever the size of ``rows``."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    cells = {0: (0, [total * i / shards for i in range(1, shards)])}  # cell -> bytes below it, targets in it
    shift, found = KEY_BITS, []
    while cells and shift:
        step = min(ROUND_BITS, shift)
        prefix = F.shiftright("key", shift)
        inside = rows.where(prefix.isin(list(cells))) if shift < KEY_BITS else rows
        shift -= step
        counts = inside.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("size"))
        by_cell = dict(counts.collect())
        narrowed: dict[int, tuple[int, list[float]]] = {}
        for parent, (below, targets) in cells.items():
            for cell in range(parent << step, (parent + 1) << step):
                above = below + by_cell.get(cell, 0)
                for target in [t for t in targets if below <= t < above]:
                    near = min((target - below, cell), (above - target, cell + 1))
                    if near[0] <= slack or not shift:
                        found.append(near[1] << shift)
                    else:
                        narrowed.setdefault(cell, (below, []))[1].append(target)
                below = above
        cells = narrowed
    return sorted(found)


def shard_of(key: Column, bounds: list[int]) -> Column:
    """How many splitters lie at or below the key."""
    above = F.lit(0)
    for b in bounds:
        above = above + (key >= F.lit(b)).cast("int")
    return above


def histogram_shards(docs: DataFrame, shards: int = 24, tolerance: float = 0.001) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per input row.

    Sizes (UTF-8 bytes plus 8) of the shards differ by the tolerance and at
    most one key's rows.  A null text has size 8 and crc32 0.  Rows that repeat
    text and doc_id share a key and stay together.  Slots number a shard's
    rows without a gap.  Extra columns are ignored; an empty table gives no
    rows.
    """
    rows = staged(keyed(docs), "sizes")
    placed = rows.withColumn("shard", shard_of(F.col("key"), splitters(rows, shards, tolerance)))
    parts = max(8, -(-rows.count() // (shards * SLOT_ROWS)))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("key", "doc_id", F.lit(3)), F.lit(parts)))
    held = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = held.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "doc_id", "size"))
    return dealt.withColumn("place", place).join(before, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """The documents as Parquet folders shard=0 .. shard=n-1, each dealt to several files."""
    rows = staged(keyed(docs), "sizes")
    bounds = splitters(rows, shards)
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    key = F.shiftleft(crc, 31).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 31) - 1)))
    parts = max(1, -(-rows.count() // (shards * SLOT_ROWS)))
    dealt = docs.withColumn("shard", shard_of(key, bounds)).withColumn("_part", F.pmod(key, F.lit(parts)))
    dealt.repartition("shard", "_part").drop("_part").write.partitionBy("shard").parquet(path)
