"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalforms.session import work_dir

BLOCK_BYTES = 1_500_000  # text handled at once inside a task; bounds memory, never results
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared work folder and read again.

    Cuts the lineage, so a lost executor costs a re-read and no recomputation,
    and fixes values that must not change between two reads.  The shuffle files
    of the write go when it ends; nothing reads them again.
    """
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the folders of staged tables.  Whatever was made from them must be staged itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def utf8_size(column: str = "text"):
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def n_words(column: str = "text"):
    """Words of a text as an expression without an array of them."""
    text = F.concat(F.lit(" "), F.coalesce(F.translate(F.col(column), "\t\n\x0b\f\r", "     "), F.lit("")))
    return F.regexp_count(text, F.lit(r" [^ ]")).cast("long")


def thinned(rows: DataFrame, sample: int, *keys: str) -> DataFrame:
    """About 1.3 * sample rows (all, if fewer), chosen by the hash of ``keys``, so that
    a following ``limit(sample)`` moves little from each of many partitions."""
    share = min(1.0, 1.3 * sample / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))


def in_blocks(batches: Iterator[pa.RecordBatch],
              work: Callable[[pa.RecordBatch, list[bytes]], Iterator[pa.RecordBatch] | pa.RecordBatch],
              column: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches to about ``size`` bytes of text and hand on (rows, texts as bytes)."""
    for batch in batches:
        column_of = batch.column(batch.schema.get_field_index(column))
        start, total, texts = 0, 0, []
        for i, text in enumerate(column_of):
            texts.append((text.as_py() or "").encode())
            total += len(texts[-1])
            if total >= size or i == len(column_of) - 1:
                yield work(batch.slice(start, i + 1 - start), texts)
                start, total, texts = i + 1, 0, []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        both = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with h[e] - h[s] = base^s * (hash of data[s:e]) modulo 2^64."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values()[data] * powers(len(data))[0], out=h[1:], dtype=np.uint64)
    return h


def range_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((h[ends] - h[starts]) * powers(len(h))[1][starts] + (ends - starts).astype(np.uint64))
