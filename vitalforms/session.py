"""Session set-up and the shared work folder."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "vitalforms", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is tuned for.

    Shuffle partition counts are left to the cluster (AQE coalesces them);
    pass ``conf`` entries to override, with ``__`` standing for a dot.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULTS)
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal dimension as a local relation.

    Unlike a table made from a Python list its size is known to the planner,
    so a join with it is planned as a broadcast of this side.
    """
    fields = T.StructType.fromDDL(schema)
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    columns = {f.name: pa.array([r[i] for r in rows], arrow[f.dataType.simpleString()])
               for i, f in enumerate(fields)}
    return spark.createDataFrame(pa.table(columns))


_DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside gives back its shuffle files when it is done, instead of when the driver collects garbage.

    For a job of many steps, of which each reads what the last one wrote.
    """
    before = spark.conf.get(_DROPPED, None)
    spark.conf.set(_DROPPED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROPPED)
        else:
            spark.conf.set(_DROPPED, before)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables of one's own; nothing happens where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for checkpoints and intermediate tables.

    The cluster names a shared folder in ``spark.checkpoint.dir``; every job
    gets its own child of it.  Where it is unset the folder lies in the
    warehouse; one on a machine's own disk is refused on a cluster, because
    executors do not see it.
    """
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        local = spark.sparkContext.master.split("[")[0] == "local"
        if not local and root.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
