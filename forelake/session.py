"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table that one task reads; a table is read by two tasks at least, so that its groups are always dealt out.
ROWS_A_TASK = 20_000
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def build_session(app_name: str = "forelake", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution and a UTC clock.

    Naive fixed-offset clocks are kept as ``TIMESTAMP_NTZ``; the session zone
    must not observe daylight saving, otherwise NTZ <-> TIMESTAMP casts shift.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; see ``stage``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def small_batches(spark: SparkSession) -> None:
    """Has Spark hand rows to Python workers in Arrow batches of a few megabytes, unless the session sets a size.

    By default a batch is 10,000 rows or 64 MB. A worker and its task hold several copies
    of one, beside the heap, so whole texts take hundreds of megabytes of an executor.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def stage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder (runs a job).

    The folder comes from ``spark.checkpoint.dir``. A session that runs in one
    process (``local[n]``) may go without the setting and gets a temporary folder;
    any other master must name a folder that driver and executors share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stage_rows(df: DataFrame) -> DataFrame:
    """``stage`` for narrow rows that are read again and again: as many tasks read them as their number needs.

    Written files are as many as the shuffle's partitions, however few the rows are. The
    rows are counted while they are written. Groups still meet in all partitions of later shuffles.
    """
    seen = Observation()
    staged = stage(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return staged.coalesce(max(2, -(-seen.get["rows"] // ROWS_A_TASK)))
