"""Running a stream to the end of what is available and reading its result as a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forelake import session


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's checkpoint folder; see ``session.shared_folder``."""
    base = spark.sparkContext.getCheckpointDir() or session.shared_folder(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, keys: list[str] | None = None, mode: str = "append", tick: str | None = None, feed: Iterable[Callable[[], None]] = ()) -> DataFrame:
    """Drain ``stream`` into Parquet and return the written table.

    In update mode every micro-batch writes its changed rows; the latest row per
    key is kept. With ``tick`` the stream runs on that interval until it has
    caught up, and one more batch fires due timers. Each step of ``feed`` adds
    input; after it the stream goes on from its checkpoint.
    """
    spark = stream.sparkSession
    out = shared_folder(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        # The folder name carries the batch, so a replayed batch replaces itself.
        batch.write.mode("overwrite").parquet(f"{out}/table/batch_id={batch_id}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(write)
    query = query.trigger(processingTime=tick) if tick else query.trigger(availableNow=True)
    for more in (None, *feed):
        if more:
            more()
        running = query.start()
        if tick:
            running.processAllAvailable()
            running.stop()
        else:
            running.awaitTermination()
    table = spark.read.schema(_with_batch(stream)).parquet(f"{out}/table")
    if mode != "update":
        return table.drop("batch_id")
    rest = [c for c in stream.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), "batch_id").alias("_l")
    return table.groupBy(*keys).agg(latest).select(*keys, "_l.*")


def _with_batch(stream: DataFrame):
    return T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])


def read_event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet file stream with a fixed schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
