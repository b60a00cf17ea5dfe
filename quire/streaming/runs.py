"""Starting and draining streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on executor disks instead of in memory: needed for large key sets and for timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def open_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = 1, fmt: str = "parquet") -> DataFrame:
    """Files of a folder as they arrive; without ``files_per_trigger`` all new ones make one batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def drain(
    stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append", timeout: int | None = None
) -> None:
    """Process everything available, batch by batch, and stop; ``timeout`` seconds at most if given."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(handle)
        .start()
    )
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("stream did not drain in time")


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Write every micro-batch to its own folder; a repeated batch replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def latest_per_key(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Result of an update-mode stream written by :func:`batch_sink`: newest batch per key."""
    stored = spark.read.parquet(path)
    body = F.struct(*[c for c in stored.columns if c not in keys])
    return stored.groupBy(*keys).agg(F.max_by(body, "batch").alias("__r")).select(*keys, "__r.*").drop("batch")
