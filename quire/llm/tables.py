"""Tables that several stages read again, kept in the cluster's shared folder.

They stay until ``release`` is called, as results are read lazily: call it when all results are written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None
#: Path and, where there is one, catalogue name of all that is kept.
_written: list[tuple[str, str | None]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a private folder, but only in local mode."""
    global _own_folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_folder


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: stages after it don't compute it again, and a
    lost executor costs only the tasks it ran.  Unlike ``checkpoint()`` this runs the plan once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((path, None))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_by(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """As :func:`keep`, dealt into ``n`` buckets by ``key``: later joins on ``key`` move the other side only."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_folder(spark)}/{table}"
    _written.append((path, table))
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(table)
    return spark.table(table)


def kept() -> int:
    """How many tables are kept now."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, last: int = 0) -> None:
    """Delete the tables kept after the first ``since``, but for the ``last`` ones; results that are read from them
    and not yet written can't be read after this."""
    end = max(since, len(_written) - last)
    gone, _written[since:end] = _written[since:end], []
    for path, table in gone:
        if table:
            spark.sql(f"drop table if exists {table}")
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def parts(spark: SparkSession) -> int:
    """Number of partitions for an explicit exchange."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
