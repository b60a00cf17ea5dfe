"""Log and job-history tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tail(log: DataFrame, n: int, order: Sequence[str], per: Sequence[str] = ()) -> DataFrame:
    """Last ``n`` records of the log, or of every log named by ``per``."""
    newest = [F.desc(c) for c in order]
    if not per:
        return log.orderBy(*newest).limit(n)
    ranked = log.withColumn("__rn", F.row_number().over(Window.partitionBy(*per).orderBy(*newest)))
    return ranked.filter(F.col("__rn") <= n).drop("__rn")


def search(log: DataFrame, text: str) -> DataFrame:
    """Records whose JSON form contains ``text``."""
    return log.filter(F.contains(F.to_json(F.struct("*")), F.lit(text)))


def latest_status(log: DataFrame, asked: DataFrame | None = None, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Newest status per book; asked books without a record are ``unknown``."""
    newest = log.groupBy("book_id").agg(F.max_by("status", F.struct(*order)).alias("status"))
    if asked is None:
        return newest
    joined = asked.select("book_id").distinct().join(newest, "book_id", "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("unknown")))


def recent_jobs(jobs: DataFrame, n: int, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    return jobs.orderBy(*[F.desc(c) for c in order]).limit(n)
