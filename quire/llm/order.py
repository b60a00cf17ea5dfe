"""Positions in a sorted order, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.tables import keep, parts


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], position: str = "idx", total: str = "n") -> DataFrame:
    """Adds ``position`` (from 0) of each row in its group and ``total``, the group's number of rows.

    Rows are dealt by ranges of (group, order), so a group of any size is spread over tasks; what is summed
    over a group is one row per task.  Null groups are a group, sorted first.  Rows alike in ``order`` are
    numbered in any order: end it with a column that tells them apart.
    """
    keys = [*[F.col(c).asc_nulls_first() for c in group], *order]
    ranged = df.repartitionByRange(parts(df.sparkSession), *keys).sortWithinPartitions(*keys)
    kept = keep(ranged.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    kept = kept.withColumn("__task", F.shiftright("__at", 33))
    runs = kept.groupBy(*group, "__task").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    whole = Window.partitionBy(*group)
    before = F.sum("__rows").over(whole.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(
        *[F.col(c).alias(f"__{c}") for c in group],
        F.col("__task").alias("__of"),
        (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__rows").over(whole).alias(total),
    )
    same = F.col("__task") == F.col("__of")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = kept.join(runs, same).withColumn(position, F.col("__at") + F.col("__shift"))
    return out.drop("__at", "__task", "__of", "__shift", *[f"__{c}" for c in group])
