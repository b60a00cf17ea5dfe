"""Book manifest: a catalogue with soft deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest_upsert(manifest: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest with the accepted books, and the rejected ones.

    A book is rejected when an active record has the same content hash, or when an earlier row of
    the same delivery has it; archived duplicates are welcome.
    """
    active = manifest.filter(F.col("archived_at").isNull()).select("sha256").distinct()
    firsts = new.groupBy("sha256").agg(F.min("book_id").alias("__first"))
    judged = (
        new.join(firsts, "sha256")
        .join(active.withColumn("__known", F.lit(True)), "sha256", "left")
        .withColumn("__bad", F.coalesce("__known", F.lit(False)) | (F.col("book_id") != F.col("__first")))
    )
    accepted = judged.filter(~F.col("__bad")).select(*new.columns)
    rejected = judged.filter("__bad").select(*new.columns)
    return manifest.unionByName(accepted, allowMissingColumns=True), rejected


def manifest_archive(manifest: DataFrame, shas: DataFrame, at: Column) -> DataFrame:
    """Mark active records of the named hashes as archived; earlier archive times stay."""
    named = shas.select("sha256").distinct().withColumn("__hit", F.lit(True))
    joined = manifest.join(named, "sha256", "left")
    stamp = F.when(F.col("__hit") & F.col("archived_at").isNull(), at).otherwise(F.col("archived_at"))
    return joined.withColumn("archived_at", stamp).drop("__hit")
