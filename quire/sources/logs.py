"""JSON-lines logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per non-blank line; a line that is no JSON object of the schema is kept in ``raw`` too."""
    lines = spark.read.text(path).withColumn("line", F.regexp_replace("value", r"^\s+|\s+$", "")).filter(F.col("line") != "")
    parsed = lines.withColumn("rec", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    fits = F.col("line").startswith("{") & F.col("rec").isNotNull() & F.col("rec._bad").isNull()
    return parsed.select("rec.*", F.when(~fits, F.col("line")).alias("raw")).drop("_bad")
