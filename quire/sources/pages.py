"""Page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.blocked import number_rows

PAGE_SCHEMA = "book_id string, subject string, order_key bigint, method string, text string"


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Pages of a folder in the stated format; text formats need the schema, nothing is inferred."""
    reader = spark.read.format(fmt)
    if fmt != "parquet":
        reader = reader.schema(schema or PAGE_SCHEMA)
    return reader.load(path)


def page_table(pages: DataFrame, order: str, keys: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """Numbered pages: 1, 2, ... per book in document order; null text is empty."""
    filled = pages.withColumn("text", F.coalesce("text", F.lit("")))
    numbered = number_rows(filled, list(keys), order, "page_num")
    return numbered.withColumn("char_count", F.length("text").cast("bigint"))
