"""Evaluation suites by version, and stored benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUITE_SCHEMA = "module string, qid string, subject string, marks int, section string, difficulty string, topic string, notes string"
RUN_SCHEMA = (
    "run_id string, n_records bigint, n_success bigint, n_failure bigint, cache_hit_rate double, total_tokens bigint, "
    "avg_total_latency_seconds double"
)


def read_eval_suites(spark: SparkSession, root: str) -> DataFrame:
    """The ``questions`` of all suite documents; the version is the ``vN`` of the ``vN.json`` file or folder."""
    document = f"questions array<struct<{SUITE_SCHEMA.replace(' ', ':').replace(',:', ',')}>>, _corrupt_record string"
    raw = spark.read.schema(document).option("multiLine", "true").option("recursiveFileLookup", "true").json(root)
    named = raw.withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), r"/(v\d+)\.json(?:/|$)", 1))
    return named.select(F.explode("questions").alias("q"), "version").select("q.*", "version")


def suite_versions(spark: SparkSession, root: str) -> DataFrame:
    return read_eval_suites(spark, root).select("version").distinct().orderBy("version")


def read_eval_suite(spark: SparkSession, root: str, version: str) -> DataFrame:
    """Rows of one version; an unknown version is an error."""
    suite = read_eval_suites(spark, root).filter(F.col("version") == version)
    if suite.isEmpty():
        known = [r.version for r in suite_versions(spark, root).limit(100).collect()]
        raise ValueError(f"unknown suite version {version!r}; known: {known}")
    return suite


def run_name(ts) -> "F.Column":
    """Compact UTC time stamp used as the name of a run."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def write_benchmark_run(records: DataFrame, summary: DataFrame, root: str, run_id: str) -> None:
    """Records and their summary of one run, as JSON next to each other; the records are compressed, as names repeat in each."""
    records.write.mode("overwrite").option("compression", "gzip").json(f"{root}/{run_id}/records")
    summary.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").json(f"{root}/{run_id}/summary")


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """Summaries of all stored runs, sorted by id."""
    return spark.read.schema(RUN_SCHEMA).json(f"{root}/*/summary").orderBy("run_id")


def get_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return list_runs(spark, root).filter(F.col("run_id") == run_id)
