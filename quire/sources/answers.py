"""Answer store: permissive reading, packing and keyed upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.session import cut_lineage

ANSWER_SCHEMA = (
    "qid string, module string, chapter string, subject string, answer_text string, versions map<string,int>, "
    "embedding_model string, kb_revision int, total_tokens bigint, latency_seconds double, generated_at string, "
    "retrieval_chunks array<string>, validation string, model string, stale boolean, stale_reasons array<string>, _corrupt_record string"
)
KEY = ["module", "chapter", "qid"]


def read_answers(spark: SparkSession, root: str, packed: bool = False) -> DataFrame:
    """All stored answers, one JSON document per file under module/chapter/qid.json, or ``packed`` by :func:`pack_answers`.

    Unreadable documents stay as rows with ``corrupt_reason``; their keys come from the path.
    """
    permissive = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    if packed:
        stored = spark.read.schema("path string, value string").parquet(root)
        # A document without any value is as unreadable as a file that breaks off.
        filled = F.coalesce(F.nullif(T.strip_blanks(F.col("value")), F.lit("")), F.lit("{"))
        raw = stored.select("path", F.from_json(filled, ANSWER_SCHEMA, permissive).alias("__a")).select("__a.*", F.split("path", "/").alias("__path"))
    else:
        files = spark.read.schema(ANSWER_SCHEMA).options(**permissive).option("multiLine", "true").option("recursiveFileLookup", "true").json(root)
        raw = files.withColumn("__path", F.split(F.col("_metadata.file_path"), "/"))
    path = F.col("__path")
    bad = F.col("_corrupt_record").isNotNull()
    stem = lambda c: F.url_decode(F.regexp_replace(F.regexp_replace(c, r"^[a-z_]+=", ""), r"\.json$", ""))
    # A writer that partitions puts the file below a folder named after the question.
    deep = F.element_at(path, -2).startswith("qid=")
    place = {"qid": (-2, -1), "chapter": (-3, -2), "module": (-4, -3)}
    named = {k: F.when(bad, stem(F.when(deep, F.element_at(path, a)).otherwise(F.element_at(path, b)))).otherwise(F.col(k)) for k, (a, b) in place.items()}
    return raw.withColumns({**named, "corrupt_reason": F.when(bad, F.lit("corrupt_file:json"))}).drop("__path")


def pack_answers(documents: DataFrame, root: str, value: str = "value") -> None:
    """Store answer documents as rows of (path, value) instead of a file each.

    A file per answer costs the driver a listing entry and a commit message for each answer; rows cost it
    nothing.  The path has the form of the file's, so that an unreadable document still names its keys.
    """
    path = F.concat_ws("/", *[F.coalesce(F.url_encode(F.col(k)), F.lit("")) for k in KEY])
    documents.select(F.concat(path, F.lit(".json")).alias("path"), F.col(value).alias("value")).write.mode("overwrite").parquet(root)


def read_answer_store(spark: SparkSession, root: str) -> DataFrame:
    """The store that :func:`write_answers` keeps."""
    return spark.read.parquet(root)


def upsert(current: DataFrame, incoming: DataFrame, version: str) -> DataFrame:
    """Last write wins per (module, chapter, qid), of equal versions the larger content; an aggregate,
    so repeated keys never pile up."""
    rows = current.unionByName(incoming)
    body = F.struct(*rows.columns)
    rank = F.struct(F.col(version), F.xxhash64(F.to_json(body)))
    return rows.groupBy(*KEY).agg(F.max_by(body, rank).alias("__r")).select("__r.*")


def write_answers(spark: SparkSession, incoming: DataFrame, root: str, version: str) -> None:
    """Merge into a Parquet store partitioned by module; only touched modules are rewritten."""
    try:
        stored = spark.read.parquet(root)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        stored = None
    merged = upsert(incoming.limit(0), incoming, version)
    if stored is not None:
        touched = incoming.select("module").distinct()
        current = stored.join(touched, "module", "left_semi").select(*incoming.columns)
        merged = cut_lineage(upsert(current, incoming, version))
    merged.hint("rebalance", "module").write.partitionBy("module").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)
