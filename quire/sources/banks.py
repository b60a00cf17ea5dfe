"""Question banks: JSON documents per subject and module, and their partitioned question table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = (
    "struct<qid:string,type:string,question_text:string,options:map<string,string>,answer:string,"
    "module_chapter:string,page_num:bigint,marks:int,section:string>"
)
BANK_SCHEMA = (
    f"questions array<{QUESTION}>, "
    "metadata struct<module_name:string,subject:string,title:string,format:string,total_pages:bigint,questions_extracted:bigint,extracted_at:string>, "
    "_corrupt_record string"
)


def read_banks(spark: SparkSession, root: str, subject: str | None = None) -> DataFrame:
    """One row per readable bank document; subject and module come from the folder names."""
    raw = (
        spark.read.schema(BANK_SCHEMA)
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(root)
    )
    folder = lambda i: F.regexp_replace(F.element_at(F.split("__path", "/"), i), r"^[a-z_]+=", "")
    placed = raw.withColumn("__path", F.col("_metadata.file_path")).withColumns({"subject": folder(-3), "module": folder(-2)})
    readable = placed.filter(F.col("_corrupt_record").isNull() & F.col("questions").isNotNull())
    if subject is not None:
        readable = readable.filter(F.col("subject") == subject)
    return readable.drop("__path", "_corrupt_record")


def read_question_banks(spark: SparkSession, root: str, subject: str | None = None) -> DataFrame:
    """One row per question of every readable bank."""
    banks = read_banks(spark, root, subject)
    return banks.select("subject", "module", F.explode("questions").alias("q")).select("subject", "module", "q.*")


def write_question_bank(questions: DataFrame, root: str) -> None:
    """Replace exactly the (subject, module) banks present in ``questions``."""
    (
        questions.hint("rebalance", "subject", "module").write.partitionBy("subject", "module")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(root)
    )


def read_bank_store(spark: SparkSession, root: str, subject: str | None = None) -> DataFrame:
    """The questions that :func:`write_question_bank` keeps."""
    stored = spark.read.parquet(root)
    return stored if subject is None else stored.filter(F.col("subject") == subject)


def list_banks(modules: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row per bank name; a module bank replaces a data set of the same name.

    Both inputs are question tables (name, subject, format, extracted_at); counting happens before
    the merge, so only one row per bank is shuffled further.
    """

    def counted(df: DataFrame, priority: int) -> DataFrame:
        return df.groupBy("name", "subject").agg(
            F.count(F.lit(1)).alias("questions"),
            F.max("format").alias("format"),
            F.max("extracted_at").alias("extracted_at"),
        ).withColumn("priority", F.lit(priority))

    both = counted(modules, 0).unionByName(counted(datasets, 1))
    row = F.struct("subject", "questions", "format", "extracted_at", "priority")
    best = both.groupBy("name").agg(F.min_by(row, F.struct("priority", "subject")).alias("b"))
    listed = best.select("name", "b.*")
    return listed.withColumn("origin", F.when(F.col("priority") == 0, "module").otherwise("dataset")).drop("priority").orderBy("subject", "name")
