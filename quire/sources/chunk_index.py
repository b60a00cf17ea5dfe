"""Chunk index: embedded chunks in folders by subject and, within it, by a hash bucket of the book.

A book lies in one bucket, so adding or deleting books reads and writes the buckets of those books and
leaves the files of all others as they are.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import cut_lineage, remove_folder


#: Buckets of a subject.  Part of the stored layout: an index is read and changed with the number it was written with.
BUCKETS = 64
_FOLDERS = ["subject", "bucket"]


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(F.col("book_id").cast("string")), F.lit(BUCKETS)).cast("int"))


def _touched(stored: DataFrame, books: DataFrame) -> DataFrame:
    """The stored rows of the buckets of some books; other folders are pruned from the scan."""
    return stored.join(F.broadcast(books) if _few(books) else books, _FOLDERS, "left_semi")


def _few(folders: DataFrame, most: int = 100_000) -> bool:
    """Whether a list of folders is short enough to be sent to all tasks."""
    return folders.limit(most + 1).count() <= most


def merge_metadata(chunks: DataFrame, metadata: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Metadata columns next to the base columns; a base column wins over one of the same name."""
    extra = [c for c in metadata.columns if c == key or c not in chunks.columns]
    return chunks.join(metadata.select(*extra), key, "left")


def write_chunk_index(chunks: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Replace the folders (subject and bucket) present in ``chunks``; readers prune by subject.

    Rows are dealt by folder first, large ones over several tasks, so a folder gets few files.  New files are staged and
    moved when all of them are written.
    """
    dealt = _bucketed(chunks).hint("rebalance", *_FOLDERS)
    dealt.write.partitionBy(*_FOLDERS).mode(mode).option("partitionOverwriteMode", "dynamic").parquet(root)


def stored_index(spark: SparkSession, root: str) -> DataFrame | None:
    """All stored rows with their bucket; None where nothing is stored."""
    try:
        return spark.read.parquet(root)
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def add_chunks(spark: SparkSession, chunks: DataFrame, root: str) -> None:
    """Add chunks to a stored index, next to the books it has; chunks that it has already are left alone.

    The key is the id, with ``chunk_seq`` where both have it.  Keys are only read in the buckets of the books that are
    added.
    """
    stored = stored_index(spark, root)
    if stored is not None:
        folders = cut_lineage(_bucketed(chunks).select(*_FOLDERS).distinct())
        key = [c for c in ("subject", "chunk_id", "chunk_seq") if c in chunks.columns and c in stored.columns]
        known = _touched(stored.select(*{*_FOLDERS, *key}), folders).select(*key)
        chunks = cut_lineage(chunks.join(known, key, "left_anti"))
    write_chunk_index(chunks, root, "append")


def read_chunk_index(spark: SparkSession, root: str, subject: str | None = None) -> DataFrame:
    stored = spark.read.parquet(root).drop("bucket")
    return stored if subject is None else stored.filter(F.col("subject") == subject)


def delete_book_chunks(chunks: DataFrame, doomed: DataFrame) -> DataFrame:
    """Chunks without those of the named (subject, book_id) pairs."""
    return chunks.join(doomed.select("subject", "book_id").distinct(), ["subject", "book_id"], "left_anti")


def rewrite_without_books(spark: SparkSession, root: str, doomed: DataFrame) -> None:
    """Delete books in a stored index; only their buckets are read and rewritten, emptied ones removed."""
    folders = cut_lineage(_bucketed(doomed).select(*_FOLDERS).distinct())
    touched = _touched(spark.read.parquet(root), folders)
    left = cut_lineage(delete_book_chunks(touched, doomed))
    # A folder that loses its last book: one short row each, gone through one by one.
    emptied = folders.join(left.select(*_FOLDERS).distinct(), _FOLDERS, "left_anti")
    write_chunk_index(left.drop("bucket"), root)
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for r in emptied.toLocalIterator():
        remove_folder(spark, f"{root}/{escape.getPartitionPathString('subject', r.subject)}/bucket={r.bucket}")


def count_book_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("subject", "book_id").agg(F.count(F.lit(1)).alias("chunks"))
