"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations alone.

Every scan partition is a run: one row per digest with the best row so far and a count.  Runs are
merged in rounds; in round r the runs whose numbers agree but for the lowest r * ``bits`` bits form one
new run, partitioned and sorted by digest, so a round is a multiway merge spread over all tasks and a
text with very many copies costs each task one row per incoming run.  Then the winners travel the same
tree downwards: each level joins at most 2**bits rows per key, and only the last step, inside one
run, touches single documents.  No step gathers the copies of a text in one place.

Rows are equal when the SHA-256 *and* the 64-bit hash and length of their normalised texts are equal;
all three are the key of every merge, so an identifier is never kept on one digest's word alone.

Defined results: null text counts as empty; texts that are empty after normalisation are equal to each
other; a null id loses against any other; of rows alike in length and id the first read stays, so
repeated rows leave one.  Every input row yields one output row; other columns are ignored or, with
``unique``, returned as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import keep

BLANKS = (" ", "\n", "\t", "\r", "\x0b", "\x0c")
KEY = ("digest", "check", "size")


def normalised(text: Column) -> Column:
    """Text without blank, tab, line feed, vertical tab, form feed and carriage return."""
    text = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def digests(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Narrow facts of each row: run, position, identifier, rank and key."""
    plain = df.select(
        F.col(doc_id).alias("id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("points"),
        normalised(F.col(text)).alias("norm"),
        F.monotonically_increasing_id().alias("at"),
    )
    return plain.select(
        "id",
        "at",
        F.spark_partition_id().alias("run"),
        # Ordered so that the smallest is the row that stays.
        F.struct(-F.col("points"), F.col("id").isNull(), F.col("id"), F.col("at")).alias("best"),
        F.unhex(F.sha2(F.encode("norm", "utf-8"), 256)).alias("digest"),
        F.xxhash64("norm").alias("check"),
        F.octet_length("norm").alias("size"),
    )


def merged(runs: DataFrame, run: Column, n: Column) -> DataFrame:
    """One round: runs that now share a number become one, the smallest of each digest staying."""
    return (
        runs.select(run.alias("run"), *KEY, "best", n.alias("n"))
        .groupBy("run", *KEY)
        .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    )


def groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = 4) -> DataFrame:
    """One row per input row: id, at, digest, keep_id, group_size, kept (see module)."""
    facts = keep(digests(df, text, doc_id), "digests")
    last = facts.agg(F.max("run")).first()[0] or 0
    levels = [merged(facts, F.col("run"), F.lit(1))]
    shift = 0
    while last >> shift:
        levels.append(keep(merged(levels[-1], F.shiftright("run", bits), F.col("n")), "run"))
        shift += bits
    winners = levels.pop().select("run", *KEY, F.col("best").alias("keep"), F.col("n").alias("group_size"))
    up = F.shiftright(F.col("run"), bits)
    while levels:
        # A node of the tree meets the winner of the node above: at most 2**bits rows per key.
        below = levels.pop().select("run", *KEY, up.alias("above"))
        above = winners.select(F.col("run").alias("above"), *KEY, "keep", "group_size")
        winners = below.join(above, ["above", *KEY]).drop("above")
    out = facts.join(winners, ["run", *KEY])
    return out.select(
        "id",
        "at",
        "digest",
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("at") == F.col("keep.at")).alias("kept"),
    )


def report(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The row of each document: doc_id, keep_id, group_size, kept, text_sha256."""
    return groups(df, text, doc_id).select(
        F.col("id").alias(doc_id), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def unique(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns; of rows that share id and text one stays.

    Only the (few) decided ids and digests meet the rows again, not their places in a scan, so the input
    may be any plan.
    """
    found = groups(df, text, doc_id).groupBy("id", "digest").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    decided = keep(found.where("not stays or n > 1"), "decided")
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.col(doc_id).alias("own"),
        F.unhex(F.sha2(F.encode(normalised(F.col(text)), "utf-8"), 256)).alias("mark"),
        F.struct(F.length(text), F.col(text)).alias("size"),
    )
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("digest"))
    out = rows.join(decided.hint("shuffle_hash"), same, "left_anti").select("row")
    again = decided.where("stays")
    if not again.isEmpty():
        twice = rows.join(again.hint("shuffle_hash"), same, "left_semi").groupBy("own", "mark").agg(F.max_by("row", "size").alias("row"))
        out = out.unionByName(twice.select("row"))
    return out.select("row.*")
