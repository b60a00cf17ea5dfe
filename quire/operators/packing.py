"""Greedy packing of consecutive pages into batches of a limited size.

Greedy packing looks sequential: where a batch starts depends on all batches before.  But which page would
start the next batch depends only on text lengths, so every page first learns its successor; the
starts that occur are then the rows visited by the chain of successors (see ``chains``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.blocked import BLOCK, last_seen, next_seen, running_sum
from quire.operators.chains import visited
from quire.session import cut_lineage


def pack_pages(
    pages: DataFrame,
    max_chars: int = 9000,
    block: int = BLOCK,
    materialize: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """``(book_id, page_num, batch_no)``: a page counts its length plus two; a longer page is alone."""
    sized = pages.select("book_id", "page_num", (F.length(F.coalesce("text", F.lit(""))) + 2).cast("bigint").alias("size"))
    sums = {"begin": F.col("size"), "idx": F.lit(1)}
    placed = materialize(running_sum(sized, ["book_id"], ["page_num"], sums, width=block))
    none = F.lit(None).cast("bigint")
    ends = placed.select("book_id", (F.col("begin") + F.col("size")).alias("pos"), F.lit(0).alias("probe"), F.col("idx").alias("ending"), none.alias("idx"))
    limits = placed.select("book_id", (F.col("begin") + max_chars).alias("pos"), F.lit(1).alias("probe"), none.alias("ending"), "idx")
    # First page that ends beyond the limit of a batch begun here, but at least the next page.
    seen = next_seen(ends.unionByName(limits), ["book_id"], ["pos", "probe"], {"over": F.col("ending")}, width=max_chars * 512)
    total = placed.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    nxt = F.when(F.col("over").isNotNull(), F.greatest(F.col("over"), F.col("idx") + 1))
    edges = seen.filter("probe = 1").join(total, "book_id").select("book_id", "idx", F.when(nxt < F.col("n"), nxt).alias("nxt"))
    starts = visited(materialize(edges), "book_id", block, materialize).withColumnRenamed("number", "batch")
    joined = placed.select("book_id", "page_num", "idx").join(starts, ["book_id", "idx"], "left")
    filled = last_seen(joined, ["book_id"], ["page_num"], {"batch_no": F.col("batch")}, width=block)
    return filled.select("book_id", "page_num", "batch_no")
