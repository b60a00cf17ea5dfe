"""Which rows a chain of successors visits, for chains of any length.

Every row of a group names a later row as its successor; the chain of a group starts at its first row.  Rows are cut into blocks
of consecutive numbers.  Inside a block pointers are doubled in arrays: after k steps every row knows the row
2**k successors on, or where it leaves the block.  Rows at which a block is entered form a much smaller chain;
its pointers are doubled by joins, one for each doubling, and each visited entry learns how many rows were
visited before it.  So no task ever holds more than one block, and a chain of n rows takes log n rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.blocked import BLOCK
from quire.session import cut_lineage

_JUMPS = "array<struct<at:bigint,n:bigint>>"


def _doubled(jumps: Column, visited: Column, base: Column, block: int) -> Column:
    """``struct<jumps, visited>`` after enough doublings for a block.

    A jump is (row it leads to, rows visited on the way); jumps out of the block stay as they are.
    ``visited`` grows from its first row to all rows of its chain inside the block, in order.
    """

    def inside(at: Column) -> Column:
        return (at >= base) & (at < base + block)

    def step(acc: Column, _: Column) -> Column:
        def on(jump: Column) -> Column:
            then = F.get(acc["jumps"], (jump["at"] - base).cast("int"))
            return F.when(inside(jump["at"]), F.struct(then["at"].alias("at"), (jump["n"] + then["n"]).alias("n"))).otherwise(jump)

        ahead = F.transform(acc["visited"], lambda i: F.get(acc["jumps"], (i - base).cast("int"))["at"])
        return F.struct(
            F.transform(acc["jumps"], on).cast(_JUMPS).alias("jumps"),
            F.concat(acc["visited"], F.filter(ahead, inside)).cast("array<bigint>").alias("visited"),
        )

    rounds = F.sequence(F.lit(1), F.lit(max(1, (block - 1).bit_length())))
    start = F.struct(jumps.cast(_JUMPS).alias("jumps"), visited.cast("array<bigint>").alias("visited"))
    return F.aggregate(rounds, start, step)


def visited(edges: DataFrame, key: str = "book_id", block: int = BLOCK, materialize: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """``(key, idx, number)`` of the rows that the chain visits; ``number`` counts them from 1.

    ``edges`` has ``key``, ``idx`` (0, 1, 2 ... within the key, without gaps) and ``nxt``, a larger ``idx`` of the same
    key or null at the end of the chain.
    """
    at = F.floor(F.col("idx") / block).cast("bigint")
    nxt = F.coalesce("nxt", F.lit(-1)).cast("bigint")
    listed = edges.select(key, at.alias("block"), F.struct("idx", nxt.alias("nxt")).alias("e")).groupBy(key, "block").agg(F.array_sort(F.collect_list("e")).alias("e"))
    jumps = F.transform("e", lambda e: F.struct(e["nxt"].alias("at"), F.lit(1).cast("bigint").alias("n")))
    blocks = materialize(listed.select(key, "block", (F.col("block") * block).alias("base"), jumps.alias("jumps")))

    crossing = edges.filter((nxt >= 0) & (F.floor(nxt / block) != at)).select(key, F.floor(nxt / block).cast("bigint").alias("block"), nxt.alias("idx"))
    first = edges.select(key).distinct().select(key, F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("idx"))
    entries = crossing.unionByName(first).groupBy(key, "block").agg(F.collect_set("idx").alias("entries"))
    none = F.array().cast("array<bigint>")
    left = blocks.join(entries, [key, "block"]).withColumn("jumps", _doubled(F.col("jumps"), none, F.col("base"), block)["jumps"])
    leaves = F.transform("entries", lambda i: F.struct(i.alias("idx"), F.get("jumps", (i - F.col("base")).cast("int")).alias("to")))
    hops = materialize(left.select(key, F.explode(leaves).alias("h")).select(key, "h.idx", F.col("h.to.at").alias("at"), F.col("h.to.n").alias("n")))

    seen = hops.filter("idx = 0").select(key, "idx", F.lit(0).cast("bigint").alias("before"))
    ends = lambda df, name: df.select(F.col(key).alias("__key"), F.col("idx").alias("__idx"), *[F.col(c).alias(f"{name}_{c}") for c in ("at", "n")])
    jump = hops
    while not jump.filter("at >= 0").isEmpty():
        met = (F.col(key) == F.col("__key")) & (F.col("idx") == F.col("__idx"))
        ahead = seen.join(ends(jump, "j"), met).filter("j_at >= 0").select(key, F.col("j_at").alias("idx"), (F.col("before") + F.col("j_n")).alias("before"))
        seen = materialize(seen.unionByName(ahead))
        then = (F.col(key) == F.col("__key")) & (F.col("at") == F.col("__idx"))
        twice = jump.join(ends(jump, "j"), then, "left")
        jump = materialize(twice.select(key, "idx", F.coalesce("j_at", F.lit(-1)).alias("at"), (F.col("n") + F.coalesce("j_n", F.lit(0))).alias("n")))

    inside = blocks.join(seen.withColumn("block", F.floor(F.col("idx") / block).cast("bigint")), [key, "block"])
    chain = _doubled(F.col("jumps"), F.array("idx"), F.col("base"), block)["visited"]
    return inside.select(key, "before", F.posexplode(chain).alias("__i", "idx")).select(key, "idx", (F.col("before") + F.col("__i") + 1).alias("number"))
