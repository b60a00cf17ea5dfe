"""Ordered computations over groups that may be far too large for one task.

A plain ``Window.partitionBy(book)`` sends a whole book to one task, and one book may hold a
third of all rows.  Every function here cuts a group into blocks of a bounded range of the
ordering key, solves each block on its own, and carries one small summary row per block across
the group.  The big side is shuffled once, by (group, block); the window over the summaries sees
rows / block_width rows per group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
_B, _C = "__block", "__carry"


def _insert_carry(blocked: DataFrame, carry: DataFrame) -> DataFrame:
    """Add the carry row of every block to its rows, marked by ``__carry``.

    The carry travels as one more row of the block, so the big side needs no join: the window
    shuffle by (group, block) is the only time it moves, and null group keys behave like any other.
    """
    return blocked.withColumn(_C, F.lit(0)).unionByName(carry.withColumn(_C, F.lit(1)), allowMissingColumns=True)


def with_block(df: DataFrame, order: str | Column, width: int = BLOCK) -> DataFrame:
    col = F.col(order) if isinstance(order, str) else order
    return df.withColumn(_B, F.floor(col / F.lit(width)).cast("bigint"))


def number_rows(
    df: DataFrame, keys: Sequence[str], order: str, out: str, width: int = 1 << 16, ties: Sequence[str] = ()
) -> DataFrame:
    """Dense 1-based position within ``keys`` by the numeric column ``order``."""
    blocked = with_block(df, order, width)
    counts = blocked.groupBy(*keys, _B).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, _B, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inner = Window.partitionBy(*keys, _B).orderBy(F.desc(_C), order, *ties)
    frame = inner.rowsBetween(Window.unboundedPreceding, 0)
    weight = F.when(F.col(_C) == 1, F.col("__off")).otherwise(F.lit(1))
    rows = _insert_carry(blocked, offsets).withColumn(out, F.sum(weight).over(frame).cast("bigint"))
    return rows.filter(F.col(_C) == 0).drop(_B, _C, "__off")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    block_on: str | Column | None = None,
    width: int = BLOCK,
    inclusive: bool = False,
) -> DataFrame:
    """Prefix sums of ``sums`` within ``keys``; exclusive of the row itself unless asked otherwise."""
    blocked = with_block(df, block_on if block_on is not None else order[0], width)
    totals = blocked.groupBy(*keys, _B).agg(*[F.sum(c).alias(f"__t_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, _B, *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__c_{o}") for o in sums]
    )
    inner = Window.partitionBy(*keys, _B).orderBy(F.desc(_C), *order)
    frame = inner.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    is_carry = F.col(_C) == 1
    rows = _insert_carry(blocked, carry).withColumns(
        {
            o: F.coalesce(F.sum(F.when(is_carry, F.col(f"__c_{o}")).otherwise(c)).over(frame), F.lit(0)).cast("bigint")
            for o, c in sums.items()
        }
    )
    return rows.filter(~is_carry).drop(_B, _C, *[f"__c_{o}" for o in sums])


def last_seen(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    block_on: str | Column | None = None,
    width: int = BLOCK,
    inclusive: bool = True,
) -> DataFrame:
    """Latest non-null value of each column so far within ``keys`` (forward fill)."""
    return _seen(df, keys, order, values, block_on, width, inclusive, forward=True)


def next_seen(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    block_on: str | Column | None = None,
    width: int = BLOCK,
    inclusive: bool = False,
) -> DataFrame:
    """Nearest later non-null value of each column within ``keys``."""
    return _seen(df, keys, order, values, block_on, width, inclusive, forward=False)


def _seen(df, keys, order, values, block_on, width, inclusive, forward):
    blocked = with_block(df, block_on if block_on is not None else order[0], width)
    position = F.struct(*[F.col(c) for c in order])
    pick = F.max_by if forward else F.min_by
    edge = blocked.groupBy(*keys, _B).agg(
        *[pick(c, F.when(c.isNotNull(), position)).alias(f"__e_{o}") for o, c in values.items()]
    )
    whole = Window.partitionBy(*keys).orderBy(_B)
    if forward:
        beyond = whole.rowsBetween(Window.unboundedPreceding, -1)
        inner = Window.partitionBy(*keys, _B).orderBy(F.desc(_C), *order)
        frame = inner.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        choose = F.last
    else:
        beyond = whole.rowsBetween(1, Window.unboundedFollowing)
        inner = Window.partitionBy(*keys, _B).orderBy(_C, *order)
        frame = inner.rowsBetween(0 if inclusive else 1, Window.unboundedFollowing)
        choose = F.first
    carry = edge.select(
        *keys, _B, *[choose(F.col(f"__e_{o}"), ignorenulls=True).over(beyond).alias(f"__c_{o}") for o in values]
    )
    is_carry = F.col(_C) == 1
    rows = _insert_carry(blocked, carry).withColumns(
        {
            o: choose(F.when(is_carry, F.col(f"__c_{o}")).otherwise(c), ignorenulls=True).over(frame)
            for o, c in values.items()
        }
    )
    return rows.filter(~is_carry).drop(_B, _C, *[f"__c_{o}" for o in values])
