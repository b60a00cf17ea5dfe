"""Small array helpers used by the text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A plain Python variable would repeat the expression; inside a lambda it would even be
    evaluated again for every array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def count_where(arr: Column, pred: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(arr, pred))


def at_or_null(arr: Column, index: Column | int) -> Column:
    return F.try_element_at(arr, index if isinstance(index, Column) else F.lit(index))


def index_range(n: Column) -> Column:
    """1..n, and an empty array for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def index_where(arr: Column, pred: Callable[[Column, Column], Column]) -> Column:
    """1-based positions of the elements for which ``pred(element, array)`` holds."""
    return let(arr, lambda a: F.filter(index_range(F.size(a)), lambda i: pred(F.element_at(a, i), a)))


def prefix_sums(arr: Column) -> Column:
    """Running sums of an array of numbers by doubling shifts: n log n for an array of n."""
    shifts = F.transform(
        F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(arr), F.lit(2)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int")
    )
    add = lambda acc, s: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - s), F.lit(0)))
    return F.aggregate(shifts, arr, add)


def run_lengths(arr: Column) -> Column:
    """Distinct values of an array with their counts, in linear time after one sort.

    Ends of equal runs in the sorted array give the counts as differences, so nothing is
    searched again and no rows leave the task.
    """

    def from_sorted(s: Column) -> Column:
        ends = F.filter(
            index_range(F.size(s)),
            lambda i: (i == F.size(s)) | (F.try_element_at(s, i + F.lit(1)) != F.element_at(s, i)),
        )
        return let(
            ends,
            lambda e: F.transform(
                e,
                lambda end, j: F.struct(
                    F.element_at(s, end).alias("value"),
                    (end - F.coalesce(F.try_element_at(e, F.nullif(j, F.lit(0))), F.lit(0))).alias("n"),
                ),
            ),
        )

    # sort_array compares in Spark's own code; array_sort would call a comparator expression for each pair.
    return let(F.sort_array(arr), from_sorted)
