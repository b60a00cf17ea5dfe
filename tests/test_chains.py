"""Chains of successors, batches of pages and page ranges next to plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators.books import page_ranges
from quire.operators.chains import visited
from quire.operators.packing import pack_pages


@pytest.mark.parametrize("block", [4, 4096])
def test_chain(spark, block):
    rng = random.Random(block)
    rows, want = [], set()
    for book in range(8):
        n = rng.choice((1, 2, 5, 40, 300))
        nxt = [k + rng.choice((1, 1, 2, 3, 9, 50)) for k in range(n)]
        rows += [(f"b{book}", k, m if m < n else None) for k, m in enumerate(nxt)]
        at, number = 0, 0
        while at < n:
            number += 1
            want.add((f"b{book}", at, number))
            at = nxt[at]
    edges = spark.createDataFrame(rows, "book_id string, idx long, nxt long")
    assert {tuple(r) for r in visited(edges, block=block).collect()} == want
    assert visited(edges.limit(0)).count() == 0


def ranges_of(pages, gap, span):
    out = []
    for p in sorted(set(pages)):
        if out and p - out[-1][1] <= gap + 1 and p - out[-1][0] < span:
            out[-1][1] = p
        else:
            out.append([p, p])
    return {tuple(r) for r in out}


@pytest.mark.parametrize("gap, span, block", [(1, 28, 4096), (2, 5, 8)])
def test_ranges(spark, gap, span, block):
    rng = random.Random(span)
    picked = {"a": [p for p in range(1, 400) if rng.random() < 0.7], "b": [5], "c": list(range(1, 200)) * 2, "d": [1, 100, 101, 5000]}
    df = spark.createDataFrame([(b, p) for b, pages in picked.items() for p in pages], "book_id string, page_num int")
    got = {(r.book_id, r.start_page, r.end_page) for r in page_ranges(df, gap, span, block).collect()}
    assert got == {(b, lo, hi) for b, pages in picked.items() for lo, hi in ranges_of(pages, gap, span)}


def test_one_book_of_very_many_pages(spark):
    """No task gets the whole book: 40,000 pages are 10 blocks."""
    n = 40_000
    pages = spark.range(1, n + 1).select(F.lit("b").alias("book_id"), F.col("id").cast("int").alias("page_num"), F.repeat(F.lit("x"), F.pmod(F.xxhash64("id"), F.lit(50)).cast("int")).alias("text"))
    size = [r.s + 2 for r in pages.orderBy("page_num").select(F.length("text").alias("s")).collect()]
    batch, used, want = 0, None, []
    for s in size:
        if used is None or used + s > 400:
            batch, used = batch + 1, 0
        used += s
        want.append(batch)
    got = [r.batch_no for r in pack_pages(pages, 400).orderBy("page_num").collect()]
    assert got == want
    chosen = pages.filter(F.pmod(F.xxhash64("page_num", F.lit(7)), F.lit(10)) < 8)
    own = [r.page_num for r in chosen.select("page_num").collect()]
    assert {(r.start_page, r.end_page) for r in page_ranges(chosen).collect()} == ranges_of(own, 1, 28)
