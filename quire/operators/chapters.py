"""Chapters: headings, page ranges, and the character layout of a chapter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import at_or_null
from quire.functions.text import lines_of, strip_blanks
from quire.functions.tokens import WORDS, Tokenizer, count_tokens
from quire.operators.blocked import last_seen, next_seen, running_sum
from quire.session import cut_lineage

# Line forms that count as a heading.
HEADING = r"^(CHAPTER\s+\d+|\d+\.\s+[A-Z]|[A-Z][A-Z\s]{4,}$|\d+\s+[A-Z][a-z]+)"

KEYS = ("book_id",)

# Text is read once: what several stages need again is a narrow table, written out.
Materialize = Callable[[DataFrame], DataFrame]


def first_heading(text: Column) -> Column:
    """First line of a page that looks like a heading, trimmed; null if there is none."""
    lines = F.transform(lines_of(F.coalesce(text, F.lit(""))), strip_blanks)
    return at_or_null(F.filter(lines, lambda x: x.rlike(HEADING)), 1)


def page_facts(pages: DataFrame, materialize: Materialize = cut_lineage, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """Everything chapters and windows need to know about a page, from one pass over its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return materialize(
        pages.select(
            *KEYS,
            "page_num",
            first_heading(text).alias("title"),
            count_tokens(text, tokenizer).cast("bigint").alias("n"),
            (text != "").alias("filled"),
            text.rlike(r"^\S").alias("opens"),
            text.rlike(r"\S\z").alias("closes"),
        )
    )


def segment_chapters(pages: DataFrame, title_from: str = "book_id", materialize: Materialize = cut_lineage) -> DataFrame:
    """Contiguous chapters of every book: title, start_page, end_page, confidence.

    Takes pages with text or the result of :func:`page_facts`.
    """
    if "title" in pages.columns:
        marked = pages
    else:
        marked = materialize(pages.select(*KEYS, "page_num", first_heading(F.col("text")).alias("title")))
    books = marked.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count("title").alias("n_headings"),
        F.min(F.when(F.col("title").isNotNull(), F.col("page_num"))).alias("first_start"),
    )
    books = books.withColumn(
        "confidence",
        F.when(F.col("n_headings") == 0, F.lit(0.5))
        .when(F.col("n_headings") == 1, F.lit(0.3))
        .otherwise(F.least(F.lit(1.0), F.col("n_headings") / F.greatest(F.lit(1), F.floor(F.col("n_pages") / 20)))),
    )
    starts = marked.filter(F.col("title").isNotNull())
    spans = next_seen(starts, KEYS, ["page_num"], {"next_start": F.col("page_num")})
    headed = spans.join(books, list(KEYS)).select(
        *KEYS,
        "title",
        F.col("page_num").alias("start_page"),
        F.coalesce(F.col("next_start") - 1, F.col("n_pages")).alias("end_page"),
        "confidence",
    )
    front = books.filter(F.col("first_start").isNull() | (F.col("first_start") != 1)).select(
        *KEYS,
        F.col(title_from).alias("title"),
        F.lit(1).cast("bigint").alias("start_page"),
        F.coalesce(F.col("first_start") - 1, F.col("n_pages")).alias("end_page"),
        "confidence",
    )
    return headed.unionByName(front)


def chapter_of_pages(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """Narrow table (book, page, chapter_start, chapter_title) of the pages that lie in a chapter.

    Chapters do not overlap, so a page belongs to the latest start at or before it.  The start
    rows meet their page by an equi-join and are carried forward block by block; the range
    condition never multiplies pages with chapters.
    """
    starts = chapters.select(
        *KEYS,
        F.col("start_page").alias("page_num"),
        F.struct(F.col("title"), F.col("start_page"), F.col("end_page")).alias("__chapter"),
    )
    joined = pages.select(*KEYS, "page_num").join(starts, [*KEYS, "page_num"], "left")
    filled = last_seen(joined, KEYS, ["page_num"], {"__here": F.col("__chapter")})
    return filled.filter(F.col("page_num") <= F.col("__here.end_page")).select(
        *KEYS,
        "page_num",
        F.col("__here.title").alias("chapter_title"),
        F.col("__here.start_page").alias("chapter_start"),
    )


def assign_chapter(pages: DataFrame, chapters: DataFrame, materialize: Materialize = cut_lineage) -> DataFrame:
    """Pages with ``chapter_title`` and ``chapter_start``."""
    return pages.join(materialize(chapter_of_pages(pages, chapters)), [*KEYS, "page_num"])


def page_offsets(pages: DataFrame, keys=("book_id", "chapter_start"), materialize: Materialize = cut_lineage) -> DataFrame:
    """Start and end character of every page in its chapter's joined text."""
    sized = pages.select(*keys, "page_num", F.length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint").alias("__len"))
    out = running_sum(materialize(sized), keys, ["page_num"], {"char_start": F.col("__len")})
    return out.withColumn("char_end", F.col("char_start") + F.col("__len")).drop("__len")


def offset_to_page(positions: DataFrame, offsets: DataFrame, keys=("book_id", "chapter_start")) -> DataFrame:
    """Page that holds a character position: the last page starting at or before it.

    As-of join by interleaving both sides on the offset axis and carrying the page forward.
    """
    pages = offsets.select(
        *keys, F.col("char_start").alias("pos"), F.lit(0).alias("__probe"), "page_num", F.lit(None).cast("bigint").alias("offset")
    )
    probes = positions.select(
        *keys, F.col("offset").alias("pos"), F.lit(1).alias("__probe"), F.lit(None).cast("bigint").alias("page_num"), "offset"
    )
    both = pages.unionByName(probes)
    filled = last_seen(both, keys, ["pos", "__probe", "page_num"], {"page": F.col("page_num")}, width=1 << 22)
    return filled.filter("__probe = 1").select(*keys, "offset", "page")
