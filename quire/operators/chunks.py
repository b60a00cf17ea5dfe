"""Overlapping token windows over chapters, chunk ids and chunk metadata."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import lexicon as L
from quire.functions import tokens as K
from quire.operators.blocked import last_seen, running_sum
from quire.session import cut_lineage

CHAPTER_KEYS = ("book_id", "chapter_start")


def chunk_windows(
    pages: DataFrame,
    size: int = 1000,
    overlap: int = 200,
    keys: Sequence[str] = CHAPTER_KEYS,
    chapters: DataFrame | None = None,
    facts: DataFrame | None = None,
    glue_pages: bool = True,
    materialize: Callable[[DataFrame], DataFrame] = cut_lineage,
    tokenizer: K.Tokenizer = K.WORDS,
) -> DataFrame:
    """Windows of ``size`` tokens, ``overlap`` shared with the window before, within each chapter.

    A chapter is never put together in one place.  Token counts per page give every page its token
    range in the chapter; each page then contributes slices to the windows it touches, and a
    window gathers at most ``size`` tokens.  With ``glue_pages`` the pages follow each other
    without a separator, so a word cut by a page break is one token.

    ``chapters`` is the narrow result of ``chapter_of_pages`` and ``facts`` that of ``page_facts``;
    without them the pages carry the chapter keys themselves.  Page text is joined once, at the end.

    ``tokenizer`` says what a token is; ``facts`` have to come from the same one.  ``chunk_seq`` tells windows
    apart whose ids are equal (same pages, same beginning): id and sequence together are the key of a chunk.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must satisfy 0 <= overlap < size")
    step = size - overlap
    keys = list(keys)
    text = F.coalesce(F.col("text"), F.lit(""))
    at = ["book_id", "page_num"] if chapters is not None else [*keys, "page_num"]

    # Narrow per-page facts; read by several stages, so written once.
    if facts is None:
        facts = pages.select(
            *at,
            K.count_tokens(text, tokenizer).cast("bigint").alias("n"),
            (text != "").alias("filled"),
            text.rlike(r"^\S").alias("opens"),
            text.rlike(r"\S\z").alias("closes"),
        )
    stats = facts.filter("filled")
    if chapters is not None:
        stats = stats.drop("title").join(chapters, at)
    named = [c for c in ("chapter_title",) if chapters is not None]
    stats = last_seen(stats, keys, ["page_num"], {"before": F.col("closes")}, inclusive=False)
    joins = F.coalesce(F.col("before") & F.col("opens"), F.lit(False)) if glue_pages and tokenizer.glues else F.lit(False)
    stats = materialize(stats.select(*keys, "page_num", *named, "n", joins.cast("int").alias("cont")))
    fresh = F.col("n") - F.col("cont")
    placed = running_sum(stats, keys, ["page_num"], {"upto": fresh})
    totals = stats.groupBy(*keys).agg(F.sum(fresh).alias("total")).filter("total > 0")
    last_window = F.when(F.col("total") <= size, F.lit(0)).otherwise(
        F.ceil((F.col("total") - overlap) / F.lit(step)) - 1
    ).cast("bigint")
    ranges = placed.join(totals.select(*keys, last_window.alias("w_max")), keys).filter("n > 0")
    ranges = ranges.withColumn("first", F.col("upto") - F.col("cont")).withColumn("last", F.col("first") + F.col("n") - 1)
    lo = F.greatest(F.lit(0), F.ceil((F.col("first") - size + 1) / F.lit(step))).cast("bigint")
    hi = F.least(F.col("w_max"), F.floor(F.col("last") / F.lit(step))).cast("bigint")
    ranges = ranges.withColumns({"w_lo": lo, "w_hi": hi}).filter("w_lo <= w_hi")

    side = ranges.select(*keys, "page_num", *named, "first", "last", "cont", "w_lo", "w_hi")
    carried = [c for c in ("subject", "chapter_title") if c in pages.columns or c in named]
    own = [c for c in (*at, "subject", "chapter_title", "text") if c in pages.columns and c not in named]
    slices = (
        pages.select(*own)
        .join(side, at)
        .withColumn("__tokens", tokenizer.split(text))
        .withColumn("window_no", F.explode(F.sequence("w_lo", "w_hi")))
    )
    begin = F.greatest(F.col("first"), F.col("window_no") * step)
    end = F.least(F.col("last"), F.col("window_no") * step + size - 1)
    piece = F.slice("__tokens", (begin - F.col("first") + 1).cast("int"), (end - begin + 1).cast("int"))
    slices = slices.select(
        *keys,
        "window_no",
        *carried,
        F.struct(
            "page_num",
            F.array_join(piece, tokenizer.joiner).alias("piece"),
            ((F.col("cont") == 1) & (begin == F.col("first"))).alias("glued"),
        ).alias("__s"),
        (end + 1).alias("__end"),
    )
    windows = slices.groupBy(*keys, "window_no").agg(
        *[F.first(c).alias(c) for c in carried],
        F.array_sort(F.collect_list("__s")).alias("__parts"),
        F.min("__s.page_num").alias("page_start"),
        F.max("__s.page_num").alias("page_end"),
        (F.max("__end") - F.col("window_no") * step).alias("token_count"),
    )
    joined = F.aggregate(
        "__parts",
        F.lit(""),
        lambda acc, p: F.concat(acc, F.when((acc == "") | p["glued"], F.lit("")).otherwise(F.lit(tokenizer.joiner)), p["piece"]),
    )
    return windows.withColumn("text", joined).withColumn("chunk_seq", F.col("window_no")).drop("__parts")


def chunk_id(book: Column, page_start: Column, page_end: Column, text: Column) -> Column:
    """Deterministic 16-hex identifier."""
    parts = F.concat_ws("|", book, page_start.cast("string"), page_end.cast("string"), F.substring(text, 1, 200))
    return F.substring(F.sha2(parts, 256), 1, 16)


def section_flags(df: DataFrame, profile: str = "chunk", text: str = "text", ascii_words: bool = False) -> DataFrame:
    """One boolean column per lexicon section, all in one projection.

    ``ascii_words`` takes only ASCII characters as parts of words, as question analysis does.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    if ascii_words:
        return df.withColumns({e.name: body.rlike(L.ascii_words(e.pattern)) for e in L.profile(profile)})
    lowered = F.lower(body)
    return df.withColumns({e.name: e.found(body, lowered) for e in L.profile(profile)})


def chunk_metadata(df: DataFrame, text: str = "text", ascii_words: bool = False) -> DataFrame:
    """Nested metadata: structure flags, medical flags, and the exam lists.

    ``ascii_words`` takes only ASCII characters as parts of the words of flags, as question analysis does.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # Only Java folds the case of "ı" and "İ" to that of "i"; "ſ" is a small letter already, but a form of "s".
    read = F.replace(F.replace(body, F.lit("ı"), F.lit("é")), F.lit("İ"), F.lit("é")) if ascii_words else body
    lowered = F.replace(F.lower("__read"), F.lit("ſ"), F.lit("s"))
    words = L.ascii_words if ascii_words else str
    with_years = df.withColumns({"__years": K.important_years(body), "__read": read}).withColumn("__lowered", lowered)
    rows = {e.name: e.found(F.col("__read"), F.col("__lowered"), words).alias(e.name) for e in L.profile("chunk")}
    exam = F.struct(
        F.col("__years").alias("important_years"),
        K.important_numbers(body, F.col("__years")).alias("important_numbers"),
        K.top_keywords(body).alias("keywords"),
    )
    return with_years.withColumn(
        "metadata",
        F.struct(
            F.struct(*[rows[n] for n in L.STRUCTURE_SECTIONS]).alias("structure"),
            F.struct(*[rows[n] for n in L.MEDICAL_SECTIONS]).alias("medical"),
            exam.alias("exam"),
        ),
    ).drop("__years", "__read", "__lowered")


Extractor = Callable[[DataFrame], DataFrame]


def enrich(chunks: DataFrame, extractors: Sequence[Extractor] = (chunk_metadata,)) -> DataFrame:
    """Apply metadata extractors in order; each is a function that adds columns to the chunks."""
    for extract in extractors:
        chunks = extract(chunks)
    return chunks


def flatten_metadata(df: DataFrame) -> DataFrame:
    """Nested metadata as scalar columns; lists become comma-joined text."""
    keep = [c for c in df.columns if c != "metadata"]
    exam = [
        F.array_join(F.col(f"metadata.exam.{n}").cast("array<string>"), ",").alias(n)
        for n in ("important_years", "important_numbers", "keywords")
    ]
    return df.select(*keep, "metadata.structure.*", "metadata.medical.*", *exam)


def content_hash_duplicates(df: DataFrame, key: str, text: str = "text", approximate: bool = False) -> DataFrame:
    """Groups of identical content with their first member; counted before anything is shuffled."""
    hashed = df.select(F.sha2(F.col(text), 256).alias("content_sha"), key)
    groups = hashed.groupBy("content_sha").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("keep"))
    if approximate:
        return hashed.agg(F.approx_count_distinct("content_sha").alias("distinct_contents"))
    return groups.filter("copies > 1")


def duplicate_gate(incoming: DataFrame, active: DataFrame, sha: str = "content_sha") -> DataFrame:
    """Incoming rows with ``duplicate``: whether an active row has the same content."""
    known = active.select(F.col(sha).alias("__sha")).distinct().withColumn("__hit", F.lit(True))
    joined = incoming.join(known, F.col(sha) == F.col("__sha"), "left")
    return joined.withColumn("duplicate", F.coalesce("__hit", F.lit(False))).drop("__sha", "__hit")
