"""Book- and bank-level quality: reports, samples, verification tables, layout selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.blocked import BLOCK, last_seen, next_seen, number_rows, running_sum
from quire.operators.chains import visited
from quire.operators.pages import page_quality_flags
from quire.session import cut_lineage

# Signals of a question bank's format.
MCQ_SIGNALS = r"\(a\)|\(b\)|\(c\)|\(d\)|\bKey:|(?m:^\s*\d+\.)"
THEORY_SIGNALS = r"(?i)\bDiscuss\b|\bDescribe\b|\bExplain\b|\bWrite\s+about\b|\bElaborate\b|\bWrite\s+short\s+notes\b"


def ocr_quality_report(pages: DataFrame) -> DataFrame:
    """Per book: page counts by flag and mean characters."""
    flagged = page_quality_flags(pages)
    return flagged.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if("suspect").alias("suspect_pages"),
        F.count_if("low_char").alias("low_char_pages"),
        F.count_if("high_garble").alias("high_garble_pages"),
        F.avg(F.length("text")).alias("avg_chars"),
    )


def flagged_page_lists(pages: DataFrame, span: int = 1024) -> DataFrame:
    """Sorted page lists per book and flag, one row per ``span`` consecutive pages.

    The lists of a very large book stay complete but never gather in one row.
    """
    flagged = page_quality_flags(pages)
    kinds = F.array_compact(
        F.array(*[F.when(F.col(k), F.lit(k)) for k in ("suspect", "low_char", "high_garble")])
    )
    rows = flagged.select("book_id", "page_num", F.explode(kinds).alias("flag"))
    return rows.groupBy("book_id", "flag", F.floor((F.col("page_num") - 1) / span).alias("part")).agg(
        F.array_sort(F.collect_list("page_num")).alias("pages")
    )


def detect_format(pages: DataFrame, images: Column | None = None, sample: int = 5) -> DataFrame:
    """Dominant kind of the first pages of every book."""
    head = pages.filter(F.col("page_num") <= sample)
    kinds = head.select("book_id", T.classify_page(F.length("text"), images).alias("kind"))
    agg = kinds.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("pages_inspected"),
        F.count_if(F.col("kind") == "text").alias("text_pages"),
        F.count_if(F.col("kind") == "image").alias("image_pages"),
        F.count_if(F.col("kind") == "blank").alias("blank_pages"),
    )
    n = F.col("pages_inspected")
    return agg.withColumn(
        "format",
        F.when(F.col("text_pages") / n > 0.80, "text").when(F.col("image_pages") / n > 0.80, "scan").otherwise("mixed"),
    )


def _at_positions(pages: DataFrame, counts: DataFrame, positions: Column, position: str = "page_num") -> DataFrame:
    """Rows at a few listed positions per book: the list is exploded, then joined by equality."""
    wanted = counts.select("book_id", F.explode(F.array_distinct(positions)).alias(position))
    return pages.join(wanted, ["book_id", position])


def strided(n: Column, samples: int = 12) -> Column:
    """1-based positions of an even sample of at most ``samples`` out of ``n`` rows."""
    step = F.greatest(F.lit(1), F.floor(n / samples)).cast("bigint")
    every = F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"), step)).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.slice(every, 1, samples)


def native_text_stats(pages: DataFrame, sample: int = 5) -> DataFrame:
    """Mean and maximum characters of a few sampled pages, and whether a text layer is likely."""
    counts = pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("pages"))
    n = F.col("pages")
    positions = F.when(n <= sample, F.sequence(F.lit(1).cast("bigint"), n)).otherwise(
        F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"), F.lit(3).cast("bigint"), F.floor(n / 2) + 1, n)
    )
    chosen = _at_positions(pages.select("book_id", "page_num", F.length(T.strip_blanks(F.col("text"))).alias("chars")), counts, positions)
    agg = chosen.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("sample_pages"), F.avg("chars").alias("mean_chars"), F.max("chars").alias("max_chars")
    )
    return agg.withColumn("has_text_layer", (F.col("mean_chars") >= 80) | (F.col("max_chars") >= 120))


def validate_ocr_pages(
    pages: DataFrame, min_nonempty: float = 0.85, min_chars: float = 40.0, max_gibberish: float = 0.78
) -> DataFrame:
    """Gate per book: enough non-empty pages, enough text, and readable samples."""
    counts = pages.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if(F.length(T.strip_blanks(F.col("text"))) >= 20).alias("nonempty_pages"),
        F.avg(F.length("text")).alias("avg_chars"),
    )
    sampled = _at_positions(pages.select("book_id", "page_num", "text"), counts, strided(F.col("page_count")))
    scores = sampled.select("book_id", T.gibberish_score(F.col("text")).alias("g")).groupBy("book_id").agg(
        F.avg("g").alias("mean_gibberish"), F.max("g").alias("max_gibberish")
    )
    ratio = F.col("nonempty_pages") / F.col("page_count")
    structure = (ratio >= min_nonempty) & (F.col("avg_chars") >= min_chars)
    readable = F.col("mean_gibberish") < max_gibberish
    return (
        counts.join(scores, "book_id")
        .withColumns({"nonempty_ratio": ratio, "ok": structure & readable})
        .withColumn(
            "message",
            F.when(F.col("ok"), "OCR quality OK")
            .when(~structure, "OCR quality failed: too little text")
            .otherwise("OCR quality failed: gibberish"),
        )
    )


def sample_text_quality(
    texts: DataFrame,
    order: str,
    max_samples: int = 12,
    fail_above: float = 0.72,
    materialize: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Mean and worst gibberish of an even sample of each book's non-blank texts."""
    # Positions are worked out on keys alone; only the few sampled texts are fetched.
    filled = F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    marks = materialize(texts.select("book_id", order, filled.alias("__filled")))
    numbered = number_rows(marks.filter("__filled").drop("__filled"), ["book_id"], order, "__n")
    counts = marks.groupBy("book_id").agg(F.count_if("__filled").alias("n_filled"))
    chosen = _at_positions(numbered, counts, strided(F.col("n_filled"), max_samples), "__n").select("book_id", order)
    sampled = texts.select("book_id", order, "text").join(chosen, ["book_id", order])
    scores = sampled.select("book_id", T.gibberish_score(F.col("text")).alias("g")).groupBy("book_id").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("g").alias("mean_gibberish"), F.max("g").alias("max_gibberish")
    )
    joined = counts.select("book_id").join(scores, "book_id", "left")
    return joined.withColumns(
        {
            "samples": F.coalesce("samples", F.lit(0)),
            "mean_gibberish": F.coalesce("mean_gibberish", F.lit(1.0)),
            "max_gibberish": F.coalesce("max_gibberish", F.lit(1.0)),
        }
    ).withColumn("ok", (F.col("samples") > 0) & (F.col("mean_gibberish") < fail_above))


def _check(name: str, ok: Column, hard: Column | bool, present: Column | None = None) -> Column:
    hard = F.lit(hard) if isinstance(hard, bool) else hard
    row = F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), hard.alias("hard"))
    return row if present is None else F.when(present, row)


def verify_books(asked: DataFrame, manifest: DataFrame, chunk_counts: DataFrame, page_flags: DataFrame, quality: DataFrame) -> DataFrame:
    """Long table of checks ``(book_id, check, ok, hard)`` for every asked book.

    Inputs: active manifest (book_id, subject, pages, chunks), indexed chunk counts, suspect page
    counts, and sampled text quality, all one row per book.
    """
    known = manifest.select("book_id", F.lit(True).alias("known"), "pages", F.col("chunks").alias("planned"))
    row = (
        asked.select("book_id")
        .distinct()
        .join(known, "book_id", "left")
        .join(chunk_counts.select("book_id", "indexed"), "book_id", "left")
        .join(page_flags.select("book_id", "suspects"), "book_id", "left")
        .join(quality.select("book_id", F.col("ok").alias("fine"), "mean_gibberish"), "book_id", "left")
        .fillna(0, ["indexed", "suspects"])
    )
    pages, planned, indexed = F.col("pages"), F.col("planned"), F.col("indexed")
    severe = ~F.coalesce(F.col("fine"), F.lit(False)) & (F.coalesce("mean_gibberish", F.lit(1.0)) >= 0.85)
    off_manifest = F.abs(indexed - planned) > F.greatest(F.lit(5), F.floor(planned / 5))
    checks = F.array_compact(
        F.array(
            _check("manifest", F.lit(True), True),
            _check("pages", pages > 0, True),
            _check("chunks_manifest", planned >= 1, True),
            _check("index_count", indexed >= 1, True),
            _check("index_vs_manifest", F.lit(False), False, (planned > 0) & (indexed > 0) & off_manifest),
            _check("chunk_density", planned / pages >= 0.15, False, (pages >= 20) & (planned > 0)),
            _check("suspect_ratio", F.col("suspects") / pages <= 0.35, False, pages > 0),
            _check("text_quality", ~severe, severe),
        )
    )
    missing = F.array(_check("manifest", F.lit(False), True))
    return row.select("book_id", F.inline(F.when(F.col("known"), checks).otherwise(missing)))


def verification_result(checks: DataFrame, key: str = "book_id") -> DataFrame:
    """Overall verdict: failed hard checks are errors, failed soft ones warnings."""
    return checks.groupBy(key).agg(
        F.coalesce(F.bool_and(F.when(F.col("hard"), F.col("ok"))), F.lit(True)).alias("ok"),
        F.count_if(~F.col("ok") & F.col("hard")).alias("errors"),
        F.count_if(~F.col("ok") & ~F.col("hard")).alias("warnings"),
    )


def verify_question_banks(questions: DataFrame, order: Sequence[str], min_questions: int = 1, min_stem: int = 20) -> DataFrame:
    """Checks per bank over its question rows (book_id, question_text)."""
    stem = T.strip_blanks(F.coalesce(F.col("question_text"), F.lit("")))
    rows = questions.select("book_id", *order, stem.alias("stem"))
    agg = rows.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("stem") == "").alias("empty"),
        F.avg(F.when(F.col("stem") != "", F.length("stem"))).alias("mean_stem"),
    )
    first = rows.filter(F.col("stem") != "").withColumn(
        "rn", F.row_number().over(Window.partitionBy("book_id").orderBy(*order))
    ).filter("rn <= 30")
    sizes = agg.select("book_id", F.least(F.lit(30), F.col("n") - F.col("empty")).alias("m"))
    step = F.greatest(F.lit(1), F.floor(F.col("m") / 12))
    sampled = first.join(sizes, "book_id").filter(((F.col("rn") - 1) % step == 0) & ((F.col("rn") - 1) / step < 12))
    quality = sampled.groupBy("book_id").agg(F.avg(T.gibberish_score(F.col("stem"))).alias("g"))
    row = agg.join(quality, "book_id", "left")
    checks = F.array_compact(
        F.array(
            _check("bank_exists", F.lit(True), True),
            _check("question_count", F.col("n") >= min_questions, True),
            _check("empty_stems", F.lit(False), F.col("empty") > F.floor(F.col("n") / 2), F.col("empty") > 0),
            F.struct(
                F.lit("avg_stem_len").alias("check"),
                (F.col("mean_stem").isNull() | (F.col("mean_stem") >= min_stem)).alias("ok"),
                F.coalesce(F.col("mean_stem").isNull() | (F.col("mean_stem") >= min_stem) | (F.col("mean_stem") < 10), F.lit(True)).alias("hard"),
            ),
            _check("stem_quality", F.coalesce("g", F.lit(1.0)) < 0.75, False),
        )
    )
    return row.select("book_id", F.inline(checks))


def detect_bank_format(pages: DataFrame, first_pages: int = 5) -> DataFrame:
    """``mcq`` or ``theory`` by counting signals on the first pages; ties are ``mcq``."""
    head = pages.filter(F.col("page_num") <= first_pages)
    agg = head.groupBy("book_id").agg(
        F.sum(F.regexp_count("text", F.lit(MCQ_SIGNALS))).alias("mcq_signals"),
        F.sum(F.regexp_count("text", F.lit(THEORY_SIGNALS))).alias("theory_signals"),
    )
    m, t = F.col("mcq_signals"), F.col("theory_signals")
    return agg.withColumn("format", F.when(m > 5 * t, "mcq").when(t > 5 * m, "theory").otherwise("mcq"))


def select_layout_pages(
    pages: DataFrame,
    min_score: float = T.LAYOUT_MIN_SCORE,
    max_fraction: float = 0.18,
    max_pages: int = 180,
    materialize: Callable[[DataFrame], DataFrame] = cut_lineage,
    score: Callable[[Column], Column] = T.layout_table_score,
) -> DataFrame:
    """Best table-like pages per book within the budget, with candidate count and ``capped``."""
    scored = materialize(pages.select("book_id", "page_num", T.round_binary(score(F.col("text")), 4).alias("score")))
    candidates = scored.filter(F.col("score") >= min_score)
    budget = F.least(F.lit(max_pages), F.greatest(F.lit(1), F.floor(F.col("n_pages") * max_fraction)))
    books = scored.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_pages"))
    totals = candidates.groupBy("book_id").agg(F.count(F.lit(1)).alias("candidates"))
    limits = books.join(totals, "book_id").select(
        "book_id", "candidates", budget.alias("budget"), (F.col("candidates") > budget).alias("capped")
    )
    # The constant limit lets Spark cut every book to max_pages before the shuffle.
    ranked = candidates.withColumn(
        "rn", F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("score"), "page_num"))
    ).filter(F.col("rn") <= max_pages)
    return ranked.join(limits, "book_id").filter(F.col("rn") <= F.col("budget"))


def page_ranges(
    selected: DataFrame, merge_gap: int = 1, max_span: int = 28, block: int = BLOCK, materialize: Callable[[DataFrame], DataFrame] = cut_lineage
) -> DataFrame:
    """Merge selected pages into ranges of at most ``max_span`` pages, over gaps of at most ``merge_gap``.

    A range ends before the first page that lies behind a larger gap or too far from the range's first
    page.  So every page knows which one would begin the next range, and the ranges that occur begin at the
    pages that the chain of these successors visits.
    """
    pages = selected.groupBy("book_id", "page_num").agg(F.count(F.lit(1)).alias("copies"))
    placed = materialize(running_sum(pages, ["book_id"], ["page_num"], {"idx": F.lit(1)}, width=block).drop("copies"))
    none = F.lit(None).cast("bigint")
    here = placed.select("book_id", F.col("page_num").cast("bigint").alias("pos"), F.lit(0).alias("probe"), F.col("idx").alias("page"), none.alias("idx"))
    far = placed.select("book_id", (F.col("page_num") + max_span - 1).cast("bigint").alias("pos"), F.lit(1).alias("probe"), none.alias("page"), "idx")
    far = next_seen(here.unionByName(far), ["book_id"], ["pos", "probe"], {"far": F.col("page")}, width=block).filter("probe = 1").select("book_id", "idx", "far")
    before = last_seen(placed, ["book_id"], ["page_num"], {"last": F.col("page_num")}, width=block, inclusive=False)
    apart = F.when(F.col("page_num") - F.col("last") > merge_gap + 1, F.col("idx"))
    island = next_seen(before, ["book_id"], ["page_num"], {"gap": apart}, width=block).select("book_id", "idx", "gap")
    edges = far.join(island, ["book_id", "idx"]).select("book_id", "idx", F.least("far", "gap").alias("nxt"))
    starts = visited(materialize(edges), "book_id", block, materialize).withColumnRenamed("number", "begins")
    joined = placed.join(starts, ["book_id", "idx"], "left")
    filled = last_seen(joined, ["book_id"], ["page_num"], {"range_no": F.col("begins")}, width=block)
    out = filled.groupBy("book_id", "range_no").agg(F.min("page_num").alias("lo"), F.max("page_num").alias("hi"))
    return out.select(
        "book_id",
        F.col("lo").alias("start_page"),
        F.col("hi").alias("end_page"),
        F.format_string("auto_%04d_%04d", "lo", "hi").alias("name"),
    )


def override_pages(base: DataFrame, override: DataFrame, on: Sequence[str]) -> DataFrame:
    """Replacement text wins over the base text; adds ``origin``."""
    joined = base.join(override.withColumnRenamed("text", "__new"), list(on), "left")
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    return joined.withColumns(
        {
            "origin": F.when(F.col("__new").isNotNull(), "override").when(blank, "empty").otherwise("base"),
            "text": F.coalesce("__new", "text", F.lit("")),
        }
    ).drop("__new")


def library_listing(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Active books, then files that are neither indexed by name nor listed by id."""
    active = manifest.filter(F.col("archived_at").isNull())
    books = active.select("book_id", "title", "subject", F.col("filename").alias("path"), F.lit(True).alias("indexed"))
    named = active.filter(F.coalesce("filename", F.lit("")) != "").select(F.col("filename").alias("name"))
    loose = (
        files.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
        .join(named, "name", "left_anti")
        .withColumn("book_id", T.path_stem(F.col("path")))
        .join(active.select("book_id"), "book_id", "left_anti")
        .groupBy("book_id")
        .agg(F.min("path").alias("path"))
    )
    extra = loose.select(
        "book_id",
        T.title_from_path(F.col("path")).alias("title"),
        T.infer_subject(F.col("path")).alias("subject"),
        "path",
        F.lit(False).alias("indexed"),
    )
    return books.unionByName(extra)
