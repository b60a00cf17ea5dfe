"""Question analysis, retrieval plans and answer blueprints."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import lexicon as L
from quire.functions.arrays import let
from quire.functions.text import strip_blanks


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def analyze_questions(questions: DataFrame, profile: str = "question", max_sections: int = 4) -> DataFrame:
    """Add ``target_sections``: matching sections in priority order, the first few only."""
    found = L.matched_sections(F.col("question_text"), L.profile(profile))
    return questions.withColumn("target_sections", F.slice(found, 1, max_sections))


Strategy = Callable[[DataFrame], DataFrame]


def retrieval_plan(analyzed: DataFrame, strategy: str | Strategy = "adaptive", max_filter_sections: int = 2) -> DataFrame:
    """Add ``top_k`` and ``filter_names``; a broad question gets no filter.

    A strategy of one's own is a function that adds the two columns.
    """
    if callable(strategy):
        return strategy(analyzed)
    empty = F.array().cast("array<string>")
    if strategy == "identity":
        return analyzed.withColumns({"top_k": F.lit(8), "filter_names": empty})
    if strategy != "adaptive":
        raise ValueError(f"unknown strategy {strategy!r}")
    narrow = F.size("target_sections").between(1, max_filter_sections)
    return analyzed.withColumns(
        {
            "top_k": F.when(F.col("marks") == 5, F.lit(5)).otherwise(F.lit(8)),
            "filter_names": F.when(narrow, F.col("target_sections")).otherwise(empty),
        }
    )


def split_filter(names: Column) -> tuple[Column, Column]:
    """Structure names and medical names of a filter."""
    return (
        F.array_intersect(names, _strings(L.STRUCTURE_SECTIONS)),
        F.array_intersect(names, _strings(L.MEDICAL_SECTIONS)),
    )


def validate_plan_input(questions: DataFrame) -> DataFrame:
    """Add ``reject_reason``: null for rows the planner accepts."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(blank("question_text"), "question_text is required")
        .when(blank("subject"), "subject is required")
        .when(~F.coalesce(F.col("type").isin("theory", "mcq"), F.lit(False)), "unknown question type")
        .when(F.col("marks").isNotNull() & ~F.col("marks").isin(5, 10), "marks must be 5, 10 or absent")
    )
    return questions.withColumn("reject_reason", reason)


def plan_answer(questions: DataFrame, intro_share: float = 0.15, conclusion_share: float = 0.10) -> DataFrame:
    """Add the blueprint: ``target_words`` and ``sections`` (name, category, words, required, metadata)."""
    marks = F.col("marks")
    theory = F.coalesce(F.col("type") == "theory", F.lit(True))
    target = F.when(marks == 5, F.lit(L.PLAN_TARGETS[5])).otherwise(F.lit(L.PLAN_TARGETS[10]))
    cap = F.when(marks == 5, F.lit(3)).otherwise(F.lit(7))

    by_name = {e.name: e for e in L.profile("planner")}
    ordered = tuple(by_name[n] for n in L.PLAN_ORDER if n in by_name)
    detected = F.slice(L.matched_sections(F.col("question_text"), ordered), F.lit(1), cap)
    structure = _strings(L.PLAN_STRUCTURE)

    def section(name, category, words, metadata) -> Column:
        return F.struct(
            name.alias("name"),
            category.alias("category"),
            words.cast("int").alias("words"),
            F.lit(True).alias("required"),
            metadata.cast("string").alias("metadata"),
        )

    def build(names: Column) -> Column:
        intro = F.bround(target * F.lit(intro_share), 0).cast("int")
        conclusion = F.bround(target * F.lit(conclusion_share), 0).cast("int")
        body = target - intro - conclusion
        n = F.size(names)
        each = F.floor(body / F.greatest(n, F.lit(1))).cast("int")
        extra = body - each * n
        framing = F.lit("framing")
        middle = F.transform(
            names,
            lambda s, i: section(
                F.translate(F.regexp_replace(s, "^section_", ""), "_", " "),
                F.when(F.array_contains(structure, s), F.lit("structure")).otherwise(F.lit("medical")),
                each + F.when(i < extra, F.lit(1)).otherwise(F.lit(0)),
                s,
            ),
        )
        first = section(F.lit("introduction"), framing, F.when(n == 0, intro + body).otherwise(intro), F.lit(None))
        last = section(F.lit("conclusion"), framing, conclusion, F.lit(None))
        return F.concat(F.array(first), middle, F.array(last))

    mcq = F.array(section(F.lit("answer"), F.lit("framing"), F.lit(0), F.lit(None)))
    return questions.withColumns(
        {
            "target_words": F.when(theory, target).otherwise(F.lit(0)),
            "sections": F.when(theory, let(detected, build)).otherwise(mcq),
        }
    )


def blueprint_sections(planned: DataFrame) -> DataFrame:
    """One row per blueprint section, numbered from 1."""
    return planned.select("*", F.posexplode("sections").alias("__pos", "__s")).select(
        *[c for c in planned.columns if c != "sections"],
        (F.col("__pos") + 1).alias("section_no"),
        "__s.*",
    )


def required_categories(sections: Column) -> Column:
    """Sorted distinct metadata sections of a blueprint."""
    names = F.filter(F.transform(sections, lambda s: s["metadata"]), lambda m: m.isNotNull())
    return F.array_sort(F.array_distinct(names))


def section_retrieval_spec(planned: DataFrame, min_chunks: int = 1, max_chunks: int = 3) -> DataFrame:
    """One row per blueprint section with its own filter, priority and chunk budget."""
    rows = blueprint_sections(planned)
    return rows.withColumns(
        {
            "filter_name": F.col("metadata"),
            "filter_group": F.when(F.col("metadata").isin(*L.STRUCTURE_SECTIONS), "structure").when(
                F.col("metadata").isNotNull(), "medical"
            ),
            "priority": F.when(F.col("required"), F.lit(0)).otherwise(F.lit(2)),
            "min_chunks": F.lit(min_chunks),
            "max_chunks": F.lit(max_chunks),
            "evidence_category": F.col("metadata"),
        }
    )


def evidence_categories(sections: Column) -> Column:
    """Distinct metadata sections in blueprint order."""
    return F.array_distinct(
        F.filter(F.transform(sections, lambda s: s["metadata"]), lambda m: m.isNotNull())
    )


def select_questions(
    questions: DataFrame,
    default_marks: int = 10,
    marks: Sequence[int] | None = None,
    chapters: Sequence[str] | None = None,
    chapter_like: str | None = None,
) -> DataFrame:
    """Answerable questions of a bank, filtered by marks and chapters."""
    chapter = F.coalesce(strip_blanks(F.col("chapter")), F.lit(""))
    out = questions.withColumns(
        {
            "question_text": strip_blanks(F.col("question_text")),
            "resolved_marks": F.when(F.col("marks").isin(3, 5, 10), F.col("marks")).otherwise(F.lit(default_marks)),
        }
    ).filter(F.coalesce(F.col("question_text"), F.lit("")) != "")
    if marks:
        out = out.filter(F.col("resolved_marks").isin(*marks))
    if chapters:
        out = out.filter(F.lower(chapter).isin(*[c.strip().lower() for c in chapters]))
    out = out.withColumn("chapter", F.when(chapter == "", "unknown").otherwise(chapter))
    if chapter_like is not None:
        out = out.filter(F.lower("chapter").contains(chapter_like.lower()))
    return out


def output_budget(marks: Column, target_words: Column) -> Column:
    """Upper bound of output tokens for an answer of the given length."""
    words = F.coalesce(F.nullif(target_words, F.lit(0)), F.lit(500))
    level = F.coalesce(marks, F.when(words >= 500, F.lit(10)).otherwise(F.lit(5)))
    return (
        F.when((level <= 3) | (words <= 150), F.floor(words * F.lit(1.30)) + 100)
        .when((level <= 5) | (words <= 400), F.floor(words * F.lit(1.30)) + 200)
        .otherwise(F.floor(words * F.lit(1.40)) + 200)
        .cast("bigint")
    )


def stage_trace(planned: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """One row per (question, stage) with the stage output as JSON."""
    entries = F.array(
        *[F.struct(F.lit(i + 1).alias("stage_no"), F.lit(n).alias("stage"), c.alias("output")) for i, (n, c) in enumerate(stages.items())]
    )
    return planned.select("qid", F.inline(entries))


__all__ = [
    "analyze_questions",
    "retrieval_plan",
    "split_filter",
    "validate_plan_input",
    "plan_answer",
    "blueprint_sections",
    "required_categories",
    "section_retrieval_spec",
    "evidence_categories",
    "select_questions",
    "output_budget",
    "stage_trace",
]
