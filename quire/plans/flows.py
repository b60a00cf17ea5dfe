"""The two long flows: pages to a chunk index, and questions to validated answers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import lexicon as L
from quire.functions import text as T
from quire.functions.tokens import WORDS, Tokenizer
from quire.operators import chapters, chunks, evaluation, pages, planning, retrieval, validation
from quire.session import cut_lineage
from quire.sources import chunk_index


def build_chunks(
    page_table: DataFrame,
    size: int = 1000,
    overlap: int = 200,
    extractors: Sequence[chunks.Extractor] = (chunks.chunk_metadata,),
    tokenizer: Tokenizer = WORDS,
) -> DataFrame:
    """Clean pages, find chapters, cut windows, add ids and metadata."""
    clean = pages.clean_pages(page_table)
    facts = chapters.page_facts(clean, tokenizer=tokenizer)
    placed = chapters.chapter_of_pages(facts, chapters.segment_chapters(facts))
    cut = chunks.chunk_windows(clean, size, overlap, chapters=placed, facts=facts, tokenizer=tokenizer)
    cid = chunks.chunk_id(F.col("book_id"), F.col("page_start"), F.col("page_end"), F.col("text"))
    return chunks.enrich(cut.withColumn("chunk_id", cid), extractors)


def ingest(page_table: DataFrame, vectors: DataFrame, root: str, size: int = 1000, overlap: int = 200) -> None:
    """Add the chunks of a page table with their vectors (chunk_id, chunk_seq if known, embedding) to a stored index."""
    flat = chunks.flatten_metadata(build_chunks(page_table, size, overlap))
    key = [c for c in ("chunk_id", "chunk_seq") if c in vectors.columns]
    chunk_index.add_chunks(page_table.sparkSession, flat.join(vectors.select(*key, "embedding"), key, "left"), root)


def solve(
    questions: DataFrame,
    indexed: DataFrame,
    flags: Sequence[str],
    infer: Callable[[list[str]], list[dict]] = evaluation.stub_infer,
    template: Callable[[DataFrame], DataFrame] | None = None,
    planner: Callable[[DataFrame], DataFrame] | None = None,
    reranker: str | Callable[[DataFrame], DataFrame] = "identity",
) -> DataFrame:
    """Answer questions (qid, subject, qvec, question_text, type, marks) from an index and validate.

    ``planner`` adds columns to the planned questions, for a template of one's own to use.
    """
    if "chunk_seq" in indexed.columns:
        # Windows of equal id stay apart: the sequence is part of the id inside the flow.
        indexed = indexed.withColumn("chunk_id", F.concat_ws("#", "chunk_id", "chunk_seq"))
    planned = planning.retrieval_plan(planning.analyze_questions(questions))
    if planner is not None:
        planned = planner(planned)
    hits = retrieval.retrieve(planned, indexed, flags, reranker).join(indexed.select("chunk_id", "text"), "chunk_id", "left")
    context = retrieval.build_context(hits, "final_rank")
    ready = planned.join(context, "qid", "left").withColumn("context", F.coalesce("context", F.lit("")))
    if template is None:
        prompt = F.concat_ws("\n\n", "question_text", "context")
        ready = ready.withColumn("prompt", prompt)
    else:
        ready = template(ready)
    # The retrieval feeds the prompts and, later, the checks: it is run once for both.
    ready = cut_lineage(ready)
    answers = evaluation.answer_batch(ready, infer)
    tidy = answers.withColumn("answer_text", T.tidy_answer(F.col("answer_text")))
    targets = F.when(F.col("marks") == 5, L.ANSWER_TARGETS[5]).otherwise(L.ANSWER_TARGETS[10])
    facts = ready.select("qid", "subject", "marks", targets.alias("target_words"), F.col("context").alias("source_text"))
    return validation.validate(tidy.join(facts, "qid"))
