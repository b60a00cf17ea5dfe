"""Batch answering with a supplied function, and benchmark aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import words_of

Infer = Callable[[list[str]], list[dict]]

ANSWER_FIELDS = "answer_text string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, latency_seconds double, error string"

# Fixed values of the deterministic stand-in reply.
STUB_MARKER, STUB_CHARS = "MOCK ANSWER (", 50
STUB_TOKENS, STUB_SECONDS = (500, 100, 600), 0.1


def stub_infer(prompts: list[str]) -> list[dict]:
    """Deterministic replies for tests and dry runs."""
    return [
        {
            "answer_text": f"{STUB_MARKER}{p[:STUB_CHARS]})",
            "prompt_tokens": STUB_TOKENS[0],
            "completion_tokens": STUB_TOKENS[1],
            "total_tokens": STUB_TOKENS[2],
            "latency_seconds": STUB_SECONDS,
        }
        for p in prompts
    ]


def stub_answer(prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
    """The same replies as columns, without leaving the JVM."""
    return prompts.withColumns(
        {
            "answer_text": F.concat(F.lit(STUB_MARKER), F.substring(prompt, 1, STUB_CHARS), F.lit(")")),
            "prompt_tokens": F.lit(STUB_TOKENS[0]).cast("bigint"),
            "completion_tokens": F.lit(STUB_TOKENS[1]).cast("bigint"),
            "total_tokens": F.lit(STUB_TOKENS[2]).cast("bigint"),
            "latency_seconds": F.lit(STUB_SECONDS),
        }
    )


def answer_batch(prompts: DataFrame, infer: Infer, key: str | Sequence[str] = "qid", prompt: str = "prompt") -> DataFrame:
    """Run ``infer`` over batches of prompts; a failing prompt becomes a row with ``error``.

    A batch that fails, or that does not give one reply per prompt, is tried again prompt by prompt,
    so one bad prompt costs only itself and no prompt gets the reply of another.
    """
    names = [f.split()[0] for f in ANSWER_FIELDS.split(", ")]
    keys = [key] if isinstance(key, str) else list(key)

    def replies_to(texts: list[str]) -> list[dict]:
        replies = list(infer(texts))
        if len(replies) != len(texts):
            raise ValueError(f"{len(replies)} replies to {len(texts)} prompts")
        return replies

    def attempt(texts: list[str]) -> list[dict]:
        try:
            return replies_to(texts)
        except Exception as exc:  # noqa: BLE001
            if len(texts) == 1:
                return [{"error": f"{type(exc).__name__}: {exc}"}]
            return [reply for text in texts for reply in attempt([text])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies = pd.DataFrame(attempt(pdf[prompt].tolist()), index=pdf.index)
            out = replies.reindex(columns=names)
            for name in ("prompt_tokens", "completion_tokens", "total_tokens"):
                out[name] = out[name].astype("Int64")
            out["latency_seconds"] = out["latency_seconds"].astype("float64")
            for name in ("answer_text", "error"):
                out[name] = [x if isinstance(x, str) else None for x in out[name]]
            yield pd.concat([pdf[keys], out], axis=1)

    types = ", ".join(f"`{k}` {prompts.schema[k].dataType.simpleString()}" for k in keys)
    return prompts.select(*keys, prompt).mapInPandas(run, f"{types}, {ANSWER_FIELDS}")


def answer_questions(
    prompts: DataFrame,
    infer: Infer,
    stored: DataFrame,
    on: Sequence[str] = ("module", "chapter", "qid"),
    force: bool = False,
    skip: Column | None = None,
    prompt: str = "prompt",
) -> DataFrame:
    """Every question with ``outcome`` (cached, generated, failed, skipped), answer, tokens, latency and error.

    A question with a stored answer (``on``, answer_text, total_tokens, latency_seconds; one row per key) takes it
    unless ``force`` is set; only the others reach ``infer``.  ``skip`` marks questions left out, for instance those
    after a cancelled run: they are neither looked up nor answered.  Repeated questions give a row each; a null
    in a key is never cached.
    """
    fields = ["answer_text", "total_tokens", "latency_seconds", "error"]
    left_out = F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False)
    open_ = prompts.filter(~left_out)
    skipped = prompts.filter(left_out).select(*on, F.lit("skipped").alias("outcome"))
    if force:
        pending, known = open_, None
    else:
        pending = open_.join(stored.select(*on), list(on), "left_anti")
        known = open_.select(*on).join(stored.select(*on, *fields[:-1]), list(on)).withColumn("outcome", F.lit("cached"))
    replies = answer_batch(pending, infer, on, prompt)
    outcome = F.when(F.col("error").isNotNull(), "failed").otherwise("generated")
    out = replies.select(*on, outcome.alias("outcome"), *fields).unionByName(skipped, allowMissingColumns=True)
    return out if known is None else out.unionByName(known, allowMissingColumns=True)


def batch_summary(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals and sorted chapters of a batch: needs outcome (generated, cached, failed, skipped), chapter, tokens, latency."""
    done = F.col("outcome").isin("generated", "cached")
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("questions_total"),
        *[F.count_if(F.col("outcome") == o).alias(f"questions_{o}") for o in ("generated", "cached", "failed", "skipped")],
        F.count_distinct("chapter").alias("n_chapters"),
        F.array_sort(F.collect_set("chapter")).alias("chapters"),
        F.coalesce(F.sum(F.when(done, F.col("total_tokens"))), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.when(done, F.col("latency_seconds"))), F.lit(0.0)).alias("total_latency_seconds"),
    )


def batch_chapters(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The chapters of a batch with their questions, a row each."""
    return results.groupBy(*keys, "chapter").agg(F.count(F.lit(1)).alias("questions"))


def failed_questions(results: DataFrame) -> DataFrame:
    return results.filter(F.col("outcome") == "failed").select("module", "qid")


def answer_metrics(answers: DataFrame, n_chunks: Column) -> DataFrame:
    return answers.withColumns(
        {
            "answer_chars": F.length("answer_text"),
            "answer_words": F.size(words_of(F.col("answer_text"))),
            "chunks": n_chunks,
            "general_fallback": n_chunks == 0,
        }
    )


def hydrate_suite(suite: DataFrame, banks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suite rows completed from their bank question, and the rows that have none.

    Values stated in the suite win; type, options and chapter come from the bank.
    """
    key = ["module", "qid"]
    src = banks.select(
        *key,
        F.col("question_text").alias("__text"),
        F.col("type").alias("__type"),
        F.col("chapter").alias("__chapter"),
        F.col("marks").alias("__marks"),
    )
    joined = suite.join(src, key)
    full = joined.withColumns(
        {
            "question_text": F.coalesce("question_text", "__text"),
            "marks": F.coalesce("marks", "__marks"),
            "type": F.coalesce("__type", F.lit("theory")),
            "chapter": F.coalesce("__chapter", F.lit("all")),
        }
    ).drop("__text", "__type", "__chapter", "__marks")
    return full, suite.join(banks.select(*key), key, "left_anti").select(*key)


#: Measures a record may have and that are averaged: over the cold path, and over all records.
COLD_MEANS = ("retrieval_latency_seconds", "generation_latency_seconds")
MEANS = ("pdf_generation_seconds", "answer_length_chars", "answer_length_words", "retrieval_chunks")


def benchmark_summary(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All aggregates of a run in one pass; a measure the records don't have gives no column."""
    cold = F.col("path") == "cold"
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    over_cold = lambda f, c: f(F.when(cold, c))
    hits, n = F.count_if("cache_hit"), F.count(F.lit(1))
    return records.groupBy(*keys).agg(
        n.alias("n_records"),
        F.count_if(cold).alias("n_cold"),
        F.count_if(F.col("path") == "warm").alias("n_warm"),
        F.count_if("success").alias("n_success"),
        F.count_if(~F.col("success")).alias("n_failure"),
        hits.alias("n_cache_hits"),
        F.count_if(cold & ~F.col("cache_hit")).alias("n_cache_misses"),
        (hits / n).alias("cache_hit_rate"),
        over_cold(F.sum, F.col("prompt_tokens")).alias("total_prompt_tokens"),
        over_cold(F.sum, F.col("completion_tokens")).alias("total_completion_tokens"),
        over_cold(F.sum, total).alias("total_tokens"),
        over_cold(F.avg, F.col("prompt_tokens")).alias("avg_prompt_tokens"),
        over_cold(F.avg, F.col("completion_tokens")).alias("avg_completion_tokens"),
        over_cold(F.avg, total).alias("avg_total_tokens"),
        *[over_cold(F.avg, F.col(c)).alias(f"avg_{c}") for c in COLD_MEANS if c in records.columns],
        *[F.avg(c).alias(f"avg_{c}") for c in MEANS if c in records.columns],
        F.avg("latency_seconds").alias("avg_total_latency_seconds"),
        F.avg(F.when(F.col("avg_distance") > 0, F.col("avg_distance"))).alias("avg_retrieval_distance"),
    )


COMPARED = ("n_records", "n_success", "n_failure", "cache_hit_rate", "total_tokens", "avg_total_latency_seconds")


def compare_runs(summaries: DataFrame, pairs: DataFrame, run: str = "run_id") -> DataFrame:
    """Differences b - a of six metrics for every asked pair; a missing run is reported."""
    side = lambda s: summaries.select(F.col(run).alias(f"run_{s}"), F.struct(*COMPARED).alias(s))
    joined = pairs.join(side("a"), "run_a", "left").join(side("b"), "run_b", "left")
    ok = F.col("a").isNotNull() & F.col("b").isNotNull()
    deltas = [(F.col(f"b.{m}") - F.col(f"a.{m}")).alias(f"delta_{m}") for m in COMPARED]
    return joined.select("run_a", "run_b", ok.alias("ok"), *deltas)


def filter_suite(suite: DataFrame, **equal: str | None) -> DataFrame:
    """Equality filters on subject, module or qid; None means no filter."""
    for name, value in equal.items():
        if value is not None:
            suite = suite.filter(F.col(name) == value)
    return suite


def suite_profile(suite: DataFrame, dims: Sequence[str] = ("subject", "marks", "difficulty")) -> DataFrame:
    """Counts per value of every dimension, in one pass over the suite."""
    values = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    return suite.select(F.inline(values)).groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))


def suite_duplicates(suite: DataFrame) -> DataFrame:
    return suite.groupBy("module", "qid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def run_report(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many items of an ordered list went through, and how many failed and were skipped."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("status") == "succeeded").alias("ok"),
        F.count_if(F.col("status") == "failed").alias("failed_and_skipped"),
        F.min_by("event_id", F.when(F.col("status") == "failed", F.struct("ts", "event_id"))).alias("first_failed"),
    )
