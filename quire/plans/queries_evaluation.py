"""Batch answering, benchmarks, logs (inventory groups J and K)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.operators import evaluation as J
from quire.operators import oplog as K
from quire.plans.queries_text import D_WORDS
from quire.plans.registry import query
from quire.session import shared_dir
from quire.sources import suites as S


def scratch(v, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


def picky(prompts):
    """Stand-in model that refuses some prompts and drops the last reply of a batch."""
    if any("NHM" in p for p in prompts):
        raise RuntimeError("model unavailable")
    return J.stub_infer(prompts if len(prompts) == 1 else prompts[:-1])


@query(
    "j1_answer_batch",
    """select qid, case when contains(question_text, 'NHM') then null else concat('MOCK ANSWER (', substring(question_text, 1, 50), ')') end as answer_text,
         case when contains(question_text, 'NHM') then null else 600 end::bigint as total_tokens, case when contains(question_text, 'NHM') then 'RuntimeError: model unavailable' end as error from f4""",
)
def _(v):
    out = J.answer_batch(v.f4.select("qid", F.col("question_text").alias("prompt")), picky)
    return out.select("qid", "answer_text", "total_tokens", "error")


@query(
    "j1_batch_outcomes",
    """with s as (select module, chapter, qid, any_value(answer_text) as a, max(length(answer_text)) as n from f5 where conv_id % 2 = 0 group by all having count(*) = 1),
       q as (select 'm' || (conv_id % 7) as module, chapter, qid, question_text, conv_id % 8 = 7 as skip from f4)
       select q.qid, case when skip then 'skipped' when s.qid is not null then 'cached' when contains(question_text, 'NHM') then 'failed' else 'generated' end as outcome,
         case when skip then null when s.qid is not null then a when contains(question_text, 'NHM') then null else concat('MOCK ANSWER (', substring(question_text, 1, 50), ')') end as answer_text,
         case when skip then null when s.qid is not null then n when contains(question_text, 'NHM') then null else 600 end::bigint as total_tokens
       from q left join s on s.module = q.module and s.chapter = q.chapter and s.qid = q.qid""",
)
def _(v):
    on = ["module", "chapter", "qid"]
    stored = v.f5.filter("conv_id % 2 = 0").groupBy(*on).agg(F.min("answer_text").alias("answer_text"), F.count("*").alias("n")).filter("n = 1")
    stored = stored.select(*on, "answer_text", F.length("answer_text").cast("bigint").alias("total_tokens"), F.lit(1.0).alias("latency_seconds"))
    asked = v.f4.select(F.expr("concat('m', cast(conv_id % 7 as string))").alias("module"), "chapter", "qid", F.col("question_text").alias("prompt"), "conv_id")
    out = J.answer_questions(asked, picky, stored, on, skip=F.col("conv_id") % 8 == 7)
    return out.select("qid", "outcome", "answer_text", "total_tokens")


@query(
    "j2_stub_answer",
    "select qid, concat('MOCK ANSWER (', substring(question_text, 1, 50), ')') as answer_text, 500::bigint as prompt_tokens, 100::bigint as completion_tokens, 600::bigint as total_tokens, 0.1::double as latency_seconds from f4",
)
def _(v):
    out = J.stub_answer(v.f4.select("qid", F.col("question_text").alias("prompt")))
    return out.drop("prompt")


D_RES = "res as (select module, qid, run_id as chapter, case when not success then 'failed' when cache_hit then 'cached' when prompt_tokens < 40 then 'skipped' else 'generated' end as outcome, prompt_tokens + completion_tokens as total_tokens, latency_seconds from f8)"


def results(v):
    outcome = F.expr("case when not success then 'failed' when cache_hit then 'cached' when prompt_tokens < 40 then 'skipped' else 'generated' end")
    return v.f8.select(
        "module", "qid", F.col("run_id").alias("chapter"), outcome.alias("outcome"),
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), "latency_seconds",
    )


@query(
    "j3_batch_summary",
    f"""with {D_RES} select module, count(*) as questions_total, count_if(outcome = 'generated')::bigint as questions_generated, count_if(outcome = 'cached')::bigint as questions_cached,
        count_if(outcome = 'failed')::bigint as questions_failed, count_if(outcome = 'skipped')::bigint as questions_skipped, count(distinct chapter) as n_chapters, string_agg(distinct chapter, ',' order by chapter) as chapters,
        coalesce(sum(total_tokens) filter (where outcome in ('generated', 'cached')), 0)::bigint as total_tokens, round(coalesce(sum(latency_seconds) filter (where outcome in ('generated', 'cached')), 0), 4) as total_latency_seconds from res group by module""",
)
def _(v):
    out = J.batch_summary(results(v), ["module"])
    return out.withColumns({"chapters": F.array_join("chapters", ","), "total_latency_seconds": F.round("total_latency_seconds", 4)})


@query("j3_batch_chapters", f"with {D_RES} select module, chapter, count(*) as questions from res group by module, chapter")
def _(v):
    return J.batch_chapters(results(v), ["module"])


@query("j3_failed_questions", f"with {D_RES} select module, qid from res where outcome = 'failed'")
def _(v):
    return J.failed_questions(results(v))


@query(
    "j4_answer_metrics",
    f"select qid, length(answer_text)::bigint as answer_chars, len({D_WORDS.format(c='answer_text')})::bigint as answer_words, (conv_id % 3)::bigint as chunks, conv_id % 3 = 0 as general_fallback from f5",
)
def _(v):
    out = J.answer_metrics(v.f5, F.col("conv_id") % 3)
    return out.select("qid", F.col("answer_chars").cast("bigint"), F.col("answer_words").cast("bigint"), "chunks", "general_fallback")


D_SUITE = "suite as (select chapter as module, qid, subject, case when conv_id % 4 = 0 then null else 10 end as marks, case conv_id % 3 when 0 then 'easy' when 1 then 'medium' else 'hard' end as difficulty, conv_id from f4)"


def suite(v):
    return v.f4.select(
        F.col("chapter").alias("module"), "qid", "subject",
        F.expr("case when conv_id % 4 = 0 then null else 10 end").alias("marks"),
        F.expr("case conv_id % 3 when 0 then 'easy' when 1 then 'medium' else 'hard' end").alias("difficulty"),
        F.lit(None).cast("string").alias("question_text"),
    )


@query(
    "j5_hydrate_suite",
    f"""with {D_SUITE}, b as (select * from f4 where conv_id % 5 <> 1)
       select 'ok' as status, s.module, s.qid, b.question_text, coalesce(s.marks, b.marks)::bigint as marks, b.type from suite s join b on b.chapter = s.module and b.qid = s.qid
       union all select 'skipped', s.module, s.qid, null, null, null from suite s where not exists (select 1 from b where b.chapter = s.module and b.qid = s.qid)""",
)
def _(v):
    banks = v.f4.filter("conv_id % 5 <> 1").select(F.col("chapter").alias("module"), "qid", "question_text", "type", "chapter", "marks")
    full, skipped = J.hydrate_suite(suite(v), banks)
    ok = full.select(F.lit("ok").alias("status"), "module", "qid", "question_text", F.col("marks").cast("bigint").alias("marks"), "type")
    return ok.unionByName(skipped.withColumn("status", F.lit("skipped")), allowMissingColumns=True)


D_SUM = """sm as (select run_id, count(*) as n_records, count_if(path = 'cold')::bigint as n_cold, count_if(path = 'warm')::bigint as n_warm, count_if(success)::bigint as n_success, count_if(not success)::bigint as n_failure,
   count_if(cache_hit)::bigint as n_cache_hits, count_if(path = 'cold' and not cache_hit)::bigint as n_cache_misses, count_if(cache_hit) / count(*)::double as cache_hit_rate,
   sum(prompt_tokens) filter (where path = 'cold')::bigint as total_prompt_tokens, sum(completion_tokens) filter (where path = 'cold')::bigint as total_completion_tokens, sum(prompt_tokens + completion_tokens) filter (where path = 'cold')::bigint as total_tokens,
   avg(prompt_tokens) filter (where path = 'cold') as avg_prompt_tokens, avg(completion_tokens) filter (where path = 'cold') as avg_completion_tokens, avg(retrieval_latency_seconds) filter (where path = 'cold') as avg_retrieval_latency_seconds,
   avg(generation_latency_seconds) filter (where path = 'cold') as avg_generation_latency_seconds, avg(pdf_generation_seconds) as avg_pdf_generation_seconds, avg(answer_length_chars) as avg_answer_length_chars, avg(answer_length_words) as avg_answer_length_words, avg(retrieval_chunks) as avg_retrieval_chunks, avg(prompt_tokens + completion_tokens) filter (where path = 'cold') as avg_total_tokens, avg(latency_seconds) as avg_total_latency_seconds,
   avg(avg_distance) filter (where avg_distance > 0) as avg_retrieval_distance from f8 group by run_id)"""
_MEANS = (
    "cache_hit_rate", "avg_prompt_tokens", "avg_completion_tokens", "avg_retrieval_latency_seconds", "avg_generation_latency_seconds",
    "avg_pdf_generation_seconds", "avg_answer_length_chars", "avg_answer_length_words", "avg_retrieval_chunks", "avg_total_tokens", "avg_total_latency_seconds", "avg_retrieval_distance")


@query(
    "j6_benchmark_summary",
    f"with {D_SUM} select * exclude ({', '.join(_MEANS)}), {', '.join(f'round({m}, 6) as {m}' for m in _MEANS)} from sm",
)
def _(v):
    return J.benchmark_summary(v.f8, ["run_id"]).withColumns({m: F.round(m, 6) for m in _MEANS})


@query(
    "j7_list_runs",
    f"with {D_SUM} select concat('run-', run_id) as run_id, n_records, n_success, n_failure, round(cache_hit_rate, 6) as cache_hit_rate, total_tokens, round(avg_total_latency_seconds, 6) as avg_total_latency_seconds from sm",
)
def _(v):
    root = scratch(v, "runs")
    for run in ("A", "N", "R"):
        records = v.f8.filter(F.col("run_id") == run)
        S.write_benchmark_run(records, J.benchmark_summary(records), root, f"run-{run}")
    out = S.list_runs(v.spark, root)
    return out.withColumns({m: F.round(m, 6) for m in ("cache_hit_rate", "avg_total_latency_seconds")})


@query(
    "j8_compare_runs",
    f"""with {D_SUM}, pairs(run_a, run_b) as (values ('A', 'R'), ('R', 'N'), ('A', 'missing'))
      select p.run_a, p.run_b, a.run_id is not null and b.run_id is not null as ok, b.n_records - a.n_records as delta_n_records, b.n_success - a.n_success as delta_n_success, b.n_failure - a.n_failure as delta_n_failure,
        round(b.cache_hit_rate - a.cache_hit_rate, 6) as delta_cache_hit_rate, b.total_tokens - a.total_tokens as delta_total_tokens, round(b.avg_total_latency_seconds - a.avg_total_latency_seconds, 6) as delta_avg_total_latency_seconds
      from pairs p left join sm a on a.run_id = p.run_a left join sm b on b.run_id = p.run_b""",
)
def _(v):
    pairs = v.spark.createDataFrame([("A", "R"), ("R", "N"), ("A", "missing")], "run_a string, run_b string")
    out = J.compare_runs(J.benchmark_summary(v.f8, ["run_id"]), pairs)
    return out.withColumns({c: F.round(c, 6) for c in ("delta_cache_hit_rate", "delta_avg_total_latency_seconds")})


@query("j9_filter_suite", f"with {D_SUITE} select module, qid from suite where subject = 'fr' and module = 'ch1'")
def _(v):
    return J.filter_suite(suite(v), subject="fr", module="ch1", qid=None).select("module", "qid")


@query(
    "j10_suite_profile",
    f"""with {D_SUITE} select 'subject' as dim, subject as value, count(*) as n from suite group by subject
      union all select 'marks', marks::varchar, count(*) from suite group by marks union all select 'difficulty', difficulty, count(*) from suite group by difficulty""",
)
def _(v):
    return J.suite_profile(suite(v))


@query(
    "j10_suite_duplicates",
    "select module, qid, count(*) as n from (select module, qid from f8 union all select module, qid from f8 where prompt_tokens > 450) group by 1, 2 having count(*) > 1",
)
def _(v):
    twice = v.f8.select("module", "qid", "prompt_tokens")
    return J.suite_duplicates(twice.unionByName(twice.filter("prompt_tokens > 450")))


@query(
    "j11_run_report",
    "select book_id % 7 as lane, count(*) as items, count_if(status = 'succeeded')::bigint as ok, count_if(status = 'failed')::bigint as failed_and_skipped, arg_min(event_id, (ts, event_id)) filter (where status = 'failed') as first_failed from f7 group by 1",
)
def _(v):
    return J.run_report(v.f7.withColumn("lane", F.col("book_id") % 7), ["lane"])


@query("k1_tail", "select event_id, book_id, status from f7 order by ts desc, event_id desc limit 50")
def _(v):
    return K.tail(v.f7.select("event_id", "book_id", "status", "ts"), 50, ["ts", "event_id"]).drop("ts")


@query(
    "k1_tail_per_log",
    "select event_id, book_id, status from (select *, row_number() over (partition by book_id order by ts desc, event_id desc) as rn from f7) where rn <= 3",
)
def _(v):
    return K.tail(v.f7, 3, ["ts", "event_id"], per=["book_id"]).select("event_id", "book_id", "status")


@query("k2_search", """select event_id from f7 where contains('"status":"' || status || '"', 'succ') or contains(props, 'succ')""")
def _(v):
    return K.search(v.f7.select("event_id", "status", "props"), "succ").select("event_id")


@query(
    "k3_latest_status",
    """select a.book_id, coalesce(s.status, 'unknown') as status from (select distinct book_id from f7 union select distinct -book_id from f7 where book_id % 10 = 0) a
       left join (select book_id, arg_max(status, (ts, event_id)) as status from f7 group by book_id) s on s.book_id = a.book_id""",
)
def _(v):
    asked = v.f7.select("book_id").union(v.f7.filter("book_id % 10 = 0").select(-F.col("book_id")))
    return K.latest_status(v.f7, asked)


@query("k4_recent_jobs", "select event_id, status from f7 where status <> 'pending' order by ts desc, event_id desc limit 25")
def _(v):
    return K.recent_jobs(v.f7.filter("status <> 'pending'"), 25).select("event_id", "status")
