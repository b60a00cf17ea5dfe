"""Streams drained to the end and compared with the batch result (inventory group L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import validation as H
from quire.plans.queries_cache import D_STALE, MODEL, cached, kb
from quire.plans.queries_evaluation import scratch
from quire.plans.queries_text import D_WORDS
from quire.plans.queries_validation import d_report
from quire.plans.registry import query
from quire.streaming import operators as ST
from quire.streaming import runs as R

CUTS = ["2024-01-09", "2024-01-16", "2024-01-24"]


def run(v, steps, stream_of, mode, sink=None):
    """Feed tables to a stream step by step, stopping it in between, and return the folder of its output.

    A step is a list of tables, one for each input of the stream; each is appended as many files as Spark makes
    of it.  Every step starts the stream anew from its checkpoint.
    """
    out, ckpt, inbox = scratch(v, "stream-out"), scratch(v, "stream-ckpt"), scratch(v, "inbox")
    for step in steps:
        inputs = []
        for i, df in enumerate(step):
            df.write.mode("append").parquet(f"{inbox}/{i}")
            inputs.append(R.open_stream(v.spark, f"{inbox}/{i}", df.schema, None))
        R.drain(stream_of(*inputs), ckpt, (sink or R.batch_sink)(out), mode)
    return out


def log_steps(v):
    """The ingest log in time order."""
    log = v.f7.withColumn("ts", F.col("ts").cast("timestamp"))
    lo = ["timestamp'1900-01-01'", *[f"timestamp'{c}'" for c in CUTS]]
    hi = [*[f"timestamp'{c}'" for c in CUTS], "timestamp'2900-01-01'"]
    return [[log.filter(f"ts >= {a} and ts < {b}")] for a, b in zip(lo, hi)]


def stamps(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


@query(
    "l1_stream_ingest_pages",
    f"""select sha256(text) as content_sha, greatest(1, ceil((n - 60) / 240.0))::bigint as n_chunks from (select text, max(len({D_WORDS.format(c='text')})) as n from rawp where text <> '' group by text) where n > 0""",
)
def _(v):
    v = v.for_streams()
    pages = v.raw.select("doc_id", "text")
    steps = [[pages.filter(f"doc_id % 4 = {i}")] for i in range(4)]
    out = run(v, steps, ST.new_contents, "append", lambda p: ST.ingest_sink(p, 300, 60))
    return v.spark.read.parquet(out).groupBy("content_sha").agg(F.count(F.lit(1)).alias("n_chunks"))


@query("l2_stream_status", "select book_id, arg_max(status, (ts, event_id)) as status from f7 group by book_id")
def _(v):
    v = v.for_streams()
    out = run(v, log_steps(v), ST.stream_status, "update")
    return R.latest_per_key(v.spark, out, ["book_id"]).select("book_id", "status")


@query(
    "l3_stream_activity_tumbling",
    """select strftime(time_bucket(interval '6 hours', ts), '%Y-%m-%d %H:%M:%S') as start, status, count(*) as n, round(max(percent), 6) as max_percent from f7 group by 1, 2""",
)
def _(v):
    v = v.for_streams()
    out = run(v, log_steps(v), lambda log: ST.stream_activity(log, "6 hours"), "update")
    rows = R.latest_per_key(v.spark, out, ["start", "status"])
    return stamps(rows, "start").select("start", "status", "n", F.round("max_percent", 6).alias("max_percent"))


@query(
    "l3_stream_activity_sliding",
    """select strftime(b - s * interval '6 hours', '%Y-%m-%d %H:%M:%S') as start, status, count(*) as n from (select time_bucket(interval '6 hours', ts) as b, status, unnest([0, 1]) as s from f7) group by 1, 2""",
)
def _(v):
    v = v.for_streams()
    out = run(v, log_steps(v), lambda log: ST.stream_activity(log, "12 hours", "6 hours"), "update")
    return stamps(R.latest_per_key(v.spark, out, ["start", "status"]), "start").select("start", "status", "n")


@query(
    "l3_stream_sessions",
    """with g as (select book_id, ts, case when ts - lag(ts) over (partition by book_id order by ts, event_id) < interval '8 hours' then 0 else 1 end as fresh, event_id from f7),
       s as (select *, sum(fresh) over (partition by book_id order by ts, event_id) as sid from g),
       w as (select book_id, min(ts) as a, max(ts) + interval '8 hours' as b, count(*) as n from s group by book_id, sid)
       select book_id, strftime(a, '%Y-%m-%d %H:%M:%S') as start, n from w where b <= (select max(ts) - interval '1 hour' from f7)""",
)
def _(v):
    v = v.for_streams()
    out = run(v, log_steps(v), lambda log: ST.stream_sessions(log, "8 hours"), "append")
    return stamps(v.spark.read.parquet(out), "start").select("book_id", "start", "n")


@query(
    "l4_stream_job_state",
    """with s as (select book_id, arg_min(struct_pack(status := status, percent := percent), (ts, event_id)) filter (where status in ('succeeded', 'failed')) as t, arg_max(struct_pack(status := status, percent := percent), (ts, event_id)) as l from f7 group by book_id)
       select book_id, coalesce(t, l).status as status, round(least(100.0, greatest(0.0, coalesce(t, l).percent)), 6) as percent from s""",
)
def _(v):
    v = v.for_streams()
    out = run(v, log_steps(v), ST.stream_job_state, "update")
    rows = R.latest_per_key(v.spark, out, ["book_id"])
    return rows.select("book_id", "status", F.round("percent", 6).alias("percent"))


def answer_steps(df):
    return [[df.filter(f"conv_id % 3 = {i}")] for i in range(3)]


@query("l5_stream_stale", f"with {D_STALE} select qid, len(reasons) > 0 as stale, array_to_string(reasons, ',') as stale_reasons from sr")
def _(v):
    v = v.for_streams()
    # Revisions rise while answers arrive; the last bump comes when all answers are open.
    bumps = [kb(v).withColumn("revision", F.greatest(F.lit(0), F.col("revision") - n)) for n in (2, 1, 0)]
    steps = [[answers, bump] for (answers,), bump in zip(answer_steps(cached(v)), bumps)]
    out = run(v, steps, lambda a, b: ST.stream_staleness(a, b, MODEL), "update")
    rows = R.latest_per_key(v.spark, out, ["qid"])
    return rows.select("qid", "stale", F.array_join("stale_reasons", ",").alias("stale_reasons"))


_BLUEPRINT_RULES = ("WordCount", "RequiredSections", "BlueprintCompliance", "EvidenceCoverage")


@query("l6_stream_validate", f"{d_report(_BLUEPRINT_RULES)} select qid, passed, round(score, 6) as score, failed_rules from rep")
def _(v):
    v = v.for_streams()
    summary = lambda answers: H.validation_summary(ST.stream_validate(answers, disabled=_BLUEPRINT_RULES))
    out = run(v, answer_steps(v.f5h), summary, "append")
    return v.spark.read.parquet(out).select("qid", "passed", F.round("score", 6).alias("score"), "failed_rules")
