"""Retrieval and reranking (inventory group G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import lexicon as L
from quire.functions import text as T
from quire.operators import planning as Q
from quire.operators import balls
from quire.operators import retrieval as G
from quire.plans.queries_questions import D_AQ, D_BP
from quire.plans.queries_text import D_MULTIPART
from quire.plans.registry import query

FLAGS = ("section_management", "section_etiology", "section_diagnosis", "section_diagram", "section_classification")

D_DIST = "list_sum(list_transform(list_zip({a}, {b}), lambda z: pow(z[1]::double - z[2]::double, 2)))"
D_DIST_QC = D_DIST.format(a="q.qvec", b="c.embedding")
D_FLAGS = "list_filter([" + ", ".join(f"case when {f} then '{f}' end" for f in FLAGS) + "], lambda s: s is not null)"

# chunks with their true flags: fc(chunk_id, subject, embedding, text, book_id, flags)
D_FC = f"fc as (select *, {D_FLAGS} as flags from f6)"
# filtered hits of analysed questions: h(qid, chunk_id, dist, rk, targets, flags, text, ...)
D_H = f"""{D_AQ}, {D_FC},
  h as (select * from (select q.qid, q.marks, q.question_text, q.targets, q.top_k, q.names, c.chunk_id, c.flags, c.text, {D_DIST_QC} as dist,
      row_number() over (partition by q.qid order by {D_DIST_QC}, c.chunk_id) as rk
    from aq q join fc c on q.subject = c.subject and (len(q.names) = 0 or len(list_intersect(q.names, c.flags)) > 0)) where rk <= top_k),
  hb as (select *, len(list_intersect(targets, flags)) as matches, dist * pow(0.67::double, len(list_intersect(targets, flags))) as boosted from h),
  hr as (select *, row_number() over (partition by qid order by matches desc, boosted, rk) as brk from hb)"""

_STOP = "[" + ", ".join(f"'{w}'" for w in L.STOPWORDS if len(w) > 3) + "]"
D_ASCII = "regexp_replace({c}, '[^\\x00-\\x7F\\PL]', '_', 'g')"


def d_keywords(c: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all({D_ASCII.format(c=c)}, '\\b[A-Za-z][A-Za-z0-9-]{{3,}}\\b'), lambda t: lower(t)), lambda t: not list_contains({_STOP}, t))"
    ).replace("{{", "{").replace("}}", "}")


def planned(v):
    return Q.retrieval_plan(Q.analyze_questions(v.qv))


D_NEAREST = f"""select qid, chunk_id, round(dist, 6) as distance, rk as rank from (
      select q.qid, c.chunk_id, {D_DIST_QC} as dist, row_number() over (partition by q.qid order by {D_DIST_QC}, c.chunk_id) as rk
      from qv q join f6 c on q.subject = c.subject) where rk <= 8"""


@query("g1_knn_topk", D_NEAREST)
def _(v):
    hits = G.knn_topk(v.qv, v.f6, 8)
    return hits.select("qid", "chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint"))


@query("g1_ball_index_topk", D_NEAREST)
def _(v):
    hits = balls.ball_topk(v.qv, balls.ball_index(v.f6, rows_per_ball=64), 8)
    return hits.select("qid", "chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint"))


@query("g2_metadata_filter", "select chunk_id, subject from f6 where section_management or section_diagram")
def _(v):
    return G.metadata_filter(v.f6, ["section_management", "section_diagram"]).select("chunk_id", "subject")


@query("g3_per_question_k", f"with {D_H} select qid, chunk_id, round(dist, 6) as distance, rk as rank from h")
def _(v):
    hits = G.knn_topk(planned(v), v.f6, "top_k", "filter_names", FLAGS)
    return hits.select("qid", "chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint"))


@query("g3_ball_index_per_question_k", f"with {D_H} select qid, chunk_id, round(dist, 6) as distance, rk as rank from h")
def _(v):
    hits = balls.ball_topk(planned(v), balls.ball_index(v.f6, FLAGS, rows_per_ball=64), "top_k", "filter_names")
    return hits.select("qid", "chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint"))


@query(
    "g4_metadata_boost",
    f"with {D_H} select qid, chunk_id, cast(matches as bigint) as matches, round(boosted, 6) as distance, brk as rank from hr",
)
def _(v):
    p = planned(v)
    hits = G.knn_topk(p, v.f6, "top_k", "filter_names", FLAGS)
    out = G.metadata_boost(hits.join(p.select("qid", "target_sections"), "qid"), FLAGS)
    return out.select(
        "qid",
        "chunk_id",
        F.col("matches").cast("bigint"),
        F.round("boosted", 6).alias("distance"),
        F.col("boost_rank").cast("bigint").alias("rank"),
    )


D_HEUR = f"""{D_H}, {D_BP},
  req as (select qid, list(metadata) filter (where metadata is not null) as cats from bp group by qid),
  sc as (select hr.*, coalesce(len(list_intersect(req.cats, hr.flags)), 0) > 0 as section_match,
      len(list_filter(list_distinct({d_keywords('question_text')}), lambda w: contains(lower(coalesce(hr.text, '')), w))) as kw
    from hr left join req on req.qid = hr.qid),
  sc2 as (select *, ((case when section_match then 1.0 else 0.0 end)::double + 0.5::double * kw) / greatest(1.0::double, ln(length(coalesce(text, '')) + exp(1.0::double))) as score from sc),
  sc3 as (select *, row_number() over (partition by qid order by score desc, brk) as rr from sc2)"""


@query(
    "g5_heuristic_rerank",
    f"with {D_HEUR} select qid, chunk_id, round(score, 6) as score, cast(kw as bigint) as keyword_matches, section_match, rr as rank from sc3 where rr <= 5",
)
def _(v):
    p = planned(v)
    cats = Q.plan_answer(v.f4).select("qid", Q.required_categories(F.col("sections")).alias("required_categories"))
    out = G.retrieve(p.join(cats, "qid"), v.f6, FLAGS, "heuristic", top_n=5)
    return out.select(
        "qid",
        "chunk_id",
        F.round("score", 6).alias("score"),
        F.col("keyword_matches").cast("bigint"),
        "section_match",
        F.col("final_rank").cast("bigint").alias("rank"),
    )


@query(
    "g6_identity_and_truncate",
    f"""with {D_H} select 'identity' as mode, qid, chunk_id from h where rk <= 3
        union all select 'identity_all', qid, chunk_id from h
        union all select 'truncate', qid, chunk_id from h where rk <= 2""",
)
def _(v):
    hits = G.knn_topk(planned(v), v.f6, "top_k", "filter_names", FLAGS)
    mode = lambda df, m: df.select(F.lit(m).alias("mode"), "qid", "chunk_id")
    return (
        mode(G.identity_rerank(hits, top_n=3), "identity")
        .unionByName(mode(G.identity_rerank(hits, top_n=0), "identity_all"))
        .unionByName(mode(G.truncate_top_n(hits, 2), "truncate"))
        .unionByName(mode(G.truncate_top_n(hits, 0), "truncate_none"))
    )


@query(
    "g7_retrieve",
    f"""with {D_H} select qid, chunk_id, cast(top_k as bigint) as top_k, len(names) > 0 as filter_active, array_to_string(targets, ',') as target_sections,
        round(boosted, 6) as distance, brk as rank from hr""",
)
def _(v):
    out = G.retrieve(planned(v), v.f6, FLAGS)
    return out.select(
        "qid",
        "chunk_id",
        F.col("top_k").cast("bigint"),
        "filter_active",
        F.array_join("target_sections", ",").alias("target_sections"),
        F.round("boosted", 6).alias("distance"),
        F.col("final_rank").cast("bigint").alias("rank"),
    )


@query(
    "g8_section_evidence",
    f"""with {D_BP}, {D_FC},
      w as (select bp.qid, bp.section_no, bp.metadata, q.subject, q.qvec from bp join qv q on q.qid = bp.qid where bp.metadata is not null),
      n as (select * from (select q.qid, q.section_no, c.chunk_id, row_number() over (partition by q.qid, q.section_no order by {D_DIST_QC}, c.chunk_id) as rk
        from w q join fc c on q.subject = c.subject and list_contains(c.flags, q.metadata)) where rk <= 3)
      select w.qid, cast(w.section_no as bigint) as section_no, w.metadata as filter_name, count(n.chunk_id) as n_chunks,
        coalesce(string_agg(n.chunk_id, ',' order by n.rk), '') as chunk_ids, count(n.chunk_id) >= 1 as satisfied
      from w left join n on w.qid = n.qid and w.section_no = n.section_no group by w.qid, w.section_no, w.metadata""",
)
def _(v):
    spec = Q.section_retrieval_spec(Q.plan_answer(v.qv))
    out = G.section_evidence(spec, v.qv, v.f6, FLAGS)
    return out.select("qid", F.col("section_no").cast("bigint"), "filter_name", "n_chunks", "chunk_ids", "satisfied")


_PROBE_SQL = "select concat('probe-', subject) as qid, subject, first_vec as probe_vec from (select subject, min(vec_id) as first_vec from f6 group by subject)"


@query(
    "g9_retrieval_probe",
    f"""with p as ({_PROBE_SQL}), q as (select p.qid, p.subject, e.embedding as qvec from p join embeddings e on e.vec_id = p.probe_vec),
      h as (select * from (select q.subject, c.book_id, row_number() over (partition by q.qid order by {D_DIST_QC}, c.chunk_id) as rk from q join f6 c on q.subject = c.subject) where rk <= 5),
      books as (select distinct subject, book_id from f6)
      select b.subject, b.book_id, (select count(*) from h where h.subject = b.subject) as hits, (select count(*) from h where h.subject = b.subject and h.book_id = b.book_id) as from_book from books b""",
)
def _(v):
    f6 = v.f6
    first = f6.groupBy("subject").agg(F.min_by("embedding", "vec_id").alias("qvec"))
    probes = first.select(F.concat(F.lit("probe-"), "subject").alias("qid"), "subject", "qvec")
    books = f6.select("subject", "book_id").distinct()
    return G.retrieval_probe(probes, f6, books)


@query(
    "g10_build_context",
    f"""with {D_H}, ctx as (select qid, string_agg(substring(coalesce(text, ''), 1, 2500), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by brk) as context, count(*) as n_chunks from hr where brk <= 8 group by qid),
      t as (select qid, question_text, coalesce(marks, 10) as m, case when coalesce(marks, 10) = 5 then 375 else 750 end as target from qv)
      select t.qid, coalesce(context, '') as context, coalesce(n_chunks, 0) as n_chunks, cast(floor(target * case when m = 5 then 0.64::double else 0.70::double end) as bigint) as lower_words,
        cast(floor(target * case when m = 5 then 1.18::double else 1.12::double end) as bigint) as upper_words,
        case when m >= 10 and {D_MULTIPART.format(c='question_text')} then greatest(180, cast(floor(target * 0.28::double) as bigint)) end as part_words
      from t left join ctx on ctx.qid = t.qid""",
)
def _(v):
    p = planned(v)
    hits = G.with_text(G.retrieve(p, v.f6, FLAGS), v.f6)
    ctx = G.build_context(hits, "final_rank")
    marks = F.coalesce("marks", F.lit(10))
    target = F.when(marks == 5, F.lit(L.ANSWER_TARGETS[5])).otherwise(F.lit(L.ANSWER_TARGETS[10]))
    low, high = G.word_band(marks, target)
    return v.qv.join(ctx, "qid", "left").select(
        "qid",
        F.coalesce("context", F.lit("")).alias("context"),
        F.coalesce("n_chunks", F.lit(0)).cast("bigint").alias("n_chunks"),
        low.alias("lower_words"),
        high.alias("upper_words"),
        G.multipart_floor(marks, target, T.is_multipart(F.col("question_text"))).alias("part_words"),
    )


@query(
    "g11_output_budget",
    """select qid, cast(case when m <= 3 or w <= 150 then floor(w * 1.30::double) + 100 when m <= 5 or w <= 400 then floor(w * 1.30::double) + 200 else floor(w * 1.40::double) + 200 end as bigint) as max_tokens
      from (select qid, marks as m0, w, coalesce(marks, case when w >= 500 then 10 else 5 end) as m from (select qid, marks, case when conv_id % 4 = 0 then 125 when conv_id % 4 = 1 then 375 when conv_id % 4 = 2 then 750 else 500 end as w from f4))""",
)
def _(v):
    target = F.expr("case conv_id % 4 when 0 then 125 when 1 then 375 when 2 then 750 else 0 end")
    return v.f4.select("qid", Q.output_budget(F.col("marks"), target).alias("max_tokens"))


@query("g12_mean_hit_distance", f"with {D_H} select qid, round(avg(dist), 6) as mean_distance from h group by qid")
def _(v):
    hits = G.knn_topk(planned(v), v.f6, "top_k", "filter_names", FLAGS)
    return G.mean_hit_distance(hits).select("qid", F.round("mean_distance", 6).alias("mean_distance"))


