"""Question analysis and planning (inventory group Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import lexicon as L
from quire.operators import planning as Q
from quire.plans.registry import query


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d_sections(col: str, entries) -> str:
    hits = ", ".join(f"case when regexp_matches({col}, {sql_text(e.pattern)}) then '{e.name}' end" for e in entries)
    return f"list_filter([{hits}], lambda s: s is not null)"


D_TARGETS = d_sections("question_text", L.profile("question"))
_PLANNER = {e.name: e for e in L.profile("planner")}
D_PLANNED = d_sections("question_text", [_PLANNER[n] for n in L.PLAN_ORDER if n in _PLANNER])
D_STRUCT = "[" + ", ".join(sql_text(n) for n in L.STRUCTURE_SECTIONS) + "]"
D_PSTRUCT = "[" + ", ".join(sql_text(n) for n in L.PLAN_STRUCTURE) + "]"

# analysed questions: aq(qid, subject, marks, question_text, targets, top_k, names)
D_AQ = f"""aq as (select *, case when marks = 5 then 5 else 8 end as top_k, case when len(targets) between 1 and 2 then targets else []::varchar[] end as names
   from (select qv.*, ({D_TARGETS})[1:4] as targets from qv))"""

# blueprint rows: bp(qid, subject, marks, type, section_no, name, category, words, metadata, n)
D_BP = f"""det as (select qid, subject, type, marks, case when marks = 5 then 475 else 775 end as target, ({D_PLANNED})[1:case when marks = 5 then 3 else 7 end] as names from f4),
  sized as (select *, round_even(target * 0.15::double, 0)::bigint as intro, round_even(target * 0.10::double, 0)::bigint as concl, len(names) as n from det),
  body as (select *, target - intro - concl as words_left from sized),
  bp as (
    select qid, subject, type, marks, 1 as section_no, 'introduction' as name, 'framing' as category, case when n = 0 then intro + words_left else intro end as words, null::varchar as metadata from body where type = 'theory'
    union all
    select qid, subject, type, marks, i + 1, replace(replace(names[i], 'section_', ''), '_', ' '), case when list_contains({D_PSTRUCT}, names[i]) then 'structure' else 'medical' end,
       words_left // n + case when i <= words_left - (words_left // n) * n then 1 else 0 end, names[i]
      from (select *, unnest(range(1, n + 1)) as i from body where type = 'theory')
    union all
    select qid, subject, type, marks, n + 2, 'conclusion', 'framing', concl, null from body where type = 'theory'
    union all
    select qid, subject, type, marks, 1, 'answer', 'framing', 0, null from body where type = 'mcq')"""


@query("q1_analyze_questions", f"select qid, array_to_string(({D_TARGETS})[1:4], ',') as target_sections from f4")
def _(v):
    return Q.analyze_questions(v.f4).select("qid", F.array_join("target_sections", ",").alias("target_sections"))


@query(
    "q2_retrieval_plan",
    f"""select qid, 'adaptive' as strategy, cast(case when marks = 5 then 5 else 8 end as bigint) as top_k,
       case when len(t) between 1 and 2 then array_to_string(list_filter(t, lambda s: list_contains({D_STRUCT}, s)), ',') else '' end as structure,
       case when len(t) between 1 and 2 then array_to_string(list_filter(t, lambda s: not list_contains({D_STRUCT}, s)), ',') else '' end as medical
     from (select qid, marks, ({D_TARGETS})[1:4] as t from f4)
     union all select qid, 'identity', 8, '', '' from f4""",
)
def _(v):
    analyzed = Q.analyze_questions(v.f4)

    def show(strategy):
        planned = Q.retrieval_plan(analyzed, strategy)
        structure, medical = Q.split_filter(F.col("filter_names"))
        return planned.select(
            "qid",
            F.lit(strategy).alias("strategy"),
            F.col("top_k").cast("bigint").alias("top_k"),
            F.array_join(structure, ",").alias("structure"),
            F.array_join(medical, ",").alias("medical"),
        )

    return show("adaptive").unionByName(show("identity"))


@query(
    "q3_plan_answer",
    f"with {D_BP} select qid, cast(section_no as bigint) as section_no, name, category, cast(words as bigint) as words, metadata from bp",
)
def _(v):
    rows = Q.blueprint_sections(Q.plan_answer(v.f4))
    return rows.select(
        "qid", F.col("section_no").cast("bigint"), "name", "category", F.col("words").cast("bigint"), "metadata"
    )


@query(
    "q4_validate_plan_input",
    """select qid, case when coalesce(question_text, '') = '' then 'question_text is required' when coalesce(subject, '') = '' then 'subject is required'
         when type is null or type not in ('theory', 'mcq') then 'unknown question type' when marks is not null and marks not in (5, 10) then 'marks must be 5, 10 or absent' end as reject_reason
       from (select qid, case when conv_id % 11 = 0 then '' else question_text end as question_text, case when conv_id % 13 = 0 then null else subject end as subject,
         case when conv_id % 17 = 0 then 'essay' else type end as type, case when conv_id % 19 = 0 then 3 else marks end as marks from f4)""",
)
def _(v):
    broken = v.f4.selectExpr(
        "qid",
        "case when conv_id % 11 = 0 then '' else question_text end as question_text",
        "case when conv_id % 13 = 0 then null else subject end as subject",
        "case when conv_id % 17 = 0 then 'essay' else type end as type",
        "case when conv_id % 19 = 0 then 3 else marks end as marks",
    )
    return Q.validate_plan_input(broken).select("qid", "reject_reason")


@query(
    "q5_required_categories",
    f"with {D_BP} select qid, coalesce(string_agg(distinct metadata, ',' order by metadata), '') as categories from bp group by qid",
)
def _(v):
    planned = Q.plan_answer(v.f4)
    return planned.select("qid", F.array_join(Q.required_categories(F.col("sections")), ",").alias("categories"))


@query(
    "q6_section_retrieval_spec",
    f"""with {D_BP} select qid, cast(section_no as bigint) as section_no, name, metadata as filter_name,
        case when metadata is null then null when list_contains({D_STRUCT}, metadata) then 'structure' else 'medical' end as filter_group,
        cast(0 as bigint) as priority, cast(1 as bigint) as min_chunks, cast(3 as bigint) as max_chunks,
        coalesce(string_agg(metadata, ',') over (partition by qid order by section_no rows between unbounded preceding and unbounded following), '') as evidence_categories
      from bp""",
)
def _(v):
    planned = Q.plan_answer(v.f4)
    planned = planned.withColumn("evidence", F.array_join(Q.evidence_categories(F.col("sections")), ","))
    spec = Q.section_retrieval_spec(planned)
    long = lambda c: F.col(c).cast("bigint").alias(c)
    return spec.select(
        "qid", long("section_no"), "name", "filter_name", "filter_group", long("priority"), long("min_chunks"), long("max_chunks"),
        F.col("evidence").alias("evidence_categories"),
    )


@query(
    "q7_stage_trace",
    f"""with {D_BP}, b as (select qid, string_agg(name, '|' order by section_no) as names, cast(sum(words) as bigint) as words from bp group by qid),
      p as (select b.qid, names, words, f4.marks, cast(len(({D_TARGETS})[1:4]) as int) as n from b join f4 on f4.qid = b.qid)
      select qid, 1::bigint as stage_no, 'planner' as stage, concat('{{"words":', cast(words as varchar), '}}') as output from p
      union all select qid, 2, 'blueprint', concat('{{"sections":"', names, '"}}') from p
      union all select qid, 3, 'retrieval', concat('{{"top_k":', case when marks = 5 then '5' else '8' end, ',"targets":', cast(n as varchar), '}}') from p
      union all select qid, 4, 'reranker', '{{"metadata":"boost","semantic":"identity"}}' from p
      union all select qid, 5, 'writer', '{{"long_words":750,"short_words":375}}' from p
      union all select qid, 6, 'validator', '{{"rule_count":12}}' from p""",
)
def _(v):
    planned = Q.retrieval_plan(Q.analyze_questions(Q.plan_answer(v.f4)))
    words = F.aggregate("sections", F.lit(0), lambda a, s: a + s["words"])
    names = F.array_join(F.transform("sections", lambda s: s["name"]), "|")
    stages = {
        "planner": F.to_json(F.struct(words.alias("words"))),
        "blueprint": F.to_json(F.struct(names.alias("sections"))),
        "retrieval": F.to_json(F.struct("top_k", F.size("target_sections").alias("targets"))),
        "reranker": F.to_json(F.struct(F.lit("boost").alias("metadata"), F.lit("identity").alias("semantic"))),
        "writer": F.to_json(F.struct(F.lit(750).alias("long_words"), F.lit(375).alias("short_words"))),
        "validator": F.to_json(F.struct(F.lit(12).alias("rule_count"))),
    }
    return Q.stage_trace(planned, stages).withColumn("stage_no", F.col("stage_no").cast("bigint"))


@query(
    "q8_select_questions",
    """select qid, case when chapter = '' then 'unknown' else chapter end as chapter, cast(rm as bigint) as resolved_marks from (
        select qid, case when conv_id % 10 = 0 then '' else upper(chapter) end as chapter, case when marks in (3, 5, 10) then marks else 10 end as rm,
          regexp_replace(question_text, '^\\s+|\\s+$', '', 'g') as t from f4)
      where t <> '' and rm in (5, 10) and lower(chapter) in ('ch1', 'ch3', '')
      and contains(lower(case when chapter = '' then 'unknown' else chapter end), 'n')
      union all
      select qid, case when chapter = '' then 'unknown' else chapter end, cast(rm as bigint) from (
        select qid, case when conv_id % 10 = 0 then '' else upper(chapter) end as chapter, case when marks in (3, 5, 10) then marks else 10 end as rm,
          regexp_replace(question_text, '^\\s+|\\s+$', '', 'g') as t from f4)
      where t <> '' and rm = 10""",
)
def _(v):
    bank = v.f4.withColumn("chapter", F.expr("case when conv_id % 10 = 0 then '' else upper(chapter) end"))
    a = Q.select_questions(bank, marks=[5, 10], chapters=["ch1", "CH3", ""], chapter_like="N")
    b = Q.select_questions(bank, marks=[10])
    return a.unionByName(b).select("qid", "chapter", F.col("resolved_marks").cast("bigint"))
