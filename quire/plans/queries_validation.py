"""Answer validation and answer blocks (inventory group H and B17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import lexicon as L
from quire.operators import blocks as B
from quire.operators import planning as Q
from quire.operators import validation as H
from quire.plans.queries_questions import D_BP
from quire.plans.queries_retrieval import D_ASCII
from quire.plans.queries_text import D_STRIP, D_WORDS
from quire.plans.registry import query


def d_list(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


_COLON = "'^(\\s*)([A-Z][A-Za-z][A-Za-z0-9 /&-]{0,60}?):\\s*(.*)$'"
_BOLD = "'^\\s*\\*\\*([^*]{2,80})\\*\\*\\s*$'"
_TITLE = "'^\\s*([A-Z][A-Za-z0-9][A-Za-z0-9 /&-]{1,60})\\s*$'"
_HEAD = f"""case when not regexp_matches(line, '\\S') or regexp_matches(line, '^\\s*[•\\-–—*]\\s+') then null
   when regexp_matches(line, {_COLON}) then trim(regexp_extract(line, {_COLON}, 2))
   when regexp_matches(line, {_BOLD}) then {D_STRIP.format(c=f"regexp_extract(line, {_BOLD}, 1)")}
   when regexp_matches(line, {_TITLE}) and len({D_WORDS.format(c=f"regexp_extract(line, {_TITLE}, 1)")}) <= 10 then trim(regexp_extract(line, {_TITLE}, 1)) end"""


def d_sec(src: str) -> str:
    """CTE ``sec(qid, sno, name, norm, content)`` over an answers view."""
    return f"""hl as (select qid, unnest(string_split(answer_text, chr(10))) as line, generate_subscripts(string_split(answer_text, chr(10)), 1) as i from {src}),
  hh as (select *, {_HEAD} as hd from hl),
  hs as (select *, sum(case when hd is not null then 1 else 0 end) over (partition by qid order by i) as sno from hh),
  sec as (select qid, sno::bigint as sno, max(hd) as name, lower(trim(max(hd))) as norm, {D_STRIP.format(c="string_agg(line, chr(10) order by i)")} as content from hs where sno > 0 group by qid, sno)"""


D_SEC = d_sec("f5h")
# blueprint per answer: bpa(qid, section_no, name, norm, words, required)
D_BPA = f"{D_BP}, bpa as (select f5h.qid, bp.section_no, bp.name, lower(bp.name) as norm, bp.words from f5h join bp on bp.qid = f5h.qid where f5h.conv_id % 6 <> 5), hasb as (select qid, count(*) as nb from bpa group by qid)"


def answers(v):
    planned = Q.plan_answer(v.f4).select("qid", F.col("sections").alias("blueprint"))
    joined = v.f5h.join(planned, "qid", "left")
    return joined.withColumn("blueprint", F.when(F.col("conv_id") % 6 != 5, F.col("blueprint")))


def only(v, rule):
    df = answers(v) if rule in ("WordCount", "RequiredSections", "BlueprintCompliance", "EvidenceCoverage") else v.f5h
    return H.rule_rows(df, rules={rule: H.RULES[rule]})


@query("h0_split_sections", f"with {D_SEC} select qid, sno as section_no, name, norm, content from sec")
def _(v):
    return H.section_rows(v.f5h).select("qid", F.col("section_no").cast("bigint"), "name", "norm", "content")


def d_rule(name: str, issues: str, src: str = "f5h", extra: str = "") -> str:
    """Rows of a rule whose issues are a list expression over ``src``."""
    return f"select qid, '{name}' as rule, case when len(x) > 0 then 'fail' else 'pass' end as severity, len(x)::bigint as n_issues, array_to_string(x, ';') as detail from (select *, list_filter({issues}, lambda z: z is not null) as x from {src} {extra})"


D_H1 = d_rule(
    "Formatting",
    "[case when contains(answer_text, chr(10) || chr(10) || chr(10)) then 'blank lines' end, case when regexp_matches(answer_text, '[ \\t\\r\\f]+(\\n|$)') then 'trailing whitespace' end]",
)
D_H2 = "select f5h.qid, 'HeadingStructure' as rule, case when count(sec.sno) = 0 then 'warn' else 'pass' end as severity, (count(sec.sno) = 0)::bigint as n_issues, count(sec.sno)::varchar as detail from f5h left join sec on sec.qid = f5h.qid group by f5h.qid"
D_H3 = "select f5h.qid, 'DuplicateSection' as rule, case when count(d.norm) > 0 then 'fail' else 'pass' end as severity, count(d.norm) as n_issues, coalesce(string_agg(d.norm || '=' || d.n, ';' order by d.norm), '') as detail from f5h left join (select qid, norm, count(*) as n from sec group by qid, norm having count(*) > 1) d on d.qid = f5h.qid group by f5h.qid"
D_H4 = "select qid, 'EmptySection' as rule, 'pass' as severity, 0::bigint as n_issues, '' as detail from f5h"


def d_blueprint_rule(name: str, body: str) -> str:
    return f"select qid, '{name}' as rule, case when nb is null then 'warn' else severity end as severity, case when nb is null then 0 else n_issues end::bigint as n_issues, case when nb is null then 'no blueprint' else detail end as detail from (select f5h.qid, hasb.nb from f5h left join hasb on hasb.qid = f5h.qid) z left join ({body}) y using (qid)"


D_LASTSEC = "ls as (select qid, norm, max_by(content, sno) as content from sec group by qid, norm)"
D_H5 = d_blueprint_rule(
    "WordCount",
    f"""select b.qid, case when count(bad) > 0 then 'fail' else 'pass' end as severity, count(bad) as n_issues, coalesce(string_agg(bad, ';' order by section_no), '') as detail from (
      select bpa.qid, bpa.section_no, case when words > 0 and ls.qid is not null and (len({D_WORDS.format(c='ls.content')}) < floor(words * (1 - 0.10::double)) or len({D_WORDS.format(c='ls.content')}) > floor(words * (1 + 0.10::double))) then concat(bpa.name, ':', len({D_WORDS.format(c='ls.content')})) end as bad
      from bpa left join ls on ls.qid = bpa.qid and ls.norm = bpa.norm) b group by b.qid""",
)
_MISS = "select bpa.qid, case when count(*) filter (where s.norm is null) > 0 then 'fail' else 'pass' end as severity, count(*) filter (where s.norm is null) as n_issues, coalesce(string_agg(bpa.name, ';' order by {order}) filter (where s.norm is null), '') as detail from bpa left join (select distinct qid, norm from sec) s on s.qid = bpa.qid and s.norm = bpa.norm group by bpa.qid"
D_H6 = d_blueprint_rule("RequiredSections", _MISS.format(order="section_no"))
D_H7 = d_blueprint_rule(
    "BlueprintCompliance",
    f"select m.qid, m.severity, m.n_issues, case when m.severity = 'fail' then m.detail else concat('extra=', coalesce(e.extra, '')) end as detail from ({_MISS.format(order='bpa.norm')}) m left join (select s.qid, string_agg(s.norm, ',' order by s.norm) as extra from (select distinct qid, norm from sec) s left join bpa on bpa.qid = s.qid and bpa.norm = s.norm where bpa.qid is null group by s.qid) e on e.qid = m.qid",
)
D_H8 = d_blueprint_rule(
    "EvidenceCoverage",
    f"select f5h.qid, case when count(sec.sno) = 0 then 'warn' else 'pass' end as severity, 0 as n_issues, coalesce(string_agg(len(list_distinct(regexp_extract_all({D_ASCII.format(c='sec.content')}, '\\b(?:chunk[_-]?)?([A-Za-z0-9]{{6,16}})\\b', 1)))::varchar, ',' order by sno), 'no sections') as detail from f5h left join sec on sec.qid = f5h.qid group by f5h.qid",
)
_CITE = "'(?i)(?:\\bchunk[_-]([A-Za-z0-9]{4,24})\\b|\\[(?:chunk[_-]?)?([A-Za-z0-9]{6,24})\\])'"
D_H9 = f"""select qid, 'ReferenceConsistency' as rule, case when count(bad) > 0 then 'fail' else 'pass' end as severity, count(bad) as n_issues, coalesce(string_agg(bad, ';' order by sno), '') as detail from (
    select qid, sno, case when len(c) <> len(list_distinct(c)) then name end as bad from (
      select qid, sno, name, list_transform(regexp_extract_all(content, {_CITE}, 1), lambda a, i: lower(concat(a, regexp_extract_all(content, {_CITE}, 2)[i]))) as c from sec)) group by qid"""
D_H10 = f"""select qid, 'ScopeLength' as rule, case when marks is null then 'warn' when w > hi or w < lo then 'fail' else 'pass' end as severity, case when marks is null then 0 when w > hi or w < lo then 1 else 0 end::bigint as n_issues,
     case when marks is null then 'no marks' else concat(w, ',', lo, ',', hi) end as detail from (
   select qid, marks, w, hi, case when t > 0 and lo1 >= hi then floor(hi * 0.7::double)::bigint else lo1 end as lo from (
    select qid, marks, w, t, case when t > 0 then least(hi0, floor(t * case when band = 10 then 1.12::double when band = 5 then 1.22::double else 1.10::double end)::bigint) else hi0 end as hi,
      case when t > 0 then greatest(lo0, floor(t * case when band = 5 then 0.64::double else 0.70::double end)::bigint) else lo0 end as lo1 from (
     select *, case band when 3 then 80 when 5 then 240 else 520 end as lo0, case band when 3 then 220 when 5 then 460 else 850 end as hi0 from (
      select qid, marks, coalesce(target_words, 0) as t, len({D_WORDS.format(c='answer_text')}) as w, case when marks <= 3 then 3 when marks <= 5 then 5 else 10 end as band from f5h))))"""
_ASC = D_ASCII.format(c="answer_text")
_DENY = "list_filter([" + ", ".join(f"case when regexp_matches({D_ASCII.format(c='upper(answer_text)')}, '\\b{d}\\b') then '{d}' end" for d in L.DENIED_NAMES) + "], lambda z: z is not null)"
D_H11 = f"""select qid, 'Grounding' as rule, case when not has_src then case when len(deny) > 0 then 'fail' else 'warn' end when len(deny) + len(acr) + len(ttl) > 0 then 'fail' else 'pass' end as severity,
     case when not has_src then len(deny) else len(deny) + len(acr) + len(ttl) end::bigint as n_issues,
     case when not has_src then case when len(deny) > 0 then array_to_string(deny, ';') else 'no source' end else array_to_string(list_concat(list_concat(deny, acr), ttl), ';') end as detail from (
   select qid, coalesce(trim(source_text), '') <> '' as has_src, {_DENY} as deny,
     list_filter(list_sort(list_distinct(regexp_extract_all({_ASC}, '\\b([A-Z]{{3,8}})\\b', 1))), lambda a: not list_contains({d_list([*L.ALLOWED_NAMES, *L.DENIED_NAMES])}, a) and not contains(upper(coalesce(source_text, '')), a)) as acr,
     list_filter(list_sort(list_distinct(regexp_extract_all({_ASC}, '\\b([A-Z][A-Za-z]+(?:\\s+[A-Z][A-Za-z]+){{0,5}}\\s+(?:Yojana|Scheme|Programme|Program|Mission))\\b', 1))), lambda t: not contains(upper(coalesce(source_text, '')), upper(t))
       and len(list_filter({d_list(L.KNOWN_TITLES)}, lambda k: contains(k, lower(regexp_replace(t, '\\s+', ' ', 'g'))) or contains(lower(regexp_replace(t, '\\s+', ' ', 'g')), k))) = 0
       and not (contains(upper(coalesce(source_text, '')), upper(regexp_extract(t, '^(\\S+)', 1))) and regexp_matches(upper(coalesce(source_text, '')), 'YOJANA|SCHEME|PROGRAMME|PROGRAM|MISSION'))) as ttl
   from f5h)"""
D_H12 = d_rule(
    "Truncation",
    """[case when len(string_split(t, '```')) % 2 = 0 then 'code fence' end,
     case when regexp_matches(t, '(?i)\\b(and|or|with|include|includes|including|such as|e\\.g\\.|i\\.e\\.|is|are|was|were|to|of|for|the|a|an|in|on|by|as|from|that|which|this|these|those|has|have|had|be|been|being)\\s*$') then 'open ending' end,
     case when regexp_matches(t, '[•\\-–—]\\s*$') then 'empty bullet' end,
     case when regexp_matches(lastl, '^[•\\-–—*]\\s+\\S') and not regexp_matches(lastl, '[.!?…:)\\]]\\s*$|\\*\\*\\s*$') and length(lastl) < 80 then 'cut bullet' end,
     case when t like '%...' or t like '%…' then 'ellipsis' end]""",
    src=f"(select qid, t, {D_STRIP.format(c='string_split(t, chr(10))[-1]')} as lastl from (select qid, regexp_replace(answer_text, '\\s+$', '') as t from f5h))",
)

_CTES = f"with {D_SEC}, {D_LASTSEC}, {D_BPA} "
_RULE_SQL = {
    "Formatting": D_H1,
    "HeadingStructure": D_H2,
    "DuplicateSection": D_H3,
    "EmptySection": D_H4,
    "WordCount": D_H5,
    "RequiredSections": D_H6,
    "BlueprintCompliance": D_H7,
    "EvidenceCoverage": D_H8,
    "ReferenceConsistency": D_H9,
    "ScopeLength": D_H10,
    "Grounding": D_H11,
    "Truncation": D_H12,
}
_RULE_KEYS = {
    "h1_formatting": "Formatting",
    "h2_heading_structure": "HeadingStructure",
    "h3_duplicate_section": "DuplicateSection",
    "h4_empty_section": "EmptySection",
    "h5_word_count": "WordCount",
    "h6_required_sections": "RequiredSections",
    "h7_blueprint_compliance": "BlueprintCompliance",
    "h8_evidence_coverage": "EvidenceCoverage",
    "h9_reference_consistency": "ReferenceConsistency",
    "h10_scope_length": "ScopeLength",
    "h11_grounding": "Grounding",
    "h12_truncation": "Truncation",
}


def _register(key: str, rule: str) -> None:
    query(key, f"{_CTES} select qid, rule, severity, n_issues, detail from ({_RULE_SQL[rule]})")(lambda v: only(v, rule))


for _key, _rule in _RULE_KEYS.items():
    _register(_key, _rule)


def d_report(skip=()) -> str:
    parts = " union all ".join(
        f"select qid, {i} as ord, rule, severity from ({sql})" for i, (n, sql) in enumerate(_RULE_SQL.items()) if n not in skip
    )
    return f"""{_CTES}, ru as ({parts}),
      rep as (select qid, count_if(severity = 'fail') = 0 as passed, (count_if(severity = 'pass') + 0.5::double * count_if(severity = 'warn')) / count(*) as score,
        coalesce(string_agg(rule, ',' order by ord) filter (where severity = 'fail'), '') as failed_rules, coalesce(string_agg(rule, ',' order by ord) filter (where severity = 'warn'), '') as warned_rules,
        count_if(severity = 'pass')::bigint as info_count, count(*) as rule_count from ru group by qid)"""


@query("h13_validate", f"{d_report()} select qid, passed, round(score, 6) as score, failed_rules, warned_rules from rep")
def _(v):
    out = H.validation_summary(H.validate(answers(v)))
    return out.select("qid", "passed", F.round("score", 6).alias("score"), "failed_rules", "warned_rules")


@query(
    "h13_validate_with_disabled_rules",
    f"{d_report(('Grounding', 'ScopeLength'))} select qid, passed, round(score, 6) as score, failed_rules from rep",
)
def _(v):
    out = H.validation_summary(H.validate(answers(v), disabled=["Grounding", "ScopeLength"]))
    return out.select("qid", "passed", F.round("score", 6).alias("score"), "failed_rules")


@query("h14_validation_summary", f"{d_report()} select qid, passed, round(score, 6) as score, failed_rules, warned_rules, info_count, rule_count from rep")
def _(v):
    return H.validation_summary(H.validate(answers(v))).withColumn("score", F.round("score", 6))


@query(
    "h15_eval_expectations",
    f"""{d_report()}, cases as (select qid, conv_id % 3 = 1 as expect_pass, case conv_id % 4 when 0 then ['Grounding'] when 1 then ['Truncation', 'DuplicateSection'] else []::varchar[] end as any_of from f5)
      select c.qid, coalesce(passed = expect_pass, false) and (len(any_of) = 0 or len(list_intersect(any_of, string_split(failed_rules, ','))) > 0) as as_expected from cases c left join rep on rep.qid = c.qid""",
)
def _(v):
    cases = v.f5.select(
        "qid",
        (F.col("conv_id") % 3 == 1).alias("expect_pass"),
        F.expr("case conv_id % 4 when 0 then array('Grounding') when 1 then array('Truncation', 'DuplicateSection') else cast(array() as array<string>) end").alias("expect_failed_any"),
    )
    return H.eval_expectations(H.validate(answers(v)), cases).select("qid", "as_expected")


_BLOCKY = """concat(answer_text, case conv_id % 3 when 0 then concat(chr(10), '| a | b |', chr(10), '|---|:-:|', chr(10), '| 1 | 2', chr(10), 'x | y |', chr(10), 'After the table', chr(10), 'goes on.', chr(10))
   when 1 then concat(chr(10), '```dot', chr(10), 'digraph {', chr(10), chr(10), 'a -> b }', chr(10), '```', chr(10), '- sub item', chr(10), '• main item', chr(10), '### Title ###', chr(10), '* star item', chr(10), 'one line;', chr(10), 'two line;')
   else concat(chr(10), '```graphviz', chr(10), 'open | ended', chr(10), '|--|') end)"""


@query(
    "b17_answer_blocks",
    f"""with recursive a as (select qid, {_BLOCKY} as t from f5),
      l as (select qid, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from a),
      s as (select *, {D_STRIP.format(c='line')} as st from l),
      f as (select *, contains(st, '-') and contains(st, '|') and list_bool_and(list_transform(string_split(regexp_replace(st, '^\\|+|\\|+$', '', 'g'), '|'), lambda c: regexp_matches(c, '^\\s*:?-+:?\\s*$'))) as sep,
         regexp_matches(line, '(?i)^\\s*`{{3,}}\\s*(dot|graphviz)\\s*$') as opens, regexp_matches(line, '^\\s*`{{3,}}\\s*$') as closes,
         array_to_string(list_transform(string_split(regexp_replace(st, '^\\||\\|$', '', 'g'), '|'), lambda c: {D_STRIP.format(c='c')}), ' | ') as trow,
         case when st = '' then 'blank' when regexp_matches(st, '^\\*\\*\\s*(.+?)\\s*\\*\\*[:.]?$') then 'heading'
           when regexp_matches(line, '^\\s*([•\\-–—])\\s*(.*)$') then case when regexp_extract(line, '^\\s*([•\\-–—])\\s*(.*)$', 1) = '•' then 'main_bullet' else 'sub_bullet' end
           when regexp_matches(line, '^\\s*([*+])\\s+(.*)$') then 'main_bullet'
           when regexp_matches(st, '^#{{1,6}}\\s*(.+?)\\s*#{{0,6}}$|^([A-Z][A-Za-z0-9 \\-/&,''()–—]{{1,80}})$') and not regexp_matches(st, '[.:;]$') then 'heading' else 'paragraph' end as kind from s),
      g as (select *, case when kind = 'heading' and regexp_matches(st, '^\\*\\*\\s*(.+?)\\s*\\*\\*[:.]?$') then trim(regexp_extract(st, '^\\*\\*\\s*(.+?)\\s*\\*\\*[:.]?$', 1))
           when kind = 'heading' then regexp_replace(regexp_replace(st, '^#+\\s*', ''), '\\s*#+$', '')
           when kind in ('main_bullet', 'sub_bullet') then case when regexp_matches(line, '^\\s*([•\\-–—])\\s*(.*)$') then trim(regexp_extract(line, '^\\s*([•\\-–—])\\s*(.*)$', 2)) else trim(regexp_extract(line, '^\\s*([*+])\\s+(.*)$', 2)) end
           else st end as content, contains(line, '|') and coalesce(lead(sep) over (partition by qid order by i), false) as head from f),
      r as (select qid, 0 as i, ''::varchar as mode, 0 as b, null::varchar as bk, null::varchar as piece from (select distinct qid from g)
        union all
        select g.qid, g.i::int,
          case when r.mode = 'fence' and closes then '' when r.mode = 'fence' then 'fence' when r.mode = 'head' then 'table' when r.mode = 'table' and st <> '' and contains(line, '|') and not sep then 'table'
            when opens then 'fence' when head then 'head' when kind = 'blank' then '' else kind end,
          case when r.mode in ('fence', 'head') or (r.mode = 'table' and st <> '' and contains(line, '|') and not sep) then r.b when opens or head then r.b + 1 when kind = 'blank' then r.b when kind = 'paragraph' and r.mode = 'paragraph' then r.b else r.b + 1 end,
          case when r.mode = 'fence' then 'diagram' when r.mode = 'head' or (r.mode = 'table' and st <> '' and contains(line, '|') and not sep) then 'table' when opens then 'diagram' when head then 'table' when kind = 'blank' then null else kind end,
          case when r.mode = 'fence' then case when closes then null else line end when r.mode = 'head' then null when r.mode = 'table' and st <> '' and contains(line, '|') and not sep then trow
            when opens then null when head then trow when kind = 'blank' then null else content end
        from r join g on g.qid = r.qid and g.i = r.i + 1)
      select qid, b::bigint as block_no, max(bk) as kind, coalesce(case when max(bk) in ('diagram', 'table') then string_agg(piece, chr(10) order by i) else string_agg(piece, ' ' order by i) end, '') as content
      from r where b > 0 and bk is not null group by qid, b""",
)
def _(v):
    shown = v.f5.select("qid", F.expr(_BLOCKY).alias("answer_text"))
    return B.answer_blocks(shown)
