"""Question extraction (inventory group E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import extraction as E
from quire.operators.packing import pack_pages
from quire.plans.queries_text import D_SQUEEZE, D_STRIP, D_WORDS
from quire.plans.registry import query

D_START = "(?i)(?:^|\\n)\\s*(?:\\d+[.)]|Q\\.?\\s*\\d+|Question\\s+\\d+)\\s*"
D_BROKEN = "regexp_replace({c}, '(^|[^\\n\\d])(\\d+[.)]\\s*)([A-Za-z])', '\\1' || chr(10) || '\\2\\3', 'g')"
# questions: qs(book_id, page_num, pos, raw, body, stem, letters, vals, qtype, key)
D_QUESTIONS = f"""sp as (select book_id, page_num, doc_id, string_split(regexp_replace({D_BROKEN.format(c='text')}, '({D_START})', chr(1) || '\\1', 'g'), chr(1)) as parts from f3),
  sr as (select book_id, page_num, doc_id, unnest(parts[2:]) as raw, unnest(range(1, len(parts))) as pos from sp),
  sb as (select *, regexp_replace(raw, '(?i)^\\s*(?:\\d+[.)]|Q\\.?\\s*\\d+|Question\\s+\\d+)\\s*', '') as body from sr),
  so as (select *, regexp_extract_all(body, '(?is)\\(([a-d])\\)\\s*([^()]+)', 1) as letters,
      list_transform(regexp_extract_all(body, '(?is)\\(([a-d])\\)\\s*([^()]+)', 2), lambda z: regexp_replace(regexp_replace({D_STRIP.format(c='z')}, '(?is)\\s*(Key|Answer)\\s*:.*$', ''), '[\\s.,;:]+$', '')) as vals,
      regexp_extract(body, '(?is)^(.*?)(?:\\([a-d]\\)|(?:Key|Answer)\\s*:\\s*[a-d]|\\z)', 1) as stem0 from sb),
  qs as (select book_id, page_num, doc_id, pos, raw, body, letters, vals, case when len(list_distinct(letters)) >= 2 then 'mcq' else 'theory' end as qtype,
      {D_STRIP.format(c='stem0')} as stem, lower(nullif(regexp_extract(body, '(?i)(?:Key|Answer)\\s*:\\s*([a-d])', 1), '')) as key from so)"""


@query("e1_break_inline_questions", f"select doc_id, {D_BROKEN.format(c='t')} as text from (select doc_id, replace(text, chr(10), ' ') as t from f3)")
def _(v):
    flat = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    return v.f3.select("doc_id", E.break_inline_questions(flat).alias("text"))


@query("e2_split_questions", f"with {D_QUESTIONS} select book_id, page_num, pos, raw from qs")
def _(v):
    return E.split_questions(v.f3).select("book_id", "page_num", F.col("pos").cast("bigint"), "raw")


@query(
    "e3_parse_mcq",
    f"""with {D_QUESTIONS} select book_id, page_num, pos, qtype as type, stem as question_text,
        case when qtype = 'mcq' then array_to_string(list_transform(letters, lambda l, i: concat(l, ') ', vals[i])), chr(10)) else '' end as options, case when qtype = 'mcq' then key end as answer from qs""",
)
def _(v):
    parsed = E.parse_questions(E.split_questions(v.f3))
    return parsed.select(
        "book_id", "page_num", F.col("pos").cast("bigint"), "type", "question_text", T.options_to_text(F.col("options")).alias("options"), "answer"
    )


@query(
    "e4_assign_qids",
    f"""with {D_QUESTIONS} select book_id, page_num, pos, concat(book_id, '::q', case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end) as qid
      from (select *, row_number() over (partition by book_id order by page_num, pos) as n from qs)""",
)
def _(v):
    ids = E.assign_qids(E.split_questions(v.f3), bank="book_id")
    return ids.select("book_id", "page_num", F.col("pos").cast("bigint"), "qid")


D_CTX = """cx0 as (select book_id, page_num, regexp_extract_all(text, '(?i:section)\\s*(\\p{Lu})', 1) as ss,
     list_filter(list_transform(regexp_extract_all(text, '(?i)\\b(\\d{1,2}(?:\\s+\\d{1,2})?)\\s*marks?\\b', 1), lambda m: regexp_replace(m, '\\s', '', 'g')::int), lambda m: m <> 0) as ms from f3),
  cx as (select book_id, page_num, last_value(ss[-1] ignore nulls) over w as section, last_value(ms[-1] ignore nulls) over w as marks
    from (select book_id, page_num, case when len(ss) > 0 then ss end as ss, case when len(ms) > 0 then ms end as ms from cx0) window w as (partition by book_id order by page_num rows between unbounded preceding and current row))"""


@query("e5_page_section_marks", f"with {D_CTX} select book_id, page_num, section, marks::bigint as marks from cx")
def _(v):
    return E.page_section_marks(v.f3).select("book_id", "page_num", "section", F.col("marks").cast("bigint"))


@query(
    "e6_annotate_questions",
    f"""with {D_QUESTIONS}, {D_CTX} select qs.book_id, qs.page_num, pos, qtype as type, section, case when qtype <> 'mcq' then marks end::bigint as marks
      from qs left join cx on cx.book_id = qs.book_id and cx.page_num = qs.page_num""",
)
def _(v):
    parsed = E.parse_questions(E.split_questions(v.f3))
    out = E.annotate_questions(parsed, E.page_section_marks(v.f3))
    return out.select("book_id", "page_num", F.col("pos").cast("bigint"), "type", "section", F.col("marks").cast("bigint"))


_HDR = "(?i)(?:(\\d+)\\s*[-–]?\\s*marks?|marks?\\s*[-–:]?\\s*(\\d+))"


@query(
    "e7_marks_from_headers",
    f"""with {D_QUESTIONS}, hp as (select book_id, page_num, text, string_split(regexp_replace(text, '({_HDR})', chr(1) || '\\1', 'g'), chr(1)) as ps from f3),
      hh as (select book_id, page_num, text, list_transform(range(2, len(ps) + 1), lambda i: {{'pos0': list_sum(list_transform(ps[1:i - 1], lambda z: length(z)))::bigint, 'marks': coalesce(nullif(regexp_extract(ps[i], '{_HDR}', 1), ''), nullif(regexp_extract(ps[i], '{_HDR}', 2), ''))::int}}) as h from hp),
      pr as (select *, last_value(case when len(h) > 0 then h[-1].marks end ignore nulls) over (partition by book_id order by page_num rows between unbounded preceding and 1 preceding) as prior from hh),
      j as (select qs.book_id, qs.page_num, qs.pos, h, prior, case when stem = '' then -1 when contains(text, substring(stem, 1, 40)) then strpos(text, substring(stem, 1, 40)) - 1 else strpos(lower(text), lower(substring(stem, 1, 40))) - 1 end as a
        from qs join pr on pr.book_id = qs.book_id and pr.page_num = qs.page_num)
      select book_id, page_num, pos, (case when a >= 0 then nullif(coalesce((list_filter(h, lambda z: z.pos0 <= a))[-1].marks, prior), 0) end)::bigint as marks from j""",
)
def _(v):
    parsed = E.parse_questions(E.split_questions(v.f3)).withColumn("marks", F.lit(None).cast("int"))
    out = E.marks_from_headers(parsed, v.f3)
    return out.select("book_id", "page_num", F.col("pos").cast("bigint"), F.col("marks").cast("bigint"))


_CHL = "(?i)^(SECTION|CHAPTER|UNIT|PART)\\s+([IVXLCDM]+|\\d+)\\s*[:.\\-–]?\\s*(.*)"
_QN = "^\\s*(?:Q\\.?\\s*)?\\d+\\s*[.\\):]"
D_SEG = f"""tt as (select book_id, bool_or(regexp_matches(text, '(?i)\\bshort\\s+essay')) as three from f3h group by book_id),
  ln as (select f.book_id, page_num, three, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from f3h f join tt on tt.book_id = f.book_id),
  l2 as (select *, {D_SQUEEZE.format(c='line')} as s, {D_STRIP.format(c='line')} as s1 from ln),
  l3 as (select *, case when length(s) between 1 and 90 and not regexp_matches(s, '{_QN}') and s not like '%?' and regexp_matches(s, '{_CHL}') then
      concat(upper(regexp_extract(s, '{_CHL}', 1)), ' ', regexp_extract(s, '{_CHL}', 2)) end as pre, {D_WORDS.format(c=f"regexp_extract(s, '{_CHL}', 3)")} as tw from l2),
  l4 as (select *, array_to_string(tw[1:coalesce(list_min(list_filter(range(1, len(tw) + 1), lambda i: not regexp_matches(tw[i], '^[A-Z0-9][A-Z0-9,&/''()\\-]*$'))) - 1, len(tw))], ' ') as tl from l3),
  l5 as (select *, case when pre is not null then case when tl = '' then pre else concat(pre, ': ', tl) end end as ch,
      case when pre is null and s1 <> '' and length(s1) <= 55 and not regexp_matches(s1, '{_QN}') and s1 not like '%?' then
        case when regexp_matches(s1, '(?i)\\b(?:3|three)\\s*[-–]?\\s*marks?\\b|\\bvery\\s+short\\s+(?:answer|note)|\\bVSA\\b') then 3
             when regexp_matches(s1, '(?i)\\b(?:10|ten)\\s*[-–]?\\s*marks?\\b|\\blong\\s+answer|\\blong\\s+essay|\\bLAQ\\b') then 10
             when regexp_matches(s1, '(?i)\\b(?:5|five)\\s*[-–]?\\s*marks?\\b|\\bshort\\s+essay|\\bSAQ\\b') then 5
             when regexp_matches(s1, '(?i)\\bshort\\s+answer|\\bshort\\s+notes?\\b') then case when three then 3 else 5 end end end as m from l4),
  l6 as (select *, ch is not null or m is not null as head from l5),
  l7 as (select *, last_value(ch ignore nulls) over w as chapter, last_value(case when head then coalesce(m, 0) end ignore nulls) over w as mk, sum(case when head then 1 else 0 end) over w as segment
     from l6 window w as (partition by book_id order by page_num, line_no rows between unbounded preceding and current row)),
  seg as (select book_id, segment::bigint as segment, page_num, nullif(any_value(mk), 0)::bigint as marks, coalesce(any_value(chapter), '') as chapter, string_agg(line, chr(10) order by line_no) as text from l7 where not head group by book_id, segment, page_num)"""


@query("e8_segment_bank_text", f"with {D_SEG} select book_id, segment, page_num, marks, chapter, text from seg")
def _(v):
    out = E.segment_bank_text(v.f3h)
    return out.withColumn("marks", F.col("marks").cast("bigint"))


@query(
    "e9_pack_lines",
    """with recursive l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from rawp),
       r as (select doc_id, i, line, 1::bigint as b, length(line) + 1 as n from l where i = 1
         union all select l.doc_id, l.i, l.line, case when r.n + length(l.line) + 1 > 400 then r.b + 1 else r.b end, case when r.n + length(l.line) + 1 > 400 then length(l.line) + 1 else r.n + length(l.line) + 1 end
         from r join l on l.doc_id = r.doc_id and l.i = r.i + 1)
       select doc_id, b as batch_no, string_agg(line, chr(10) order by i) as batch from r group by doc_id, b""",
)
def _(v):
    out = E.pack_lines(v.raw.select("doc_id", "text"), max_chars=400)
    return out.select("doc_id", F.col("batch_no").cast("bigint"), "batch")


@query(
    "e9_pack_pages",
    """with recursive s as (select book_id, page_num, length(text) + 2 as n from f1),
       r as (select book_id, page_num, 1::bigint as b, n::bigint as used from s where page_num = 1
         union all select s.book_id, s.page_num, case when r.used + s.n > 9000 then r.b + 1 else r.b end, case when r.used + s.n > 9000 then s.n else r.used + s.n end
         from r join s on s.book_id = r.book_id and s.page_num = r.page_num + 1)
       select book_id, page_num, b as batch_no from r""",
)
def _(v):
    return pack_pages(v.f1)


@query(
    "e10_dedupe_questions",
    f"""with a as (select qid, subject, 0 as src, conv_id * 100 + turn as p, case when conv_id % 9 = 0 then 'abc' else question_text end as t from f4),
       b as (select qid, subject, 1 as src, conv_id * 100 + turn as p, case when conv_id % 5 = 0 then concat(question_text, '  more') else translate(concat(' ', question_text), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') end as t from f4),
       u as (select * from a union all select * from b),
       r as (select *, row_number() over (partition by subject, lower({D_SQUEEZE.format(c='t')}) order by src, p) as rn from u where length(t) >= 4)
       select subject, qid, src::bigint as source_no, t as question_text from r where rn = 1""",
)
def _(v):
    pos = (F.col("conv_id") * 100 + F.col("turn")).alias("p")
    a = v.f4.select("qid", "subject", pos, F.expr("case when conv_id % 9 = 0 then 'abc' else question_text end").alias("question_text"))
    b = v.f4.select("qid", "subject", pos, F.expr("case when conv_id % 5 = 0 then concat(question_text, '  more') else translate(concat(' ', question_text), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') end").alias("question_text"))
    out = E.dedupe_questions([a, b], ["subject"], "p")
    return out.select("subject", "qid", F.col("source_no").cast("bigint"), "question_text")


@query(
    "e10_merge_by_id",
    """with a as (select case when conv_id % 11 = 0 then null when conv_id % 13 = 0 then '' else qid end as qid, subject, 0 as src, conv_id * 100 + turn as p, question_text as t from f4 where conv_id % 3 > 0),
       b as (select qid, subject, 1 as src, conv_id * 100 + turn as p, upper(question_text) as t from f4),
       u as (select subject, coalesce(nullif(qid, ''), 'q' || case when length(p::varchar) < 3 then lpad(p::varchar, 3, '0') else p::varchar end) as qid, src, p, t from (select * from a union all select * from b)),
       r as (select *, row_number() over (partition by subject, qid order by src, p) as rn from u)
       select subject, qid, src::bigint as source_no, t as question_text from r where rn = 1""",
)
def _(v):
    pos = (F.col("conv_id") * 100 + F.col("turn")).alias("p")
    holes = F.expr("case when conv_id % 11 = 0 then null when conv_id % 13 = 0 then '' else qid end").alias("qid")
    a = v.f4.filter("conv_id % 3 > 0").select(holes, "subject", pos, "question_text")
    b = v.f4.select("qid", "subject", pos, T.upper_by_letter(F.col("question_text")).alias("question_text"))
    return E.merge_by_id([a, b], ["subject"], "p").select("subject", "qid", F.col("source_no").cast("bigint"), "question_text")


@query(
    "e11_fill_chapters",
    """with s as (select qid, subject, conv_id * 100 + turn as p, case when conv_id % 7 = 0 then '  Unit   One ' when conv_id % 7 = 1 then 'Short Essays' else '' end as seg, case conv_id % 5 when 0 then 'unknown' when 1 then 'N/A' when 2 then chapter when 3 then 'Long Answers' else null end as own from f4),
       c as (select *, trim(regexp_replace(coalesce(seg, ''), '\\s+', ' ', 'g')) as s1, trim(regexp_replace(coalesce(own, ''), '\\s+', ' ', 'g')) as o1 from s),
       k as (select *, case when s1 in ('', 'Short Essays') then null else s1 end as s2, case when lower(o1) in ('', 'unknown', 'n/a', 'null', 'none', '-') or o1 = 'Long Answers' then null else o1 end as o2 from c)
       select qid, coalesce(last_value(coalesce(s2, o2) ignore nulls) over (partition by subject order by p rows between unbounded preceding and current row), '') as chapter from k""",
)
def _(v):
    rows = v.f4.select(
        "qid", "subject", (F.col("conv_id") * 100 + F.col("turn")).alias("p"),
        F.expr("case when conv_id % 7 = 0 then '  Unit   One ' when conv_id % 7 = 1 then 'Short Essays' else '' end").alias("seg"),
        F.expr("case conv_id % 5 when 0 then 'unknown' when 1 then 'N/A' when 2 then chapter when 3 then 'Long Answers' else null end").alias("own"),
    )
    out = E.fill_chapters(rows, ["subject"], "p", "seg", "own")
    return out.select("qid", F.col("chapter_filled").alias("chapter"))


_ITEM = """concat('{{"question_text": "', qt, '", "marks": ', m, ', "chapter": "a {{b", "options": {{"a": "x}}"}}}}')"""
# Doubled braces: the statement is formatted once, to fill in the table.
_REPLY_SQL = f"""select qid, conv_id, case conv_id % 4
    when 0 then concat('[', {_ITEM}, ', ', {_ITEM}, ']')
    when 1 then concat('```json', chr(10), 'Here: [', {_ITEM}, ']', chr(10), '```')
    when 2 then concat('[', {_ITEM}, ', {{{{"question_text": "cut {{{{ off, "o": {{{{"a": "b"}}}}')
    else concat('Sorry, no questions: ', qt) end as reply
  from (select qid, conv_id, regexp_replace(question_text, '[^A-Za-z ]', '') as qt, cast(coalesce(marks, 3) as string) as m from {{f4}})"""


@query(
    "e12_parse_reply_corpus",
    """with r as (select qid, conv_id, regexp_replace(question_text, '[^A-Za-z ]', '', 'g') as qt, cast(coalesce(marks, 3) as varchar) as m from f4)
       select qid, case conv_id % 4 when 0 then 'clean' when 1 then 'clean' else 'salvaged' end as outcome, i as item_no, qt as question_text, m as marks, 'a {b' as chapter
       from (select *, unnest(case when conv_id % 4 = 0 then [1, 2] else [1] end)::bigint as i from r where conv_id % 4 < 3)
       union all select qid, 'lost', 0, null, null, null from r where conv_id % 4 = 3""",
)
def _(v):
    replies = v.spark.sql(_REPLY_SQL, f4=v.f4)
    parsed = E.parse_replies(replies)
    return parsed.select("qid", "outcome", F.posexplode_outer("items").alias("i", "x")).select(
        "qid", "outcome", F.coalesce(F.col("i") + 1, F.lit(0)).cast("bigint").alias("item_no"), "x.question_text", "x.marks", "x.chapter"
    )


@query(
    "e12_reply_counts",
    """select conv_id % 5 as batch, count_if(conv_id % 4 < 2)::bigint as clean, count_if(conv_id % 4 = 2)::bigint as salvaged, count_if(conv_id % 4 = 3)::bigint as lost from f4 group by 1""",
)
def _(v):
    parsed = E.parse_replies(v.spark.sql(_REPLY_SQL, f4=v.f4))
    return parsed.groupBy((F.col("conv_id") % 5).alias("batch")).agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("clean", "salvaged", "lost")]
    )


@query(
    "e13_question_mix",
    """select subject, count(*) as questions, count_if(type <> 'mcq' and marks = 5)::bigint as five_mark, count_if(type <> 'mcq' and marks = 10)::bigint as ten_mark, count_if(type = 'mcq')::bigint as mcq,
         0::bigint as as_3, count_if(marks = 5)::bigint as as_5, count_if(marks = 10 or marks is null)::bigint as as_10, count(distinct case when chapter <> 'unknown' then chapter end) as chapters
       from (select subject, type, marks, case when conv_id % 6 = 0 then 'unknown' else chapter end as chapter from f4) group by subject""",
)
def _(v):
    bank = v.f4.withColumn("chapter", F.expr("case when conv_id % 6 = 0 then 'unknown' else chapter end"))
    return E.question_mix(bank, ["subject"])
