"""Text cleaning, page scores, question and answer text (inventory group B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import pages as P
from quire.plans.registry import query

# SQL pieces shared by several reference statements.
D_WORDS = "list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"
D_STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
D_SQUEEZE = "regexp_replace(regexp_replace({c}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
D_HF = (
    "array_to_string(list_filter(string_split({c}, chr(10)), lambda x: not regexp_matches("
    + D_STRIP.format(c="x")
    + ", '^(\\d+|Page\\s+\\d+\\s+of\\s+\\d+)$')), chr(10))"
)


def d_letter_spacing(c: str) -> str:
    """Token-position form of the letter-spacing rule, per line."""
    toks = "string_split(s, ' ')"
    single = "regexp_matches(coalesce(t[{i}], ''), '^\\p{{L}}$')"
    s = lambda i: single.format(i=i)
    in_run = (
        f"({s('i')} and (({s('i-1')} and {s('i-2')} and i > 2) or ({s('i-1')} and {s('i+1')} and i > 1) or ({s('i+1')} and {s('i+2')})))"
    )
    joined = f"i > 1 and {in_run} and ({s('i-1')} or regexp_matches(coalesce(t[i-1], ''), '^\\p{{L}}{{2,}}$'))".replace("{{", "{").replace("}}", "}")
    walked = (
        f"array_to_string(list_transform(range(1, len(t) + 1), lambda i: case when i = 1 then t[i] when {joined} then t[i] else concat(' ', t[i]) end), '')"
    )
    per_line = f"""case when len(t) < 3 then x
        when list_bool_and(list_transform(t, lambda w: regexp_matches(w, '^\\p{{L}}$')))
          then case when regexp_matches(array_to_string(t, ''), '\\p{{Lu}}') or length(array_to_string(t, '')) > 8 then array_to_string(t, '') else x end
        else {walked} end""".replace("{{", "{").replace("}}", "}")
    bind_t = f"list_transform([{toks}], lambda t: {per_line})[1]"
    bind_s = f"list_transform([{D_SQUEEZE.format(c='x')}], lambda s: {bind_t})[1]"
    return f"array_to_string(list_transform(string_split({c}, chr(10)), lambda x: {bind_s}), chr(10))"


def d_whitespace(c: str) -> str:
    t = f"regexp_replace({c}, '\\n{{3,}}', chr(10) || chr(10), 'g')".replace("{{", "{").replace("}}", "}")
    t = f"regexp_replace({t}, '[ \\t]+(\\n|$)', '\\1', 'g')"
    t = f"regexp_replace({t}, ' {{2,}}', ' ', 'g')".replace("{{", "{").replace("}}", "}")
    return D_STRIP.format(c=t)


def d_count(c: str, cls: str) -> str:
    return f"length(regexp_replace({c}, '[^{cls}]', '', 'g'))"


def d_gibberish(c: str) -> str:
    """Score of the text expression ``c``."""
    raw = D_STRIP.format(c=c)
    words = D_WORDS.format(c="r")
    body = f"""list_transform([{{'n': length(r)::double, 'alpha': {d_count('r', chr(92) + 'p{L}')}::double, 'digit': {d_count('r', chr(92) + 'p{Nd}')}::double,
      'vow': {d_count('r', 'aeiouAEIOU')}::double,
      'odd': length(regexp_replace(r, '[\\p{{L}}\\p{{N}}\\s.,;:()\\[\\]\\-%/''"]', '', 'g'))::double,
      'wc': length(regexp_replace(r, '\\s', '', 'g'))::double,
      'words': len({words})::double,
      'real': len(list_filter({words}, lambda w: regexp_matches(w, '^\\p{{L}}{{3,}}$')))::double}}],
      lambda m: case when m.n = 0 then 1.0::double when m.n < 20 then 0.85::double else least(1.0::double,
        (case when m.alpha / m.n < 0.30 then 0.55 when m.alpha / m.n < 0.45 then 0.40 when m.alpha / m.n < 0.55 then 0.18 else 0 end)::double
        + (case when m.alpha > 20 and m.vow / greatest(m.alpha, 1) < 0.22 then 0.25 else 0 end)::double
        + (case when m.odd / m.n > 0.25 then 0.35 when m.odd / m.n > 0.12 then 0.22 else 0 end)::double
        + (case when m.words > 0 and m.wc / m.words > 0 and (m.wc / m.words < 2.2 or m.wc / m.words > 18) then 0.15 else 0 end)::double
        + (case when m.real / greatest(m.words, 1) < 0.25 and m.n > 40 then 0.25 else 0 end)::double
        + (case when m.digit / m.n > 0.45 and m.alpha / m.n < 0.3 then 0.1 else 0 end)::double) end)[1]"""
    return f"list_transform([{raw}], lambda r: {body})[1]"


def d_layout(c: str) -> str:
    raw = D_STRIP.format(c=c)
    body = """list_transform([list_filter(list_transform(string_split(r, chr(10)), lambda x: """ + D_STRIP.format(c="x") + """), lambda x: x <> '')],
      lambda ls: list_transform([{'n': len(ls)::double, 'chars': list_sum(list_transform(ls, lambda x: length(x)))::double,
        'short': len(list_filter(ls, lambda x: length(x) <= 28))::double,
        'digit': length(regexp_replace(r, '[^\\p{Nd}]', '', 'g'))::double, 'alpha': length(regexp_replace(r, '[^\\p{L}]', '', 'g'))::double,
        'gaps': len(list_filter(ls, lambda x: regexp_matches(x, '\\S\\s{2,}\\S')))::double,
        'pipes': len(list_filter(ls, lambda x: length(x) - length(replace(x, '|', '')) >= 2 or contains(x, '¦')))::double,
        'rows': len(list_filter(ls, lambda x: list_transform([""" + D_WORDS.format(c="x") + """], lambda w: len(w) >= 4
             and len(list_filter(w, lambda t: regexp_matches(t, '\\p{Nd}'))) >= 2
             and len(list_filter(w, lambda t: regexp_matches(t, '\\p{Nd}'))) / len(w)::double >= 0.35)[1]))::double}],
       lambda m: least(1.0::double,
         (0.28::double * least(1.0::double, m.short / m.n / 0.55::double) + 0.22::double * least(1.0::double, m.gaps / m.n / 0.35::double)
          + 0.18::double * least(1.0::double, m.rows / m.n / 0.25::double) + 0.12::double * least(1.0::double, m.digit / greatest(m.chars, 1) / 0.22::double)
          + 0.10::double * least(1.0::double, m.pipes / m.n / 0.15::double)
          + 0.10::double * (case when m.n >= 25 and m.chars / m.n <= 22 then 1.0 when m.n >= 18 and m.chars / m.n <= 30 then 0.6 else 0 end)::double)
         * (case when m.chars / m.n >= 45 and m.alpha / greatest(m.chars, 1) >= 0.70 and m.digit / greatest(m.chars, 1) < 0.08 then 0.35 else 1 end)::double
         * (case when m.alpha / greatest(m.chars, 1) >= 0.78 and m.short / m.n < 0.25 and m.gaps / m.n < 0.12 then 0.40 else 1 end)::double))[1])[1]"""
    return f"list_transform([{raw}], lambda r: case when length(r) < 40 then 0::double else {body} end)[1]"


@query("b1_strip_header_footer", f"select doc_id, {D_HF.format(c='text')} as text from f2")
def _(v):
    return v.f2.select("doc_id", T.strip_header_footer(F.col("text")).alias("text"))


@query("b2_collapse_letter_spacing", f"select doc_id, {d_letter_spacing('text')} as text from f2")
def _(v):
    return v.f2.select("doc_id", T.collapse_letter_spacing(F.col("text")).alias("text"))


@query("b3_normalize_whitespace", f"select doc_id, {d_whitespace('text')} as text from f2")
def _(v):
    return v.f2.select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


D_CLEAN = d_whitespace(d_letter_spacing(D_HF.format(c="text")))


@query(
    "b4_clean_pages",
    f"select subject, book_id, page_num, doc_id, t as text, cast(length(t) as bigint) as char_count from (select *, {D_CLEAN} as t from f2)",
)
def _(v):
    return P.clean_pages(v.f2).select("subject", "book_id", "page_num", "doc_id", "text", "char_count")


@query(
    "b5_page_quality_flags",
    f"""select doc_id, low_char, high_garble, single_char, low_char or high_garble or single_char as suspect from (
      select doc_id, char_count < 500 as low_char,
        case when length(text) = 0 then 0 else length(regexp_replace(text, '[\\p{{L}}\\p{{N}}]', '', 'g')) / length(text)::double end > 0.30 as high_garble,
        case when len({D_WORDS.format(c='text')}) = 0 then 0 else len(list_filter({D_WORDS.format(c='text')}, lambda w: length(w) = 1)) / len({D_WORDS.format(c='text')})::double end > 0.4 as single_char
      from rawp)""",
)
def _(v):
    return P.page_quality_flags(v.raw).select("doc_id", "low_char", "high_garble", "single_char", "suspect")


@query("b6_gibberish_score", f"select doc_id, round({d_gibberish('text')}, 6) as gibberish from rawp")
def _(v):
    return v.raw.select("doc_id", F.round(T.gibberish_score(F.col("text")), 6).alias("gibberish"))


@query(
    "b7_layout_table_score",
    f"select doc_id, round(s, 4) as score, s >= 0.48 as needs_layout from (select doc_id, {d_layout('text')} as s from rawp)",
)
def _(v):
    scored = v.raw.select("doc_id", T.layout_table_score(F.col("text")).alias("s"))
    return scored.select("doc_id", T.round_binary(F.col("s"), 4).alias("score"), (F.col("s") >= T.LAYOUT_MIN_SCORE).alias("needs_layout"))


@query(
    "b8_classify_page",
    """select doc_id, case when char_count > 500 then 'text' when char_count = 0 and doc_id % 3 = 0 then 'blank' else 'image' end as kind from rawp""",
)
def _(v):
    images = F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.lit(1))
    return v.raw.select("doc_id", T.classify_page(F.col("char_count"), images).alias("kind"))


@query(
    "b9_choose_page_text",
    """with native as (select book_id, doc_id, case when doc_id % 5 = 0 then '' when doc_id % 7 = 0 then 'Scanned page' else text end as text from rawp),
         ocr as (select book_id, doc_id, case when doc_id % 3 = 0 then '' else concat('OCR: ', text) end as text from rawp where doc_id % 2 = 0)
       select n.doc_id,
         case when length(n.text) >= 100 or o.text is null or length(o.text) <= length(n.text) then n.text else o.text end as longer_text,
         case when length(n.text) >= 100 or o.text is null or length(o.text) <= length(n.text) then 'text' else 'ocr' end as longer_method,
         case when length(n.text) >= 100 or o.text is null then 'text' else 'ocr' end as ocr_method
       from native n left join ocr o on n.book_id = o.book_id and n.doc_id = o.doc_id""",
)
def _(v):
    poor = F.expr("case when doc_id % 5 = 0 then '' when doc_id % 7 = 0 then 'Scanned page' else text end")
    native = v.raw.select("book_id", "doc_id", poor.alias("text"))
    ocr = v.raw.filter("doc_id % 2 = 0").select(
        "book_id", "doc_id", F.expr("case when doc_id % 3 = 0 then '' else concat('OCR: ', text) end").alias("text")
    )
    both = P.choose_page_text(native, ocr, on=["book_id", "doc_id"], prefer=("longer", "ocr"))
    return both.select("doc_id", "longer_text", "longer_method", "ocr_method")


_D_BREAK = """list_filter(list_transform(range(0, length(w)), lambda j: case when substring(w, (j + 1)::int, length(pat)) = pat then lo + j + length(pat) else null end), lambda a: a is not null and a > pos)"""


@query(
    "b10_distribute_text",
    """with recursive blocks as (
         select doc_id, regexp_replace(case when doc_id % 2 = 0 then concat(substring(text, 1, 50), chr(12), substring(text, 51, 50), case when doc_id % 4 = 0 then chr(12) else '' end, substring(text, 101)) else text end, '^\\s+|\\s+$', '', 'g') as content,
           [length(text) // 3, 100 + doc_id % 400, length(text) // 2]::bigint[] as lens
         from rawp),
       parts as (select doc_id, content, lens, list_transform(string_split(content, chr(12)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')) as ps from blocks where content <> ''),
       trimmed as (select *, list_filter(range(1, len(ps) + 1), lambda i: ps[i] <> '') as filled from parts),
       sep as (select *, contains(content, chr(12)) and len(filled) > 0 and filled[-1] - filled[1] + 1 = 3 as by_sep from trimmed),
       prop as (select doc_id, content, length(content)::bigint as n,
           list_transform(lens, lambda l: greatest(40, round_even(length(content) * greatest(l, 80) / list_sum(list_transform(lens, lambda z: greatest(z, 80)))::double, 0)::bigint)) as targets
         from sep where not by_sep),
       walk as (
         select doc_id, content, n, targets, 1 as i, 0::bigint as start_pos, 0::bigint as pos from prop
         union all
         select doc_id, content, n, targets, i + 1, pos,
           case when i = 3 then n else
             list_transform([case when best is null then te else best end], lambda b: case when b <= pos then least(n, pos + greatest(1, targets[i])) else b end)[1] end
         from (select *, coalesce(
             list_transform([list_filter(list_transform(range(0, length(w)), lambda j: case when substring(w, (j + 1)::int, 2) = chr(10) || chr(10) then lo + j + 2 else null end), lambda a: a is not null and a > pos)], lambda c: c[list_position(list_transform(c, lambda a: abs(a - te)), list_min(list_transform(c, lambda a: abs(a - te))))])[1],
             list_transform([list_filter(list_transform(range(0, length(w)), lambda j: case when substring(w, (j + 1)::int, 1) = chr(10) then lo + j + 1 else null end), lambda a: a is not null and a > pos)], lambda c: c[list_position(list_transform(c, lambda a: abs(a - te)), list_min(list_transform(c, lambda a: abs(a - te))))])[1],
             list_transform([list_filter(list_transform(range(0, length(w)), lambda j: case when substring(w, (j + 1)::int, 1) = ' ' then lo + j + 1 else null end), lambda a: a is not null and a > pos)], lambda c: c[list_position(list_transform(c, lambda a: abs(a - te)), list_min(list_transform(c, lambda a: abs(a - te))))])[1]) as best
           from (select *, substring(content, (lo + 1)::int, greatest(hi - lo, 0)::int) as w from
             (select *, least(n, pos + targets[i]) as te, greatest(pos + 20, least(n, pos + targets[i]) - 120) as lo, least(n, least(n, pos + targets[i]) + 160) as hi from walk where i <= 3)))
       ),
       pieces as (
         select doc_id, i - 2 as page_off, regexp_replace(substring(content, (start_pos + 1)::int, (pos - start_pos)::int), '^\\s+|\\s+$', '', 'g') as text from walk where i >= 2
         union all
         select doc_id, i - filled[1] as page_off, ps[i] as text from (select doc_id, filled, ps, unnest(filled) as i from sep where by_sep))
       select doc_id, cast(page_off as bigint) as page_off, text from pieces where text <> ''""",
)
def _(v):
    content = F.expr(
        "case when doc_id % 2 = 0 then concat(substring(text, 1, 50), chr(12), substring(text, 51, 50), case when doc_id % 4 = 0 then chr(12) else '' end, substring(text, 101)) else text end"
    )
    lens = F.array((F.length("text") / 3).cast("bigint"), (F.lit(100) + F.col("doc_id") % 400).cast("bigint"), (F.length("text") / 2).cast("bigint"))
    blocks = v.raw.select("doc_id", content.alias("content"), lens.alias("page_lengths"))
    return P.distribute_text(blocks).select("doc_id", F.col("page_off").cast("bigint"), "text")


@query(
    "b11_names_from_paths",
    """select page_id, case when contains(lower(url), 'psm') then 'psm' when contains(lower(stem), 'fmt') or contains(lower(stem), 'forensic') then 'fmt' else 'unknown' end as subject,
        array_to_string(list_transform(regexp_extract_all(lower(replace(stem, '_', ' ')), '\\p{L}*[^\\p{L}]|\\p{L}+$'), lambda p: concat(upper(substring(p, 1, 1)), substring(p, 2))), '') as title,
        case when regexp_replace(stem, '[^\\p{L}\\p{N}._-]', '', 'g') = '' then 'bank' else regexp_replace(stem, '[^\\p{L}\\p{N}._-]', '', 'g') end as safe_id,
        regexp_matches(stem, '^[a-z0-9]+(-[a-z0-9]+)*$') as kebab
      from (select page_id, url, case when regexp_matches(base, '.\\.[^.]*$') then regexp_replace(base, '\\.[^.]*$', '') else base end as stem from
        (select page_id, url, regexp_extract(url, '([^/]*)$', 1) as base from pages))""",
)
def _(v):
    url = F.col("url")
    stem = T.path_stem(url)
    return v.table("pages").select(
        "page_id",
        T.infer_subject(url).alias("subject"),
        T.title_from_path(url).alias("title"),
        T.safe_stem(stem).alias("safe_id"),
        T.is_kebab(stem).alias("kebab"),
    )


# Trigger words that do occur in the questions, in the same shape as the built-in rules.
DEMO_RULES = (
    (r"(?i)\bmanagement\b", "treatment regimen care"),
    (r"(?i)\b(diagnosis|features)\b", "signs criteria"),
    (r"(?i)programme", "NHM scheme"),
)


@query(
    "b12_expand_query",
    """select qid, case when len(h) = 0 then question_text else concat(question_text, chr(10), array_to_string(h, ' ')) end as expanded from (
      select qid, question_text, list_filter([case when regexp_matches(question_text, '(?i)\\bmanagement\\b') then 'treatment regimen care' end,
        case when regexp_matches(question_text, '(?i)\\b(diagnosis|features)\\b') then 'signs criteria' end,
        case when regexp_matches(question_text, '(?i)programme') then 'NHM scheme' end], lambda x: x is not null) as h from f4)""",
)
def _(v):
    return v.f4.select("qid", T.expand_query(F.col("question_text"), DEMO_RULES).alias("expanded"))


_RULE_HITS = ", ".join("case when regexp_matches(question_text, '{}') then '{}' end".format(*rule) for rule in T.QUERY_RULES)


@query(
    "b12_expand_query_rules",
    f"""select qid, case when len(h) = 0 then question_text else concat(question_text, chr(10), array_to_string(h, ' ')) end as expanded from (
      select qid, question_text, list_filter([{_RULE_HITS}], lambda x: x is not null) as h from f4)""",
)
def _(v):
    return v.f4.select("qid", T.expand_query(F.col("question_text")).alias("expanded"))


D_MULTIPART = """(length({c}) - length(replace({c}, '?', '')) >= 2
   or regexp_matches({c}, '(?i)\\b(a\\)|b\\)|c\\)|\\(a\\)|\\(b\\)|\\(c\\)|part\\s*[abc123]|section\\s*[abc])\\b')
   or regexp_matches({c}, '(?i)\\?\\s*(Mention|Outline|Enumerate|Describe|Explain|List|Write|Discuss)\\b')
   or len(regexp_extract_all({c}, '(?i)\\b(Mention|Outline|Enumerate|Describe|Explain|List|Define|What are|What is)\\b')) >= 2)"""


@query("b13_is_multipart", f"select qid, {D_MULTIPART.format(c='question_text')} as multipart from f4")
def _(v):
    return v.f4.select("qid", T.is_multipart(F.col("question_text")).alias("multipart"))


_D_CODEISH = """list_transform([regexp_replace(x, '^[,.;:]+|[,.;:]+$', '', 'g')], lambda z: z = '' or (not list_contains(string_split('IPC MTP CRPC BNS BNSS POCSO NDPS DNA HIV STD MCI NMC AIDS MLC FIR IEA PNDT ICU CPR ECG', ' '), upper(z)) and regexp_matches(z, '[\\d()]|^[A-Za-z]{1,3}$')))[1]"""


@query(
    "b14_clean_question_text",
    f"""with q as (select qid, concat(cast(conv_id % 7 as varchar), '. ', question_text, case conv_id % 5 when 0 then ' 275 Jo7(OS)' when 1 then ' CA 31, D02 IPC' when 2 then ' 14 J15(RS3) Doa.' else '' end) as t from f4),
       w as (select qid, regexp_replace({D_SQUEEZE.format(c='t')}, '^\\s*\\d{{1,3}}\\s*[.)]\\s*', '') as t from q),
       ws as (select qid, {D_WORDS.format(c='t')} as words from w),
       cutp as (select qid, words, coalesce(list_max(list_filter(range(1, len(words) + 1), lambda i: not list_transform([words[i]], lambda x: {_D_CODEISH})[1])), 0) as last_real from ws),
       c as (select qid, words, list_max(list_filter(range(1, len(words) + 1), lambda i: i < len(words) and i >= last_real and regexp_matches(regexp_replace(words[i], '^[.,]+|[.,]+$', '', 'g'), '^\\d{{2,3}}$'))) as cut_at from cutp),
       b as (select qid, words, cut_at, case when cut_at is not null then regexp_replace(array_to_string(words[1:cut_at - 1 - (case when cut_at > 1 and upper(words[cut_at - 1]) in ('CA', 'CN') then 1 else 0 end)], ' '), '[ .,;:]+$', '') end as body from c)
       select qid, trim(case when cut_at is null then array_to_string(words, ' ') when body <> '' and not regexp_matches(body, '[?.]$') then concat(body, '.') else body end) as question_text from b""",
)
def _(v):
    noisy = F.expr(
        "concat(cast(conv_id % 7 as string), '. ', question_text, case conv_id % 5 when 0 then ' 275 Jo7(OS)' when 1 then ' CA 31, D02 IPC' when 2 then ' 14 J15(RS3) Doa.' else '' end)"
    )
    return v.f4.select("qid", T.clean_question_text(noisy).alias("question_text"))


def d_drop(flag: str, start: str, rounds: int) -> str:
    k = "coalesce(list_max(list_filter(range(1, k + 1), lambda i: f[i].filled)), 0)"
    return f"""list_reduce(list_concat([({start})::bigint], range(1, {rounds} + 1)), lambda k, step: list_transform([{k}], lambda z: case when z > 0 and f[z].{flag} then z - 1 else z end)[1])"""


_D_UNF = """list_transform([{'s': regexp_replace(x, '^\\s+|\\s+$', '', 'g')}], lambda u: {'filled': u.s <> '',
   'unf': u.s = '' or regexp_matches(x, '^\\s*[•\\-–—*]\\s*$')
     or regexp_matches(u.s, '(?i)\\b(and|or|with|include|includes|including|such as|e\\.g\\.|i\\.e\\.|is|are|was|were|to|of|for|the|a|an|in|on|by|as|from|that|which|this|these|those|its|their|has|have|had|be|been|being)\\s*$')
     or (regexp_matches(x, '^\\s*[•\\-–—*]\\s+\\S') and not regexp_matches(u.s, '[.!?…:)\\]]\\s*$|\\*\\*\\s*$') and length(u.s) < 80)
     or (not regexp_matches(u.s, '[.!?…:)\\]]\\s*$|\\*\\*\\s*$') and length(u.s) < 40 and not u.s like '%**'),
   'hd': regexp_matches(x, '^\\s*(\\*\\*[^*].+\\*\\*|#{1,3}\\s+\\S|[A-Z][A-Za-z0-9 /&-]{2,60})\\s*$') and not regexp_matches(x, '^\\s*[•\\-–—*]\\s+\\S')})[1]"""


@query(
    "b15_tidy_answer",
    f"""with l as (select qid, string_split(answer_text, chr(10)) as ls from f5),
       fl as (select qid, ls, list_transform(ls, lambda x: {_D_UNF}) as f from l),
       k1 as (select qid, ls, f, {d_drop('unf', 'len(ls)', 12)} as k1 from fl),
       k2 as (select qid, ls, {d_drop('hd', 'k1', 4)} as k2 from k1)
       select qid, regexp_replace(regexp_replace(regexp_replace(array_to_string(ls[1:k2], chr(10)), '\\s+$', ''), '(\\.\\.\\.|…)\\s*$', ''), '\\s+$', '') as answer_text from k2""",
)
def _(v):
    return v.f5.select("qid", T.tidy_answer(F.col("answer_text")).alias("answer_text"))


_CUT_BOLD = """concat(answer_text, case conv_id % 7 when 0 then concat(chr(10), '- give **fluids and') when 1 then concat(chr(10), '- one two three four five six **cou')
  when 2 then concat(chr(10), '• one two three four five. **cou ') when 3 then concat(' **open', repeat(' far away', 12)) when 4 then ' ***' when 5 then concat(chr(10), '* stub **a** b **') else '' end)"""


@query(
    "b15_close_open_bold",
    f"""with a as (select qid, regexp_replace({_CUT_BOLD}, '\\s+$', '') as t from f5),
       b as (select qid, t, regexp_extract(t, '(?s)^(.*)\\*\\*', 1) as before, len(string_split(t, '**')) % 2 = 0 as odd from a),
       c as (select qid, t, odd and length(t) - length(before) <= 80 as cut, regexp_replace(before, '\\s+$', '') as body from b),
       d as (select *, string_split(body, chr(10)) as ls, {D_STRIP.format(c='string_split(body, chr(10))[-1]')} as last from c),
       e as (select *, regexp_matches(last, '^[•\\-–—*]') and (len({D_WORDS.format(c="regexp_replace(last, '^[•\\-–—*]\\s*', '')")}) < 5 or not regexp_matches(last, '[.!?:)\\]"]$')) as stump from d)
       select qid, case when not cut then t when stump then regexp_replace(array_to_string(ls[1:len(ls) - 1], chr(10)), '\\s+$', '') else body end as answer_text from e""",
)
def _(v):
    return v.f5.select("qid", T.close_open_bold(F.expr(_CUT_BOLD)).alias("answer_text"))


@query(
    "b16_merge_split_tokens",
    """with t as (select doc_id, unnest(string_split(text, ' ')) as tok, generate_subscripts(string_split(text, ' '), 1) as i from rawp),
       p as (select *, regexp_matches(tok, '^\\p{L}{1,2}$') and coalesce(regexp_matches(lead(tok) over w, '^\\p{Ll}\\p{L}*$'), false) as pair from t window w as (partition by doc_id order by i)),
       g as (select *, i - sum(case when pair then 1 else 0 end) over (partition by doc_id order by i) as isl from p),
       r as (select *, case when pair then row_number() over (partition by doc_id, isl, pair order by i) end as pos from g),
       m as (select *, coalesce(pair and pos % 2 = 1, false) as glued from r)
       select doc_id, rtrim(string_agg(case when glued then tok else concat(tok, ' ') end, '' order by i), ' ') as text
       from m group by doc_id""",
)
def _(v):
    return v.raw.select("doc_id", F.rtrim(T.merge_split_tokens(F.col("text"))).alias("text"))


@query(
    "b18_options_to_text",
    """select doc_id, concat('a) ', 'alpha', chr(10), 'b) ', text, chr(10), 'c) ', source) as options_text from documents""",
)
def _(v):
    opts = F.create_map(
        F.lit("c"), F.col("source"), F.lit("a"), F.lit("alpha"), F.lit("b"), F.col("text")
    )
    return v.table("documents").select("doc_id", T.options_to_text(opts).alias("options_text"))


@query("b19_estimate_tokens", "select doc_id, cast(length(text) // 4 as bigint) as tokens from rawp")
def _(v):
    return v.raw.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))
