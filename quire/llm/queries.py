"""The registered queries of this package and the SQL that some of them are compared with.

Each query applies one operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, exact_dedup, jaccard, knn, language, packing, quality, queries_corpus, secrets, substrings, url_rules

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules(spark: SparkSession) -> DataFrame:
    rows = ", ".join(str(r) for r in RULES)
    return spark.sql(f"select * from values {rows} as rules(action, host, path)")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS)
    decoded = bpe.decode(coded.select("doc_id", "ids"), RANKS)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.report(table(spark, sf_dir, "embeddings"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), rules(spark), keys=("page_id",))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_exact_topk": op3_exact_topk,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_packing": op7_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_secret_scans": op9_secret_scans,
    "op10_language_id": op10_language_id,
    **queries_corpus.QUERIES,
}

OP2 = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents
), starts_ as (
  select doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) as h
  from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w where len(words) >= 50)
), gone as (
  select doc_id, list(distinct i + k) as places
  from (select doc_id, i, min(doc_id) over (partition by h) as first_ from starts_), range(0, 50) r(k)
  where first_ < doc_id group by doc_id
), marked as (
  select w.doc_id, words, coalesce(places, []) as places from w left join gone using (doc_id)
), cut as (
  select doc_id, len(words) as n_words, len(places) as n_removed, words, list_filter(range(1, len(words) + 1), lambda i: not list_contains(places, i)) as stays from marked
)
select doc_id, cast(n_words as bigint) as n_words, cast(n_removed as bigint) as n_removed,
  sha256(array_to_string(list_transform(stays, lambda i: words[i]), ' ')) as kept_sha256
from cut
"""

OP3 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) as bigint) as score
  from v q join v d on q.vec_id % 100 = 0 and d.vec_id <> q.vec_id
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
)
select * from r where rank <= 10
"""

OP5 = r"""
with t as (
  select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents
), w as (
  select doc_id, norm,
    first_value(doc_id) over best as keep_id,
    count(*) over (partition by norm) as group_size,
    row_number() over best = 1 as kept
  from t window best as (partition by norm order by length(text) desc, doc_id)
)
select doc_id, keep_id, group_size, kept, sha256(norm) as text_sha256 from w
"""

OP6 = rf"""
with rules(action, rhost, rpath) as (values {", ".join(str(r) for r in RULES)}),
p as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages
), f as (
  select p.*, rhost || rpath as rule, action,
    row_number() over (partition by page_id order by length(rhost || rpath) desc nulls last) as place
  from p left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from f where place = 1
"""


def _spans_sql(kind: int, pattern: str, test: str) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
  select doc_id, {kind} as kind, m, g, cast(before as int) as start_, cast(before + length(m) as int) as end_ from (
    select doc_id, ms[i] as m, gs[i] as g,
      list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as before
    from (
      select doc_id, ms, gs, gaps, unnest(range(1, len(ms) + 1)) as i from (
        select doc_id, regexp_extract_all(text, {p}, 0) as ms, regexp_extract_all(text, {p}, {2 if kind == 0 else 0}) as gs,
          regexp_split_to_array(text, {p}) as gaps
        from t where regexp_matches(text, {p}))
    )) where {test}"""


def _op9() -> str:
    import math

    unit = secrets.UNIT
    cases = []
    for pattern, w, bits in secrets.CLASSES.values():
        cost = "[" + ", ".join(str(round(c * math.log2(c) * unit)) for c in range(1, w + 1)) + "]"
        most = math.floor(w * (math.log2(w) - bits) * unit)
        cases.append((pattern, w, cost, most))
    parts, earlier = [], ""
    for pattern, w, cost, most in cases:
        parts.append(f"""
  select doc_id, start_ + o as lo, {w} as w, start_ as c from (
    select doc_id, start_, o, string_split(substring(m, cast(o + 1 as int), {w}), '') as chars from (
      select doc_id, start_, m, unnest(range(0, length(m) - {w} + 1)) as o from candidates
      where regexp_matches(m, '{pattern}') {earlier}))
  where list_sum(list_transform(list_distinct(chars), lambda c: {cost}[len(list_filter(chars, lambda x: x = c))])) <= {most}""")
        earlier += f" and not regexp_matches(m, '{pattern}')"
    allowed = " or ".join(f"regexp_matches(m, '{p}')" for p in secrets.ALLOWED)
    kinds = "['assign', 'access', 'hex', 'entropy']"
    return rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
base as ({_spans_sql(0, secrets.ASSIGN, "length(g) >= 12")}
  union all {_spans_sql(1, secrets.ACCESS, "length(m) >= 18")}
  union all {_spans_sql(2, secrets.HEX, "length(m) >= 16")}),
candidates as (select * from ({_spans_sql(3, secrets.CANDIDATE, "true")}) where not ({allowed})),
windows as ({" union all ".join(parts)}),
fresh as (
  select *, coalesce(cast(lo > lag(lo + w) over (partition by doc_id, c order by lo) as int), 1) as new_ from windows
), islands as (
  select *, sum(new_) over (partition by doc_id, c order by lo) as island from fresh
), spans as (
  select doc_id, kind, start_, end_ from base
  union all
  select doc_id, 3, min(lo), max(lo + w) from islands group by doc_id, c, island
), listed as (
  select doc_id, kind, start_, end_, {kinds}[kind + 1] || ':' || start_ || ':' || end_ as s from spans
)
select doc_id,
  count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
  sha256(coalesce(string_agg(s, ',' order by start_, kind) filter (kind < 3), '')) as base_sha256,
  coalesce(string_agg(s, ',' order by start_, kind) filter (s is not null), '') as spans
from t left join listed using (doc_id) group by doc_id
"""


ORACLES: dict[str, str] = {
    "op2_substring_dedup": OP2,
    "op3_exact_topk": OP3,
    "op5_exact_dedup": OP5,
    "op6_url_filters": OP6,
    "op9_secret_scans": _op9(),
    **queries_corpus.ORACLES,
}
