"""The registered queries of operators 11 to 13 and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import merkle, mixing, periodic


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checksum(doc_id: str = "doc_id") -> Column:
    """CRC-32 of the decimal id, unsigned."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(documents(spark, sf_dir), 1 + F.pmod("place", F.lit(3))).drop("copies")


def planted(text: Column, h: Column) -> Column:
    """The text, or for one id in ten its words with a stretch of them repeated to the end."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(words), F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    times = F.ceil((n - a) / p).cast("int")
    # The stretch as one text, repeated, with as many words of it cut off at the end as go beyond n.
    head, stretch = F.slice(words, 1, a.cast("int")), F.slice(words, (a + 1).cast("int"), p.cast("int"))
    whole = F.concat(head, F.flatten(F.array_repeat(stretch, times)))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(F.slice(whole, 1, n), " ")).otherwise(text)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", planted(F.col("text"), checksum()).alias("text"))
    found = periodic.collapse(docs)
    best = F.expr("aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    listed = F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(listed, ""), "utf-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"),
    )


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    facts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.coalesce(F.pmod(checksum(), F.lit(2)) == 0, F.lit(False))
    own = merkle.leaf(*facts, F.col("text"))
    now = F.when(tampered, merkle.leaf(*facts, F.replace("text", F.lit("\n"), F.lit("")))).otherwise(F.col("leaf"))
    leaves = docs.withColumn("leaf", own).select("doc_id", "source", "leaf", now.alias("now"))
    return merkle.manifest(leaves, replaced="now").select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.encode("siblings", "utf-8"), 256).alias("proof_sha256"), "folded_root", "verified"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op11_mixing": op11_mixing,
    "op12_periodic": op12_periodic,
    "op13_manifest": op13_manifest,
}

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def crc_sql(value: str) -> str:
    """CRC-32 of an integer's decimal digits."""
    bits = "list_reduce([xor(c, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    digits = f"list_transform(string_split(cast({value} as varchar), ''), lambda d: cast(ascii(d) as bigint))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {digits}), lambda c, d: {bits}), 4294967295)"


OP11 = rf"""
with recursive d as (
  select doc_id, source, cast(len({WORDS}) as bigint) as size,
    (cast(concat('0x', substr(md5(concat('mix:', coalesce(cast(doc_id as varchar), ''))), 1, 12)) as bigint) + 0.5::double) / 281474976710656::double as u
  from documents
), s as (
  select source, size, cast(1 + (row_number() over (order by source nulls last) - 1) % 3 as double) as w
  from (select source, cast(sum(size) as bigint) as size from d group by source)
), by_limit as (
  select *, sum(3.0::double * size) over upto as held, sum(w) over () - sum(w) over upto as open_, sum(size) over () as total
  from s window upto as (order by 3.0::double * size / w, source nulls last rows unbounded preceding)
), levels as (
  select held, open_, total, row_number() over (order by held) as k from by_limit
  union all select 0, sum(w), sum(size), 0 from s
), level as (
  -- the first number of held sources at which no other is above its limit
  select (l.total - l.held) / l.open_ as v from levels l
  where l.open_ > 0 and not exists (
    select 1 from (select *, row_number() over (order by held) as k from by_limit) b where b.k > l.k and b.w * ((l.total - l.held) / l.open_) > 3.0::double * b.size)
  order by l.k limit 1
), t as (
  select source, size as source_size, least(w * coalesce((select v from level), 0), 3.0::double * size)::double as target from s
), r as (
  select d.*, source_size, target, floor(case when source_size > 0 then target / source_size else 0 end) as sure,
    case when source_size > 0 then target / source_size else 0 end - floor(case when source_size > 0 then target / source_size else 0 end) as chance,
    row_number() over () as row_
  from d join t on d.source is not distinct from t.source
), c as (
  select *, target - sum(sure * size) over (partition by source) as need,
    sum(size) over (partition by source, chance > 0 and size > 0 order by u, doc_id, size, row_ rows unbounded preceding) as up_to
  from r
), p as (
  select *, chance > 0 and size > 0 and up_to <= need as drawn from c
), g as (
  select *, need - sum(case when drawn then size else 0 end) over (partition by source) as gap from p
), f as (
  select *, not drawn and chance > 0 and size > 0 and abs(size - gap) < gap
    and row_number() over (partition by source, not drawn and chance > 0 and size > 0 order by abs(size - gap), u, doc_id, row_) = 1 as fills
  from g
)
select doc_id, size, source_size, target, cast((sure + cast(drawn or fills as int)) * size as bigint) as taken from f
"""

OP12 = rf"""
with o as (
  select doc_id, {WORDS} as words, {crc_sql("doc_id")} as h, row_number() over () as row_ from documents
), m as (
  select doc_id, row_, words, len(words) as n, h % 10 = 0 as hit, case when len(words) > 0 then (h // 10) % len(words) end as a,
    1 + (len(words) - (h // 10) % greatest(len(words), 1)) // (3 + (h // 10) % 8) as p
  from o
), w as (
  select doc_id, row_, n, case when hit and n > 0 then list_transform(range(0, n), lambda i: words[cast(case when i >= a then a + (i - a) % p else i end as bigint) + 1]) else words end as words from m
), grams as (
  -- in a run of period q, 16 words and more stand again q words on
  select row_, i, array_to_string(words[i + 1:i + 16], ' ') as g from (select row_, words, unnest(range(0, n - 15)) as i from w where n >= 24)
), pairs as (
  select x.row_, x.i, y.i - x.i as q from grams x join grams y on x.row_ = y.row_ and x.g = y.g and y.i > x.i
), islands as (
  select row_, q, i, i - row_number() over (partition by row_, q order by i) as island from pairs
), stretches as (
  select row_, q, min(i) as s, count(*) + 15 + q as len from islands group by row_, q, island
), long_ as (
  select * from stretches where len >= greatest(24, 3 * q)
), runs as (
  select * from long_ r where not exists (select 1 from long_ z where z.row_ = r.row_ and z.q < r.q and z.s <= r.s and z.s + z.len >= r.s + r.len)
), listed as (
  select row_, count(*) as n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as text_ from runs group by row_
), best as (
  select * from (select *, row_number() over (partition by row_ order by cast(len as double) / q desc, s, q) as place from runs) where place = 1
), gone as (
  select row_, list(distinct i) as places from (select row_, unnest(range(s + q, s + len)) as i from runs) group by row_
), kept as (
  -- one row per word: the words of a text in order, without those that are gone
  select row_, string_agg(word, ' ' order by i) as t from (
    select row_, unnest(words) as word, unnest(range(0, n)) as i from w where n > 0
  ) left join (select row_, unnest(places) as i, true as drop_ from gone) using (row_, i) where drop_ is null group by row_
)
select doc_id, cast(coalesce(n_runs, 0) as bigint) as n_runs, cast(best.s as bigint) as start, cast(best.len as bigint) as length, cast(best.q as bigint) as period,
  cast(floor(1000 * best.len / best.q) as bigint) as exponent_milli, sha256(coalesce(text_, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from w left join listed using (row_) left join best using (row_) left join kept using (row_)
"""


def _leaf_sql(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    stamped = [f"coalesce(octet_length(encode(cast({f} as varchar))) || ':' || cast({f} as varchar), '-')" for f in fields]
    return f"sha256({' || '.join(stamped)})"


OP13 = f"""
with recursive d as (
  select doc_id, source, {_leaf_sql("text")} as leaf,
    case when coalesce({crc_sql("doc_id")} % 2 = 0, false) then {_leaf_sql("replace(text, chr(10), '')")} else {_leaf_sql("text")} end as now
  from documents
), rows_ as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf, now) - 1 as idx, count(*) over (partition by source) as n from d
), up as (
  select source, 0 as lvl, idx, n, leaf as v from rows_
  union all
  select source, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(v, '' order by idx)) from up where n > 1 group by source, lvl, idx // 3, n
), sub as (
  select source, v as subroot, row_number() over (order by source nulls first) - 1 as sidx, count(*) over () as sn from up where n = 1
), top as (
  select 0 as lvl, sidx as idx, sn as n, subroot as v from sub
  union all
  select lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(v, '' order by idx)) from top where n > 1 group by lvl, idx // 3, n
), sides as (
  select a.source, a.lvl, a.idx, coalesce(string_agg(b.v, '' order by b.idx) filter (b.idx < a.idx), '') as l, coalesce(string_agg(b.v, '' order by b.idx) filter (b.idx > a.idx), '') as r
  from up a join up b on a.source is not distinct from b.source and a.lvl = b.lvl and a.idx // 3 = b.idx // 3 where a.n > 1 group by a.source, a.lvl, a.idx
), top_sides as (
  select a.lvl, a.idx, coalesce(string_agg(b.v, '' order by b.idx) filter (b.idx < a.idx), '') as l, coalesce(string_agg(b.v, '' order by b.idx) filter (b.idx > a.idx), '') as r
  from top a join top b on a.lvl = b.lvl and a.idx // 3 = b.idx // 3 where a.n > 1 group by a.lvl, a.idx
), folds as (
  select row_number() over () as row_, doc_id, source, leaf, 0 as lvl, idx, now as v, '' as proof from rows_
  union all
  select row_, doc_id, f.source, leaf, f.lvl + 1, f.idx // 3, sha256(l || f.v || r), proof || l || r
  from folds f join sides s on f.source is not distinct from s.source and f.lvl = s.lvl and f.idx = s.idx
), ended as (
  select * from folds qualify row_number() over (partition by row_ order by lvl desc) = 1
), over_ as (
  select row_, doc_id, leaf, subroot, 0 as lvl, sidx as idx, v, proof from ended e join sub on e.source is not distinct from sub.source
  union all
  select row_, doc_id, leaf, subroot, o.lvl + 1, o.idx // 3, sha256(l || o.v || r), proof || l || r from over_ o join top_sides s on o.lvl = s.lvl and o.idx = s.idx
), done as (
  select * from over_ qualify row_number() over (partition by row_ order by lvl desc) = 1
)
select doc_id, leaf, subroot, (select v from top where n = 1) as root, sha256(proof) as proof_sha256, v as folded_root, v = (select v from top where n = 1) as verified from done
"""

ORACLES: dict[str, str] = {"op11_mixing": OP11, "op12_periodic": OP12, "op13_manifest": OP13}
