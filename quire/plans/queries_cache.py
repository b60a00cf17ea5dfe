"""Cache, versions and staleness (inventory group I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import lexicon as L
from quire.operators import cache as I
from quire.plans.registry import query

MODEL = "model-a"
KB = {"en": 1, "fr": 2, "es": 1}

# answers with their reasons: sr(qid, module, chapter, subject, reasons, ...)
_COMP = [(c, v) for c, v in L.COMPONENT_VERSIONS.items()]
_HAVE = {"prompt": "v_prompt", "validator": "v_validator", "schema": "3", "retrieval": "1", "renderer": "1"}
_CHECKS = ", ".join(
    f"case when {_HAVE[c]} <> {v} then '{c}_version_drift' end" if c in _HAVE else f"case when {str(v != 0).lower()} then '{c}_version_drift' end"
    for c, v in _COMP
)
_MISSING = ", ".join(["'missing_versions_field'"] + [f"'{c}_version_drift'" for c, v in _COMP if v != 0])
D_STALE = f"""kb(subject, revision) as (values ('en', 1), ('fr', 2), ('es', 1)),
  sr as (select a.*, case when v_prompt is null then [{_MISSING}] else list_filter([{_CHECKS},
      case when embedding_model <> 'model-a' then 'embedding_model_drift' end,
      case when case when kb_revision is null then coalesce(kb.revision, 0) > 0 else kb_revision <> coalesce(kb.revision, 0) end then 'kb_reindexed' end], lambda x: x is not null) end as reasons
    from f5 a left join kb on kb.subject = a.subject)"""


def kb(v):
    return v.spark.createDataFrame(list(KB.items()), "subject string, revision int")


def cached(v):
    versions = F.when(
        F.col("v_prompt").isNotNull(),
        F.create_map(
            F.lit("prompt"), F.col("v_prompt").cast("int"), F.lit("validator"), F.col("v_validator").cast("int"),
            F.lit("schema"), F.lit(3), F.lit("retrieval"), F.lit(1), F.lit("renderer"), F.lit(1),
        ),
    )
    return v.f5.withColumn("versions", versions)


def marked(v):
    return I.mark_stale(cached(v), kb(v), MODEL)


@query(
    "i1_cache_key",
    f"""select qid, substring(sha256(concat_ws('|', module, qid, answer_text, 'THEORY', 'model-a', concat('subject=', subject), 'versions={I.versions_text(L.COMPONENT_VERSIONS)}',
        concat('target_word_count=', coalesce(marks, 0)::varchar), concat('embedding_model=', embedding_model))), 1, 16) as cache_key from f5""",
)
def _(v):
    c = F.col
    key = I.cache_key(c("module"), c("qid"), c("answer_text"), F.lit("THEORY"), F.lit(MODEL), c("subject"), c("marks"), c("embedding_model"))
    return v.f5.select("qid", key.alias("cache_key"))


@query("i2_stale_reasons", f"with {D_STALE} select qid, array_to_string(reasons, ',') as stale_reasons from sr")
def _(v):
    out = I.stale_reasons(cached(v), kb(v), MODEL)
    return out.select("qid", F.array_join("stale_reasons", ",").alias("stale_reasons"))


@query("i3_mark_stale", f"with {D_STALE} select qid, module, len(reasons) > 0 as stale, len(reasons)::bigint as n_reasons from sr")
def _(v):
    return marked(v).select("qid", "module", "stale", F.size("stale_reasons").cast("bigint").alias("n_reasons"))


@query(
    "i4_find_stale",
    f"""with {D_STALE} select module, qid, array_to_string(reasons, ',') as stale_reasons from sr where len(reasons) > 0 and conv_id % 20 <> 0
      union all select module, qid, 'corrupt_file:json' from f5 where conv_id % 20 = 0""",
)
def _(v):
    corrupt = v.f5.filter("conv_id % 20 = 0").select("module", "qid", F.lit("json").alias("error"))
    out = I.find_stale(marked(v).filter("conv_id % 20 <> 0"), corrupt)
    return out.withColumn("stale_reasons", F.array_join("stale_reasons", ","))


@query(
    "i5_cache_lookup",
    f"""with {D_STALE} select 'strict' as mode, f4.qid, coalesce(sr.qid is not null and len(reasons) = 0, false) as cache_hit from f4 left join sr on sr.qid = f4.qid
      union all select 'accept_stale', f4.qid, sr.qid is not null from f4 left join sr on sr.qid = f4.qid
      union all select 'force', qid, false from f4""",
)
def _(v):
    m = marked(v)
    out = lambda mode, **kw: I.cache_lookup(v.f4.select("qid"), m, ["qid"], **kw).select(F.lit(mode).alias("mode"), "qid", "cache_hit")
    return out("strict").unionByName(out("accept_stale", accept_stale=True)).unionByName(out("force", force=True))


@query(
    "i6_cache_entries",
    f"""with {D_STALE} select qid, module, subject, len(reasons) > 0 as stale, array_to_string(reasons, ',') as stale_reasons,
        case when v_prompt is null then 0 else 3 end as schema_version, coalesce(v_prompt, 0)::int as prompt_version, case when v_prompt is null then 0 else 1 end as retrieval_version, 0 as planner_version,
        coalesce(v_validator, 0)::int as validator_version, 0 as reranker_version, case when v_prompt is null then 0 else 1 end as renderer_version, embedding_model from sr where len(reasons) > 0 and subject = 'fr'""",
)
def _(v):
    return I.cache_entries(marked(v), subject="fr", stale_only=True)


@query(
    "i7_cache_status",
    f"with {D_STALE} select subject, count(*) as entries, count_if(len(reasons) > 0)::bigint as stale_entries from sr group by rollup(subject)",
)
def _(v):
    return I.cache_status(marked(v), with_total=True)


_BY_QID = "module = 'm1' and qid in (select qid from f4 where conv_id % 2 = 0)"
_QIDS = "qid in (select qid from f4 where conv_id % 3 = 0)"


@query(
    "i8_evict",
    " union all ".join(
        f"select '{mode}' as mode, 'kept' as part, count(*) as n from f5 where not ({cond}) union all select '{mode}', 'removed', count(*) from f5 where {cond}"
        for mode, cond in (("by_qid", _BY_QID), ("module", "module = 'm2'"), ("qids", _QIDS))
    ),
)
def _(v):
    def shown(mode, **kw):
        kept, removed = I.evict(v.f5, **kw)
        part = lambda df, name: df.select(F.lit(mode).alias("mode"), F.lit(name).alias("part"), F.col("n"))
        left = part(kept.agg(F.count(F.lit(1)).alias("n")), "kept")
        return left.unionByName(part(removed.withColumnRenamed("removed", "n"), "removed"))

    evens, thirds = v.f4.filter("conv_id % 2 = 0"), v.f4.filter("conv_id % 3 = 0")
    return (
        shown("by_qid", qids=evens, module="m1").unionByName(shown("module", module="m2")).unionByName(shown("qids", qids=thirds))
    )


@query(
    "i9_bump_kb_revision",
    """select coalesce(r.subject, s.subject) as subject, (coalesce(r.revision, 0) + case when s.subject is null then 0 else 1 end)::bigint as revision
       from (select distinct subject, 1 as revision from f9 where subject in ('en', 'fr')) r full outer join (select distinct subject from f9 where subject <> 'en') s on s.subject = r.subject""",
)
def _(v):
    revisions = v.f9.filter("subject in ('en', 'fr')").select("subject").distinct().withColumn("revision", F.lit(1))
    return I.bump_kb_revision(revisions, v.f9.filter("subject <> 'en'"))


@query(
    "i10_group_by_bank",
    """select qid, case when module in ('m1', 'm3', 'm5') then upper(module) || '!' else 'Single answers' end as group_label, module in ('m1', 'm3', 'm5') as is_bank from f5""",
)
def _(v):
    banks = v.f5.filter("module in ('m1', 'm3', 'm5')").select(F.concat(F.col("module"), F.lit("!")).alias("name")).distinct()
    out = I.group_by_bank(v.f5, banks).withColumn("group_label", F.when(F.col("is_bank"), F.upper("group_label")).otherwise(F.col("group_label")))
    return out.select("qid", "group_label", "is_bank")


@query("i11_reanswer_plan", f"with {D_STALE} select module, qid from sr where len(reasons) > 0 and module = 'm3'")
def _(v):
    return I.reanswer_plan(marked(v), module="m3")


@query(
    "i12_chapter_sequence",
    """with a as (select qid, module, conv_id * 100 + turn as p, case when conv_id % 6 = 0 then 'unknown' when module = 'm4' then 'only' when conv_id % 3 = 0 then null else chapter end as chapter from f5),
       b as (select *, case when lower(coalesce(chapter, '')) not in ('', 'unknown') then chapter end as c from a),
       d as (select *, last_value(c ignore nulls) over (partition by module order by p rows between unbounded preceding and 1 preceding) as prev, min(c) over (partition by module) <> max(c) over (partition by module) as many from b)
       select qid, coalesce(many, false) and c is not null and c is distinct from prev as divider from d""",
)
def _(v):
    rows = v.f5.select(
        "qid", "module", (F.col("conv_id") * 100 + F.col("turn")).alias("p"),
        F.expr("case when conv_id % 6 = 0 then 'unknown' when module = 'm4' then 'only' when conv_id % 3 = 0 then null else chapter end").alias("chapter"),
    )
    return I.chapter_sequence(rows, "p").select("qid", "divider")
