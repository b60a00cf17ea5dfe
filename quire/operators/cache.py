"""Cached answers: keys, staleness, lookup, listing, eviction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import lexicon as L
from quire.functions.text import safe_stem
from quire.operators.blocked import last_seen

# Names of the reasons.
MISSING_VERSIONS = "missing_versions_field"
EMBEDDING_DRIFT = "embedding_model_drift"
KB_REINDEXED = "kb_reindexed"


def versions_text(versions: Mapping[str, int]) -> str:
    return ",".join(f"{k}={versions[k]}" for k in sorted(versions))


def cache_key(
    module: Column,
    qid: Column,
    text: Column,
    template: Column,
    model: Column,
    subject: Column,
    target_words: Column,
    embedding_model: Column,
    versions: Mapping[str, int] = L.COMPONENT_VERSIONS,
) -> Column:
    """16-hex key over everything that determines an answer."""
    parts = F.concat_ws(
        "|",
        module,
        qid,
        text,
        template,
        model,
        F.concat(F.lit("subject="), subject),
        F.lit("versions=" + versions_text(versions)),
        F.concat(F.lit("target_word_count="), F.coalesce(target_words, F.lit(0)).cast("string")),
        F.concat(F.lit("embedding_model="), embedding_model),
    )
    return F.substring(F.sha2(parts, 256), 1, 16)


def fixed_reasons(embedding_model: str, current: Mapping[str, int] = L.COMPONENT_VERSIONS) -> Column:
    """Reasons that follow from the answer alone: components and embedding model."""
    drift = lambda c: F.lit(f"{c}_version_drift")
    without = [F.lit(MISSING_VERSIONS), *[drift(c) for c, v in current.items() if v != 0]]
    checks = []
    for component, value in current.items():
        have = F.try_element_at("versions", F.lit(component))
        differs = F.when(have.isNull(), F.lit(value != 0)).otherwise(have != value)
        checks.append(F.when(differs, drift(component)))
    checks.append(F.when(F.col("embedding_model") != embedding_model, F.lit(EMBEDDING_DRIFT)))
    return F.when(F.col("versions").isNull(), F.array(*without)).otherwise(F.array_compact(F.array(*checks)))


def watches_corpus(subject: str = "subject") -> Column:
    """Whether the revision of the corpus matters to an answer: it has versions and a subject."""
    return F.col("versions").isNotNull() & (F.coalesce(F.col(subject), F.lit("")) != "")


def stale_reasons(
    answers: DataFrame,
    kb: DataFrame,
    embedding_model: str,
    current: Mapping[str, int] = L.COMPONENT_VERSIONS,
    subject: str = "subject",
) -> DataFrame:
    """Add ``stale_reasons``: why an answer no longer matches the current components and corpus.

    ``versions`` is a map column, ``kb`` holds (subject, revision); a subject without a revision
    counts as 0 and of several the highest counts.  The revisions are joined, reduced to one short
    row per subject; as a table of that size they are broadcast by Spark's own size rule.
    """
    revisions = kb.groupBy(subject).agg(F.max("revision").alias("__rev"))
    joined = answers.join(revisions, subject, "left")
    rev = F.coalesce("__rev", F.lit(0))
    kb_moved = F.when(F.col("kb_revision").isNull(), rev > 0).otherwise(F.col("kb_revision") != rev)
    corpus = F.when(watches_corpus(subject) & kb_moved, F.array(F.lit(KB_REINDEXED))).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("stale_reasons", F.concat(fixed_reasons(embedding_model, current), corpus)).drop("__rev")


def mark_stale(answers: DataFrame, kb: DataFrame, embedding_model: str, **kw) -> DataFrame:
    out = stale_reasons(answers, kb, embedding_model, **kw)
    return out.withColumn("stale", F.size("stale_reasons") > 0)


def find_stale(marked: DataFrame, corrupt: DataFrame | None = None, module: str | None = None) -> DataFrame:
    """(module, qid, stale_reasons) of stale answers, and unreadable ones with their own reason."""
    rows = marked.filter("stale").select("module", "qid", "stale_reasons")
    if corrupt is not None:
        bad = corrupt.select("module", "qid", F.array(F.concat(F.lit("corrupt_file:"), F.col("error"))).alias("stale_reasons"))
        rows = rows.unionByName(bad)
    return rows if module is None else rows.filter(F.col("module") == module)


def cache_lookup(
    questions: DataFrame, marked: DataFrame, on: Sequence[str], force: bool = False, accept_stale: bool = False
) -> DataFrame:
    """Add ``cache_hit``; a stale answer is a hit only where the caller accepts it."""
    usable = marked if accept_stale else marked.filter(~F.col("stale"))
    known = usable.select(*on, F.lit(not force).alias("__hit")).dropDuplicates(list(on))
    joined = questions.join(known, list(on), "left")
    return joined.withColumn("cache_hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def cache_entries(marked: DataFrame, subject: str | None = None, stale_only: bool = False) -> DataFrame:
    """Listing with one column per component version; missing ones are 0."""
    rows = marked
    if subject is not None:
        rows = rows.filter(F.col("subject") == subject)
    if stale_only:
        rows = rows.filter("stale")
    version = lambda c: F.coalesce(F.try_element_at("versions", F.lit(c)), F.lit(0)).alias(f"{c}_version")
    return rows.select(
        "qid", "module", "subject", "stale", F.array_join("stale_reasons", ",").alias("stale_reasons"),
        *[version(c) for c in L.COMPONENT_VERSIONS],
        F.coalesce("embedding_model", F.lit("")).alias("embedding_model"),
    )


def cache_status(marked: DataFrame, with_total: bool = False) -> DataFrame:
    """Entries and stale entries per subject, on request with a total row (null subject)."""
    grouped = marked.rollup("subject") if with_total else marked.groupBy("subject")
    return grouped.agg(F.count(F.lit(1)).alias("entries"), F.count_if("stale").alias("stale_entries"))


def evict(answers: DataFrame, qids: DataFrame | None = None, module: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Remaining answers and a one-row count of removed ones."""
    if qids is None and module is None:
        raise ValueError("name qids or a module")
    target = answers if module is None else answers.filter(F.col("module") == module)
    gone = target if qids is None else target.join(qids.select("qid").distinct(), "qid", "left_semi")
    key = ["module", "chapter", "qid"]
    if qids is None:
        kept = answers.filter(~F.col("module").eqNullSafe(module))
    else:
        doomed = qids.select("qid").distinct()
        if module is not None:
            doomed = doomed.withColumn("module", F.lit(module))
        kept = answers.join(doomed, doomed.columns, "left_anti")
    return kept, gone.select(*key).agg(F.count(F.lit(1)).alias("removed"))


def bump_kb_revision(revisions: DataFrame, subjects: DataFrame) -> DataFrame:
    """Add one to every re-indexed subject; a new subject starts at 1."""
    touched = subjects.select("subject").distinct().withColumn("__t", F.lit(1))
    joined = revisions.join(touched, "subject", "full_outer")
    value = F.coalesce("revision", F.lit(0)) + F.coalesce("__t", F.lit(0))
    return joined.select("subject", value.cast("bigint").alias("revision"))


def group_by_bank(answers: DataFrame, banks: DataFrame, single: str = "Single answers") -> DataFrame:
    """Group label per answer: its bank if the module is one, else a common group; banks sort first."""
    # Of names that give the same module the first in order stands for all.
    named = banks.groupBy(safe_stem(F.col("name")).alias("__module")).agg(F.min("name").alias("__bank"))
    joined = answers.join(named, F.col("module") == F.col("__module"), "left")
    return joined.withColumns(
        {"is_bank": F.col("__bank").isNotNull(), "group_label": F.coalesce("__bank", F.lit(single))}
    ).drop("__bank", "__module")


def reanswer_plan(marked: DataFrame, module: str | None = None) -> DataFrame:
    """Questions to answer again, one row each."""
    return find_stale(marked, module=module).filter(F.col("qid").isNotNull()).select("module", "qid")


def chapter_sequence(answers: DataFrame, order: str, keys: Sequence[str] = ("module",), width: int = 1 << 16) -> DataFrame:
    """Add ``divider``: a named chapter starts here; only where a group has two or more of them."""
    name = F.trim(F.coalesce(F.col("chapter"), F.lit("")))
    named = F.when(~F.lower(name).isin("", "unknown"), name)
    rows = answers.withColumn("__c", named)
    spread = rows.groupBy(*keys).agg((F.min("__c") != F.max("__c")).alias("__many"))
    out = last_seen(rows, list(keys), [order], {"__prev": F.col("__c")}, width=width, inclusive=False)
    changed = F.col("__c").isNotNull() & ~F.col("__c").eqNullSafe(F.col("__prev"))
    joined = out.join(spread, list(keys))
    return joined.withColumn("divider", F.coalesce(F.col("__many"), F.lit(False)) & changed).drop("__c", "__prev", "__many")
