"""Mixes sources to target weights by Pareto order sampling.

Every source gets a target in words: its weight's share of all words, at most ``cap`` times its own size; what
a source can't use is shared again by weight until no target is above its limit.  Within a source each
document is expected ``c = target / size of the source`` times (times its own weight, if there is such a
column, and at most ``cap``).  It gets floor(c) whole copies for certain.  The rest of the target is a
sample without replacement: documents are ranked by the odds of a random number in (0, 1), divided by
the odds of the fraction of ``c`` that is left (Pareto order sampling), and taken in that order as long as
they fit what is left of the target.  One more document fills the gap at the end: of those not
taken the one whose size comes nearest to the gap, if that brings the source nearer to its target.  So a
source misses its target by less than one document, mostly by a few words.

The random number of a document follows from its id and ``seed``, so reruns agree in any partitioning.

No source is sorted as a whole: sums by ranges of the rank tell in which range the sample ends, and
only that range is looked at more closely, until it is small enough to be sorted (``FINE`` rows).

Defined results: null text has no words and is never taken; a null source is a source like any other; a null id
draws one number of its own; repeated rows are documents of their own, and of rows alike any may be
taken; a null or negative document weight is 0, and such documents are never taken; a source without words
has the target 0; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.order import numbered
from quire.llm.tables import keep

#: Rank ranges are cut in 2 ** STEP parts at a time; ranks have BITS bits.
STEP, BITS = 10, 50
#: Rows of one source that are sorted in one task, at most (unless their ranks are equal).
FINE = 8192
#: Parts in which a source's rows meet its facts.
SALTS = 32


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blank and 0x09-0x0D (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that follows from the id and the seed."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, cap: float, share: float) -> DataFrame:
    """Adds ``target`` to rows (source, source_size, weight), one per source.

    All sources below their limit get the same number of words per unit of weight; each round finds
    the sources that this puts above their limit, until there are no more of them.
    """
    limit = F.col("source_size") * cap
    total, weights = sizes.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total or not weights:
        return sizes.withColumn("target", F.lit(0.0))
    level, above = total * share / weights, -1
    while True:
        over = F.col("weight") * level > limit
        n, taken, rest = sizes.agg(F.count_if(over), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == above or not rest:
            break
        level, above = (total * share - (taken or 0)) / rest, n
    return sizes.withColumn("target", F.least(F.col("weight") * level, limit).cast("double"))


def _meet(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Each row with the facts of its source; a source's rows are spread over SALTS keys."""
    facts = facts.withColumnRenamed("source", "__source").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = F.col("source").eqNullSafe(F.col("__source")) & (F.pmod("at", F.lit(SALTS)).cast("int") == F.col("__salt"))
    return rows.join(facts, met).drop("__source", "__salt")


def expected(rows: DataFrame, sizes: DataFrame, cap: float) -> DataFrame:
    """sizes with ``rate``: copies per unit of document weight, so that the expected words are the target.

    Documents that would be above ``cap`` copies are held there and the others raised, in rounds.
    """
    facts = sizes.withColumn("rate", F.lit(0.0)).withColumn("above", F.lit(-1).cast("long"))
    while True:
        over = F.col("rate") * F.col("own") > cap
        sums = _meet(rows, facts.select("source", "rate")).groupBy("source").agg(
            F.count_if(over).alias("n_over"),
            F.coalesce(F.sum(F.when(over, F.col("size"))), F.lit(0)).alias("held"),
            F.sum(F.when(~over, F.col("size") * F.col("own"))).alias("open"),
        )
        last = facts.select(F.col("source").alias("__source"), *[c for c in sizes.columns if c != "source"], F.col("rate").alias("before"), "above")
        rate = F.when(F.col("open") > 0, F.greatest(F.lit(0.0), F.col("target") - F.col("held") * cap) / F.col("open"))
        facts = sums.join(last, F.col("source").eqNullSafe(F.col("__source"))).withColumn("rate", F.coalesce(rate, "before"))
        facts = keep(facts.withColumn("moved", F.col("n_over") != F.col("above")).select(*sizes.columns, "rate", F.col("n_over").alias("above"), "moved"), "rates")
        if facts.where("moved").isEmpty():
            return facts.select(*sizes.columns, "rate")
        facts = facts.drop("moved")


def sample_ends(candidates: DataFrame, needs: DataFrame) -> DataFrame:
    """Where the sample of each source ends: rows (source, bits, path, cut).

    Candidates whose first ``bits`` bits of ``rank`` are below ``path`` are taken, and those equal to it up to
    the row ``cut`` (null: none of them).  ``needs`` has source and ``need``, the words to be sampled.
    """
    narrow = candidates.select("source", "at", "rank", "id", "size")
    state = needs.select("source", "need", F.lit(0.0).alias("before"), F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("rows"))
    bits, open_ = 0, narrow
    while True:
        bits += STEP
        if bits > STEP:
            open_ = _meet(narrow, state.select("source", "path")).where(F.shiftright("rank", BITS - bits + STEP) == F.col("path")).drop("path")
        ranges = open_.groupBy("source", F.shiftright("rank", BITS - bits).alias("part")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        state_of = state.select(F.col("source").alias("__source"), "need", "before")
        ranges = ranges.join(state_of, F.col("source").eqNullSafe(F.col("__source")))
        up_to = F.sum("words").over(Window.partitionBy("source").orderBy("part"))
        ranges = ranges.withColumn("up_to", F.col("before") + up_to)
        # The first range that goes beyond the need; where none does, all are taken.
        end = F.min_by(F.struct("part", (F.col("up_to") - F.col("words")).alias("before"), "n"), F.when(F.col("up_to") > F.col("need"), F.col("part")))
        found = ranges.groupBy("source", "need").agg(end.alias("end"))
        path = F.coalesce("end.part", F.lit(1 << bits).cast("long"))
        state = keep(found.select("source", "need", F.coalesce("end.before", F.lit(0.0)).alias("before"), path.alias("path"), F.coalesce("end.n", F.lit(0)).alias("rows")), "ranges")
        if bits >= BITS or state.where(F.col("rows") > FINE).isEmpty():
            break
    last = _meet(narrow, state.select("source", "path", "need", "before")).where(F.shiftright("rank", BITS - bits) == F.col("path"))
    order = ["rank", "id", "size", "at"]
    up_to = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    cuts = last.withColumn("up_to", up_to).where("up_to <= need").groupBy("source").agg(F.max(F.struct(*order)).alias("cut"))
    cuts = cuts.withColumnRenamed("source", "__source")
    met = state.join(cuts, F.col("source").eqNullSafe(F.col("__source")), "left")
    return met.select("source", F.lit(bits).alias("bits"), "path", "cut")


def copies(
    df: DataFrame,
    source_weight: Column,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weight: str | None = None,
    cap: int = 3,
    share: float = 1.0,
    seed: str = "mix",
) -> DataFrame:
    """Per row: doc_id, size, source_size, target (of its source), copies, taken (words).

    ``source_weight`` is a column over ``source`` and ``place`` (the source's place by code point, null
    last, from 0).  ``weight`` names a column of document weights.  All targets together are ``share`` of all
    words; no document is taken more than ``cap`` times.
    """
    own = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    rows = df.select(
        F.col(doc_id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), own.alias("own"), F.monotonically_increasing_id().alias("at")
    )
    rows = keep(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = numbered(sizes, [], [F.col("source").asc_nulls_last()], "place", "n_sources")
    sizes = keep(placed.select("source", "source_size", source_weight.cast("double").alias("weight")), "sources")
    sizes = targets(sizes, cap, share).drop("weight")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    facts = expected(rows, sizes, cap) if weight else sizes.withColumn("rate", rate)

    times = F.least(F.col("rate") * F.col("own"), F.lit(float(cap)))
    sure = F.floor(times)
    chance = F.when(F.col("size") > 0, times - sure).otherwise(0.0)
    rows = _meet(rows, facts).withColumn("sure", sure).withColumn("chance", chance)
    rest = rows.groupBy("source", "target").agg(F.sum(F.col("sure") * F.col("size")).alias("certain"), F.avg(F.when(F.col("chance") > 0, F.col("chance"))).alias("mean"))
    rest = keep(rest.select("source", (F.col("target") - F.col("certain")).alias("need"), "mean"), "rests")

    # Ranks are scaled by the mean chance of a source (its order stays): they then spread over (0, 1).
    odds = lambda p: p / (F.lit(1.0) - p)
    ratio = odds(uniform(F.col("id"), seed)) / odds(F.col("chance")) * odds(F.col("mean"))
    rank = F.floor(ratio / (ratio + 1) * F.lit(float(1 << BITS))).cast("long")
    ranked = _meet(rows, rest).withColumn("rank", F.when(F.col("chance") > 0, rank))
    ranked = keep(ranked.drop("mean", "rate", "own", "chance"), "ranked")
    ends = sample_ends(ranked.where("rank is not null"), rest)

    part = F.expr(f"shiftright(rank, {BITS} - bits)")
    first = (part < F.col("path")) | ((part == F.col("path")) & F.coalesce(F.struct("rank", "id", "size", "at") <= F.col("cut"), F.lit(False)))
    drawn = keep(_left_meet(ranked, ends).withColumn("drawn", F.coalesce(first, F.lit(False))).drop("bits", "path", "cut"), "drawn")
    gaps = drawn.groupBy("source").agg(F.first("need").alias("need"), F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0)).alias("got"))
    gaps = gaps.select("source", (F.col("need") - F.col("got")).alias("gap"))
    off = F.abs(F.col("size") - F.col("gap"))
    near = _meet(drawn.where("rank is not null and not drawn"), gaps).where(off < F.col("gap"))
    fill = near.groupBy("source").agg(F.min_by("at", F.struct(off, F.col("rank"), F.col("id"), F.col("at"))).alias("fill"))
    out = _left_meet(drawn, fill).withColumn("copies", F.col("sure") + (F.col("drawn") | F.coalesce(F.col("at") == F.col("fill"), F.lit(False))).cast("long"))
    return out.select(F.col("id").alias(doc_id), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _left_meet(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """As ``_meet``, keeping rows of sources without facts."""
    facts = facts.withColumnRenamed("source", "__source").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = F.col("source").eqNullSafe(F.col("__source")) & (F.pmod("at", F.lit(SALTS)).cast("int") == F.col("__salt"))
    return rows.join(facts, met, "left").drop("__source", "__salt")


def repeated(df: DataFrame, n: str = "copies") -> DataFrame:
    """Each row as often as its column ``n`` says, without that column."""
    return df.where(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).drop(n)
