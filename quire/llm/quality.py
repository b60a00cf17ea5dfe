"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts byte classes from the three before them, per language.  All trusted text is counted;
counts, continuation counts, discounts (three per order and language, from the counts of counts) and
back-off weights are aggregations and joins of count tables that Spark shards by context.  The result
is cut into shards of at most ``SHARD`` n-grams by language and the last two classes of the context; each
shard is joined with the documents by broadcasting it, and gives every document the bits of the
positions that fall into it.  The sum over the shards is the document's code length.  A larger model has
more shards, none of them larger, and no n-gram is dropped.

A document is kept if its perplexity is at most its language's threshold: the ``quantile`` of the
perplexities of the trusted documents of that language, widened by ``margin``.  Those perplexities are held
out: documents fall into ``folds`` by crc32 of their id, and each is measured by a model of the other folds'
trusted text, as a document that the model has not seen.  The quantile is exact over perplexities in steps of a
thousandth of a bit; all trusted documents count.

Defined results: null or empty text has no perplexity and is not kept; a null language is a language of
its own; a language without trusted text is scored by no model and kept, one whose trusted documents all
fall into one fold has no threshold and is kept; repeated rows count as often as
they occur; a repeated id in ``labels`` is trusted only if all its rows say so.  Other columns are not read, whole
texts of any length are, and a perplexity equal to the threshold is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.language import context_codes
from quire.llm.tables import keep
from quire.llm.words import batches, rows_of

#: 0: before the text; 1-26 and 27-52 letters; 53 digits; 54 blanks; 55 line ends; 56 controls;
#: 57-88 other ASCII signs; 89-216 bytes from 0x80.
SYMBOLS = 217
ORDER = 4
#: N-grams of one shard; about 16 bytes each are sent to every executor.
SHARD = 1_500_000


def _symbol_map() -> np.ndarray:
    table = np.full(256, 56, np.uint8)
    for k in range(26):
        table[ord("a") + k], table[ord("A") + k] = 1 + k, 27 + k
    table[ord("0") : ord("9") + 1] = 53
    table[[0x20, 0x09]] = 54
    table[[0x0A, 0x0D]] = 55
    signs = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
    table[signs] = np.arange(57, 57 + len(signs))
    table[0x80:] = np.arange(89, 217)
    return table


_SYMBOL = _symbol_map()


def count_grams(df: DataFrame) -> DataFrame:
    """lang, gram (four classes as one number), c of all rows (lang, text); counted in each task first."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in batches(batch, "text"):
                code, symbols, ends = context_codes(part.column("text"), _SYMBOL, SYMBOLS)
                langs = part.column("lang").dictionary_encode()
                row = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[rows_of(ends)]
                gram, c = np.unique((row * SYMBOLS**3 + code) * SYMBOLS + symbols, return_counts=True)
                which, gram = np.divmod(gram, SYMBOLS**ORDER)
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(which)), pa.array(gram), pa.array(c.astype(np.int64))], ["lang", "gram", "c"])

    return df.mapInArrow(run, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def discounts(grams: DataFrame) -> DataFrame:
    """Per language: d1, d2, d3 of modified Kneser-Ney; where counts of counts are missing, halves."""
    n = [F.count_if(F.col("c") == k).cast("double") for k in range(1, 5)]
    got = grams.groupBy("lang").agg(*[x.alias(f"n{k}") for k, x in enumerate(n, 1)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    out = {f"d{k}": F.when((F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")) for k in (1, 2, 3)}
    return got.select("lang", *[F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), F.coalesce(out[f"d{k}"], F.lit(0.5)))).alias(f"d{k}") for k in (1, 2, 3)])


def estimated(grams: DataFrame, order: int, lower: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, p) of all seen n-grams and (lang, context, back) of all contexts of one order;
    ``lower`` has p of the order below."""
    context = F.floor(F.col("gram") / SYMBOLS).cast("long")
    counted = grams.withColumn("context", context).join(F.broadcast(discounts(grams)), "lang")
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    counted = counted.select("lang", "gram", "context", "c", d.alias("d"))
    back = counted.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("back"))
    both = counted.join(back, ["lang", "context"])
    own = (F.col("c") - F.col("d")) / F.col("total")
    if lower is None:
        p = both.select("lang", "gram", (own + F.col("back") / SYMBOLS).alias("p"))
    else:
        short = F.pmod("gram", F.lit(SYMBOLS ** (order - 1)))
        p = both.withColumn("short", short).join(lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("q")), ["lang", "short"])
        p = p.select("lang", "gram", (own + F.col("back") * F.col("q")).alias("p"))
    return p, back.select("lang", "context", "back")


def with_folds(counts: DataFrame, folds: int) -> DataFrame:
    """4-gram counts whose lang is ``fold:lang``, summed for ``all:lang`` and, per fold k, for ``k:lang`` without fold k."""
    fold, lang = F.regexp_extract("lang", r"(?s)^(\d+):(.*)$", 1), F.regexp_extract("lang", r"(?s)^(\d+):(.*)$", 2)
    others = F.filter(F.array(*[F.lit(str(k)) for k in range(folds)]), lambda k: k != fold)
    names = F.transform(F.concat(F.array(F.lit("all")), others), lambda k: F.concat(k, F.lit(":"), lang))
    return counts.select(F.explode(names).alias("lang"), "gram", "c").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def model(grams: DataFrame) -> DataFrame:
    """From 4-gram counts: rows (lang, level, key, value): level 1-4 log2 p of seen n-grams by order, 11-14 log2 back-off of contexts."""
    tables = [keep(grams, "grams-4")]
    for order in (3, 2, 1):
        # How many different classes an n-gram follows: its continuation count.
        shorter = tables[0].groupBy("lang", F.pmod("gram", F.lit(SYMBOLS**order)).alias("gram")).agg(F.count("*").alias("c"))
        tables.insert(0, keep(shorter, f"grams-{order}"))
    rows, lower = [], None
    for order, grams in enumerate(tables, 1):
        p, back = estimated(grams, order, lower)
        p = keep(p, f"p-{order}")
        rows.append(p.select("lang", F.lit(order).alias("level"), F.col("gram").alias("key"), F.log2("p").cast("float").alias("value")))
        rows.append(back.select("lang", F.lit(10 + order).alias("level"), F.col("context").alias("key"), F.log2("back").cast("float").alias("value")))
        lower = p
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


class Shard:
    """Part of the model in sorted arrays; n-grams are told apart by language and key."""

    def __init__(self, rows: pa.Table):
        self.langs = sorted(set(rows["lang"].to_pylist()))
        code = np.searchsorted(np.array(self.langs, dtype=object), np.array(rows["lang"].to_pylist(), dtype=object)).astype(np.int64) if self.langs else np.zeros(0, np.int64)
        level, key, value = rows["level"].to_numpy(), rows["key"].to_numpy(), rows["value"].to_numpy()
        self.tables = {}
        for k in (1, 2, 3, 4, 11, 12, 13, 14):
            own = level == k
            full = code[own] * SYMBOLS**ORDER + key[own]
            order = np.argsort(full)
            self.tables[k] = full[order], value[own][order]

    def look(self, level: int, lang: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.tables[level]
        if not len(keys):
            return np.zeros(len(key), np.float32), np.zeros(len(key), bool)
        full = lang * SYMBOLS**ORDER + key
        at = np.minimum(np.searchsorted(keys, full), len(keys) - 1)
        return values[at], keys[at] == full

    def bits(self, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """-log2 p of n-grams: the longest seen form, after the back-off weights of the longer contexts."""
        out, open_ = np.zeros(len(gram)), np.arange(len(gram))
        for order in (4, 3, 2, 1):
            value, seen = self.look(order, lang[open_], gram[open_] % SYMBOLS**order)
            out[open_[seen]] -= value[seen]
            open_ = open_[~seen]
            back, known = self.look(10 + order, lang[open_], gram[open_] % SYMBOLS**order // SYMBOLS)
            out[open_[known]] -= back[known]
        out[open_] += np.log2(SYMBOLS)
        return out


def score_shard(df: DataFrame, rows: DataFrame, shard: int, shards: int) -> DataFrame:
    """id, lang, mark, n, bits: of the positions of each text whose last two classes fall into ``shard``."""
    near = (F.col("level") < 3) | (F.col("level").isin(11, 12))
    last_two = F.when(F.col("level").isin(3, 4), F.floor(F.col("key") / SYMBOLS)).otherwise(F.col("key"))
    place = F.pmod(F.pmod(last_two, F.lit(SYMBOLS**2)), F.lit(shards))
    own = Shard(rows.where(near | (place == shard)).toArrow())
    sent = df.sparkSession.sparkContext.broadcast(own)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = sent.value
        names = {name: k for k, name in enumerate(mine.langs)}
        for batch in stream:
            for part in batches(batch, "text"):
                code, symbols, ends = context_codes(part.column("text"), _SYMBOL, SYMBOLS)
                row_lang = np.array([names.get(x, -1) for x in part.column("lang").to_pylist()], np.int64)
                rows = rows_of(ends)
                take = (row_lang[rows] >= 0) & (code % SYMBOLS**2 % shards == shard)
                total = np.zeros(len(ends))
                if take.any():
                    full = (row_lang[rows[take]] * SYMBOLS**3 + code[take]) * SYMBOLS + symbols[take]
                    some, which = np.unique(full, return_inverse=True)
                    lang, gram = np.divmod(some, SYMBOLS**ORDER)
                    # Whole millionths add up to the same sum in any order.
                    cost = np.rint(mine.bits(lang, gram) * 1e6)
                    total = np.bincount(rows[take], weights=cost[which], minlength=len(ends))
                sizes = np.diff(ends, prepend=0)
                known = pa.array(np.where((row_lang >= 0) & (sizes > 0), total, np.nan).astype(np.float64), from_pandas=True)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("id", "lang", "mark")], known, pa.array(sizes)], ["id", "lang", "mark", "bits", "n"])

    asked = df.select("id", "lang", F.xxhash64("text").alias("mark"), "text")
    return asked.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, lang string, mark long, bits double, n long")


def perplexity(df: DataFrame, rows: DataFrame, n_rows: int) -> DataFrame:
    """id, lang, n (bytes), bits (per byte, in thousandths; null without model or text) of rows (id, lang, text)."""
    shards = max(1, -(-n_rows // SHARD))
    out = score_shard(df, rows, 0, shards)
    if shards > 1:
        for k in range(1, shards):
            out = out.unionByName(score_shard(df, rows, k, shards))
        # Rows alike in all of this come once per shard each and have equal bits.
        times = (F.count("*") / shards).cast("int")
        out = out.groupBy("id", "lang", "mark", "n").agg((F.sum("bits") / times).alias("bits"), F.expr(f"sequence(1, int(count(*) / {shards}))").alias("times"))
        out = out.select("id", "lang", "n", "bits", F.explode("times"))
    return out.select("id", "lang", "n", F.round(F.col("bits") / F.col("n") / 1000).cast("int").alias("bits"))


def thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """lang, edge: the least value that at least ``quantile`` of a language's values don't exceed."""
    steps = scored.where("bits is not null").groupBy("lang", "bits").agg(F.count("*").alias("n"))
    below = Window.partitionBy("lang").orderBy("bits").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("lang")
    ranked = steps.select("lang", "bits", F.sum("n").over(below).alias("up_to"), F.sum("n").over(whole).alias("of"))
    return ranked.where(F.col("up_to") >= F.col("of") * quantile).groupBy("lang").agg(F.min("bits").alias("edge"))


def classify(
    df: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", quantile: float = 0.95, margin: float = 0.05, folds: int = 4
) -> DataFrame:
    """Per row: doc_id, perplexity, threshold, kept, learned from rows whose labels have quality 1 and toxic 0."""
    language: Column = F.coalesce(F.col(lang).cast("string"), F.lit(""))
    rows = df.select(F.col(doc_id).alias("id"), language.alias("lang"), F.col(text).alias("text"))
    good = labels.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t"))
    good = good.where("q = 1 and t = 0").select("id")
    trusted = rows.where("text is not null").join(good.hint("shuffle_hash"), "id", "left_semi")
    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(folds)).cast("string")
    by_fold = F.concat(fold, F.lit(":"), F.col("lang")).alias("lang")
    table = keep(model(with_folds(keep(count_grams(trusted.select(by_fold, "text")), "grams-folds"), folds)), "kneser-ney")

    def measured(name: Column, part: DataFrame, kept: str) -> DataFrame:
        sizes = part.where("level in (3, 4, 13, 14)").count()
        return keep(perplexity(rows.select("id", name, "text"), part, sizes).withColumn("lang", F.regexp_extract("lang", "(?s)^[^:]*:(.*)$", 1)), kept)

    scored = measured(F.concat(F.lit("all:"), F.col("lang")).alias("lang"), table.where("lang like 'all:%'"), "perplexity")
    # Measured for all rows, so that no text is joined with the labels again.
    held = measured(by_fold, table.where("lang not like 'all:%'"), "held-out")
    edges = thresholds(held.join(good, "id", "left_semi"), quantile)
    out = scored.join(F.broadcast(edges), "lang", "left")
    limit = F.col("edge") * (1 + margin)
    return out.select(
        F.col("id").alias(doc_id),
        F.pow(F.lit(2.0), F.col("bits") / 1000).alias("perplexity"),
        F.pow(F.lit(2.0), limit / 1000).alias("threshold"),
        # Without a model of its language a text with content stays.
        F.when(F.col("n") == 0, F.lit(False)).otherwise(F.coalesce(F.col("bits") <= limit, F.lit(True))).alias("kept"),
    )
