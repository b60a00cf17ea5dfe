"""Page-level operators: cleaning, flags, choosing between copies, spreading text over pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.arrays import index_range, index_where, let


def clean_pages(pages: DataFrame) -> DataFrame:
    cleaned = pages.withColumn("text", T.clean_text(F.col("text")))
    return cleaned.withColumn("char_count", F.length("text").cast("bigint"))


def page_quality_flags(
    pages: DataFrame,
    min_chars: int = T.QUALITY_MIN_CHARS,
    max_non_alnum: float = T.QUALITY_MAX_NON_ALNUM,
    max_single: float = T.QUALITY_MAX_SINGLE,
) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    flagged = pages.withColumns(
        {
            "low_char": F.length(text) < min_chars,
            "high_garble": T.non_alnum_ratio(text) > max_non_alnum,
            "single_char": T.single_char_ratio(text) > max_single,
        }
    )
    return flagged.withColumn("suspect", F.col("low_char") | F.col("high_garble") | F.col("single_char"))


def choose_page_text(
    native: DataFrame, ocr: DataFrame, on: Sequence[str], threshold: int = 100, prefer: Sequence[str] = ("longer",)
) -> DataFrame:
    """Native text where it is long enough, otherwise the longer copy or always the scanned one."""
    joined = native.join(ocr.withColumnRenamed("text", "__ocr"), list(on), "left")
    fine = (F.length("text") >= threshold) | F.col("__ocr").isNull()
    take = {
        "longer": ~fine & (F.length("__ocr") > F.length("text")),
        "ocr": ~fine,
    }
    out = {}
    for p in prefer:
        out[f"{p}_text"] = F.when(take[p], F.col("__ocr")).otherwise(F.col("text"))
        out[f"{p}_method"] = F.when(take[p], F.lit("ocr")).otherwise(F.lit("text"))
    return joined.withColumns(out).drop("__ocr")


def distribute_text(blocks: DataFrame, content: str = "content", page_lengths: str = "page_lengths") -> DataFrame:
    """One row per page that receives a piece of a text block.

    Explicit page separators win when they give exactly the expected number of pages; otherwise
    the text is cut in proportion to ``page_lengths`` (at least 80 each) at the closest
    paragraph, line or word break.
    """
    pages = F.size(F.col(page_lengths))
    body = T.strip_blanks(F.coalesce(F.col(content), F.lit("")))

    def by_separator(sep: str) -> Column:
        parts = F.transform(F.split(F.col("__body"), F.lit(f"\\Q{sep}\\E"), -1), T.strip_blanks)
        filled = lambda p: index_where(p, lambda e, _: e != "")

        def inner(p: Column) -> Column:
            return let(
                filled(p),
                lambda f: F.when(
                    F.size(f) > 0,
                    F.slice(p, F.element_at(f, 1), F.element_at(f, -1) - F.element_at(f, 1) + 1),
                ).otherwise(F.array().cast("array<string>")),
            )

        return F.when(
            F.col("__body").contains(sep), let(parts, inner)
        )

    def matching(candidate: Column) -> Column:
        return let(candidate, lambda c: F.when(F.size(c) == pages, c))

    explicit = F.coalesce(*[matching(by_separator(s)) for s in T.PAGE_SEPARATORS])
    base = blocks.withColumn("__body", body).filter(F.col("__body") != "")
    base = base.withColumn("__explicit", F.when(pages == 1, F.array("__body")).otherwise(explicit))
    pieces = F.coalesce(F.col("__explicit"), _proportional(F.col("__body"), F.col(page_lengths)))
    return (
        base.select(*[c for c in blocks.columns if c not in (content, page_lengths)], F.posexplode(pieces).alias("page_off", "text"))
        .filter(F.col("text") != "")
    )


def _proportional(body: Column, lengths: Column) -> Column:
    weights = F.transform(lengths, lambda x: F.greatest(x, F.lit(80)).cast("bigint"))

    def cut(w: Column) -> Column:
        total = F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + x)
        n = F.length(body).cast("bigint")
        targets = F.transform(w, lambda x: F.greatest(F.lit(40), F.bround(n * x / total, 0).cast("bigint")).cast("bigint"))
        return let(targets, lambda t: _walk(body, n, t))

    return let(weights, cut)


def _walk(body: Column, n: Column, targets: Column) -> Column:
    """Fold over the pages, carrying the position reached and the pieces cut so far."""
    zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<string>").alias("out"))

    def closest(window: Column, lo: Column, aim: Column, pos: Column, pat: str) -> Column:
        """The end of ``pat`` next to ``aim``: of the last one up to it and the first one from it on, no other can be."""
        reach = F.greatest(aim - lo, F.lit(0)).cast("int")
        head = F.substring(window, F.lit(1), reach)
        up_to = F.when(head.contains(pat), lo + F.length(head) - F.length(F.substring_index(head, pat, -1)))
        found = F.position(F.lit(pat), window, F.greatest(reach + 1 - len(pat), F.lit(1)))
        onward = F.when(found > 0, lo + found - 1 + len(pat))
        both = F.struct(up_to.alias("a"), onward.alias("b"))
        nearer = lambda s: F.when(s["b"].isNull() | (aim - s["a"] <= s["b"] - aim), s["a"]).otherwise(s["b"])
        return let(both, lambda s: let(nearer(s), lambda at: F.when(at > pos, at)))

    def step(acc: Column, target: Column) -> Column:
        pos = acc["pos"]
        is_last = F.size(acc["out"]) == F.size(targets) - 1

        def place(aim: Column) -> Column:
            lo = F.greatest(pos + 20, aim - 120)
            hi = F.least(n, aim + 160)
            window = F.substring(body, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
            best = let(
                F.struct(window.alias("w"), lo.alias("lo")),
                lambda s: F.coalesce(*[closest(s["w"], s["lo"], aim, pos, p) for p in ("\n\n", "\n", " ")], aim),
            )
            return let(best, lambda b: F.when(b <= pos, F.least(n, pos + F.greatest(F.lit(1), target))).otherwise(b))

        end = F.when(is_last, n).otherwise(let(F.least(n, pos + target), place))
        return let(
            end,
            lambda e: F.struct(
                e.cast("bigint").alias("pos"),
                F.concat(
                    acc["out"], F.array(T.strip_blanks(F.substring(body, (pos + 1).cast("int"), (e - pos).cast("int"))))
                ).alias("out"),
            ),
        )

    return F.aggregate(targets, zero, step, lambda acc: acc["out"])
