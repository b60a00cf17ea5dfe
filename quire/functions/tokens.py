"""Keywords, years and numbers found in text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import lexicon as L
from quire.functions.arrays import let, run_lengths
from quire.functions.text import count_words, words_of

# (?U) makes a word boundary treat accented letters as letters on every Java version.
KEYWORD = r"(?U)(?=[A-Za-z])\b[A-Za-z][A-Za-z0-9-]{3,}\b"
YEAR = r"(?U)\b(19[0-9][0-9]|20[0-9][0-9]|2100)\b"
NUMBER = r"(?<!\d)([1-9]\d{0,2}(?:,\d{3})+|\d{4,})(?!\d)"


@dataclass(frozen=True)
class Tokenizer:
    """How text falls into tokens and how tokens become text again.

    ``split`` maps a text column to an array of strings; ``joiner`` stands between two tokens of a window.
    With ``glues`` a token cut by a page break counts once.
    """

    split: Callable[[Column], Column]
    joiner: str = " "
    glues: bool = True


WORDS = Tokenizer(words_of)


def pattern_tokenizer(pattern: str) -> Tokenizer:
    """Matches of ``pattern`` as tokens; one that covers every character keeps all blanks of the text."""
    return Tokenizer(lambda text: F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), "", False)


def function_tokenizer(pieces: Callable[[str], list[str]], joiner: str = "") -> Tokenizer:
    """Tokens of a Python function, such as the pieces of a subword vocabulary; texts go to it in Arrow batches."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: list(pieces(t)), na_action="ignore")

    return Tokenizer(split, joiner, False)


def count_tokens(text: Column, tokenizer: Tokenizer = WORDS) -> Column:
    return count_words(text) if tokenizer is WORDS else F.size(tokenizer.split(text))


def _stopwords() -> Column:
    return F.array(*[F.lit(w) for w in L.STOPWORDS if len(w) > 3])


def word_tokens(text: Column) -> Column:
    """Lower-cased words of four or more characters, in text order, with repeats."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(KEYWORD), F.lit(0))
    # Lower-casing the joined tokens is one call instead of one per token.
    return F.split(F.lower(F.array_join(found, "\n")), "\n")


def keywords(text: Column) -> Column:
    """Distinct content words."""
    stop = F.concat(_stopwords(), F.array(F.lit("")))
    return F.array_except(word_tokens(text), stop)


def top_keywords(text: Column, n: int = 12) -> Column:
    """Most frequent content words, ties alphabetical; counted inside the row, without a shuffle."""
    counted = run_lengths(word_tokens(text))
    stop = [w for w in L.STOPWORDS if len(w) > 3]
    content = F.filter(counted, lambda c: ~c["value"].isin("", *stop))
    ranked = F.sort_array(F.transform(content, lambda c: F.struct((-c["n"]).alias("neg"), c["value"].alias("w"))))
    return F.transform(F.slice(ranked, 1, n), lambda r: r["w"])


def important_years(text: Column, n: int = 8) -> Column:
    """Distinct years 1900-2100, ascending, the first few."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(YEAR), F.lit(1))
    return F.slice(F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int")))), 1, n)


def important_numbers(text: Column, years: Column, n: int = 8) -> Column:
    """Integers of at least 1000 other than ``years``, first spelling per value, in text order."""

    def pick(raws: Column) -> Column:
        """Sorted by value and place, the first of each value is the one that differs from the one before."""
        digits = lambda r: F.regexp_replace(F.regexp_replace(r, ",", ""), "^0+(?=.)", "")
        year_text = F.transform(years, lambda y: y.cast("string"))
        entries = F.transform(raws, lambda r, i: F.struct(digits(r).alias("digits"), i.alias("i"), r.alias("raw")))
        wanted = F.filter(entries, lambda p: (F.length(p["digits"]) >= 4) & ~F.array_contains(year_text, p["digits"]))
        return let(F.array_sort(wanted), first_by_value)

    def first_by_value(ordered: Column) -> Column:
        new = lambda p, k: (k == 0) | (F.get(ordered, k - 1)["digits"] != p["digits"])
        placed = F.array_sort(F.transform(F.filter(ordered, new), lambda p: F.struct(p["i"].alias("i"), p["raw"].alias("raw"))))
        return F.transform(F.slice(placed, 1, n), lambda p: p["raw"])

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(1)), pick)
