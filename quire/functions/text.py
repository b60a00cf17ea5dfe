"""Cleaning and scoring of page, question and answer text as native column expressions.

Where the rule is "walk over the tokens", the work is expressed either as one regular expression
with look-around (Java's engine runs it inside the generated code) or as index arithmetic over an
array, never as a per-row Python function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.arrays import at_or_null, count_where, index_range, let

# --- fixed values -------------------------------------------------------------------------
HEADER_FOOTER = r"(?U)^(\d+|Page\s+\d+\s+of\s+\d+)$"
QUALITY_MIN_CHARS = 500
QUALITY_MAX_NON_ALNUM = 0.30
QUALITY_MAX_SINGLE = 0.4
TEXT_CHAR_THRESHOLD = 500
LAYOUT_MIN_SCORE = 0.48
PAGE_SEPARATORS = ("\f", "\n---PAGE---\n", "\n<!-- page -->\n", "\n\n---\n\n")
CONNECTOR_END = (
    r"(?i)\b(and|or|with|include|includes|including|such as|e\.g\.|i\.e\.|is|are|was|were|to|of|for|the|a|an|in|on|by|as|"
    r"from|that|which|this|these|those|its|their|has|have|had|be|been|being)\s*$"
)
EMPTY_BULLET = r"^\s*[•\-–—*]\s*$"
BULLET_LINE = r"^\s*[•\-–—*]\s+\S"
COMPLETE_END = r"[.!?…:)\]]\s*$|\*\*\s*$"
OPEN_BOLD_TAIL = 80
STUMP_MARK = r"^[•\-–—*]\s*"
STUMP_COMPLETE = r"[.!?:)\]\"]$"
ORPHAN_HEADING = r"^\s*(\*\*[^*].+\*\*|#{1,3}\s+\S|[A-Z][A-Za-z0-9 /&-]{2,60})\s*$"
KEBAB_CASE = r"^[a-z0-9]+(-[a-z0-9]+)*$"
QUESTION_WORDS_KEPT = (
    "IPC MTP CRPC BNS BNSS POCSO NDPS DNA HIV STD MCI NMC AIDS MLC FIR IEA PNDT ICU CPR ECG".split()
)
QUERY_RULES = (
    (
        r"(?i)\badolescent",
        "RKSK ARSH Rashtriya Kishor Swasthya Karyakram adolescent reproductive sexual health school health",
    ),
    (r"(?i)\b(antenatal|anc)\b", "antenatal care ANC objectives elements high risk pregnancy"),
    (r"(?i)\b(post\s*natal|postnatal|post\s*partal|pnc)\b", "postnatal care postpartum mother newborn"),
    (r"(?i)\b(essential obstetric|emoc|bemoc|cemoc)\b", "essential obstetric care EmOC RCH FRU JSSK"),
)
# ------------------------------------------------------------------------------------------


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


# White space as page text has it: also no-break, thin and ideographic blanks and the separators.
_BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# The same as a class of a pattern: with (?U) Java's own white space is all of them but the four separators.
_BLANK = r"(?U)[\s\x1c-\x1f]"
_BLANK_BUT_SPACE = r"[\s\x1c-\x1f&&[^ ]]"


def words_of(text: Column) -> Column:
    """Blank-separated tokens; an all-blank text has none."""
    body = strip_blanks(text)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"{_BLANK}+"))


def count_words(text: Column) -> Column:
    return F.size(words_of(text))


def strip_blanks(text: Column) -> Column:
    """Trim by character set: looks at the two ends only."""
    return F.btrim(text, F.lit(_BLANKS))


def rstrip_blanks(text: Column) -> Column:
    return F.rtrim(text, F.lit(_BLANKS))


def squeeze_blanks(text: Column) -> Column:
    """Single blanks between tokens; runs that are already one blank are left alone."""
    return strip_blanks(F.regexp_replace(text, f"{_BLANK}{{2,}}+|{_BLANK_BUT_SPACE}", " "))


def chars_matching(text: Column, char_class: str) -> Column:
    """How many characters belong to a regular-expression class such as ``\\p{L}``.

    Whole runs are removed at a time, which is what makes this cheap.
    """
    return F.length(F.regexp_replace(text, f"[^{char_class}]+", ""))


def char_length_without(text: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(text, f"[{char_class}]+", ""))


# Letters whose capital form is several characters ("ß"), and the single capital that they have, if any.
_LONG_CAPITALS = "".join(c for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if len(c.upper()) > 1)
_SHORT_CAPITALS = "".join("\u1e9e" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _LONG_CAPITALS)


def upper_by_letter(text: Column) -> Column:
    """Capitals letter by letter, so that no text grows: "ß" becomes "ẞ", "ŉ" stays."""
    some = f"[{_LONG_CAPITALS}]"
    pieces = F.split(text, f"(?<={some})|(?={some})")
    one = lambda p: F.when(p.rlike(some), F.translate(p, _LONG_CAPITALS, _SHORT_CAPITALS)).otherwise(F.upper(p))
    return F.when(text.rlike(some), F.array_join(F.transform(pieces, one), "")).otherwise(F.upper(text))


# --- cleaning -----------------------------------------------------------------------------


def strip_header_footer(text: Column) -> Column:
    keep = F.filter(lines_of(text), lambda line: ~strip_blanks(line).rlike(HEADER_FOOTER))
    return F.array_join(keep, "\n")


def _collapse_line(line: Column) -> Column:
    """Join runs of three or more single letters, also with a longer alphabetic token before them.

    Every pattern is anchored at a token's start or looks a fixed number of characters around, so the time
    grows with the length of the line.
    """
    end, begin = r"(?![^ ])", r"(?<![^ ])"
    run = rf"\p{{L}} \p{{L}} \p{{L}}{end}"
    # The blank between a longer token and a run is doubled first, as no others are double here.
    after_token = rf"{begin}(\p{{L}}{{2,}}+) (?={run})"
    # A blank inside a run: two letters before it, or one before and two after.
    inside = rf" (?=\p{{L}}{end})(?:(?<=(?:^| )\p{{L}} \p{{L}} )|(?<=(?:^| )\p{{L}} )(?=\p{{L}} \p{{L}}{end}))"

    def rewrite(s: Column) -> Column:
        all_single = s.rlike(r"^\p{L}(?: \p{L}){2,}+$")
        joined = F.regexp_replace(s, " ", "")
        marked = F.regexp_replace(F.regexp_replace(s, after_token, "$1  "), inside, "")
        return (
            F.when(~s.rlike(r"^\S+ \S+ \S"), line)
            .when(~s.rlike(begin + run), s)
            .when(all_single, F.when(joined.rlike(r"\p{Lu}") | (F.length(joined) > 8), joined).otherwise(line))
            .otherwise(F.replace(marked, F.lit("  "), F.lit("")))
        )

    return let(squeeze_blanks(line), rewrite)


def collapse_letter_spacing(text: Column) -> Column:
    return F.array_join(F.transform(lines_of(text), _collapse_line), "\n")


def normalize_whitespace(text: Column) -> Column:
    t = F.regexp_replace(text, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \t]+(?=\n|$)", "")
    t = F.regexp_replace(t, r" {2,}", " ")
    return strip_blanks(t)


def clean_text(text: Column) -> Column:
    body = collapse_letter_spacing(strip_header_footer(text))
    return F.coalesce(normalize_whitespace(body), F.lit(""))


# --- page scores --------------------------------------------------------------------------


def non_alnum_ratio(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, F.lit(0.0)).otherwise(char_length_without(text, r"\p{L}\p{N}") / n)


def single_char_ratio(text: Column) -> Column:
    words = count_words(text)
    return F.when(words == 0, F.lit(0.0)).otherwise(F.regexp_count(text, F.lit(r"(?<!\S)\S(?!\S)")) / words)


def gibberish_score(text: Column) -> Column:
    """0 (readable) to 1 (unusable)."""

    def metrics(raw: Column) -> Column:
        return F.struct(
            F.length(raw).cast("double").alias("n"),
            chars_matching(raw, r"\p{L}").cast("double").alias("alpha"),
            chars_matching(raw, r"\p{Nd}").cast("double").alias("digit"),
            chars_matching(raw, "aeiouAEIOU").cast("double").alias("vowels"),
            char_length_without(raw, r"\p{L}\p{N}\s.,;:()\[\]\-%/'\"").cast("double").alias("odd"),
            char_length_without(raw, r"\s").cast("double").alias("word_chars"),
            count_words(raw).cast("double").alias("words"),
            F.regexp_count(raw, F.lit(r"(?<!\S)\p{L}{3,}+(?!\S)")).cast("double").alias("real"),
        )

    def step(cond: Column, value: float) -> Column:
        return F.when(cond, F.lit(value)).otherwise(F.lit(0.0))

    def score(m: Column) -> Column:
        n, alpha = m["n"], m["alpha"]
        share = alpha / n
        odd = m["odd"] / n
        mean_word = m["word_chars"] / F.greatest(m["words"], F.lit(1.0))
        total = (
            F.when(share < 0.30, F.lit(0.55)).when(share < 0.45, F.lit(0.40)).when(share < 0.55, F.lit(0.18)).otherwise(F.lit(0.0))
            + step((alpha > 20) & (m["vowels"] / F.greatest(alpha, F.lit(1.0)) < 0.22), 0.25)
            + F.when(odd > 0.25, F.lit(0.35)).when(odd > 0.12, F.lit(0.22)).otherwise(F.lit(0.0))
            + step((mean_word > 0) & ((mean_word < 2.2) | (mean_word > 18)), 0.15)
            + step((m["real"] / F.greatest(m["words"], F.lit(1.0)) < 0.25) & (n > 40), 0.25)
            + step((m["digit"] / n > 0.45) & (share < 0.3), 0.1)
        )
        return F.when(n == 0, F.lit(1.0)).when(n < 20, F.lit(0.85)).otherwise(F.least(F.lit(1.0), total))

    return let(metrics(strip_blanks(F.coalesce(text, F.lit("")))), lambda m: F.when(m["n"] == 0, F.lit(1.0)).otherwise(score(m)))


def round_binary(value: Column, digits: int) -> Column:
    """Rounded in binary arithmetic: the decimal form of a score such as 0.12345 may lie on the other side of the tie."""
    return F.round(value * 10.0**digits, 0) / 10.0**digits


def layout_table_score(text: Column, rows_weight: float = 0.18) -> Column:
    """0..1: how much a page looks like a table or several columns rather than prose.

    ``rows_weight`` is the weight of lines that hold several numbers.
    """

    def data_row(line: Column) -> Column:
        return let(
            words_of(line),
            lambda w: let(
                count_where(w, lambda t: t.rlike(r"\p{Nd}")),
                lambda d: (F.size(w) >= 4) & (d >= 2) & (d / F.size(w) >= 0.35),
            ),
        )

    def metrics(t: Column) -> Column:
        """``t`` holds trimmed, non-blank lines; most counts are single passes over the text."""
        breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
        n = (breaks + 1).cast("double")
        chars = (F.length(t) - breaks).cast("double")
        # (?d): only "\n" ends a line, as in the count of breaks.
        lines_like = lambda pattern: F.regexp_count(t, F.lit(rf"(?md)^{pattern}$"))
        # Lines with digits in two tokens at least: to the first digit, over the rest of its token, to the next digit.
        two_tokens = r"(?mdU)^[^\n\p{Nd}]*+\p{Nd}[^\s\x1c-\x1f]*+[^\n\p{Nd}]*+\p{Nd}.*+$"
        with_numbers = F.regexp_extract_all(t, F.lit(two_tokens), F.lit(0))
        return F.struct(
            n.alias("n"),
            (chars / n).alias("mean"),
            (lines_like(".{1,28}") / n).alias("short"),
            (chars_matching(t, r"\p{Nd}") / F.greatest(chars, F.lit(1.0))).alias("digit"),
            (chars_matching(t, r"\p{L}") / F.greatest(chars, F.lit(1.0))).alias("alpha"),
            (lines_like(r".*\S[^\S\n]{2,}\S.*") / n).alias("gaps"),
            (lines_like(r".*(?:\|.*\||¦).*") / n).alias("pipes"),
            (count_where(with_numbers, data_row) / n).alias("rows"),
        )

    def capped(ratio: Column, at: float) -> Column:
        return F.least(F.lit(1.0), ratio / at)

    def score(m: Column) -> Column:
        dense = (
            F.when((m["n"] >= 25) & (m["mean"] <= 22), F.lit(1.0))
            .when((m["n"] >= 18) & (m["mean"] <= 30), F.lit(0.6))
            .otherwise(F.lit(0.0))
        )
        total = (
            0.28 * capped(m["short"], 0.55)
            + 0.22 * capped(m["gaps"], 0.35)
            + rows_weight * capped(m["rows"], 0.25)
            + 0.12 * capped(m["digit"], 0.22)
            + 0.10 * capped(m["pipes"], 0.15)
            + 0.10 * dense
        )
        prose = F.when((m["mean"] >= 45) & (m["alpha"] >= 0.70) & (m["digit"] < 0.08), F.lit(0.35)).otherwise(F.lit(1.0))
        wordy = F.when((m["alpha"] >= 0.78) & (m["short"] < 0.25) & (m["gaps"] < 0.12), F.lit(0.40)).otherwise(F.lit(1.0))
        return F.least(F.lit(1.0), total * prose * wordy)

    def of(raw: Column) -> Column:
        lines = F.regexp_replace(raw, r"[^\S\n]*\n\s*", "\n")
        return F.when(F.length(raw) < 40, F.lit(0.0)).otherwise(let(lines, lambda t: let(metrics(t), score)))

    return let(strip_blanks(F.coalesce(text, F.lit(""))), of)


def classify_page(char_count: Column, images: Column | None = None, threshold: int = TEXT_CHAR_THRESHOLD) -> Column:
    images = F.lit(0) if images is None else images
    return (
        F.when(char_count > threshold, F.lit("text"))
        .when((char_count == 0) & (images == 0), F.lit("blank"))
        .otherwise(F.lit("image"))
    )


# --- names and paths ----------------------------------------------------------------------


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def infer_subject(path: Column) -> Column:
    stem = F.lower(path_stem(path))
    return (
        F.when(F.lower(path).contains("psm"), F.lit("psm"))
        .when(stem.contains("fmt") | stem.contains("forensic"), F.lit("fmt"))
        .otherwise(F.lit("unknown"))
    )


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest."""
    pieces = F.split(F.lower(text), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def title_from_path(path: Column) -> Column:
    return title_case(F.replace(path_stem(path), F.lit("_"), F.lit(" ")))


def safe_stem(name: Column) -> Column:
    """Identifier made of letters, digits, dash, underscore and dot only."""
    cleaned = F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "")
    return F.when(cleaned == "", F.lit("bank")).otherwise(cleaned)


def is_kebab(name: Column) -> Column:
    return name.rlike(KEBAB_CASE)


# --- questions ----------------------------------------------------------------------------


def expand_query(question: Column, rules=QUERY_RULES) -> Column:
    hits = F.array_compact(F.array(*[F.when(question.rlike(p), F.lit(extra)) for p, extra in rules]))
    return let(
        hits, lambda h: F.when(F.size(h) == 0, question).otherwise(F.concat(question, F.lit("\n"), F.array_join(h, " ")))
    )


def is_multipart(question: Column) -> Column:
    verbs = r"(?i)\b(Mention|Outline|Enumerate|Describe|Explain|List|Define|What are|What is)\b"
    return (
        (F.regexp_count(question, F.lit(r"\?")) >= 2)
        | question.rlike(r"(?i)\b(a\)|b\)|c\)|\(a\)|\(b\)|\(c\)|part\s*[abc123]|section\s*[abc])\b")
        | question.rlike(r"(?i)\?\s*(Mention|Outline|Enumerate|Describe|Explain|List|Write|Discuss)\b")
        | (F.regexp_count(question, F.lit(verbs)) >= 2)
    )


def clean_question_text(text: Column) -> Column:
    """Drop a leading number and a trailing page-number plus code tail."""

    def codeish(word: Column) -> Column:
        return let(
            F.regexp_replace(word, r"^[,.;:]+|[,.;:]+$", ""),
            lambda w: (w == "")
            | (~F.upper(w).isin(*QUESTION_WORDS_KEPT) & w.rlike(r"[\d()]|^[A-Za-z]{1,3}$")),
        )

    def cut(words: Column) -> Column:
        n = F.size(words)
        idx = index_range(n)
        last_real = F.coalesce(F.array_max(F.filter(idx, lambda i: ~codeish(F.element_at(words, i)))), F.lit(0))
        is_number = lambda i: F.regexp_replace(F.element_at(words, i), r"^[.,]+|[.,]+$", "").rlike(r"^\d{2,3}$")
        return let(
            last_real, lambda lr: F.array_max(F.filter(idx, lambda i: (i < n) & (i >= lr) & is_number(i)))
        )

    def rebuild(words: Column) -> Column:
        def head(at: Column) -> Column:
            code_before = F.upper(at_or_null(words, F.nullif(at - 1, F.lit(0)))).isin("CA", "CN")
            keep = at - 1 - F.when(code_before, F.lit(1)).otherwise(F.lit(0))
            body = F.regexp_replace(F.array_join(F.slice(words, F.lit(1), keep), " "), r"[ .,;:]+$", "")
            ended = F.when((body != "") & ~body.rlike(r"[?.]$"), F.concat(body, F.lit("."))).otherwise(body)
            return F.when(at.isNull(), F.array_join(words, " ")).otherwise(ended)

        return let(cut(words), head)

    t = squeeze_blanks(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, r"^\s*\d{1,3}\s*[.)]\s*", "")
    return F.trim(let(words_of(t), rebuild))


# --- answers ------------------------------------------------------------------------------


def tidy_answer(text: Column, max_lines: int = 12, max_headings: int = 4) -> Column:
    """Remove an unfinished end: blank, empty-bullet, dangling and very short last lines."""

    def unfinished(line: Column) -> Column:
        def of(s: Column) -> Column:
            open_end = ~s.rlike(COMPLETE_END)
            return (
                (s == "")
                | line.rlike(EMPTY_BULLET)
                | s.rlike(CONNECTOR_END)
                | (line.rlike(BULLET_LINE) & open_end & (F.length(s) < 80))
                | (open_end & (F.length(s) < 40) & ~s.endswith("**"))
            )

        return let(strip_blanks(line), of)

    def drop(flags: Column, state: Column, rounds: int) -> Column:
        """Lower the number of kept lines while the last non-blank one is flagged."""

        def once(kept: Column, _: Column) -> Column:
            last = F.coalesce(
                F.array_max(F.filter(index_range(kept), lambda i: F.element_at(flags, i)["filled"])), F.lit(0)
            )
            return let(
                last,
                lambda k: F.when((k > 0) & F.coalesce(at_or_null(flags, F.nullif(k, F.lit(0)))["drop"], F.lit(False)), k - 1).otherwise(k),
            )

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, once)

    def of(lines: Column) -> Column:
        tail = F.transform(
            lines, lambda x: F.struct((strip_blanks(x) != "").alias("filled"), unfinished(x).alias("drop"))
        )
        heads = F.transform(
            lines,
            lambda x: F.struct(
                (strip_blanks(x) != "").alias("filled"), (x.rlike(ORPHAN_HEADING) & ~x.rlike(BULLET_LINE)).alias("drop")
            ),
        )
        kept = let(tail, lambda f: drop(f, F.size(lines), max_lines))
        kept = let(kept, lambda k: let(heads, lambda f: drop(f, k, max_headings)))
        joined = rstrip_blanks(F.array_join(let(kept, lambda k: F.slice(lines, F.lit(1), k)), "\n"))
        return rstrip_blanks(F.regexp_replace(joined, r"(\.\.\.|…)\s*$", ""))

    return let(lines_of(text), of)


def close_open_bold(text: Column, max_tail: int = OPEN_BOLD_TAIL) -> Column:
    """Drop an unclosed bold piece at the end of a cut-off answer, and the bullet that became a stump by it.

    Only texts with an odd number of bold marks, the last of them within ``max_tail`` characters of the end, change.
    The last line goes too if it is a bullet of fewer than five words or without an ending sign.  Null is empty.
    """

    def without_stump(body: Column) -> Column:
        lines = lines_of(body)
        last = strip_blanks(F.element_at(lines, -1))
        words = F.size(words_of(F.regexp_replace(last, STUMP_MARK, "")))
        stump = last.rlike(STUMP_MARK) & ((words < 5) | ~last.rlike(STUMP_COMPLETE))
        head = rstrip_blanks(F.array_join(F.slice(lines, F.lit(1), F.size(lines) - 1), "\n"))
        return F.when(stump, head).otherwise(body)

    def of(body: Column) -> Column:
        odd = F.size(F.split(body, r"\*\*", -1)) % 2 == 0
        before = F.regexp_extract(body, r"(?s)^(.*)\*\*", 1)
        near = F.length(body) - F.length(before) <= max_tail
        return F.when(odd & near, let(rstrip_blanks(before), without_stump)).otherwise(body)

    return let(rstrip_blanks(F.coalesce(text, F.lit(""))), of)


def merge_split_tokens(text: Column) -> Column:
    """Join a one- or two-letter token with a following lower-case alphabetic token."""
    return F.regexp_replace(text, r"(?<![^ ])(\p{L}{1,2}) (\p{Ll}\p{L}*)(?![^ ])", "$1$2")


def options_to_text(options: Column) -> Column:
    entries = F.array_sort(F.map_entries(options))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n")


def estimate_tokens(text: Column, tokens: Callable[[Column], Column] | None = None) -> Column:
    """Number of tokens: those of ``tokens`` (text to an array, see ``tokens.Tokenizer``), else a quarter of the characters."""
    if tokens is not None:
        return F.size(tokens(F.coalesce(text, F.lit("")))).cast("bigint")
    return F.floor(F.length(text) / 4).cast("bigint")
