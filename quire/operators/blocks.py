"""Answer text as typed blocks: headings, bullets, paragraphs, tables and diagrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import let, prefix_sums
from quire.functions.text import lines_of, strip_blanks

# --- fixed values: line forms ----------------------------------------------------------------
FENCE_OPEN = r"(?i)^\s*`{3,}\s*(dot|graphviz)\s*$"
FENCE_CLOSE = r"^\s*`{3,}\s*$"
SEPARATOR_CELL = r"^\s*:?-+:?\s*$"
BOLD_LINE = r"^\*\*\s*(.+?)\s*\*\*[:.]?$"
BULLET = r"^\s*([•\-–—])\s*(.*)$"
MARKDOWN_BULLET = r"^\s*([*+])\s+(.*)$"
HEADING = r"^#{1,6}\s*(.+?)\s*#{0,6}$|^([A-Z][A-Za-z0-9 \-/&,'()–—]{1,80})$"
# ---------------------------------------------------------------------------------------------

_BLOCK = "struct<kind:string,content:string>"


def is_table_separator(line: Column) -> Column:
    def of(s: Column) -> Column:
        cells = F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|")
        return s.contains("-") & s.contains("|") & F.forall(cells, lambda c: c.rlike(SEPARATOR_CELL))

    return let(strip_blanks(line), of)


def table_row(line: Column) -> Column:
    inner = F.regexp_replace(strip_blanks(line), r"^\||\|$", "")
    return F.array_join(F.transform(F.split(inner, r"\|"), strip_blanks), " | ")


def line_kind(line: Column) -> Column:
    """``struct<kind, content>`` of one line outside tables and diagrams."""

    def of(s: Column) -> Column:
        mark = lambda pattern, dash: F.struct(
            F.when(F.regexp_extract(line, pattern, 1).isin(*dash), "sub_bullet").otherwise("main_bullet").alias("kind"),
            strip_blanks(F.regexp_extract(line, pattern, 2)).alias("content"),
        )
        plain = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("content"))
        title = F.regexp_replace(F.regexp_replace(s, r"^#+\s*", ""), r"\s*#+$", "")
        return (
            F.when(s == "", plain("blank", F.lit("")))
            .when(s.rlike(BOLD_LINE), plain("heading", strip_blanks(F.regexp_extract(s, BOLD_LINE, 1))))
            .when(line.rlike(BULLET), mark(BULLET, ("–", "—", "-")))
            .when(line.rlike(MARKDOWN_BULLET), mark(MARKDOWN_BULLET, ("",)))
            .when(s.rlike(HEADING) & ~s.rlike(r"[.:;]$"), plain("heading", title))
            .otherwise(plain("paragraph", s))
            .cast(_BLOCK)
        )

    return let(strip_blanks(line), of)


#: A line as one letter.  O opens a diagram, C could close one; T and H are lines before a table separator
#: (a separator itself, or not), w and u separators elsewhere; b is blank; the other lines by their kind,
#: without and with a bar.
KIND_LETTERS = {"heading": "hi", "paragraph": "pq", "main_bullet": "mn", "sub_bullet": "st"}
#: Blocks as runs of letters: a diagram up to its close, a table with its separator and rows, a paragraph
#: of lines, any other line on its own.
BLOCK_LETTERS = "O[^C]*C?|[HT].[Hinqt]*|[pqwC]+|[hismntub]"


def line_letter(line: Column, separator: Column, before_separator: Column, kind: Column) -> Column:
    bar = line.contains("|")
    of_kind = F.lit("b")
    for name, (plain, barred) in KIND_LETTERS.items():
        of_kind = F.when(kind == name, F.when(bar, barred).otherwise(plain)).otherwise(of_kind)
    return (
        F.when(line.rlike(FENCE_OPEN), "O")
        .when(line.rlike(FENCE_CLOSE), "C")
        .when(bar & before_separator, F.when(separator, "T").otherwise("H"))
        .when(separator, F.when(kind == "sub_bullet", "u").otherwise("w"))
        .otherwise(of_kind)
    )


def blocks_of(text: Column) -> Column:
    """``array<struct<kind, content>>`` of an answer.

    Every line becomes a letter, one pattern cuts the letters into blocks, and each block takes its slice of
    the lines: no state travels from line to line, and the time grows with the number of lines.
    """

    def coded(lines: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            ahead = F.coalesce(is_table_separator(F.try_element_at(lines, i + 2)), F.lit(False))
            return let(
                line_kind(x),
                lambda k: F.struct(
                    x.alias("line"), line_letter(x, is_table_separator(x), ahead, k["kind"]).alias("letter"), k["content"].alias("content")
                ),
            )

        return F.transform(lines, of)

    def cut(rows: Column) -> Column:
        letters = F.array_join(F.transform(rows, lambda r: r["letter"]), "")
        parts = F.regexp_extract_all(letters, F.lit(BLOCK_LETTERS), F.lit(0))
        return let(parts, lambda ps: let(prefix_sums(F.transform(ps, F.length)), lambda ends: placed(rows, ps, ends)))

    def placed(rows: Column, parts: Column, ends: Column) -> Column:
        spans = F.zip_with(parts, ends, lambda p, e: F.struct(p.alias("part"), e.alias("end")))
        return F.transform(F.filter(spans, lambda s: s["part"] != "b"), lambda s: block(rows, s["part"], s["end"]))

    def block(rows: Column, part: Column, end: Column) -> Column:
        n = F.length(part)
        first = F.substring(part, 1, 1)
        own = F.slice(rows, end - n + 1, n)
        closed = F.when(part.endswith("C"), 1).otherwise(0)
        inside = F.slice(rows, end - n + 2, n - 1 - closed)
        single = F.element_at(rows, end)["content"]
        kinds = F.when(first == "O", "diagram").when(first.isin("H", "T"), "table")
        for name, pair in KIND_LETTERS.items():
            kinds = kinds.when(first.isin(*pair), name)
        kinds = kinds.when(first == "u", "sub_bullet").otherwise("paragraph")
        joined = lambda arr, f, sep: F.array_join(F.transform(arr, f), sep)
        content = (
            F.when(first == "O", joined(inside, lambda r: r["line"], "\n"))
            .when(first.isin("H", "T"), joined(F.filter(own, lambda r, i: i != 1), lambda r: table_row(r["line"]), "\n"))
            .when(first.isin("p", "q", "w", "C"), joined(own, lambda r: r["content"], " "))
            .otherwise(single)
        )
        return F.struct(kinds.alias("kind"), content.alias("content")).cast(_BLOCK)

    return let(lines_of(F.coalesce(text, F.lit(""))), lambda lines: let(coded(lines), cut))


def answer_blocks(answers: DataFrame, key: str = "qid") -> DataFrame:
    rows = answers.select(key, F.posexplode(blocks_of(F.col("answer_text"))).alias("__i", "b"))
    return rows.select(key, (F.col("__i") + 1).cast("bigint").alias("block_no"), "b.kind", "b.content")
