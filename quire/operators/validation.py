"""Answer validation: twelve rules as column expressions over one answer row.

Sections, words, citations and names all come from the answer itself, so a rule needs no shuffle:
every rule is an expression that yields ``struct(rule, severity, n_issues, detail)`` and a run of
any number of rules is one projection.  New rules are functions added to the registry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import lexicon as L
from quire.functions.arrays import at_or_null, count_where, index_where, let, run_lengths
from quire.functions.text import count_words, lines_of, rstrip_blanks, strip_blanks

# --- fixed values: line forms and marks of the rules ----------------------------------------
COLON_HEADING = r"^(\s*)([A-Z][A-Za-z][A-Za-z0-9 /&-]{0,60}?):\s*(.*)$"
BOLD_HEADING = r"^\s*\*\*([^*]{2,80})\*\*\s*$"
TITLE_HEADING = r"^\s*([A-Z][A-Za-z0-9][A-Za-z0-9 /&-]{1,60})\s*$"
BULLET_START = r"^\s*[•\-–—*]\s+"
EVIDENCE_TOKEN = r"\b(?:chunk[_-]?)?([A-Za-z0-9]{6,16})\b"
CITATION = r"(?i)(?:\bchunk[_-]([A-Za-z0-9]{4,24})\b|\[(?:chunk[_-]?)?([A-Za-z0-9]{6,24})\])"
ACRONYM = r"\b([A-Z]{3,8})\b"
SCHEME_TITLE = r"\b([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,5}\s+(?:Yojana|Scheme|Programme|Program|Mission))\b"
SCHEME_WORDS = r"YOJANA|SCHEME|PROGRAMME|PROGRAM|MISSION"
OPEN_ENDING = (
    r"(?i)\b(and|or|with|include|includes|including|such as|e\.g\.|i\.e\.|is|are|was|were|to|of|for|the|a|an|in|on|by|as|"
    r"from|that|which|this|these|those|has|have|had|be|been|being)\s*$"
)
CLOSED_ENDING = r"[.!?…:)\]]\s*$|\*\*\s*$"
WORD_TOLERANCE = 0.10
MAX_ANSWER_CHARS = 1_000_000
# --------------------------------------------------------------------------------------------

PASS, WARN, FAIL = "pass", "warn", "fail"
RESULT = "struct<rule:string,severity:string,n_issues:bigint,detail:string>"


def heading_name(line: Column) -> Column:
    """Section name if the line is a heading, else null."""
    title = strip_blanks(F.regexp_extract(line, TITLE_HEADING, 1))
    return (
        F.when(~line.rlike(r"\S") | line.rlike(BULLET_START), F.lit(None).cast("string"))
        .when(line.rlike(COLON_HEADING), strip_blanks(F.regexp_extract(line, COLON_HEADING, 2)))
        .when(line.rlike(BOLD_HEADING), strip_blanks(F.regexp_extract(line, BOLD_HEADING, 1)))
        .when(line.rlike(TITLE_HEADING) & ~title.rlike(r"^\S+(?:\s+\S+){10}"), title)
    )


def split_sections(text: Column) -> Column:
    """``array<struct<name, norm, content, body>>``; text before the first heading is dropped.

    ``content`` includes the heading line, ``body`` does not.
    """

    def build(lines: Column) -> Column:
        names = F.transform(lines, heading_name)

        def cut(ns: Column) -> Column:
            starts = index_where(ns, lambda n, _: n.isNotNull())

            def pieces(at: Column) -> Column:
                def one(start: Column, i: Column) -> Column:
                    stop = F.coalesce(F.try_element_at(at, i + 2), F.size(lines) + 1)
                    name = F.element_at(ns, start)
                    return F.struct(
                        name.alias("name"),
                        F.lower(strip_blanks(name)).alias("norm"),
                        strip_blanks(F.array_join(F.slice(lines, start, stop - start), "\n")).alias("content"),
                        strip_blanks(F.array_join(F.slice(lines, start + 1, stop - start - 1), "\n")).alias("body"),
                    )

                return F.transform(at, one)

            return let(starts, pieces)

        return let(names, cut)

    return let(lines_of(F.coalesce(text, F.lit(""))), build)


def section_rows(answers: DataFrame, key: str = "qid") -> DataFrame:
    rows = answers.select(key, F.posexplode(split_sections(F.col("answer_text"))).alias("__i", "s"))
    return rows.select(key, (F.col("__i") + 1).alias("section_no"), "s.*")


def word_count(text: Column) -> Column:
    return count_words(text)


# --- rules ----------------------------------------------------------------------------------


class Context:
    """Columns a rule may read; missing ones are typed nulls."""

    def __init__(self, df: DataFrame):
        def col(name: str, kind: str) -> Column:
            return F.col(name) if name in df.columns else F.lit(None).cast(kind)

        self.answer = F.coalesce(F.col("answer_text"), F.lit(""))
        self.sections = F.col("__sections")
        self.blueprint = col("blueprint", "array<struct<name:string,category:string,words:int,required:boolean,metadata:string>>")
        self.marks = col("marks", "int")
        self.target_words = col("target_words", "int")
        self.source = F.coalesce(col("source_text", "string"), F.lit(""))


def _result(rule: str, severity: Column | str, n: Column | int, detail: Column | str) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(rule).alias("rule"),
        as_col(severity).alias("severity"),
        as_col(n).cast("bigint").alias("n_issues"),
        as_col(detail).alias("detail"),
    )


def _from_issues(rule: str, issues: Column, fail: str = FAIL) -> Column:
    """Fail with the joined issues, or pass when there are none."""
    return let(
        issues,
        lambda x: _result(rule, F.when(F.size(x) > 0, fail).otherwise(PASS), F.size(x), F.array_join(x, ";")),
    )


def _needs_blueprint(rule: str, ctx: Context, check: Column) -> Column:
    return F.when(ctx.blueprint.isNull(), _result(rule, WARN, 0, "no blueprint")).otherwise(check)


def _norm(name: Column) -> Column:
    return F.lower(strip_blanks(name))


def formatting(ctx: Context, rule: str) -> Column:
    issues = F.array_compact(
        F.array(
            F.when(F.contains(ctx.answer, F.lit("\n\n\n")), "blank lines"),
            F.when(ctx.answer.rlike(r"[ \t\r\f]+(\n|\z)"), "trailing whitespace"),
            F.when(F.length(ctx.answer) > MAX_ANSWER_CHARS, "too long"),
        )
    )
    return F.when(~ctx.answer.rlike(r"\S"), _result(rule, FAIL, 1, "empty")).otherwise(_from_issues(rule, issues))


def heading_structure(ctx: Context, rule: str) -> Column:
    n = F.size(ctx.sections)
    return _result(rule, F.when(n == 0, WARN).otherwise(PASS), F.when(n == 0, 1).otherwise(0), n.cast("string"))


def duplicate_section(ctx: Context, rule: str) -> Column:
    counted = run_lengths(F.transform(ctx.sections, lambda s: s["norm"]))
    again = F.transform(
        F.filter(counted, lambda c: c["n"] > 1), lambda c: F.concat(c["value"], F.lit("="), c["n"].cast("string"))
    )
    return _from_issues(rule, again)


def empty_section(ctx: Context, rule: str, body_only: bool = False) -> Column:
    part = "body" if body_only else "content"
    return _from_issues(rule, F.transform(F.filter(ctx.sections, lambda s: s[part] == ""), lambda s: s["name"]))


def section_word_count(ctx: Context, rule: str, tolerance: float = WORD_TOLERANCE) -> Column:
    def off(spec: Column) -> Column:
        same = F.filter(ctx.sections, lambda s: s["norm"] == _norm(spec["name"]))
        words = word_count(at_or_null(same, -1)["content"])
        low, high = F.floor(spec["words"] * F.lit(1 - tolerance)), F.floor(spec["words"] * F.lit(1 + tolerance))
        return let(
            F.when(F.size(same) > 0, words),
            lambda w: F.when(
                (spec["words"] > 0) & ((w < low) | (w > high)), F.concat(spec["name"], F.lit(":"), w.cast("string"))
            ),
        )

    issues = F.filter(F.transform(ctx.blueprint, off), lambda x: x.isNotNull())
    return _needs_blueprint(rule, ctx, _from_issues(rule, issues))


def _missing(ctx: Context, wanted: Column) -> Column:
    present = F.transform(ctx.sections, lambda s: s["norm"])
    return let(present, lambda p: F.filter(wanted, lambda n: ~F.array_contains(p, _norm(n))))


def required_sections(ctx: Context, rule: str) -> Column:
    names = F.transform(F.filter(ctx.blueprint, lambda s: s["required"]), lambda s: s["name"])
    return _needs_blueprint(rule, ctx, _from_issues(rule, _missing(ctx, names)))


def blueprint_compliance(ctx: Context, rule: str) -> Column:
    """Missing sections fail; sections beyond the blueprint are only listed."""
    wanted = F.array_distinct(F.transform(ctx.blueprint, lambda s: _norm(s["name"])))
    present = F.array_distinct(F.transform(ctx.sections, lambda s: s["norm"]))
    missing = F.array_sort(F.array_except(wanted, present))
    extra = F.array_sort(F.array_except(present, wanted))
    check = let(
        missing,
        lambda m: F.when(F.size(m) > 0, _result(rule, FAIL, F.size(m), F.array_join(m, ";"))).otherwise(
            _result(rule, PASS, 0, F.concat(F.lit("extra="), F.array_join(extra, ",")))
        ),
    )
    return _needs_blueprint(rule, ctx, check)


def evidence_coverage(ctx: Context, rule: str) -> Column:
    tokens = F.transform(
        ctx.sections,
        lambda s: F.size(F.array_distinct(F.regexp_extract_all(s["content"], F.lit(EVIDENCE_TOKEN), F.lit(1)))).cast("string"),
    )
    check = F.when(F.size(ctx.sections) == 0, _result(rule, WARN, 0, "no sections")).otherwise(
        _result(rule, PASS, 0, F.array_join(tokens, ","))
    )
    return _needs_blueprint(rule, ctx, check)


def citations(text: Column) -> Column:
    """Explicit chunk citations, lower-cased, in text order."""
    a = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    b = F.regexp_extract_all(text, F.lit(CITATION), F.lit(2))
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.lower(F.concat(z["a"], z["b"])))


def reference_consistency(ctx: Context, rule: str) -> Column:
    whole = F.array(F.struct(F.lit("(body)").alias("name"), ctx.answer.alias("content")))
    named = F.transform(ctx.sections, lambda s: F.struct(s["name"].alias("name"), s["content"].alias("content")))
    parts = F.when(F.size(ctx.sections) == 0, whole).otherwise(named)
    repeated = F.filter(
        parts, lambda s: let(citations(s["content"]), lambda c: F.size(c) != F.size(F.array_distinct(c)))
    )
    return _from_issues(rule, F.transform(repeated, lambda s: s["name"]))


def scope_length(ctx: Context, rule: str) -> Column:
    words = word_count(ctx.answer)
    band = F.when(ctx.marks <= 3, F.lit(3)).when(ctx.marks <= 5, F.lit(5)).otherwise(F.lit(10))
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), band)
    low0 = pick({b: v[0] for b, v in L.SCOPE_BANDS.items()})
    high0 = pick({b: v[1] for b, v in L.SCOPE_BANDS.items()})
    t = ctx.target_words
    low_t = F.floor(t * F.when(band == 5, F.lit(0.64)).otherwise(F.lit(0.70))).cast("int")
    high_t = F.floor(t * F.when(band == 10, F.lit(1.12)).when(band == 5, F.lit(1.22)).otherwise(F.lit(1.10))).cast("int")
    use = F.coalesce(t > 0, F.lit(False))
    high = F.when(use, F.least(high0, high_t)).otherwise(high0)
    low1 = F.when(use, F.greatest(low0, low_t)).otherwise(low0)

    def judge(m: Column) -> Column:
        low = F.when(use & (m["low"] >= m["high"]), F.floor(m["high"] * F.lit(0.7)).cast("int")).otherwise(m["low"])
        bad = (m["w"] > m["high"]) | (m["w"] < low)
        detail = F.concat_ws(",", m["w"].cast("string"), low.cast("string"), m["high"].cast("string"))
        return _result(rule, F.when(bad, FAIL).otherwise(PASS), F.when(bad, 1).otherwise(0), detail)

    checked = let(F.struct(words.alias("w"), low1.alias("low"), high.alias("high")), judge)
    return F.when(ctx.marks.isNull(), _result(rule, WARN, 0, "no marks")).otherwise(checked)


def grounding(
    ctx: Context,
    rule: str,
    allowed: Iterable[str] = L.ALLOWED_NAMES,
    denied: Iterable[str] = L.DENIED_NAMES,
    titles: Iterable[str] = L.KNOWN_TITLES,
) -> Column:
    """Names in the answer must be allowed or appear in its source; denied names always fail."""
    denied = sorted(denied)
    known = F.array(*[F.lit(t) for t in titles])
    pardoned = F.array(*[F.lit(x) for x in [*allowed, *denied]])
    upper_answer = F.upper(ctx.answer)
    foreign = F.array_compact(F.array(*[F.when(upper_answer.rlike(rf"\b{d}\b"), F.lit(d)) for d in denied]))

    def unsupported(src: Column) -> Column:
        acronyms = F.array_sort(F.array_distinct(F.regexp_extract_all(ctx.answer, F.lit(ACRONYM), F.lit(1))))
        bad_acronyms = F.filter(acronyms, lambda a: ~F.array_contains(pardoned, a) & ~F.contains(src, F.upper(a)))
        found = F.array_sort(F.array_distinct(F.regexp_extract_all(ctx.answer, F.lit(SCHEME_TITLE), F.lit(1))))

        def unknown(t: Column) -> Column:
            norm = F.lower(F.regexp_replace(strip_blanks(t), r"\s+", " "))
            listed = F.exists(known, lambda k: F.contains(k, norm) | F.contains(norm, k))
            head = F.upper(F.regexp_extract(t, r"^(\S+)", 1))
            return ~F.contains(src, F.upper(t)) & ~listed & ~(F.contains(src, head) & src.rlike(SCHEME_WORDS))

        return F.concat(bad_acronyms, F.filter(found, unknown))

    has_source = ctx.source.rlike(r"\S")
    no_source = let(
        foreign,
        lambda d: F.when(F.size(d) > 0, _result(rule, FAIL, F.size(d), F.array_join(d, ";"))).otherwise(
            _result(rule, WARN, 0, "no source")
        ),
    )
    checked = _from_issues(rule, F.concat(foreign, let(F.upper(ctx.source), unsupported)))
    return (
        F.when(~ctx.answer.rlike(r"\S"), _result(rule, FAIL, 1, "empty")).when(has_source, checked).otherwise(no_source)
    )


def truncation(ctx: Context, rule: str) -> Column:
    def issues(text: Column) -> Column:
        last = strip_blanks(F.substring_index(text, "\n", -1))
        # An ending is at most a few words: only the tail is searched for it.
        tail = F.when(F.length(text) > 40, F.substring(text, -40, 40)).otherwise(text)
        fences = F.size(F.split(text, "```")) - 1
        return F.array_compact(
            F.array(
                F.when(fences % 2 == 1, "code fence"),
                F.when(tail.rlike(OPEN_ENDING), "open ending"),
                F.when(tail.rlike(r"[•\-–—]\s*$"), "empty bullet"),
                F.when(last.rlike(r"^[•\-–—*]\s+\S") & ~last.rlike(CLOSED_ENDING) & (F.length(last) < 80), "cut bullet"),
                F.when(text.endswith("...") | text.endswith("…"), "ellipsis"),
            )
        )

    checked = _from_issues(rule, let(rstrip_blanks(ctx.answer), issues))
    return F.when(~ctx.answer.rlike(r"\S"), _result(rule, FAIL, 1, "empty")).otherwise(checked)


Rule = Callable[[Context, str], Column]

RULES: dict[str, Rule] = {
    "Formatting": formatting,
    "HeadingStructure": heading_structure,
    "DuplicateSection": duplicate_section,
    "EmptySection": empty_section,
    "WordCount": section_word_count,
    "RequiredSections": required_sections,
    "BlueprintCompliance": blueprint_compliance,
    "EvidenceCoverage": evidence_coverage,
    "ReferenceConsistency": reference_consistency,
    "ScopeLength": scope_length,
    "Grounding": grounding,
    "Truncation": truncation,
}


def enabled_rules(disabled: Iterable[str] = (), rules: Mapping[str, Rule] | None = None) -> dict[str, Rule]:
    rules = RULES if rules is None else rules
    unknown = set(disabled) - set(rules)
    if unknown:
        raise ValueError(f"unknown rules {sorted(unknown)}")
    return {n: r for n, r in rules.items() if n not in set(disabled)}


def run_rules(answers: DataFrame, disabled: Iterable[str] = (), rules: Mapping[str, Rule] | None = None) -> DataFrame:
    """Add ``results``: one entry per enabled rule, in registry order."""
    active = enabled_rules(disabled, rules)
    staged = answers.withColumn("__sections", split_sections(F.col("answer_text")))
    ctx = Context(staged)
    found = [rule(ctx, name).cast(RESULT) for name, rule in active.items()]
    results = F.array(*found) if found else F.array().cast(f"array<{RESULT}>")
    return staged.withColumn("results", results).drop("__sections")


def rule_rows(answers: DataFrame, key: str = "qid", **kw) -> DataFrame:
    """Long form: one row per answer and rule."""
    return run_rules(answers, **kw).select(key, F.inline("results"))


def validate(answers: DataFrame, disabled: Iterable[str] = (), rules: Mapping[str, Rule] | None = None) -> DataFrame:
    """Add the report: passed, score, failed and warned rules, counts."""
    ran = run_rules(answers, disabled, rules)
    named = lambda sev: F.transform(F.filter("results", lambda r: r["severity"] == sev), lambda r: r["rule"])
    n = F.size("results")
    n_pass = count_where(F.col("results"), lambda r: r["severity"] == PASS)
    n_warn = count_where(F.col("results"), lambda r: r["severity"] == WARN)
    return ran.withColumns(
        {
            "failed_rules": named(FAIL),
            "warned_rules": named(WARN),
            "score": F.when(n == 0, F.lit(1.0)).otherwise((n_pass + 0.5 * n_warn) / n),
            "rule_count": n.cast("bigint"),
            "info_count": n_pass.cast("bigint"),
        }
    ).withColumn("passed", F.size("failed_rules") == 0)


def validation_summary(validated: DataFrame) -> DataFrame:
    return validated.select(
        "qid",
        "passed",
        "score",
        F.array_join("failed_rules", ",").alias("failed_rules"),
        F.array_join("warned_rules", ",").alias("warned_rules"),
        "info_count",
        "rule_count",
    )


def eval_expectations(validated: DataFrame, cases: DataFrame, key: str = "qid") -> DataFrame:
    """Compare reports with the expected pass flag and any-of failing rules."""
    joined = cases.join(validated.select(key, "passed", "failed_rules"), key, "left")
    any_of = F.coalesce(F.col("expect_failed_any"), F.array().cast("array<string>"))
    rules_ok = (F.size(any_of) == 0) | F.coalesce(F.arrays_overlap("failed_rules", any_of), F.lit(False))
    return joined.withColumn("as_expected", F.coalesce(F.col("passed") == F.col("expect_pass"), F.lit(False)) & rules_ok)


