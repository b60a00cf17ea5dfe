"""Secret scan: known forms by pattern, unknown ones by sliding-window entropy per character class.

Everything is an expression over one row: no shuffle, no Python, and the work of a document follows
its length alone.  A *candidate* is a long run of key characters between separators (``/ _ = -`` and all
that no key holds), so a name or path next to a key neither changes its class nor hides it.  A window slides over it; the
counts of the characters in it and the sum of c*log2(c) over them are kept up by one addition and one
removal a step (in whole millionths of a bit, so the sums are exact).  The candidate's class (hex,
mixed or letters) gives the window and the least entropy; windows at or above it join to spans.  Candidates on the
allow-list (checksums of the right length after their name, listed values, alphabets) yield no span; the parts of a
dashed UUID are too short to be candidates.  The
pattern spans (assignments, access ids, hex runs) are never suppressed.

Positions are code points, ends exclusive.  Defined results: null or empty text has no spans; repeated
rows are scanned alike; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: A maximal run of lower-case hex digits of 16 or more is what HEX leaves after its length test.
HEX_LONG = "[0-9a-f]{16,}"
#: A checksum with its name in front, or a part between separators.
CANDIDATE = (
    "(?:[Mm][Dd]5[-_=][0-9A-Fa-f]{32}|[Ss][Hh][Aa]1[-_=][0-9A-Fa-f]{40}|[Ss][Hh][Aa]256[-_=][0-9A-Fa-f]{64}|[Ss][Hh][Aa]384[-_=][0-9A-Fa-f]{96}"
    "|[Ss][Hh][Aa]512[-_=][0-9A-Fa-f]{128})\\b|[A-Za-z0-9+]{20,}"
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: class: (pattern of the whole candidate, window, least entropy of a window in bits)
CLASSES = {
    "hex": ("^[0-9A-Fa-f]+$", 20, 3.0),
    "mixed": ("[0-9][+]*[A-Za-z]|[A-Za-z][+]*[0-9]", 20, 3.75),
    # Capitals as close to each other as words and names written together hardly have them.
    "letters": ("(?:[A-Z][a-z]{0,2}){5}", 20, 3.95),
}
#: Candidates that are no secrets: alphabets in order, published checksums by their names.
ALLOWED = ("(?i)0123456789abcdef|abcdefghijklmnopqrst", "^(?:[Mm][Dd]5|[Ss][Hh][Aa][0-9]+)[-_=]")
KINDS = ("assign", "access", "hex", "entropy")
SPANS = "array<struct<start: int, kind: int, end: int>>"
UNIT = 1_000_000


def prefix_sums(values: str) -> str:
    """Running sums of an array of numbers by doubling shifts: n log n for an array of n."""
    shifts = f"transform(sequence(0, cast(ceil(log2(greatest(size({values}), 2))) as int)), k -> shiftleft(1, k))"
    return f"aggregate({shifts}, {values}, (acc, s) -> transform(acc, (x, i) -> x + coalesce(get(acc, i - s), 0)))"


def matches(df: DataFrame, text: str, name: str, pattern: str, test: str | None = None) -> DataFrame:
    """Adds ``name``: start, end and text of the leftmost non-overlapping matches that pass ``test``.

    ``test`` is an SQL condition on ``g``, the second group of the match.  Between the matches lie the
    parts that splitting by the pattern gives; running sums of both lengths are the positions.
    """
    # Raw literals: no escape is read in them; a quote in a pattern ends the other kind of literal.
    p = "r\"" + pattern.replace('"', "\\x22") + "\""
    whole = f"regexp_extract_all({text}, {p}, 0)"
    if test is None:
        raw = f"transform({whole}, m -> struct(m, '' as g))"
    else:
        raw = f"zip_with({whole}, regexp_extract_all({text}, {p}, 2), (m, g) -> struct(m, g))"
    df = df.withColumn(f"{name}_m", F.expr(f"case when rlike({text}, {p}) then {raw} else array() end"))
    df = df.withColumn(
        f"{name}_g",
        F.expr(f"case when size({name}_m) > 0 then transform(slice(split({text}, {p}, -1), 1, size({name}_m)), x -> length(x)) else cast(array() as array<int>) end"),
    )
    df = df.withColumn(f"{name}_x", F.expr(f"zip_with({name}_m, {name}_g, (a, b) -> length(a.m) + b)"))
    df = df.withColumn(f"{name}_e", F.expr(f"case when size({name}_x) > 1 then {prefix_sums(f'{name}_x')} else {name}_x end"))
    found = f"zip_with({name}_m, {name}_e, (a, e) -> struct(e - length(a.m) as start, e as end, a.m as m, a.g as g))"
    kept = f"filter({found}, f -> {test.replace('g)', 'f.g)')})" if test else found
    return df.withColumn(name, F.expr(kept)).drop(*[f"{name}_{s}" for s in "mgxe"])


def window_spans(candidate: str, window: int, bits: float) -> str:
    """SQL for the spans, from 0 within ``candidate``, of windows of at least ``bits`` of entropy."""
    # s = sum of c*log2(c); the entropy is log2(w) - s/w, so a high entropy is a low s.
    cost = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(window + 2)]
    most = math.floor(window * (math.log2(window) - bits) * UNIT)
    steps = "array(" + ", ".join(f"{b - a}L" for a, b in zip(cost, cost[1:])) + ")"
    codes = f"transform(split({candidate}, ''), c -> locate(c, '{ALPHABET}'))"
    w = window
    zero = (
        f"named_struct('n', array_repeat(0, {len(ALPHABET) + 1}), 's', 0L, 'lo', -1, 'hi', -1, 'done', cast(array() as array<struct<lo: int, hi: int>>))"
    )
    gone = f"if(i >= {w}, get(cs, i - {w}), -1)"
    inner = (
        "named_struct("
        "'n', transform(acc.n, (v, j) -> v + if(j = get(cs, i), 1, 0) - if(j = out, 1, 0)), "
        f"'s', acc.s - if(out >= 0, get({steps}, get(acc.n, out) - 1), 0L) + get({steps}, get(acc.n, get(cs, i)) - if(out = get(cs, i), 1, 0)), "
        "'lo', acc.lo, 'hi', acc.hi, 'done', acc.done)"
    )
    moved = f"aggregate(array({gone}), acc, (acc, out) -> {inner})"
    marked = (
        "aggregate(array(1), b, (b, one) -> named_struct('n', b.n, 's', b.s, "
        f"'lo', if(i >= {w - 1} and b.s <= {most}L and i - {w - 1} > b.hi, i - {w - 1}, b.lo), "
        f"'hi', if(i >= {w - 1} and b.s <= {most}L, i + 1, b.hi), "
        f"'done', if(i >= {w - 1} and b.s <= {most}L and i - {w - 1} > b.hi and b.hi >= 0, concat(b.done, array(named_struct('lo', b.lo, 'hi', b.hi))), b.done)))"
    )
    step = f"aggregate(array({moved}), acc, (x, b) -> {marked})"
    fold = (
        f"aggregate(sequence(0, size(cs) - 1), {zero}, (acc, i) -> {step}, "
        "acc -> if(acc.hi >= 0, concat(acc.done, array(named_struct('lo', acc.lo, 'hi', acc.hi))), acc.done))"
    )
    return f"flatten(transform(array({codes}), cs -> {fold}))"


def entropy_spans(found: str, classes: dict = CLASSES, allowed: tuple[str, ...] = ALLOWED, allowed_values: tuple[str, ...] = ()) -> str:
    """SQL for the entropy spans of an array of candidates with start and m."""
    lit = lambda x: "r\"" + x.replace('"', "\\x22") + "\""
    off = " or ".join([f"rlike(f.m, {lit(p)})" for p in allowed] + [f"f.m = {lit(v)}" for v in allowed_values])
    spans = "cast(array() as array<struct<lo: int, hi: int>>)"
    for pattern, window, bits in reversed(classes.values()):
        spans = f"case when rlike(f.m, {lit(pattern)}) then {window_spans('f.m', window, bits)} else {spans} end"
    free = f"filter({found}, f -> not ({off}))" if off else found
    return f"flatten(transform({free}, f -> transform({spans}, s -> struct(f.start + s.lo as start, {len(KINDS) - 1} as kind, f.start + s.hi as end))))"


def scan(df: DataFrame, text: str = "text", spans: str = "secret_spans", **options) -> DataFrame:
    """Adds ``spans``: start, kind (index into KINDS) and end of every span, in order."""
    out = df.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    for name, pattern, test in (
        ("__assign", ASSIGN, "length(g) >= 12"),
        ("__access", ACCESS + "", None),
        ("__hex", HEX_LONG, None),
        ("__candidate", CANDIDATE, None),
    ):
        out = matches(out, "__text", name, pattern, test)
    out = out.withColumn("__access", F.expr("filter(__access, f -> length(f.m) >= 18)"))
    base = [f"transform({name}, f -> struct(f.start as start, {kind} as kind, f.end as end))" for kind, name in enumerate(("__assign", "__access", "__hex"))]
    out = out.withColumn(spans, F.expr(f"cast(array_sort(concat({', '.join(base)}, {entropy_spans('__candidate', **options)})) as {SPANS})"))
    return out.drop("__text", "__assign", "__access", "__hex", "__candidate")


def listed(spans: str) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', get({kinds}, s.kind), s.start, s.end)), ',')")


def report(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), **options)
    count = lambda k: F.expr(f"cast(size(filter(secret_spans, s -> s.kind = {k})) as bigint)")
    return found.select(
        F.col("id").alias(doc_id),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(listed("filter(secret_spans, s -> s.kind < 3)"), 256).alias("base_sha256"),
        listed("secret_spans").alias("spans"),
    )


def redact(df: DataFrame, text: str = "text", mask: str = "[secret]", **options) -> DataFrame:
    """All rows and columns, with ``mask`` in place of every span in ``text``; spans that touch are one."""
    hide = (
        f"aggregate(__spans, named_struct('at', 0, 'parts', cast(array() as array<string>)), "
        f"(a, s) -> named_struct('at', greatest(a.at, s.end), 'parts', if(a.at > 0 and s.start <= a.at, a.parts, "
        f"concat(a.parts, array(substring(`{text}`, a.at + 1, s.start - a.at)))))"
        f", a -> array_join(concat(a.parts, array(substring(`{text}`, a.at + 1))), r\"{mask}\"))"
    )
    out = scan(df, text, "__spans", **options)
    return out.withColumn(text, F.when(F.size("__spans") > 0, F.expr(hide)).otherwise(F.col(text))).drop("__spans")
