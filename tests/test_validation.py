import random
import time

import pytest
from pyspark.sql import functions as F

from quire.operators import blocks as B
from quire.operators import cache as I
from quire.operators import validation as H

BLUEPRINT = "array<struct<name:string,category:string,words:int,required:boolean,metadata:string>>"


@pytest.fixture
def judge(spark):
    def run(text, rule, marks=None, source=None, blueprint=None, target=None):
        df = spark.createDataFrame(
            [("q", text, marks, source, target, blueprint)],
            f"qid string, answer_text string, marks int, source_text string, target_words int, blueprint {BLUEPRINT}",
        )
        r = H.rule_rows(df, rules={rule: H.RULES[rule]}).first()
        return r.severity, r.n_issues, r.detail

    return run


def test_formatting(judge):
    assert judge("", "Formatting")[0] == "fail"
    assert judge("ok\n\n\nx ", "Formatting") == ("fail", 2, "blank lines;trailing whitespace")
    assert judge("fine", "Formatting")[0] == "pass"


def test_sections(judge, spark):
    text = "lost\nDefinition: a\nmore\n**Types**\n- b\nClinical Features\nc. d"
    df = spark.createDataFrame([("q", text)], "qid string, answer_text string")
    rows = [(r.name, r.content) for r in H.section_rows(df).orderBy("section_no").collect()]
    assert rows == [("Definition", "Definition: a\nmore"), ("Types", "**Types**\n- b"), ("Clinical Features", "Clinical Features\nc. d")]
    assert judge("plain text only, no heading.", "HeadingStructure")[0] == "warn"
    assert judge("Types: x\nTYpes: y", "DuplicateSection") == ("fail", 1, "types=2")
    assert judge("Types:\nOther:\nx", "EmptySection")[0] == "pass"


def test_blueprint_rules(judge):
    plan = [("introduction", "framing", 10, True, None), ("types", "medical", 3, True, "section_x")]
    text = "Introduction: one two three\nTypes: a b"
    assert judge(text, "WordCount", blueprint=plan)[:2] == ("fail", 1)
    assert judge(text, "RequiredSections", blueprint=plan)[0] == "pass"
    assert judge("Types: a", "RequiredSections", blueprint=plan) == ("fail", 1, "introduction")
    assert judge("Types: a\nExtra: b", "BlueprintCompliance", blueprint=plan)[0] == "fail"
    for rule in ("WordCount", "RequiredSections", "BlueprintCompliance", "EvidenceCoverage"):
        assert judge(text, rule)[0] == "warn"


def test_references(judge):
    assert judge("Part: x [chunk_ab12cd] y [ab12cd]", "ReferenceConsistency")[0] == "fail"
    assert judge("Part: pregnancy pregnancy", "ReferenceConsistency")[0] == "pass"


def test_scope(judge):
    assert judge("w " * 300, "ScopeLength", marks=5)[0] == "pass"
    assert judge("w " * 300, "ScopeLength", marks=10)[0] == "fail"
    assert judge("w", "ScopeLength")[0] == "warn"
    assert judge("w " * 100, "ScopeLength", marks=3, target=125) == ("pass", 0, "100,87,137")


@pytest.mark.parametrize(
    "text, source, want",
    [
        ("Uses PRAMS data", "anything", "fail"),
        ("Uses PRAMS data", None, "fail"),
        ("WHO says so", "no match", "pass"),
        ("The XQZV plan", "no match", "fail"),
        ("The XQZV plan", "about xqzv", "pass"),
        ("Under the Golden Rice Yojana", "no match", "fail"),
        ("Under the Janani Suraksha Yojana", "no match", "pass"),
        ("fine", None, "warn"),
    ],
)
def test_grounding(judge, text, source, want):
    assert judge(text, "Grounding", source=source)[0] == want


@pytest.mark.parametrize("text, bad", [("It ends with", True), ("So on...", True), ("- cut", True), ("All done.", False), ("```x", True)])
def test_truncation(judge, text, bad):
    assert (judge(text, "Truncation")[0] == "fail") is bad


def test_report_and_disabling(spark):
    df = spark.createDataFrame([("q", "Definition: fine.\nIt ends with")], "qid string, answer_text string")
    row = H.validate(df).first()
    assert row.failed_rules == ["Truncation"] and not row.passed and row.rule_count == 12 and 0 <= row.score <= 1
    assert H.validate(df, disabled=["Truncation"]).first().passed
    assert H.validate(df, disabled=list(H.RULES)).first().score == 1.0
    with pytest.raises(ValueError):
        H.validate(df, disabled=["Nope"])


def test_own_rule(spark):
    shout = lambda ctx, rule: H._from_issues(rule, F.array_compact(F.array(F.when(ctx.answer.rlike("!"), F.lit("loud")))))
    df = spark.createDataFrame([("q", "hey!")], "qid string, answer_text string")
    assert H.validate(df, rules={**H.RULES, "Shout": shout}).first().failed_rules[-1] == "Shout"


def test_blocks(spark):
    text = "Title\n- sub\n• main\npara one\npara two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n```dot\ng {\n}\n```\nend."
    df = spark.createDataFrame([("q", text)], "qid string, answer_text string")
    rows = [(r.kind, r.content) for r in B.answer_blocks(df).orderBy("block_no").collect()]
    assert rows == [
        ("heading", "Title"), ("sub_bullet", "sub"), ("main_bullet", "main"), ("paragraph", "para one para two"),
        ("table", "a | b\n1 | 2"), ("diagram", "g {\n}"), ("paragraph", "end."),
    ]


def test_staleness(spark):
    kb = spark.createDataFrame([("s", 2)], "subject string, revision int")
    good = {"schema": 3, "prompt": 7, "retrieval": 1, "validator": 7, "renderer": 1}
    rows = [("fresh", "s", good, "m", 2), ("none", "s", None, "m", 2), ("old", "s", {**good, "prompt": 6}, "x", 1), ("norev", "s", good, "m", None), ("newsub", "t", good, None, None)]
    df = spark.createDataFrame(rows, "qid string, subject string, versions map<string,int>, embedding_model string, kb_revision int")
    out = {r.qid: r.stale_reasons for r in I.stale_reasons(df, kb, "m").collect()}
    assert out["fresh"] == [] and out["newsub"] == [] and out["norev"] == ["kb_reindexed"]
    assert out["old"] == ["prompt_version_drift", "embedding_model_drift", "kb_reindexed"]
    assert out["none"][0] == "missing_versions_field" and len(out["none"]) == 6


def plain_blocks(lines):
    """The same blocks by a walk from line to line, for lines of a few known forms."""
    out, mode, i = [], "", 0
    bar = lambda x: "|" in x
    separator = lambda x: x in ("|--|", "|---|:-:|")
    cells = lambda x: " | ".join(c.strip() for c in x.strip("|").split("|"))
    kinds = {"- a": ("sub_bullet", "a"), "• b": ("main_bullet", "b"), "Title": ("heading", "Title"), "- x | y": ("sub_bullet", "x | y")}
    for i, x in enumerate(lines):
        if mode == "fence":
            if x == "```":
                mode = ""
            else:
                out[-1][1].append(x)
        elif mode == "head":
            mode = "table"
        elif mode == "table" and bar(x) and not separator(x):
            out[-1][1].append(cells(x))
        elif x == "```dot":
            mode = "fence"
            out.append(("diagram", [], "\n"))
        elif bar(x) and i + 1 < len(lines) and separator(lines[i + 1]):
            mode = "head"
            out.append(("table", [cells(x)], "\n"))
        elif x == "":
            mode = ""
        elif x in kinds:
            mode = kinds[x][0]
            out.append((mode, [kinds[x][1]], ""))
        elif mode == "paragraph":
            out[-1][1].append(x)
        else:
            mode = "paragraph"
            out.append((mode, [x], " "))
    return [(kind, sep.join(parts)) for kind, parts, sep in out]


def test_blocks_equal_a_walk(spark):
    forms = ["- a", "• b", "Title", "- x | y", "|--|", "|---|:-:|", "| c | d", "```dot", "```", "", "some words", "more words."]
    rng = random.Random(5)
    texts = [[rng.choice(forms) for _ in range(rng.randint(1, 40))] for _ in range(300)]
    df = spark.createDataFrame([(k, "\n".join(t)) for k, t in enumerate(texts)], "qid int, answer_text string")
    got = {}
    for r in sorted(B.answer_blocks(df).collect(), key=lambda r: (r.qid, r.block_no)):
        got.setdefault(r.qid, []).append((r.kind, r.content))
    for k, t in enumerate(texts):
        assert got.get(k, []) == plain_blocks(t), t


def test_blocks_of_a_long_answer(spark):
    """Time grows with the lines: 40,000 take seconds."""
    text = "\n".join("- item" if k % 3 else f"line {k}." for k in range(40_000))
    df = spark.createDataFrame([("q", text)], "qid string, answer_text string")
    begun = time.time()
    assert B.answer_blocks(df).count() == 40_000
    assert time.time() - begun < 60
