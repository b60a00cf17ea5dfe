import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import tokens as K
from quire.operators import books as D
from quire.operators import chapters as C
from quire.operators import chunks as W
from quire.operators import evaluation as J
from quire.operators import extraction as E
from quire.operators import pages as P
from quire.operators import planning as Q
from quire.operators.packing import pack_pages


def book(spark, texts, name="b"):
    return spark.createDataFrame([(name, i + 1, t) for i, t in enumerate(texts)], "book_id string, page_num bigint, text string")


def test_chapters_cover_every_page_once(spark):
    pages = book(spark, ["intro", "CHAPTER 1\nx", "y", "2. Next\nz", "w"])
    rows = [tuple(r) for r in C.segment_chapters(pages).orderBy("start_page").select("title", "start_page", "end_page", "confidence").collect()]
    assert rows == [("b", 1, 1, 1.0), ("CHAPTER 1", 2, 3, 1.0), ("2. Next", 4, 5, 1.0)]


def test_no_heading_is_one_chapter(spark):
    rows = C.segment_chapters(book(spark, ["aa", "bb"])).collect()
    assert [(r.title, r.start_page, r.end_page, r.confidence) for r in rows] == [("b", 1, 2, 0.5)]


@pytest.mark.parametrize("size, overlap", [(5, 2), (3, 0), (7, 6), (100, 10)])
def test_windows_match_the_joined_text(spark, size, overlap):
    texts = ["one two thr", "ee four", "", " five six", "seven", "eight ", "   ", "nine ten eleven twelve thirteen"]
    pages = book(spark, texts).withColumn("chapter_start", F.lit(1))
    tokens = "".join(texts).split()
    got = [r.text for r in W.chunk_windows(pages, size, overlap).orderBy("window_no").collect()]
    want, start = [], 0
    while True:
        want.append(" ".join(tokens[start : start + size]))
        if start + size >= len(tokens):
            break
        start += size - overlap
    assert got == want


def test_windows_page_ranges_and_errors(spark):
    pages = book(spark, ["a b c ", "d e f ", "g"]).withColumn("chapter_start", F.lit(1))
    rows = W.chunk_windows(pages, 4, 1).orderBy("window_no").collect()
    assert [(r.page_start, r.page_end, r.token_count) for r in rows] == [(1, 2, 4), (2, 3, 4)]
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            W.chunk_windows(pages, *bad)


def test_offsets(spark):
    pages = book(spark, ["abc", "", "de"]).withColumn("chapter_start", F.lit(1))
    placed = C.page_offsets(pages)
    probes = spark.createDataFrame([("b", 1, o) for o in range(5)], "book_id string, chapter_start int, offset bigint")
    out = {r.offset: r.page for r in C.offset_to_page(probes, placed).collect()}
    assert out == {0: 1, 1: 1, 2: 1, 3: 3, 4: 3}


def test_choose_and_override(spark):
    native = spark.createDataFrame([(1, "x" * 100), (2, "short"), (3, "short")], "p int, text string")
    ocr = spark.createDataFrame([(1, "y" * 200), (2, "longer text"), (3, "x")], "p int, text string")
    out = {r.p: (r.longer_method, r.ocr_method) for r in P.choose_page_text(native, ocr, ["p"], prefer=("longer", "ocr")).collect()}
    assert out == {1: ("text", "text"), 2: ("ocr", "ocr"), 3: ("text", "ocr")}


def test_page_ranges(spark):
    pages = spark.createDataFrame([("b", p) for p in [1, 2, 4, 7, 8, *range(20, 60)]], "book_id string, page_num bigint")
    out = [(r.start_page, r.end_page) for r in D.page_ranges(pages).orderBy("start_page").collect()]
    assert out == [(1, 4), (7, 8), (20, 47), (48, 59)]


def test_mcq_parsing(spark):
    page = "1. Which is red? (a) sky (b) blood, (c) leaf (d) yellow. Key:b 2. Discuss fever in detail"
    parsed = E.parse_questions(E.split_questions(book(spark, [page]))).orderBy("pos").collect()
    assert [(r.type, r.question_text, r.answer) for r in parsed] == [("mcq", "Which is red?", "b"), ("theory", "Discuss fever in detail", None)]
    assert parsed[0].options == {"a": "sky", "b": "blood", "c": "leaf", "d": "yellow"}


def test_later_option_wins(spark):
    parsed = E.parse_questions(E.split_questions(book(spark, ["1. Q (a) x (b) y (a) z"]))).first()
    assert parsed.options == {"a": "z", "b": "y"}


def test_section_marks_carry_forward(spark):
    pages = book(spark, ["SECTION A 1 0 marks", "nothing", "section B5 marks and 5 Marks"])
    out = [(r.section, r.marks) for r in E.page_section_marks(pages).orderBy("page_num").collect()]
    assert out == [("A", 10), ("A", 10), ("B", 5)]


def test_bank_segments(spark):
    pages = book(spark, ["lead\nCHAPTER 2: LEGAL PROCEDURE abc\nLong answer\nq one", "q two\nShort notes\nq three"])
    out = [(r.segment, r.page_num, r.marks, r.chapter, r.text) for r in E.segment_bank_text(pages).orderBy("segment", "page_num").collect()]
    chapter = "CHAPTER 2: LEGAL PROCEDURE"
    assert out == [(0, 1, None, "", "lead"), (2, 1, 10, chapter, "q one"), (2, 2, 10, chapter, "q two"), (3, 2, 5, chapter, "q three")]


def test_replies(spark):
    texts = ['[{"question_text":"A b"}]', 'x [{"question_text":"A {"}, {"question_text":"cut', "no json", '{"a":1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, reply string")
    out = [(r.outcome, len(r["items"])) for r in E.parse_replies(df).orderBy("i").collect()]
    assert out[:3] == [("clean", 1), ("salvaged", 1), ("lost", 0)]


def test_packing(spark):
    df = spark.createDataFrame([(1, "aaaa\nbb\ncccccccccc\nd")], "i int, text string")
    out = [r.batch for r in E.pack_lines(df, 8).orderBy("batch_no").collect()]
    assert out == ["aaaa\nbb", "cccccccccc", "d"]


@pytest.mark.parametrize("block", [1, 3, 8, 4096])
def test_page_packing_in_blocks(spark, block):
    rng = random.Random(block)
    rows, want = [], {}
    for name, n in (("hot", 90), ("one", 1)):
        used, batch = 0, 0
        for i in range(1, n + 1):
            size = rng.choice([0, 3, 10, 20, 70])
            rows.append((name, i, "x" * size))
            if batch == 0 or used + size + 2 > 50:
                batch, used = batch + 1, 0
            used += size + 2
            want[name, i] = batch
    pages = spark.createDataFrame(rows, "book_id string, page_num bigint, text string")
    got = {(r.book_id, r.page_num): r.batch_no for r in pack_pages(pages, 50, block).collect()}
    assert got == want


@pytest.mark.parametrize("size, overlap", [(5, 2), (4, 0), (50, 10)])
def test_windows_of_another_tokenizer_are_slices_of_the_text(spark, size, overlap):
    texts = ["one  two thr", "ee,\n four", "", "   ", "nine ten\televen — twelve"]
    cut = lambda t: re.findall(r"\s*\w{1,3}|\W", t)
    pages = book(spark, texts).withColumn("chapter_start", F.lit(1))
    tokens = [x for t in texts for x in cut(t)]
    starts = [s for s in range(0, len(tokens), size - overlap) if s == 0 or s + overlap < len(tokens)]
    want = ["".join(tokens[s : s + size]) for s in starts]
    for tokenizer in (K.function_tokenizer(cut), K.pattern_tokenizer(r"(?U)\s*\w{1,3}|\W")):
        got = W.chunk_windows(pages, size, overlap, tokenizer=tokenizer).orderBy("window_no").collect()
        assert [r.text for r in got] == want and [r.token_count for r in got] == [len(tokens[s : s + size]) for s in starts]
    assert starts[-1] + size >= len(tokens)


def test_windows_of_equal_ids_have_different_keys(spark):
    pages = book(spark, ["same words again " * 400]).withColumn("chapter_start", F.lit(1))
    cut = W.chunk_windows(pages, 300, 0)
    keyed = cut.withColumn("chunk_id", W.chunk_id(F.col("book_id"), F.col("page_start"), F.col("page_end"), F.col("text")))
    assert keyed.count() == 4 and keyed.select("chunk_id").distinct().count() == 1
    assert keyed.select("chunk_id", "chunk_seq").distinct().count() == 4


def test_merge_by_id(spark):
    form = "qid string, p int, question_text string"
    a = spark.createDataFrame([("q1", 1, "a1"), (None, 2, "a2"), ("q1", 3, "later"), ("", 1234, "a4")], form)
    b = spark.createDataFrame([("q1", 1, "b1"), ("q002", 2, "b2"), ("q9", 3, "b3")], form)
    got = {(r.qid, r.question_text) for r in E.merge_by_id([a, b], [], "p").collect()}
    assert got == {("q1", "a1"), ("q002", "a2"), ("q1234", "a4"), ("q9", "b3")}
    assert E.merge_by_id([a.limit(0), b.limit(0)], [], "p").count() == 0


def test_outcomes_of_a_batch(spark):
    asked = spark.createDataFrame([("m", "c", f"q{k}", f"prompt {k}") for k in range(6)] + [("m", None, "q1", "prompt null")], "module string, chapter string, qid string, prompt string")
    stored = spark.createDataFrame([("m", "c", "q1", "kept", 7, 0.5), ("m", "c", "q5", "kept", 7, 0.5)], "module string, chapter string, qid string, answer_text string, total_tokens long, latency_seconds double")

    def infer(prompts):
        if any("prompt 2" in p or "prompt 1" in p for p in prompts):
            raise RuntimeError("off")
        return [{"answer_text": "new", "total_tokens": 1, "latency_seconds": 0.1} for _ in prompts]

    late = F.col("qid") >= "q4"
    rows = J.answer_questions(asked, infer, stored, skip=late).collect()
    assert sorted((r.qid, r.outcome, r.answer_text) for r in rows) == [
        ("q0", "generated", "new"), ("q1", "cached", "kept"), ("q1", "generated", "new"), ("q2", "failed", None),
        ("q3", "generated", "new"), ("q4", "skipped", None), ("q5", "skipped", None),
    ]
    again = {(r.qid, r.chapter): r.outcome for r in J.answer_questions(asked, infer, stored, force=True).collect()}
    assert again["q1", "c"] == "failed" and again["q5", "c"] == "generated"


def test_words_of_questions_are_ascii(spark):
    texts = ["märch und", "the RCH here", "xrch", "épathİ NHM", "Übericds"]
    df = spark.createDataFrame([(i, t, "theory", 10) for i, t in enumerate(texts)], "qid int, question_text string, type string, marks int")
    hits = {r.qid: r.target_sections for r in Q.analyze_questions(df).collect()}
    assert [bool(hits[i]) for i in range(5)] == [True, True, False, True, False]
    flags = W.section_flags(df, "chunk", "question_text", ascii_words=True).orderBy("qid").collect()
    assert [r.section_national_programme for r in flags] == [True, True, False, True, False]
    plain = W.section_flags(df, "chunk", "question_text").orderBy("qid").collect()
    assert [r.section_national_programme for r in plain] == [False, True, False, True, False]


def test_breaks_take_the_letter_behind_a_number(spark):
    df = spark.createDataFrame([("20@mai 1. l6.example", "20@mai \n1. l6.example"), ("1. a 2) b", "\n1. a \n2) b"), ("x1.5 a3.\nb", "x1.5 a3.\nb"[:5] + "a\n3.\nb")], "t string, want string")
    assert all(r.got == r.want for r in df.select("want", E.break_inline_questions(F.col("t")).alias("got")).collect())


def test_batch_summary_lists_chapters(spark):
    rows = [("m", "q1", "c2", "generated", 3, 0.5), ("m", "q2", "c1", "failed", 9, 0.5), ("m", "q3", "c2", "cached", 4, 0.25), ("m", "q4", None, "skipped", 0, 0.0)]
    df = spark.createDataFrame(rows, "module string, qid string, chapter string, outcome string, total_tokens long, latency_seconds double")
    got = J.batch_summary(df, ["module"]).first()
    assert (got.chapters, got.n_chapters, got.questions_total, got.total_tokens) == (["c1", "c2"], 2, 4, 7)


def test_layout_scores_are_rounded_as_the_reference_database_does(spark):
    import duckdb

    lines = ["$$ " * 3] * 319 + ["$% " * 30] * 321
    got = D.select_layout_pages(book(spark, ["\n".join(lines)]), min_score=0.1).first()
    assert got.score == duckdb.execute("select round(0.28::double * (319 / 640::double / 0.55::double), 4)").fetchall()[0][0] == 0.2537


def test_page_ranges_by_the_score_of_their_statement(spark, tmp_path):
    from check import compare, duck
    import __spark_entry__ as entry
    import os

    source = "/root/testdata/sf0.001"
    for name in os.listdir(source):
        if name != "documents.parquet":
            os.symlink(f"{source}/{name}", tmp_path / name)
    table = "\n".join(["12 34 ab 56 78"] * 12)
    short = "\n".join(["short words only here"] * 12)
    rows = [(i, table if i % 3 == 0 else short, "en", "web", 100) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "d"))
    part = next(f for f in os.listdir(tmp_path / "d") if f.endswith(".parquet"))
    os.symlink(tmp_path / "d" / part, tmp_path / "documents.parquet")
    for query in ("d10_select_layout_pages", "d11_page_ranges"):
        assert compare(spark, duck(str(tmp_path)), entry.queries()[query], entry.oracle_sql()[query], str(tmp_path))[0] is None


def test_question_text_is_cut_once(spark):
    """The pattern of question starts is named once in the plan, so a page is not cut a second time for its size."""
    pages = spark.createDataFrame([("b", 1, "1. What is it? 2) Why")], "book_id string, page_num int, text string")
    plan = E.split_questions(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Question\\s+\\d+") == 1
    assert [r.raw for r in E.split_questions(pages).collect()] == ["\n1. What is it? ", "\n2) Why"]


def test_options_with_brackets_and_keys(spark):
    cases = {
        "stem (a) one; (b) two (c)": [("a", "one"), ("b", "two")],
        "stem (a) one (x) (b) two Key: b": [("b", "two")],
        "stem (a) one Answer : a) (b) Key: b (c) three": [("a", "one"), ("b", "Key: b"), ("c", "three")],
        "(A) x(a)y (a)z\n": [("A", "x"), ("a", "z")],
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id int, raw string")
    got = {r.id: r for r in E.parse_questions(rows).selectExpr("id", "type", "question_text", "answer", "map_entries(options) o").collect()}
    for i, want in enumerate(cases.values()):
        assert [tuple(x) for x in got[i].o] == (want if len(want) > 1 else [])
    assert (got[0].question_text, got[2].answer, got[1].type, got[3].question_text) == ("stem", "a", "theory", "")


def test_pieces_of_patterns_lose_no_section(spark):
    """Every text that a section's pattern matches holds one of the section's pieces."""
    stems = "epidemiological aetiology causation caused risk factors high-risk signs and symptoms clinical feature presenting complaint diagnosing ddx differentials lab tests haematology X-ray EKG CT scan prescribing drugs immunation prophylactic vaccination national programme NVBDCP RNTCP NHP medico-legal medicolegal legal aspect evidence act per 5 odds ratio mean ± is defined definition: refers to is a disease stages IV type 2 category -> → --> flow chart flowchart step 3: Table 4. tab. 7 see table Fig. 3 figure 9 diagram = π formula calculation: conclusions summary: to summarise key point take-home message in summary mechanism incidence testimony screening dosage".split()
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice((str, str.upper, str.title))(rnd.choice(stems)) for _ in range(rnd.randint(1, 4))) for _ in range(6000)]
    texts += [" ".join(stems[i : i + n]) for i in range(len(stems)) for n in (1, 2, 3, 4)] + ["İs A  disease", "FIGURE\n3", "Straße", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    entries = W.L.profile("chunk")
    assert {n for n, _ in W.L.CHUNK_PATTERNS} - set(W.L.CHUNK_PIECES) == {"section_statistics"}
    got = W.section_flags(df, "chunk").withColumns({f"p_{e.name}": F.col("text").rlike(e.pattern) for e in entries})
    for e in entries:
        assert got.filter(F.col(e.name) != F.col(f"p_{e.name}")).count() == 0 and got.filter(e.name).count() > 5
    assert "contains(" in W.section_flags(df, "chunk")._jdf.queryExecution().optimizedPlan().toString().lower()


def test_keywords_are_sorted_without_a_comparator(spark):
    df = spark.createDataFrame([("Beta alpha beta, gamma ALPHA the with from x-ray- café delta",)], "text string")
    top = df.select(K.top_keywords(F.col("text"), 3).alias("k"))
    assert top.first().k == ["alpha", "beta", "delta"]
    assert "array_sort" not in top._jdf.queryExecution().optimizedPlan().toString()


def test_breaks_next_to_the_aim(spark):
    """Of two breaks at the same distance the earlier one; blank lines before lines before blanks; no walk over a window."""
    text = "a" * 98 + " " + "b" * 1 + " " + "c" * 99
    lined = "a" * 60 + "\n\n\n" + "b" * 77 + " " + "c" * 59
    df = spark.createDataFrame([(1, text, [80, 80]), (2, lined, [80, 80]), (3, "x" * 300, [80, 80])], "id int, content string, page_lengths array<bigint>")
    out = P.distribute_text(df)
    got = {(r.id, r.page_off): r.text for r in out.collect()}
    assert (got[1, 0], got[2, 0], got[3, 0]) == ("a" * 98, "a" * 60, "x" * 150)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(1, length(" not in plan


@pytest.mark.parametrize("query", ["d10_select_layout_pages", "d11_page_ranges"])
def test_layout_pages_with_rows_of_numbers_equal_their_statement(spark, tmp_path, query):
    from check import compare, duck
    import __spark_entry__ as entry
    import os

    rnd = random.Random(3)
    token = lambda: rnd.choice([str(rnd.randrange(1000)), "ab", "word", "|", "é1", "x\ry"])
    line = lambda: "".join(token() + rnd.choice([" ", "  ", "\t"]) for _ in range(rnd.choice([0, 2, 4, 9, 14])))
    rows = [(i, "\n".join(line() for _ in range(rnd.choice([3, 9, 30]))), "en", "web", 100) for i in range(300)]
    source = "/root/testdata/sf0.001"
    for name in os.listdir(source):
        if name != "documents.parquet":
            os.symlink(f"{source}/{name}", tmp_path / name)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "d"))
    part = next(f for f in os.listdir(tmp_path / "d") if f.endswith(".parquet"))
    os.symlink(tmp_path / "d" / part, tmp_path / "documents.parquet")
    assert compare(spark, duck(str(tmp_path)), entry.queries()[query], entry.oracle_sql()[query], str(tmp_path))[0] is None


def test_flattened_flags_take_ascii_words(spark):
    texts = ["märch und", "the RCH here", "xrch", "épath NHM", "Übericds", "cauſes", "causatıon", "classİfication"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid int, answer_text string")
    flat = W.flatten_metadata(W.chunk_metadata(df, "answer_text", ascii_words=True)).orderBy("qid").collect()
    assert [r.section_national_programme for r in flat] == [True, True, False, True, False, False, False, False]
    assert [r.section_etiology for r in flat] == [False] * 5 + [True, False, False]
    assert not any(r.section_classification for r in flat)
    plain = W.flatten_metadata(W.chunk_metadata(df, "answer_text")).orderBy("qid").collect()
    assert [r.section_national_programme for r in plain] == [False, True, False, True, False, False, False, False]


def test_flattened_metadata_equals_its_statement(spark, tmp_path):
    from check import compare, duck
    import __spark_entry__ as entry
    import os

    texts = ["märch und überNHM", "the RCH here", "xrch", "Übericds äe", "ärztcauseö drug"]
    rows = [(i, 1, "assistant", t) for i, t in enumerate(texts)]
    source = "/root/testdata/sf0.001"
    for name in os.listdir(source):
        if name != "conversations.parquet":
            os.symlink(f"{source}/{name}", tmp_path / name)
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    part = next(f for f in os.listdir(tmp_path / "d") if f.endswith(".parquet"))
    os.symlink(tmp_path / "d" / part, tmp_path / "conversations.parquet")
    query = "c12_flatten_metadata"
    assert compare(spark, duck(str(tmp_path)), entry.queries()[query], entry.oracle_sql()[query], str(tmp_path))[0] is None
