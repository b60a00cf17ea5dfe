"""Exact, near and substring deduplication next to plain versions."""

import hashlib
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import plain

from quire.llm import exact_dedup, jaccard, substrings
from quire.llm.components import smallest_reachable

SCHEMA = "doc_id long, text string, id long, at string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)] + ["Ähre", "été", "ABC", "abc"]
    rows = []
    phrase = " ".join(rng.choices(vocabulary, k=60))
    for k in range(60):
        own = rng.choices(vocabulary, k=rng.randrange(30, 160))
        rows.append((k * 3, " ".join(own)))
        for n in range(rng.choice((0, 0, 1, 4))):
            near = own[:]
            for _ in range(rng.randrange(0, 6)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append((1000 + k * 7 + n, "\t".join(near)))
        if k % 4 == 0:
            rows.append((k * 3 + 1, " ".join(own[:40]) + "\n" + phrase + " " + " ".join(own[40:])))
    # A tight group, repeats, short and empty texts, nulls, one long text of one word.
    base = rng.choices(vocabulary, k=120)
    for n in range(40):
        near = base[:]
        near[rng.randrange(120)] = f"n{n}"
        rows.append((5000 + n, " ".join(near)))
    rows += [(6000 + n, "the same words " * 30) for n in range(9)]
    rows += [(7000, None), (7001, ""), (7002, " \n\t"), (7003, "one"), (7004, "ONE"), (7005, "one two three four"), (7006, "one  two three four")]
    rows += [(None, "one two three four five six"), (7007, "one two three four five six"), (7008, "x" * 5000), (7009, "be " * 3000), (7010, "be " * 2500)]
    rng.shuffle(rows)
    return rows


def test_exact(spark, corpus):
    rows = corpus + corpus[:7]  # repeated rows
    got = [tuple(r) for r in exact_dedup.report(frame(spark, rows, 40)).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert plain.order(got) == plain.order(plain.exact(rows))
    stays = exact_dedup.unique(frame(spark, rows, 5))
    assert stays.columns == ["doc_id", "text", "id", "at"]
    assert sorted(r[0] is None or r[0] for r in stays.select("doc_id").collect()) == sorted(r[0] is None or r[0] for r in plain.exact(rows) if r[3])


def test_exact_digest_and_order(spark):
    got = {r.doc_id: r for r in exact_dedup.report(frame(spark, [(5, "a b"), (3, "a\x0bb"), (9, "a  b"), (1, "é\u00a0")])).collect()}
    assert got[3].keep_id == got[5].keep_id == 9 and got[9].group_size == 3
    assert got[5].text_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert got[1].text_sha256 == hashlib.sha256("é\u00a0".encode()).hexdigest()


def test_jaccard(spark, corpus):
    rows = corpus + corpus[:7]
    got = [tuple(r) for r in jaccard.components(frame(spark, rows)).collect()]
    assert plain.order(got) == plain.order(plain.jaccard(rows))


def test_jaccard_blocks_and_boundary(spark, corpus, monkeypatch):
    """Small blocks and a scan of several batches give the same components."""
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    chosen = [r for r in corpus if r[0] is not None and (r[0] >= 5000 or r[0] < 60)]
    got = [tuple(r) for r in jaccard.components(frame(spark, chosen, 7)).collect()]
    assert plain.order(got) == plain.order(plain.jaccard(chosen))


def test_jaccard_at_the_threshold(spark):
    words = [f"a{k}" for k in range(11)]
    # 7 and 6 shingles, 6 shared: 6/7 links; 12 of 16 is exactly 75 %.
    rows = [(1, " ".join(words)), (2, " ".join(words[:10])), (3, " ".join(f"b{k}" for k in range(18))), (4, " ".join(f"b{k}" for k in range(16)) + " c d e f")]
    got = {r[0]: r[2] for r in jaccard.components(frame(spark, rows)).collect()}
    assert got == {i: c for i, _, c in plain.jaccard(rows)}


def test_representatives(spark, corpus):
    rows = [r for r in corpus if r[0] is not None]
    got = sorted(r.doc_id for r in jaccard.representatives(frame(spark, rows)).collect())
    assert got == sorted(i for i, _, c in plain.jaccard(rows) if i == c)


def test_representatives_of_repeated_ids(spark):
    """A row goes by its own text, whatever other rows of its id are linked with."""
    one, two, three, four = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(3, one), (5, one + " end"), (5, two), (7, two + " end"), (5, three), (9, three + " end"), (5, three + " other"), (8, four), (None, one)]
    got = {(r.doc_id, r.text) for r in jaccard.representatives(frame(spark, rows)).collect()}
    assert {(3, one), (5, two), (8, four), (None, one)} <= got and len(got) == 5
    assert len(got & {(5, three), (5, three + " other")}) == 1


@pytest.mark.parametrize("width", [50, 26, 7, 104])
def test_substrings(spark, corpus, width):
    rows = corpus + corpus[:5] + [(8000, (corpus[3][1] or "") + " end"), (8001, corpus[3][1]), (8001, "other " + (corpus[9][1] or "")), (8001, corpus[9][1])]
    got = [tuple(r) for r in substrings.report(frame(spark, rows), width=width).collect()]
    want = [(i, n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, n, kept in plain.substrings(rows, width)]
    assert plain.order(got) == plain.order(want)


def test_widths():
    assert substrings.widths(50) == [25, 50]
    assert substrings.widths(104) == [13, 26, 52, 104]
    assert substrings.widths(7) == [7]


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 299)]
    got = {r.node: r.label for r in smallest_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 100 for k in range(100, 160)) and got[300] == got[299] == 299


def test_release(spark, tmp_path):
    from quire.llm import tables

    path = tables.keep(spark.range(3), "three").inputFiles()[0].removeprefix("file:")
    assert Path(path).exists()
    tables.release(spark)
    assert not Path(path).exists() and tables.keep(spark.range(3), "three").count() == 3


def test_empty_tables(spark):
    none = frame(spark, [], 1)
    assert exact_dedup.report(none).count() == 0
    assert jaccard.components(none).count() == 0
    assert substrings.report(none).count() == 0
    assert exact_dedup.unique(none).count() == 0


@pytest.mark.parametrize("block", [4096, 50])
def test_jaccard_of_a_loose_group(spark, monkeypatch, block):
    """Copies of one text with so many changes that most of them lie between 0.5 and 0.85 of each other."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for n in range(260):
        own = base[:]
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((n, " ".join(own)))
    got = [tuple(r) for r in jaccard.components(frame(spark, rows)).collect()]
    assert plain.order(got) == plain.order(plain.jaccard(rows))
