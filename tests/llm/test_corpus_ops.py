"""Mixing, periodic runs and the Merkle manifest next to plain versions."""

import hashlib
import random
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import plain

from quire.llm import merkle, mixing, periodic, queries_corpus


def texts(rng, n, most):
    return [" ".join(rng.choices("abcdefg", k=rng.randrange(0, most))) for _ in range(n)]


# --- periodic runs


def periodic_rows():
    rng = random.Random(3)
    rows = [None, "", " \n\t", "one", "x " * 23, "x " * 24, "x " * 5000, "a b " * 11 + "a", "a b " * 12, "é ü " * 40]
    for q in (2, 3, 7, 8, 9, 16, 17, 31, 64, 100):
        unit = [f"w{rng.randrange(6)}" for _ in range(q)]
        body = (unit * 9)[: rng.choice((3 * q, 3 * q - 1, 3 * q + 1, 5 * q + 2))]
        rows.append(" ".join([f"l{k}" for k in range(rng.randrange(5))] + body + ["end"] * rng.randrange(3)))
        rows.append(" ".join(body + ["mid"] + body))
    # Runs that overlap, runs of runs, few different words.
    rows += [" ".join(rng.choices("ab", k=300)) for _ in range(15)]
    rows += ["a a a b " * 30, ("a b " * 20 + "c ") * 4, "a " * 30 + "b " * 30 + "a " * 30, "x\x0by\x0cz\r" * 20]
    rows += [" ".join(rng.choices("abc", k=40)) + " " + "p q r s " * 9 + "p q r x " * 9 for _ in range(5)]
    return rows


def test_runs_like_the_plain_version(spark):
    rows = periodic_rows()
    df = spark.createDataFrame([(i, t, "own", 5) for i, t in enumerate(rows)] * 2, "doc_id long, text string, runs string, period int").repartition(3)
    got = periodic.collapse(df)
    assert got.columns == ["doc_id", "text", "period", "runs", "collapsed"]
    seen = got.collect()
    assert len(seen) == 2 * len(rows)
    for r in seen:
        want, kept = plain.runs(plain.words(r.text))
        assert [tuple(x) for x in r.runs] == want, r.doc_id
        assert r.collapsed == " ".join(kept)


def test_runs_with_other_bounds(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randrange(80)))) for i in range(60)]
    for least, times in ((4, 3), (1, 3), (9, 4)):
        for r in periodic.collapse(spark.createDataFrame(rows, "i long, text string"), least=least, times=times).collect():
            want, kept = plain.runs(plain.words(r.text), least, times)
            assert [tuple(x) for x in r.runs] == want and r.collapsed == " ".join(kept)
    with pytest.raises(ValueError):
        periodic.collapse(spark.createDataFrame(rows, "i long, text string"), times=2)


def test_long_text_without_rare_words_is_scanned_whole(spark):
    """No word is rare and the text is far longer than a batch: 300,000 words, a run at the very end."""
    rng = random.Random(6)
    noise = rng.choices([f"w{k}" for k in range(50)], k=300_000)
    unit = rng.choices([f"w{k}" for k in range(50)], k=1000)
    text = " ".join(noise + ["mark"] + unit * 3)
    got = periodic.collapse(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in got.runs] == [(300_001, 3000, 1000)]
    assert got.collapsed == " ".join(noise + ["mark"] + unit)


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    """Numbers don't rest on the hash: with all hashes alike they are still those of the words."""
    import numpy as np
    import pyarrow as pa

    whole = periodic.word_hashes

    def alike(column):
        hashes, *rest = whole(column)
        return np.zeros_like(hashes), *rest

    text = pa.array(["aa b aa ccc b", "b longer-than-eight-bytes longer-than-eight-bytex"])
    monkeypatch.setattr(periodic, "word_hashes", alike)
    number = periodic.word_numbers(text)[0].tolist()
    assert [number.index(x) for x in number] == [0, 1, 0, 3, 1, 1, 6, 7]


def test_no_rows(spark):
    assert periodic.collapse(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_planting(spark):
    """The query's planting, word by word."""
    import zlib

    rows = [(i, " ".join(f"w{k}" for k in range(n))) for i, n in enumerate([0, 1, 2, 3, 5, 30, 77] * 40)] + [(None, "a b"), (54, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("p", queries_corpus.planted(F.col("text"), queries_corpus.checksum()))
    hits = 0
    for r in df.collect():
        w = plain.words(r.text)
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, hits = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)], hits + 1
        assert plain.words(r.p) == w
    assert hits > 10


# --- mixing


def mix_rows():
    rng = random.Random(8)
    rows = []
    for k in range(1500):
        # A third of all rows are of one source; some sources are tiny, one has no words, one is null.
        source = rng.choice(["hot"] * 6 + ["a", "b", "cé", "d", "e", "f", "g", "h", "tiny" if rng.random() < 0.05 else "z", None, "Z", "i"])
        rows.append((k, "w " * rng.choice((0, 1, 7, 30, 60, 200)), source))
    return rows + [(9000, None, "none"), (9001, "", "none"), (None, "w " * 20, "a"), (None, "w " * 20, "a")]


def check_mix(rows, got, weights_by_place, cap=3, share=1.0):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(plain.words(t))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, plain.targets([sizes[s] for s in names], [weights_by_place(k) for k in range(len(names))], cap, share)))
    source_of = {i: s for i, _, s in rows}
    taken, biggest = defaultdict(int), defaultdict(int)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size) for r in got) == sorted((i is not None, i or 0, len(plain.words(t))) for i, t, _ in rows)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-12)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= cap
        c = r.target / r.source_size if r.source_size else 0
        if r.size:
            assert int(c) <= r.copies <= int(c) + 1
        taken[s] += r.taken
        biggest[s] = max(biggest[s], r.size)
    for s in names:
        assert abs(taken[s] - want[s]) < max(1, biggest[s] / 2 + 1), s
    return taken, want


def test_mix_meets_targets(spark):
    rows = mix_rows()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, source string, size int, at string, copies int")
    got = mixing.copies(df.repartition(5), 1 + F.pmod("place", F.lit(3))).collect()
    taken, want = check_mix(rows, got, lambda k: 1 + k % 3)
    assert abs(sum(taken.values()) - sum(want.values())) < 200
    again = mixing.copies(df.repartition(2).orderBy("text"), 1 + F.pmod("place", F.lit(3))).collect()
    assert plain.order(map(tuple, again)) == plain.order(map(tuple, got))
    other = mixing.copies(df, 1 + F.pmod("place", F.lit(3)), seed="other").collect()
    assert plain.order(map(tuple, other)) != plain.order(map(tuple, got))


def test_mix_in_narrow_ranges(spark, monkeypatch):
    """Ranges that are split again and again give the same rows."""
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = [tuple(r) for r in mixing.copies(df, F.lit(1.0)).collect()]
    monkeypatch.setattr(mixing, "FINE", 3)
    monkeypatch.setattr(mixing, "STEP", 2)
    assert plain.order(map(tuple, mixing.copies(df, F.lit(1.0)).collect())) == plain.order(one)


def test_mix_by_document_weight(spark):
    """Unequal chances: over many seeds, documents are taken as often as their weight says."""
    rows = [(k, "w " * 10, "s", float(1 + k % 4)) for k in range(200)] + [(900, "w " * 10, "s", None), (901, "w " * 10, "s", -1.0), (902, "w " * 10, "s", 500.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, q double").cache()
    sums = defaultdict(int)
    for seed in range(6):
        got = mixing.copies(df, F.lit(1.0), weight="q", share=0.5, seed=str(seed)).collect()
        assert sum(r.taken for r in got) == 1010 or abs(sum(r.taken for r in got) - 1015) <= 10
        for r in got:
            sums[rows[r.doc_id][3] if r.doc_id < 900 else r.doc_id] += r.copies
            assert r.copies <= 3
    assert sums[900] == sums[901] == 0 and sums[902] == 18
    # The held document has 3 copies; 98.5 are left for weights that sum up to 500.
    for w in (1.0, 2.0, 3.0, 4.0):
        assert sums[w] / (6 * 50) == pytest.approx(w * 98.5 / 500, abs=0.08)
    df.unpersist()


def test_mix_ends(spark):
    assert mixing.copies(spark.createDataFrame([], "doc_id long, text string, source string"), F.lit(1.0)).count() == 0
    only = mixing.copies(spark.createDataFrame([(1, None, None), (2, " ", None)], "doc_id long, text string, source string"), F.lit(1.0)).collect()
    assert [(r.size, r.target, r.taken) for r in only] == [(0, 0.0, 0)] * 2
    # A source can't be asked for more than its limit.
    all_ = mixing.copies(spark.createDataFrame([(1, "a b", "x"), (2, "a", "y")], "doc_id long, text string, source string"), F.lit(1.0), share=9.0).collect()
    assert sorted((r.doc_id, r.target, r.copies) for r in all_) == [(1, 6.0, 3), (2, 3.0, 3)]
    twice = mixing.repeated(spark.createDataFrame([(1, 0), (2, 2)], "i long, copies long"))
    assert sorted(r.i for r in twice.collect()) == [2, 2]


# --- manifest


def leaf_rows(sizes, rng):
    rows = []
    for source, n in sizes:
        for k in range(n):
            leaf = plain.sha(f"{source}{k}")
            rows.append((source, rng.randrange(10**6), leaf, plain.sha("new", leaf) if rng.random() < 0.3 else leaf))
    return rows


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest(spark, height):
    rng = random.Random(height)
    rows = leaf_rows([("hot", 95), (None, 4), ("", 1), ("b", 28), ("B", 27), ("é", 3), ("z", 10)] + [(f"s{k}", 1) for k in range(9)], rng)
    rows += [("b", None, plain.sha("n"), plain.sha("n")), ("b", 7, plain.sha("m"), plain.sha("m")), ("b", 7, plain.sha("m"), plain.sha("m")), ("b", 7, plain.sha("k"), plain.sha("m"))]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "source string, doc_id long, leaf string, now string, idx int, value string, root string")
    got = merkle.manifest(df.repartition(6), replaced="now", height=height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "siblings", "folded_root", "verified"]
    assert plain.order(map(tuple, got.collect())) == plain.order(plain.manifest(rows))
    whole = merkle.manifest(df, height=height).collect()
    assert all(r.verified and r.folded_root == r.root for r in whole)


def test_manifest_ends(spark):
    schema = "source string, doc_id long, leaf string"
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(None, 5, plain.sha("x"))], schema)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.siblings == "" and one.verified
    text_ids = merkle.manifest(spark.createDataFrame([("s", "b", plain.sha("x")), ("s", "a", plain.sha("y"))], "source string, doc_id string, leaf string"))
    assert text_ids.first().root == plain.sha(plain.sha("y"), plain.sha("x"))


def test_leaf(spark):
    df = spark.createDataFrame([(5, "s", None, 3, "é\n-"), (None, None, None, None, None), (1, "", "x", 0, "y" * 300_000)], "doc_id long, source string, lang string, n_chars long, text string")
    got = [r[0] for r in df.select(merkle.leaf(*[F.col(c) for c in df.columns])).collect()]
    want = ["1:51:s-1:34:é\n-", "-----", "1:10:1:x1:0300000:" + "y" * 300_000]
    assert got == [hashlib.sha256(w.encode()).hexdigest() for w in want]


def test_parent_resumes_states():
    children = [plain.sha(str(k)) for k in range(3)]
    for n in (1, 2, 3):
        parent = merkle.Parent(children[:n])
        assert parent.digest == plain.sha(*children[:n])
        for slot in range(n):
            changed = [*children[:n]]
            changed[slot] = plain.sha("other")
            assert parent.folded(slot, changed[slot]) == plain.sha(*changed)
        assert parent.digest == parent.folded(0, children[0])
