"""Language identification, quality and nearest neighbours."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from quire.llm import knn, language, quality
from quire.llm import queries as llm

WORDS = {"en": "the of and that which from with this".split(), "fr": "le de et que dans pour avec é".split(), "de": "der die und das nicht mit für ü".split()}


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(WORDS[name], k=30)), name) for k, name in enumerate(list(WORDS) * 40)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 ...", "fr"), (1003, "的", None), (None, "the of and", "en"), (rows[0][0], rows[0][1], rows[0][2])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_language(spark, texts):
    got = {r.doc_id: r for r in language.report(texts).collect()}
    assert len(got) == 125
    for k in range(120):
        assert got[k].lang_pred == list(WORDS)[k % 3] and 0.9 < got[k].score <= 1
    for k in (1000, 1001, 1002):
        assert got[k].lang_pred == "und" and got[k].score == 0
    assert got[1003].lang_pred in WORDS and got[None].held_out is False
    import zlib

    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items() if k is not None)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_every_language_of_the_sample_counts(spark):
    """Languages after the 64th and those of few rows are predicted too, with all their n-grams."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:02}": ["".join(rng.choices(letters, k=6)) for _ in range(12)] for k in range(80)}
    rows = [(name, " ".join(rng.choices(words, k=20))) for k, (name, words) in enumerate(own.items()) for _ in range(2 if k > 70 else 6)]
    df = spark.createDataFrame([(k, t, name) for k, (name, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.train(df)
    assert model.labels == list(own)
    counted = {r["label"]: r["count"] for r in language.count_grams(df, "text", "lang").groupBy("label").count().collect()}
    assert {name: len(model.tables[k][3][0]) for k, name in enumerate(own)} == counted
    assert all(r.lang_pred == r.lang for r in language.predict(df, model).collect())


def test_code_lengths_follow_the_definition():
    """Escapes and exclusions written out for one language."""
    train = ["abab abcab", "ab cab"]
    counts = Counter()
    for text in train:
        s = [0, 0, 0, *[1 + ord(c) - 97 if c != " " else 28 for c in text]]
        counts.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))

    def p(context, symbol):
        if context is None:
            return 1 / language.SYMBOLS
        seen = Counter()
        for g, n in counts.items():
            if g[3 - len(context) : 3] == context:
                seen[g[3]] += n
        shorter = context[1:] if context else None
        if not seen:
            return p(shorter, symbol)
        total, distinct = sum(seen.values()), len(seen)
        if symbol in seen:
            return seen[symbol] / (total + distinct)
        return distinct / (total + distinct) * p(shorter, symbol) / (1 - sum(p(shorter, x) for x in seen))

    grams = np.array([((a * 158 + b) * 158 + c) * 158 + d for a, b, c, d in counts])
    model = language.frozen(["x"], np.zeros(len(grams), np.int64), grams, np.array(list(counts.values())))
    text = "abcz ab"
    s = [0, 0, 0, *[1 + ord(c) - 97 if c != " " else 28 for c in text]]
    want = sum(-math.log2(p(tuple(s[i : i + 3]), s[i + 3])) for i in range(len(text)))
    assert abs(model.code_lengths(pa.array([text]))[0, 0] / language.UNIT - want) < 0.05


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.report(df).first().lang_pred == "und"
    assert language.report(df.limit(0)).count() == 0


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney over classes, written out."""
    grams = Counter()
    for t in texts:
        s = [0, 0, 0, *quality._SYMBOL[np.frombuffer(t.encode(), np.uint8)].tolist()]
        grams.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    tables = {4: grams}
    for order in (3, 2, 1):
        tables[order] = Counter(g[1:] for g in tables[order + 1])
    cuts = {}
    for order, table in tables.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else 0.5 for k in (1, 2, 3)]
        cuts[order] = [max(0.05, min(k - 0.05, x)) for k, x in enumerate(d, 1)]
    contexts = defaultdict(list)
    for order, table in tables.items():
        for g, c in table.items():
            contexts[order, g[:-1]].append(c)

    def p(gram, order):
        if order == 0:
            return 1 / quality.SYMBOLS
        gram, d = gram[-order:], cuts[order]
        followed = contexts.get((order, gram[:-1]))
        if not followed:
            return p(gram, order - 1)
        total, c = sum(followed), tables[order].get(gram, 0)
        back = sum(d[min(x, 3) - 1] for x in followed) / total
        return max(c - (d[min(c, 3) - 1] if c else 0), 0) / total + back * p(gram, order - 1)

    return p


@pytest.mark.parametrize("shard", [1_500_000, 60])
def test_quality(spark, monkeypatch, shard):
    """Perplexities equal the written-out model's, with one shard or many."""
    monkeypatch.setattr(quality, "SHARD", shard)
    rng = random.Random(4)
    good = [" ".join(rng.choices(WORDS["en"], k=20)) for _ in range(30)]
    rows = [(k, t, "en") for k, t in enumerate(good)] + [(100, "ZZ!! QX## ZZ!!", "en"), (101, None, "en"), (102, "", "en"), (103, "le de", "fr"), (104, "the of", None), (0, good[0], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(25)] + [(25, 1, 1), (26, 0, 0), (27, None, None), (24, 0, 0)], "doc_id long, quality int, toxic int")
    got = defaultdict(list)
    for r in quality.classify(docs, labels).collect():
        got[r.doc_id].append(r)
    p = kneser_ney([*good[:24], good[0]])
    for k, text, name in rows:
        if name == "en" and text:
            s = [0, 0, 0, *quality._SYMBOL[np.frombuffer(text.encode(), np.uint8)].tolist()]
            bits = sum(-math.log2(p(tuple(s[i : i + 4]), 4)) for i in range(len(s) - 3)) / (len(s) - 3)
            assert abs(math.log2(got[k][0].perplexity) - bits) < 0.002
    # The threshold: the 24th of 25 values, each by a model of the other folds' trusted texts.
    trusted = [(k, good[k]) for k in range(24)] + [(0, good[0])]
    fold = lambda k: zlib.crc32(str(k).encode()) % 4
    unseen = [kneser_ney([t for k, t in trusted if fold(k) != f]) for f in range(4)]
    bits = []
    for k, text in trusted:
        s = [0, 0, 0, *quality._SYMBOL[np.frombuffer(text.encode(), np.uint8)].tolist()]
        bits.append(sum(-math.log2(unseen[fold(k)](tuple(s[i : i + 4]), 4)) for i in range(len(s) - 3)) / (len(s) - 3))
    assert abs(math.log2(got[3][0].threshold) - sorted(bits)[23] * 1.05) < 0.003
    assert len(got[0]) == 2 and got[3][0].kept and not got[100][0].kept and not got[101][0].kept and not got[102][0].kept
    assert got[103][0].perplexity is None and got[103][0].kept and got[104][0].kept


def test_quality_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = llm.op4_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    poor = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.97 * len(clean) and sum(poor) <= 0.1 * len(poor)


@pytest.mark.parametrize("n, least", [(3, 0.9), (10, 0.95)])
def test_quality_keeps_clean_documents_of_a_language_with_few_labels(spark, n, least):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' and text is not null")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    clean = docs.join(labels.where("quality = 1 and toxic = 0"), "doc_id", "left_semi")
    some = [r.doc_id for r in clean.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(n).collect()]
    few = labels.where(F.col("doc_id").isin(some))
    rows = quality.classify(docs, few).join(clean.select("doc_id").distinct(), "doc_id").where(~F.col("doc_id").isin(some)).collect()
    assert len(rows) > 100 and sum(r.kept for r in rows) >= least * len(rows)


def test_quality_with_long_text_and_clashing_columns(spark):
    rows = [(k, "some plain words " * 10, "en", 1, "x", 2.0) for k in range(8)] + [(9, "some plain words " * 20_000, "en", 1, "x", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, id int, mark string, bits double")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(8)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 9 and all(r.kept for r in got)


def test_quality_without_rows(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).first().kept
    assert quality.classify(docs.limit(0), labels).count() == 0


def plain_top(rows, k):
    clean = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in clean if i % 100 == 0}):
        own = min(v for i, v in clean if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in clean if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("pivots, block", [(32, 2048), (3, 2)])
def test_top_k(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(knn, "QUERY_BLOCK", block)
    monkeypatch.setattr(knn, "DATA_BLOCK", 200)
    rng = random.Random(1)
    rows = [(k, [rng.gauss(c, 0.2) for c in (k % 3, 1, -1)]) for k in range(900)]
    rows += [(1000 + k, [1.0, 1.0, -1.0]) for k in range(300)]
    rows += [(2000, None), (2100, [1.0, None, 2.0]), (2200, [float("nan")] * 3), (2300, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (2400, []), (2500, [5.0]), (100, [9.0, 9.0, 9.0]), (7, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id int").repartition(4)
    got = sorted(tuple(r) for r in knn.search(df, "vec_id", "embedding", df.vec_id % 100 == 0, n_pivots=pivots).collect())
    assert got == sorted(plain_top(rows, 10))


@pytest.mark.parametrize("copies", [12])
def test_top_k_of_repeated_query_ids(spark, copies):
    """More rows of a query's id than k around it do not hide the others, however far off they are."""
    rng = random.Random(3)
    rows = [(100, [40.0, 0.0, 0.0])] * copies + [(k, [rng.gauss(c, 0.1) for c in (k % 3, -20 * (k % 2), 20)]) for k in range(1, 90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in knn.search(df, "vec_id", "embedding", df.vec_id % 100 == 0, n_pivots=200).collect())
    assert got == sorted(plain_top(rows, 10)) and len(got) == 10


def test_top_k_large_numbers(spark):
    rows = [(0, [1e12, -1e12]), (1, [1e12, 1.0]), (2, [3e12, 2.0]), (3, [-1e300, 0.0])]
    got = [tuple(r) for r in knn.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2).collect()]
    assert [r[2] for r in sorted(got)] == [1, 2]  # both scores are cut to the largest long: the smaller id first


def test_few_and_no_vectors(spark):
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in knn.report(one).collect()] == [(0, 1, 1, 2048 * 1024)]
    assert knn.report(one.limit(0)).count() == 0
    assert knn.report(one.where("vec_id = 0")).count() == 0
