import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import planning as Q
from quire.operators import retrieval as G

FLAGS = ("section_a", "section_b")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    chunks, questions = [], []
    for i in range(400):
        subject = "hot" if i % 3 else "cold"
        # Duplicated vectors make ties that must be broken by chunk id.
        vec = rng.normal(size=4).round(1) if i % 5 else np.ones(4)
        chunks.append((f"c{i:03d}", subject, [float(x) for x in vec], i % 2 == 0, i % 7 == 0))
    for i in range(40):
        names = [[], ["section_a"], ["section_a", "section_b"], ["section_none"]][i % 4]
        questions.append((f"q{i:02d}", "hot" if i % 4 else "cold", [float(x) for x in rng.normal(size=4)], 3 + i % 4, names))
    c = spark.createDataFrame(chunks, "chunk_id string, subject string, embedding array<float>, section_a boolean, section_b boolean")
    q = spark.createDataFrame(questions, "qid string, subject string, qvec array<float>, top_k int, names array<string>")
    return c, q, chunks, questions


def brute(chunks, questions):
    out = {}
    for qid, subject, vec, k, names in questions:
        v = np.float32(vec).astype(float)
        pool = []
        for cid, s, e, a, b in chunks:
            have = {n for n, on in (("section_a", a), ("section_b", b)) if on}
            if s == subject and (not names or have & set(names)):
                pool.append((round(float(((np.float32(e).astype(float) - v) ** 2).sum()), 9), cid))
        out[qid] = [cid for _, cid in sorted(pool)[:k]]
    return out


@pytest.mark.parametrize("qb, cb", [(2048, 1 << 17), (7, 13), (3, 100)])
def test_blocks_do_not_change_the_result(data, qb, cb):
    c, q, chunks, questions = data
    hits = G.knn_topk(q, c, "top_k", "names", FLAGS, query_block=qb, chunk_block=cb).collect()
    got = {}
    for r in sorted(hits, key=lambda r: (r.qid, r.rank)):
        got.setdefault(r.qid, []).append(r.chunk_id)
    want = {k: v for k, v in brute(chunks, questions).items() if v}
    assert got == want


def test_results_stay_in_their_subject(data):
    c, q, _, _ = data
    hits = G.knn_topk(q, c, 4).join(q.select("qid", "subject"), "qid").join(c.select("chunk_id", F.col("subject").alias("s2")), "chunk_id")
    assert hits.filter("subject <> s2").count() == 0


def test_boost_orders_matches_first(spark):
    hits = spark.createDataFrame(
        [("q", "far", 1.0, 1, 2, ["section_a"]), ("q", "near", 0.9, 0, 1, ["section_a"])],
        "qid string, chunk_id string, distance double, flags_mask bigint, rank int, target_sections array<string>",
    )
    out = G.metadata_boost(hits, FLAGS).orderBy("boost_rank").collect()
    assert [r.chunk_id for r in out] == ["far", "near"] and round(out[0].boosted, 2) == 0.67
    with pytest.raises(ValueError):
        G.metadata_boost(hits, FLAGS, 0.0)


def test_heuristic_rerank(spark):
    hits = spark.createDataFrame(
        [("q", "c1", 0, 1, "nothing here", "malaria vector control"), ("q", "c2", 0, 2, "malaria and vectors", "malaria vector control")],
        "qid string, chunk_id string, flags_mask bigint, rank int, text string, question_text string",
    )
    out = G.heuristic_rerank(hits, FLAGS, "rank", required=None).orderBy("rerank").collect()
    assert [(r.chunk_id, r.keyword_matches) for r in out] == [("c2", 2), ("c1", 0)]
    assert G.heuristic_rerank(hits, FLAGS, "rank", None, top_n=0).count() == 0
    assert G.identity_rerank(hits, top_n=0).count() == 2


def questions(spark, *rows):
    return spark.createDataFrame(rows, "qid string, subject string, type string, marks int, question_text string")


def test_plan_words_add_up(spark):
    df = questions(
        spark,
        ("a", "s", "theory", 5, "Discuss the management, etiology, diagnosis and prevention"),
        ("b", "s", "theory", 10, "Nothing special"),
        ("c", "s", "mcq", None, "Pick one"),
    )
    out = {r.qid: r for r in Q.plan_answer(df).collect()}
    assert [s["name"] for s in out["a"].sections] == ["introduction", "etiology", "diagnosis", "management", "conclusion"]
    assert sum(s["words"] for s in out["a"].sections) == 475
    assert sum(s["words"] for s in out["b"].sections) == 775 and len(out["b"].sections) == 2
    assert [s["name"] for s in out["c"].sections] == ["answer"] and out["c"].target_words == 0


def test_strategy(spark):
    df = questions(spark, ("a", "s", "theory", 5, "management"), ("b", "s", "theory", 10, "management etiology diagnosis"))
    plan = {r.qid: (r.top_k, r.filter_names) for r in Q.retrieval_plan(Q.analyze_questions(df)).collect()}
    assert plan == {"a": (5, ["section_management"]), "b": (8, [])}
    with pytest.raises(ValueError):
        Q.retrieval_plan(df, "other")


def test_vectors_of_a_block_are_widened_in_slices():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    def vectors(n):
        return pa.ListArray.from_arrays(pa.array(np.arange(0, 256 * n + 1, 256, dtype=np.int32)), pa.array(np.zeros(256 * n, np.float32)))

    n = 1 << 16
    q = pa.table({"qid": ["q"], "qvec": vectors(1), "top_k": pa.array([2], pa.int64()), "want_mask": pa.array([0], pa.int64())})
    # All chunks but one carry the same vector: ids decide.
    c = pa.table({"chunk_id": [f"c{i:05d}" for i in range(n)], "embedding": vectors(n), "flags_mask": pa.array(np.zeros(n, np.int64))})
    tracemalloc.start()
    got = G._block_topk(q, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["chunk_id"].to_pylist() == ["c00000", "c00001"] and peak < 100 << 20


def test_equal_vectors_are_compared_in_slices():
    import tracemalloc

    import pyarrow as pa

    def vectors(a):
        return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.astype(np.float32).ravel()))

    rng = np.random.default_rng(5)
    n, m = 1 << 13, 300
    points, ids = np.zeros((n, 64)), rng.permutation(n)
    points[::4096] = 2.0
    asked, k = rng.normal(size=(m, 64)), rng.integers(1, 6, m)
    want, have = rng.integers(0, 2, m), rng.integers(0, 2, n)
    q = pa.table({"qid": [f"q{i:03d}" for i in range(m)], "qvec": vectors(asked), "top_k": pa.array(k), "want_mask": pa.array(want)})
    c = pa.table({"chunk_id": [f"c{i:05d}" for i in ids], "embedding": vectors(points), "flags_mask": pa.array(have)})
    tracemalloc.start()
    got = G._block_topk(q, c).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    hits = {}
    for qid, cid in zip(got["qid"], got["chunk_id"]):
        hits.setdefault(qid, []).append(int(cid[1:]))
    shut = {w: set(ids[(have & w) == 0]) if w else set() for w in (0, 1)}
    middle, corner = set(ids) - set(ids[::4096]), set(ids[::4096])
    for i, v in enumerate(np.float32(asked).astype(float)):
        near, far = (middle, corner) if (v**2).sum() < ((v - 2.0) ** 2).sum() else (corner, middle)
        pool = sorted(near - shut[want[i]]) + sorted(far - shut[want[i]])
        assert hits[f"q{i:03d}"] == pool[: k[i]]
    assert peak < 64 << 20
