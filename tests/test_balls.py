"""Nearest neighbours by the ball index next to all distances."""

import numpy as np
import pytest

from quire.operators import balls as B
from quire.operators import retrieval as G

FLAGS = ("section_a", "section_b")


def tables(spark, clustered, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 6)) * 40
    chunks, questions = [], []
    for i in range(1500):
        vec = centres[i % 12] + rng.normal(size=6) if clustered else rng.normal(size=6)
        if i % 3 == 0 and not clustered:
            vec = np.ones(6)  # a third of all chunks is the same vector
        vec = None if i == 7 else [float(x) for x in vec]
        chunks.append((f"c{i:04d}", "hot" if i % 4 else "cold", vec, i % 50 == 0, i % 2 == 0))
    chunks.append(("only", "lone", [0.0] * 6, False, False))
    for i in range(60):
        vec = centres[i % 12] + rng.normal(size=6) if clustered else rng.normal(size=6)
        names = [[], ["section_a"], ["section_a", "section_b"], ["section_none"]][i % 4]
        questions.append((f"q{i:02d}", ("hot", "hot", "cold", "lone", "missing")[i % 5], None if i == 9 else [float(x) for x in vec], i % 7, names))
    c = spark.createDataFrame(chunks, "chunk_id string, subject string, embedding array<float>, section_a boolean, section_b boolean")
    q = spark.createDataFrame(questions, "qid string, subject string, qvec array<float>, top_k int, names array<string>")
    return c, q


def rows(df):
    return sorted((r.qid, r["rank"], r.chunk_id, round(r.distance, 6), r.flags_mask) for r in df.collect())


@pytest.mark.parametrize("clustered", [True, False])
def test_index_gives_the_same_hits(spark, clustered):
    c, q = tables(spark, clustered)
    want = rows(G.knn_topk(q, c, "top_k", "names", FLAGS))
    # Small blocks: balls of several parts, several blocks of questions.
    for per_ball, block, ask in ((50, 1 << 17, 2048), (200, 23, 5)):
        index = B.ball_index(c, FLAGS, per_ball, block)
        assert rows(B.ball_topk(q, index, "top_k", "names", ask)) == want
    assert rows(B.ball_topk(q, B.ball_index(c, (), 40), 4)) == rows(G.knn_topk(q, c, 4))


def test_few_balls_are_read_of_clustered_vectors(spark):
    c, q = tables(spark, True)
    read = {r.subject: r.read / r.chunks for r in B.rows_read(q, B.ball_index(c, FLAGS, 20), 5).collect()}
    # hot has twelve clusters, cold three: hardly more than the own cluster is read.
    assert read["hot"] < 0.2 and read["cold"] < 0.45


def test_no_rows(spark):
    c, q = tables(spark, True)
    assert B.ball_topk(q.limit(0), B.ball_index(c, FLAGS), 3).count() == 0
    assert B.ball_topk(q, B.ball_index(c.limit(0), FLAGS), 3).count() == 0


def test_retrieve_by_index(spark):
    c, q = tables(spark, True)
    c = c.selectExpr("*", "chunk_id as text")
    planned = q.selectExpr("*", "names as filter_names", "names as target_sections", "'x' as question_text")
    index = B.ball_index(c, FLAGS, 100)
    got = G.retrieve(planned, c, FLAGS, "heuristic", 3, nearest=lambda p: B.ball_topk(p, index, "top_k", "filter_names"))
    want = G.retrieve(planned, c, FLAGS, "heuristic", 3)
    key = lambda df: sorted((r.qid, r.chunk_id, r.final_rank) for r in df.collect())
    assert key(got) == key(want)


def test_no_question_is_sent_to_each_ball(spark):
    from quire.session import cut_lineage

    c, q = tables(spark, False)
    kept = []
    keep = lambda df: (kept.append(df.count()), cut_lineage(df))[1]
    index = B.ball_index(c, FLAGS, 10)
    B.ball_topk(q, index, 3, materialize=keep).count()
    # One block of questions a subject; nearly every question reaches nearly every ball.
    assert max(kept) <= max(index.balls.count(), 3 * q.count())
