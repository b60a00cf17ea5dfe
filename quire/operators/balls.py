"""A metric index over chunk vectors, and nearest neighbours that read only the balls they need.

The chunks of a subject are dealt to balls: every chunk belongs to the nearest of some centres, and a ball
keeps its radius, how many of its chunks carry each flag, and how many there are.  A question first
goes to its home ball, the nearest one with enough chunks that its filter accepts; the k-th distance found
there is an upper bound.  By the triangle inequality a ball can only hold a nearer chunk if the distance to its
centre less its radius is not above that bound; only those balls are read in the second phase.

The number of centres grows with the subject (one for about ``rows_per_ball`` chunks), a ball of very
many chunks (repeated vectors) is cut into parts, and what is compared at once is a shelf of balls with a block of
questions near each other.  A ball is sent to the blocks that reach it, a question to the shelves of its subject, so what
is moved grows with rows times blocks, not with questions times balls.  Results are exact whatever the data.  With vectors that lie equally far from each other nothing is
pruned: every ball is read for every question, which is the work of ``knn_topk`` without an index.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.retrieval import CHUNK_BLOCK, QUERY_BLOCK, _block_topk, _vectors, flag_mask, names_mask, ranked_hits
from quire.session import cut_lineage

ROWS_PER_BALL = 2048
INDEX_QUERY_BLOCK = 8192
HITS = "qid string, chunk_id string, distance double, flags_mask bigint, top_k bigint"


@dataclass(frozen=True)
class BallIndex:
    """``rows``: chunk_id, subject, embedding, flags_mask, ball, part; ``balls``: one row per ball."""

    rows: DataFrame
    balls: DataFrame
    flags: tuple[str, ...]


def _fresh(df: DataFrame, *columns: str) -> DataFrame:
    """Some columns under new identities, so that a table can meet another one that it was made from."""
    return df.select(*[F.col(c).alias(c) for c in columns])


def _nearest_centre(chunks: pa.Table, centres: pa.Table) -> pa.Table:
    """Ball and distance of every chunk of a block; ties go to the smaller ball."""
    out = chunks.select(["chunk_id", "subject", "embedding", "flags_mask"])
    order = np.argsort(centres["ball"].to_numpy(), kind="stable")
    names, middle = centres["ball"].to_numpy()[order], _vectors(centres["centre"])[order]
    vectors = _vectors(chunks["embedding"])
    ball, far = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    norms = np.einsum("ij,ij->i", middle, middle)
    for lo in range(0, len(vectors), 4096):
        some = vectors[lo : lo + 4096]
        at = np.argmin(norms[None, :] - 2.0 * (some @ middle.T), axis=1)
        ball[lo : lo + 4096] = names[at]
        far[lo : lo + 4096] = np.sqrt(((some - middle[at]) ** 2).sum(1))
    return out.append_column("ball", pa.array(ball)).append_column("far", pa.array(far))


def ball_index(
    chunks: DataFrame,
    flags: Sequence[str] = (),
    rows_per_ball: int = ROWS_PER_BALL,
    chunk_block: int = CHUNK_BLOCK,
    materialize: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> BallIndex:
    """Index of all chunks with a vector.

    Centres are chunks chosen by a hash of their id; each subject has one at least.  Every centre meets
    every block of its subject's chunks once; no chunk is sent twice.
    """
    kind = chunks.schema["embedding"].dataType.simpleString()
    c = chunks.filter(F.col("embedding").isNotNull()).select("chunk_id", "subject", "embedding", flag_mask(flags).alias("flags_mask"))
    mark = F.xxhash64("chunk_id")
    sizes = c.groupBy("subject").agg(
        F.ceil(F.count(F.lit(1)) / chunk_block).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.count(F.lit(1)) / rows_per_ball).alias("wanted"),
        F.count(F.lit(1)).alias("n"),
        F.min(mark).alias("first"),
    )
    chosen = (F.col("first") == mark) | (F.pmod(mark, F.lit(1 << 30)) < F.col("wanted") / F.col("n") * F.lit(float(1 << 30)))
    centres = c.join(sizes, "subject").filter(chosen).select("subject", mark.alias("ball"), F.col("embedding").alias("centre"), "blocks")
    centres = centres.dropDuplicates(["subject", "ball"])
    centres = materialize(centres)
    copied = centres.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    copied = _fresh(copied, "subject", "ball", "centre", "block")
    dealt = c.join(sizes.select("subject", "blocks"), "subject").withColumn("block", F.pmod(F.xxhash64("chunk_id", F.lit(1)), "blocks").cast("int"))
    out = f"chunk_id string, subject string, embedding {kind}, flags_mask bigint, ball bigint, far double"
    rows = dealt.drop("blocks").groupBy("subject", "block").cogroup(copied.groupBy("subject", "block")).applyInArrow(_nearest_centre, out)
    rows = materialize(rows)
    counts = [F.count_if(F.col("flags_mask").bitwiseAND(F.lit(1 << i)) != 0) for i in range(len(flags))]
    balls = rows.groupBy("subject", "ball").agg(
        F.max("far").alias("radius"), F.array(F.count(F.lit(1)), *counts).alias("counts"), F.ceil(F.count(F.lit(1)) / chunk_block).cast("int").alias("parts")
    )
    balls = materialize(balls.join(centres.select("subject", "ball", "centre"), ["subject", "ball"]))
    parted = rows.join(balls.select("subject", "ball", "parts"), ["subject", "ball"])
    parted = parted.withColumn("part", F.pmod(F.xxhash64("chunk_id", F.lit(2)), "parts").cast("int")).drop("far", "parts")
    return BallIndex(parted, balls, tuple(flags))


def _to_centres(questions: pa.Table, balls: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all questions of a block to all centres, and how many chunks each filter accepts at least."""
    q, c = _vectors(questions["qvec"]), _vectors(balls["centre"])
    d = np.sqrt(np.maximum(0.0, (q**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2.0 * (q @ c.T)))
    counts = _vectors(balls["counts"])
    want = questions["want_mask"].to_numpy()
    sure = np.zeros_like(d)
    for i in range(counts.shape[1]):
        asked = want == 0 if i == 0 else (want >> (i - 1)) & 1 == 1
        sure[asked] = np.maximum(sure[asked], counts[:, i][None, :])
    return d, sure


def _home(questions: pa.Table, balls: pa.Table) -> pa.Table:
    """(qid, ball): the nearest ball with top_k chunks that the filter accepts, else the one with most of them."""
    schema = pa.schema([("qid", pa.string()), ("ball", pa.int64())])
    if not questions.num_rows or not balls.num_rows:
        return schema.empty_table()
    d, sure = _to_centres(questions, balls)
    k = questions["top_k"].to_numpy()[:, None]
    best = np.lexsort((d, -np.minimum(sure, k)), axis=1)[:, 0]
    some = sure[np.arange(len(best)), best] > 0
    return pa.table([questions["qid"].combine_chunks().filter(pa.array(some)), pa.array(balls["ball"].to_numpy()[best[some]])], schema=schema)


def _home_and_side(questions: pa.Table, balls: pa.Table) -> pa.Table:
    """(qid, ball, side): home, and the nearest of the first few balls, one for each block of the subject's questions."""
    schema = pa.schema([("qid", pa.string()), ("ball", pa.int64()), ("side", pa.int32())])
    home = _home(questions, balls)
    if not home.num_rows:
        return schema.empty_table()
    few = balls.take(pa.array(np.argsort(balls["ball"].to_numpy(), kind="stable")[: questions["__n"][0].as_py()]))
    d, _ = _to_centres(questions, few)
    side = dict(zip(questions["qid"].to_pylist(), d.argmin(1).tolist()))
    return home.append_column("side", pa.array([side[x] for x in home["qid"].to_pylist()], pa.int32())).cast(schema)


def _reachable_balls(questions: pa.Table, balls: pa.Table) -> pa.Table:
    """(subject, side, lot, ball) of the balls that any question of a block may find a chunk in."""
    schema = pa.schema([("subject", pa.string()), ("side", pa.int32()), ("lot", pa.int32()), ("ball", pa.int64())])
    if not questions.num_rows or not balls.num_rows:
        return schema.empty_table()
    hit = np.zeros(balls.num_rows, bool)
    for lo in range(0, questions.num_rows, 1024):
        hit |= _may_hold(questions.slice(lo, 1024), balls).any(0)
    names = balls["ball"].to_numpy()[hit]
    key = [pa.repeat(questions[c][0], len(names)) for c in ("subject", "side", "lot")]
    return pa.table([*key, pa.array(names)], schema=schema)


def _reachable(questions: pa.Table, balls: pa.Table) -> pa.Table:
    """(qid, ball) of all balls but the home that may hold a chunk within the bound."""
    schema = pa.schema([("qid", pa.string()), ("ball", pa.int64())])
    if not questions.num_rows or not balls.num_rows:
        return schema.empty_table()
    row, col = np.nonzero(_may_hold(questions, balls))
    return pa.table([questions["qid"].combine_chunks().take(pa.array(row)), pa.array(balls["ball"].to_numpy()[col])], schema=schema)


def _may_hold(questions: pa.Table, balls: pa.Table) -> np.ndarray:
    """Whether a ball that is not a question's home may hold a chunk within its bound."""
    d, sure = _to_centres(questions, balls)
    bound = questions["bound"].to_numpy(zero_copy_only=False)
    names = balls["ball"].to_numpy()
    slack = 1e-6 * (1.0 + d)
    return (d - balls["radius"].to_numpy()[None, :] - slack <= bound[:, None]) & (sure > 0) & (names[None, :] != questions["home"].to_numpy()[:, None])


def visits(questions: DataFrame, index: BallIndex, query_block: int, test: Callable, extra: Sequence[str] = (), out: str = "qid string, ball bigint") -> DataFrame:
    """Rows (qid, ball) that ``test`` finds for blocks of questions and the balls of their subject."""
    blocks = questions.groupBy("subject").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("__n"))
    dealt = questions.join(blocks, "subject").withColumn("__b", F.pmod(F.xxhash64("qid"), "__n").cast("int"))
    copied = index.balls.join(blocks, "subject").withColumn("__b", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    left = dealt.select("subject", "__b", "qid", "qvec", "top_k", "want_mask", *extra).groupBy("subject", "__b")
    return left.cogroup(_fresh(copied, "subject", "__b", "ball", "centre", "radius", "counts").groupBy("subject", "__b")).applyInArrow(test, out)


def _compared(questions: DataFrame, pairs: DataFrame, index: BallIndex, query_block: int) -> DataFrame:
    """Best hits of each question in each ball it visits; balls that nobody visits are not read."""
    visited = pairs.join(questions, "qid")
    balls = visited.groupBy("subject", "ball").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("blocks"))
    balls = balls.join(index.balls.select("subject", "ball", "parts"), ["subject", "ball"])
    q = visited.join(balls, ["subject", "ball"]).withColumn("block", F.pmod(F.xxhash64("qid"), "blocks").cast("int"))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    c = index.rows.join(balls.select("subject", "ball", "blocks"), ["subject", "ball"])
    c = c.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["subject", "ball", "part", "block"]
    left = q.select(*keys, "qid", "qvec", "top_k", "want_mask").groupBy(*keys)
    return left.cogroup(_fresh(c, *keys, "chunk_id", "embedding", "flags_mask").groupBy(*keys)).applyInArrow(_block_topk, HITS)


def _within_bounds(bounded: DataFrame, index: BallIndex, query_block: int, chunk_block: int, materialize: Callable) -> DataFrame:
    """Hits of each question outside its home, within its bound.

    Questions of one side of the subject make blocks.  What is sent is a ball to each block that reaches it, and a
    question to each shelf of balls of its subject: never a question to each ball.
    """
    lots = bounded.groupBy("subject", "side").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("lots"))
    placed = bounded.join(lots, ["subject", "side"]).withColumn("lot", F.pmod(F.xxhash64("qid"), "lots").cast("int")).drop("lots")
    placed = materialize(placed)
    block = ["subject", "side", "lot"]
    copied = index.balls.join(placed.select(*block).distinct(), "subject")
    copied = _fresh(copied, *block, "ball", "centre", "radius", "counts")
    reached = placed.groupBy(*block).cogroup(copied.groupBy(*block)).applyInArrow(_reachable_balls, "subject string, side int, lot int, ball bigint")
    reached = materialize(reached)
    met = reached.select("subject", "ball").distinct().join(index.balls, ["subject", "ball"])
    shelves = met.groupBy("subject").agg(F.ceil(F.sum(F.col("counts")[0]) / chunk_block).cast("int").alias("shelves"))
    c = index.rows.join(shelves, "subject").withColumn("shelf", F.pmod(F.xxhash64("ball", "part"), "shelves").cast("int")).drop("shelves")
    c = c.join(reached, ["subject", "ball"])
    q = placed.join(shelves, "subject").withColumn("shelf", F.explode(F.sequence(F.lit(0), F.col("shelves") - 1)))
    keys = [*block, "shelf"]
    left = q.select(*keys, "qid", "qvec", "top_k", "want_mask", "home", "bound").groupBy(*keys)
    return left.cogroup(_fresh(c, *keys, "chunk_id", "embedding", "flags_mask", "ball").groupBy(*keys)).applyInArrow(_block_topk, HITS)


def ball_topk(
    questions: DataFrame,
    index: BallIndex,
    k: int | str = "top_k",
    filter_names: str | None = None,
    query_block: int = INDEX_QUERY_BLOCK,
    materialize: Callable[[DataFrame], DataFrame] = cut_lineage,
    chunk_block: int = CHUNK_BLOCK,
) -> DataFrame:
    """As ``knn_topk``, by the index: ``(qid, chunk_id, distance, flags_mask, rank)``."""
    q, most = asked(questions, k, filter_names, index.flags)
    home = materialize(visits(q, index, query_block, _home_and_side, ["__n"], "qid string, ball bigint, side int"))
    first = materialize(ranked_hits(_compared(q, home.drop("side"), index, query_block), most))
    enough = first.groupBy("qid").agg(F.max("distance").alias("d"), F.count(F.lit(1)).alias("n"), F.first("top_k").alias("k"))
    bounds = home.select("qid", "side", F.col("ball").alias("home")).join(enough, "qid", "left")
    bound = F.when(F.col("n") >= F.col("k"), F.sqrt("d")).otherwise(F.lit(float("inf")))
    bounded = q.join(bounds.select("qid", "side", "home", bound.alias("bound")), "qid")
    rest = _within_bounds(bounded, index, query_block, chunk_block, materialize)
    return ranked_hits(first.drop("rank").unionByName(rest), most).drop("top_k")


def asked(questions: DataFrame, k: int | str, filter_names: str | None, flags: Sequence[str]) -> tuple[DataFrame, int]:
    """Questions with a vector and a positive k as (qid, subject, qvec, top_k, want_mask), and the largest k."""
    top_k = F.lit(k) if isinstance(k, int) else F.col(k)
    want = names_mask(F.col(filter_names), flags) if filter_names else F.lit(0).cast("bigint")
    q = questions.filter(F.col("qvec").isNotNull()).select(
        "qid", "subject", "qvec", top_k.cast("bigint").alias("top_k"), want.alias("want_mask")
    ).filter(F.col("top_k") > 0)
    return q, k if isinstance(k, int) else (q.agg(F.max("top_k")).first()[0] or 0)


def rows_read(questions: DataFrame, index: BallIndex, k: int | str = "top_k", filter_names: str | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Per subject: chunks, and the mean number of chunks that a question is compared with."""
    q, most = asked(questions, k, filter_names, index.flags)
    home = cut_lineage(visits(q, index, query_block, _home))
    first = ranked_hits(_compared(q, home, index, query_block), most)
    enough = first.groupBy("qid").agg(F.max("distance").alias("d"), F.count(F.lit(1)).alias("n"), F.first("top_k").alias("k"))
    bound = F.when(F.col("n") >= F.col("k"), F.sqrt("d")).otherwise(F.lit(float("inf")))
    bounded = q.join(home.withColumnRenamed("ball", "home").join(enough, "qid", "left").select("qid", "home", bound.alias("bound")), "qid")
    pairs = home.unionByName(visits(bounded, index, query_block, _reachable, ["home", "bound"])).join(q.select("qid", "subject"), "qid")
    size = F.col("counts")[0]
    read = pairs.join(index.balls, ["subject", "ball"]).groupBy("subject").agg(F.sum(size).alias("read"), F.countDistinct("qid").alias("questions"))
    return index.balls.groupBy("subject").agg(F.sum(size).alias("chunks")).join(read, "subject").select("subject", "chunks", (F.col("read") / F.col("questions")).alias("read"))
